"""Context packs: sections of an organization's memory in one text of bounded length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .ranking import top_k

# Sections in order with their shares of the budget, and how many rows each has at most.
SECTIONS = {"inbox": 15, "handoff": 20, "guidelines": 35, "profile": 10, "index": 10, "recent": 10}
ROWS = {"inbox": 5, "handoff": 1, "guidelines": 1000, "profile": 1, "index": 12, "recent": 5}
TITLES = {"inbox": "## Inbox\n\n", "handoff": "## Handoff\n\n", "guidelines": "## Guidelines\n\n", "profile": "## Profile\n\n", "index": "## Project pages\n\n", "recent": "## Recent changes\n\n"}
MARK = "\n…[cut]\n\n"


def lines(section: str) -> Column:
    """How a row (title, content, day, domain) is shown."""
    title, content = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("content", F.lit("")))
    shown = {
        "inbox": F.concat(F.lit("- "), title, F.lit(": "), text.collapse(content), F.lit("\n")),
        "handoff": F.concat(content, F.lit("\n\n")),
        "guidelines": F.concat(F.lit("### "), title, F.lit("\n"), content, F.lit("\n\n")),
        "profile": F.concat(content, F.lit("\n\n")),
        "index": F.concat(F.lit("- [["), title, F.lit("]]"), F.when(content != "", F.concat(F.lit(" — "), text.collapse(F.substring(content, 1, 220)))).otherwise(""), F.lit("\n")),
        "recent": F.concat(F.lit("- "), F.col("day"), F.lit(" · "), title, F.when(F.coalesce("domain", F.lit("")) != "", F.concat(F.lit(" ("), "domain", F.lit(")"))).otherwise(""), F.lit("\n")),
    }
    return shown[section]


def pack(sections: dict[str, DataFrame], max_chars: int) -> DataFrame:
    """(organization_id, section, position, body, cut) of the sections given, each (organization_id, title, content, day,
    domain, seq): the latest rows by seq, within the section's share of ``max_chars``; what one leaves isn't given to others.
    The text of a pack is its bodies in order. Empty sections have no row."""
    whole = sum(SECTIONS[s] for s in sections)
    out = []
    for position, name in enumerate(SECTIONS):
        if name not in sections:
            continue
        budget = max_chars * SECTIONS[name] // whole
        latest = top_k(sections[name], ["organization_id"], [F.desc("seq")], ROWS[name], "r").select("organization_id", "r", lines(name).alias("line"))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "")
        full = latest.groupBy("organization_id").agg(F.concat(F.lit(TITLES[name]), body, F.lit("" if name in ("guidelines", "handoff", "profile") else "\n")).alias("body"))
        long = F.char_length("body") > budget
        capped = F.when(long, F.concat(F.regexp_replace(F.substring("body", 1, budget), r"[ \t\n]+$", ""), F.lit(MARK))).otherwise(F.col("body"))
        out.append(full.select("organization_id", F.lit(name).alias("section"), F.lit(position).alias("position"), capped.alias("body"), long.alias("cut")))
    return reduce(DataFrame.unionByName, out)
