"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import re2

MASK = "«REDACTED-SECRET»"
URL_MASK = "[link removed]"

# Credentials, in the order in which they are masked.
SECRETS = [
    r"sk-[A-Za-z0-9_\-]{20,}",
    r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bAIza[0-9A-Za-z_\-]{30,}\b",
    r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{6,}\b",
    r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----",
]
#: What a text must have for each of them to match: a plain search for it comes first.
NEEDS = [["sk-"], ["_live_", "_test_"], ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], ["xox"], ["AKIA"], ["AIza"], ["eyJ"], ["PRIVATE KEY-----"]]
ACCENTED, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"


def normalize(s: Column) -> Column:
    """Lower case, common accents dropped, everything else a single hyphen, none at the ends."""
    plain = F.translate(F.lower(s), ACCENTED, PLAIN)
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(title: Column, salt: Column) -> Column:
    """At most 80 characters of the normalised title, and six hex digits that depend on ``salt`` alone."""
    base = F.regexp_replace(F.substring(normalize(title), 1, 80), "-+$", "")
    return F.concat_ws("-", F.when(base == "", "untitled").otherwise(base), F.substring(F.sha2(salt.cast("string"), 256), 1, 6))


def sanitize_slug(s: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(inner, 1, 64), "^-+|-+$", "")


def content_hash(s: Column) -> Column:
    """SHA-256 of the text in lower case with white space collapsed."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(s, r"\s+", " "))), 256)


def redact(s: Column) -> tuple[Column, Column]:
    """(masked text, how many secrets were masked); each pattern sees what the ones before left. Patterns run only over texts
    that have what they need, so texts without secrets are searched but not matched."""
    each = F.array(*[F.struct(F.lit(re2(p)).alias("p"), F.array(*[F.lit(x) for x in need]).alias("need")) for p, need in zip(SECRETS, NEEDS, strict=True)])

    def step(acc: Column, x: Column) -> Column:
        found = F.struct(F.regexp_replace(acc["t"], x["p"], F.lit(MASK)).alias("t"), (acc["n"] + F.regexp_count(acc["t"], x["p"])).alias("n"))
        return F.when(F.exists(x["need"], lambda m: F.contains(acc["t"], m)), found).otherwise(acc)

    done = F.aggregate(each, F.struct(s.alias("t"), F.lit(0).alias("n")), step)
    return done["t"], done["n"]


# Links, and their hosts without a user and a port.
LINK = r"""https?://[^\s)\]}"'<>]+"""
LINK_HOST = r"^https?://([^/?#]+)"


def host(link: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(link, LINK_HOST, 1)), r"^.*@", ""), r":.*$", "")


def egress_filter(answer: Column, grounding: Column) -> tuple[Column, Column]:
    """(answer without links to hosts that ``grounding`` doesn't name, how many were masked), link by link."""
    links = F.regexp_extract_all(answer, F.lit(LINK), F.lit(0))
    strange = lambda u: (host(u) != "") & ~F.contains(F.lower(grounding), host(u))
    kept = F.transform(links, lambda u: F.when(strange(u), URL_MASK).otherwise(u))
    # between the links stands one piece more than there are links
    pieces = F.transform(F.split(answer, LINK, -1), lambda p, i: F.concat(p, F.coalesce(F.get(kept, i), F.lit(""))))
    return F.array_join(pieces, ""), F.size(F.filter(links, strange))


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


# Marks in a model's text, and the folder of each domain.
FINAL = "(?is)<final>(.*?)</final>"
SCRATCH = "(?is)<scratch>.*?</scratch>"
STRAY = "(?i)</?(final|scratch)>"
THINK, OPEN_THINK = "(?s)<think>.*?</think>", "(?s)<think>.*$"
FOLDERS = {"wiki": "concepts", "guideline": "guidelines", "decision": "decisions", "gotcha": "gotchas"}


def extract_final(s: Column) -> Column:
    """What stands in <final>, else the text without scratch blocks, else without stray tags; never empty if it wasn't."""
    some = lambda c: F.when(trimmed(c) != "", trimmed(c))
    return F.coalesce(
        some(F.regexp_extract(s, FINAL, 1)),
        some(F.regexp_replace(F.regexp_replace(s, SCRATCH, ""), STRAY, "")),
        some(F.regexp_replace(s, STRAY, "")),
        trimmed(s),
    )


def strip_thinking(s: Column) -> Column:
    """Without <think> blocks; an open one takes the rest of the text with it."""
    return trimmed(F.regexp_replace(F.regexp_replace(s, THINK, ""), OPEN_THINK, ""))


def strip_code_fence(s: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(s), r"^```[a-zA-Z]*\s*", ""), r"```\s*$", ""))


def cap(s: Column, n: int, marker: str = "…") -> Column:
    return F.when(F.char_length(s) > n, F.concat(F.substring(s, 1, n), F.lit(marker))).otherwise(s)


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def snippet(s: Column, n: int = 400) -> Column:
    """At most ``n`` characters, cut at the last space if that is past the middle."""
    head = F.substring(s, 1, n)
    whole = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
    return F.when(F.char_length(s) <= n, s).otherwise(F.concat(F.when(F.char_length(whole) > n // 2, whole).otherwise(head), F.lit("…")))


def file_name(title: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.trim(title), r"[/\\:*|]", "-"), r"""[?"<>]""", "")
    return F.when(clean == "", "untitled").otherwise(clean)


def wiki_path(domain: Column, title: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    folder = F.coalesce(F.try_element_at(table, F.lower(domain)), F.lit("memories"))
    return F.concat(folder, F.lit("/"), file_name(title), F.lit(".md"))


def words(s: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
