"""English lexemes: stop words dropped, suffixes taken off by the published Porter2 ("English") rules.

The rules look at regions of a word and apply step by step, which built-in functions can't express, so words go through an
Arrow batch; a worker remembers what it stemmed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.arrow import in_arrow
from .text import words

# The stop words of the English list, and the rules' exceptions and endings.
STOP = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do
does did doing a an the and but if or because as until while of at by for with about against between into through during before
after above below to from up down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
UNTOUCHED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
PREFIXES = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_VOWEL = re.compile("[aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    first = next((len(p) for p in PREFIXES if w.startswith(p)), None)
    if first is None:
        m = _REGION.search(w)
        first = m.end() if m else len(w)
    m = _REGION.search(w, first)
    return first, m.end() if m else len(w)


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")) or not w.endswith("s"):
        return w
    return w[:-1] if _VOWEL.search(w[:-2]) else w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if end in ("eed", "eedly"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    if end is None or not _VOWEL.search(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w[:-1]
    return w + "e" if _SHORT.search(w) and len(w) <= r1 else w


@lru_cache(maxsize=200_000)
def english(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or word in EXCEPTIONS:
        return EXCEPTIONS.get(word, word)
    # a y at the start or after a vowel is a consonant, here Y
    w = re.sub("(?:^|(?<=[aeiou]))y", "Y", word.lstrip("'"))
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        w = w.removesuffix(end)
    w = _plural(w)
    if w in UNTOUCHED:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    end = _longest(w, [*STEP_2, "ogi", "li"])
    if end and len(w) - len(end) >= r1:
        if end in STEP_2:
            w = w[: -len(end)] + STEP_2[end]
        elif end == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif w[-3:-2] and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    end = _longest(w, [*STEP_3, "ative"])
    if end and len(w) - len(end) >= r1:
        if end in STEP_3:
            w = w[: -len(end)] + STEP_3[end]
        elif len(w) - len(end) >= r2:
            w = w[: -len(end)]
    end = _longest(w, [*STEP_4, "ion"])
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _kept(text: Column) -> Column:
    kept = F.filter(words(text), lambda w: ~w.isin(*STOP))
    return F.when(F.size(kept) > 0, kept).otherwise(words(text))


def _stems(lists: pa.Array) -> pa.Array:
    """Of each list of words their stems. Texts stay in Arrow: only a batch's different words become Python's."""
    own = lists.flatten().dictionary_encode()
    found = pa.array([english(w) for w in own.dictionary.to_pylist()], pa.string()).take(own.indices)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), found, mask=lists.is_null())


def stemmed(text: Column) -> Column:
    """The stems of a text's words but stop words; of a text of stop words alone, all."""
    return F.arrow_udf(_stems, "array<string>")(_kept(text))


def stemmed_texts(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with a text's stems, joined by spaces, in its place; for whole texts, as batches are bounded in bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    at, own = df.columns.index(column), df.withColumn(column, _kept(F.col(column)))
    arrow = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            joined = pc.binary_join(_stems(b.column(at)), " ").cast(pa.string())
            yield pa.RecordBatch.from_arrays([joined if i == at else c.cast(arrow.field(i).type) for i, c in enumerate(b.columns)], schema=arrow)

    return in_arrow(own, run, df.schema)
