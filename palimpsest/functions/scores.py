"""Scores, similarities and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
WEIGHTS = {"vector": 1.0, "fts": 1.0, "entity": 1.5, "date": 0.5, "graph": 0.8}
TAU_DAYS, DURABLE_FLOOR = 30.0, 0.5
ANCHOR_GAIN, ANCHOR_DAYS = 4.0, 7.0
DAMPING = 0.001
HOP_DECAY, MIN_CONFIDENCE, HUB_DEGREE = 0.5, 0.5, 40


def rrf(weight: Column, rank: Column) -> Column:
    return weight / (RRF_K + rank)


def recency(score: Column, age_days: Column, durable: Column) -> Column:
    """Fades with age; a floor for what is durable; unchanged without an age."""
    fade = F.exp(-F.greatest(age_days, F.lit(0.0)) / TAU_DAYS)
    return score * F.coalesce(F.when(durable, F.greatest(fade, F.lit(DURABLE_FLOOR))).otherwise(fade), F.lit(1.0))


def anchored(score: Column, days_off: Column) -> Column:
    return score * F.coalesce(1 + ANCHOR_GAIN * F.exp(-F.abs(days_off) / ANCHOR_DAYS), F.lit(1.0))


def damped(similarity: Column, degree: Column) -> Column:
    off = F.greatest(degree - 1, F.lit(0)).cast("double")
    return similarity / (1 + DAMPING * off * off)


def confidence(state: Column, score: Column) -> Column:
    """(state, score) with unknown states as 'extracted' and scores in (0, 1]."""
    known = F.when(F.lower(state).isin("extracted", "inferred", "ambiguous"), F.lower(state)).otherwise("extracted")
    default = F.when(known == "inferred", 0.7).when(known == "ambiguous", 0.4).otherwise(1.0)
    return F.struct(known.alias("state"), F.when(F.coalesce(score, F.lit(0.0)) <= 0, default).otherwise(F.least(score, F.lit(1.0))).alias("score"))


def cosine_distance(a: Column, b: Column) -> Column:
    """Null for vectors without length or of other sizes."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def trigrams(s: Column) -> Column:
    """Distinct trigrams of the words, each padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))
