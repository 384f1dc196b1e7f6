"""Joins of moments with validity intervals, in one plan for any number of moments.

An interval stands at the level of its length, in bins twice as wide as it is long at most, so in one or two; a moment stands in one
bin of every level that intervals have. What meets in a bin is checked exactly. So a join on (level, bin) replaces comparing all
with all, and no interval is copied more than once however long it is. Moments that are few, which is counted, go to all tasks;
more are shuffled, and a bin of very many intervals is dealt to several tasks, to each of which its moments go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import fresh, small

#: Level of intervals without an end. Intervals of a bin that a task has, about.
OPEN, HOT = 64, 100_000


def holds(moment: Column, start: Column, end: Column) -> Column:
    """Whether the half-open interval has the moment; a null moment is the present, which what has no end has."""
    return F.when(moment.isNull(), end.isNull()).otherwise((start <= moment) & (end.isNull() | (end > moment)))


def _level(start: Column, end: Column) -> Column:
    """The least power of two, in microseconds, that is no shorter than the interval."""
    return F.when(end.isNull(), F.lit(OPEN)).otherwise(F.ceil(F.log2(F.greatest(F.unix_micros(end) - F.unix_micros(start), F.lit(1)).cast("double"))).cast("int"))


def _bin(t: Column, level: Column) -> Column:
    # beyond 2^62 there is one bin for all time
    return F.when(level >= 62, F.lit(0).cast("long")).otherwise(F.floor(F.unix_micros(t) / F.pow(F.lit(2.0), level)).cast("long"))


def join_moments(moments: DataFrame, intervals: DataFrame, moment: str = "moment", start: str = "valid_from", end: str = "valid_to", keys: list[str] | None = None) -> DataFrame:
    """Rows of ``moments`` with every row of ``intervals`` that holds their moment: half-open intervals of timestamps, a null end
    is none, an interval that ends before it starts holds nothing, nor does a null moment or start. With ``keys`` also these agree."""
    keys = keys or []
    level, bin_, salt, deal = (fresh(moments, fresh(intervals, c)) for c in ("_level", "_bin", "_salt", "_deal"))
    some = intervals.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))).withColumn(level, _level(F.col(start), F.col(end)))
    last = F.when(F.col(end).isNull(), _bin(F.col(start), F.col(level))).otherwise(_bin(F.timestamp_micros(F.unix_micros(F.col(end)) - 1), F.col(level)))
    binned = some.withColumn(bin_, F.explode(F.array_distinct(F.array(_bin(F.col(start), F.col(level)), last))))
    levels = [r[0] for r in some.select(level).distinct().collect()]  # 65 at most
    asked = moments.filter(F.col(moment).isNotNull()).withColumn(level, F.explode(F.array(*[F.lit(x) for x in sorted(levels)]).cast("array<int>"))).withColumn(bin_, _bin(F.col(moment), F.col(level)))
    on = [level, bin_, *keys]
    few = small(moments)
    if few is not moments:
        met = binned.join(F.broadcast(asked), on)
    else:
        # how many tasks a bin of many intervals is dealt to; all others have one
        counts = binned.groupBy(*on).agg(F.ceil(F.count("*") / HOT).cast("int").alias(deal)).filter(F.col(deal) > 1)
        hot = small(counts)
        parts = F.coalesce(deal, F.lit(1))
        left = binned.join(hot, on, "left").withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in intervals.columns]), parts).cast("int")).drop(deal)
        right = asked.join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).drop(deal)
        met = left.join(right, [*on, salt]).drop(salt)
    return met.filter(holds(F.col(moment), F.col(start), F.col(end))).drop(level, bin_)
