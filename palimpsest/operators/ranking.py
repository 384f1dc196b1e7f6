"""Ranking: top-k per question, fusion, boosts and selections. Every order is total: equal scores rank by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int | Column, name: str = "rank") -> DataFrame:
    return ranked(df, by, order, name).filter(F.col(name) <= k)


def fuse(channels: DataFrame, by: list[str], item: str) -> DataFrame:
    """Reciprocal rank fusion over rows (by, item, rank, weight)."""
    return channels.groupBy(*by, item).agg(F.sum(scores.rrf(F.col("weight"), F.col("rank"))).alias("score"))


def cap_with_backfill(df: DataFrame, by: list[str], page: str, cap: int, limit: int) -> DataFrame:
    """The first ``cap`` of each page in rank order, then the overflow in rank order, ``limit`` in all."""
    inner = ranked(df, [*by, page], [F.col("rank")], "_own")
    return top_k(inner.withColumn("_over", F.col("_own") > cap), by, [F.col("_over"), F.col("rank")], limit, "position").drop("_own", "_over")


def hard_cap(df: DataFrame, by: list[str], page: str, cap: int) -> DataFrame:
    return top_k(df, [*by, page], [F.col("rank")], cap, "_own").drop("_own")


def session_gain(df: DataFrame, by: list[str], page: str) -> DataFrame:
    """Discounted gain of each page over its own results, and the pages' order by it."""
    inner = ranked(df, [*by, page], [F.col("rank")], "_own")
    gain = inner.groupBy(*by, page).agg(F.sum(F.col("score") / F.log2(F.col("_own") + 1)).alias("gain"), F.min("rank").alias("first"))
    return ranked(gain, by, [F.col("gain").desc(), F.col("first")], "page_rank")


def round_robin(df: DataFrame, by: list[str], page: str, pages: int, budget: int) -> DataFrame:
    """The best pages' results in turn: all first ones, all second ones, and so on."""
    best = session_gain(df, by, page).filter(F.col("page_rank") <= pages).select(*by, page, "page_rank")
    inner = ranked(df, [*by, page], [F.col("rank")], "_own").join(best, [*by, page])
    return top_k(inner, by, [F.col("_own"), F.col("page_rank")], budget, "position").drop("_own")


def contribution(channels: DataFrame, final: DataFrame, by: list[str], item: str) -> DataFrame:
    """Of each channel, how many of the final results it covers and how many it alone does."""
    kept = channels.join(final.select(*by, item), [*by, item]).select(*by, item, "channel").distinct()
    alone = F.count("*").over(Window.partitionBy(*by, item)) == 1
    return kept.withColumn("_alone", alone).groupBy("channel").agg(F.count("*").alias("covers"), F.count_if("_alone").alias("exclusive"))


def first_seen(df: DataFrame, by: list[str], item: str, order: list[str]) -> DataFrame:
    """Ordered union: every item where it comes first."""
    return ranked(top_k(df, [*by, item], [F.col(c) for c in order], 1, "_own").drop("_own"), by, [F.col(c) for c in order], "position")


def page_params(limit: Column, offset: Column, default: int, most: int) -> tuple[Column, Column]:
    """(limit, offset) of a request's texts: what is no whole number or not positive is the default, or no offset."""
    whole = lambda x: F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("bigint"))
    n, skip = whole(limit), whole(offset)
    return F.least(F.when(n > 0, n).otherwise(F.lit(default)), F.lit(most)), F.when(skip > 0, skip).otherwise(F.lit(0))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of ``df`` in ``order``: its rows with position, total (rows in all) and has_more. Only the rows up to the page's end
    are ranked; all others are only counted."""
    total = df.count()
    first = df.orderBy(*order).limit(offset + limit).withColumn("_all", F.lit(0))
    rows = ranked(first, ["_all"], order, "position").drop("_all").filter(F.col("position") > offset)
    return rows.withColumns({"total": F.lit(total).cast("long"), "has_more": F.lit(offset + limit < total)})
