"""Usage: roll-ups, monthly quotas, grace periods, token buckets, claims."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def monthly_quota(rows: DataFrame, limit: Column, key: list[str], order: list[str]) -> DataFrame:
    """Rows (ts) counted per key and month in order: allowed while within ``limit`` (0: always); blocked ones don't count."""
    month = F.trunc("ts", "month")
    own = Window.partitionBy(*key, month).orderBy(*order)
    n = F.row_number().over(own)
    ok = (limit == 0) | (n <= limit)
    return rows.withColumn("allowed", ok).withColumn("used", F.when(limit == 0, n).otherwise(F.least(n, limit)))


GRACE_HOURS = 72


def grace(states: DataFrame, key: str) -> DataFrame:
    """Rows (key, ts, over) in order: over_since starts with the first row over, clears with one that isn't; blocked once
    it has lasted longer than the grace. Runs are islands of equal ``over``, so windows are enough."""
    own = Window.partitionBy(key).orderBy("ts", "event_id")
    run = F.sum(F.when(F.lag("over").over(own).eqNullSafe(F.col("over")), 0).otherwise(1)).over(own)
    marked = states.withColumn("_run", run)
    since = F.when(F.col("over"), F.min("ts").over(Window.partitionBy(key, "_run")))
    out = marked.withColumn("over_since", since)
    return out.withColumn("blocked", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("over_since").cast("timestamp")) > GRACE_HOURS * 3600 * 1_000_000, F.lit(False))).drop("_run")


def token_bucket(requests: DataFrame, key: str, per_minute: int) -> DataFrame:
    """Requests (key, event_id, ts) admitted by a bucket a key: per_minute / 2 + 1 tokens, refilled steadily.

    Whether a request is admitted depends on all admitted before, so a key's requests are walked in order, in batches."""
    burst, rate = per_minute // 2 + 1, per_minute / 60.0

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["ts", "event_id"])
        seconds = g["ts"].astype("int64").to_numpy() / (1e9 if g["ts"].dtype == "datetime64[ns]" else 1e6)
        level, last, out = float(burst), None, []
        for t in seconds.tolist():
            level = burst if last is None else min(burst, level + (t - last) * rate)
            last = t
            out.append(level >= 1)
            level -= out[-1]
        return pd.DataFrame({"event_id": g["event_id"].to_numpy(), "admitted": out})

    return requests.select(key, "event_id", "ts").groupBy(key).applyInPandas(walk, "event_id long, admitted boolean")


def first_claim(claims: DataFrame, message: str, order: list[str]) -> DataFrame:
    """Of all claims of a message only the first counts."""
    return claims.withColumn("won", F.row_number().over(Window.partitionBy(message).orderBy(*order)) == 1)


def from_top(column: str, share: str) -> Column:
    """The value at floor((1 - share) * n) of the n sorted values, counted from the top: values are counted, not collected."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{column}` DESC)")


def upper_median(column: str) -> Column:
    """The value at n // 2 of the sorted values."""
    return from_top(column, "0.5")


def stratified(rows: DataFrame, stratum: str, ids: list[str], n: int, seed: int) -> DataFrame:
    """max(1, n // strata) rows of each stratum by a seeded hash, ``n`` in all."""
    strata = rows.select(F.count_distinct(stratum).alias("k"))
    order = F.sha2(F.concat_ws("-", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))), 256)
    marked = rows.withColumn("_o", order).withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_o")))
    share = F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("k")))
    kept = marked.join(F.broadcast(strata), F.lit(True)).filter(F.col("_r") <= share)
    return kept.orderBy("_r", "_o").limit(n).drop("_o", "_r", "k")
