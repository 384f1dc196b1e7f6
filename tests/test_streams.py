"""Streams judged in order: the result doesn't hang on files and batches; late rows are named; deadlines fall due; restarts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.streaming import jobs, ordered

T0 = dt.datetime(2024, 1, 1)


def made(n=300):
    r = np.random.default_rng(6)
    out = []
    for i in range(n):
        out.append((int(r.integers(5)), i, T0 + dt.timedelta(seconds=float(np.round(r.uniform(0, 3 * 86400), 3))), bool(r.random() < 0.7)))
    out += [(9, 1000, T0, True), (9, 1001, T0 + dt.timedelta(hours=1), True), (8, 1002, T0, True), (8, 1003, T0 + dt.timedelta(hours=2), False)]
    return out


def plain(rows, judge):
    """Every key's events in order, one after the other, and what falls due in the end."""
    out = []
    us = lambda t: int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    for key in {r[0] for r in rows}:
        known = None

        def expire(until):
            nonlocal known
            while (due := judge.due(known)) is not None and due < until:
                known, said = judge.expire(known, due)
                out.extend((str(key), -1, due, *x) for x in said)  # noqa: B023

        for _, event, t, flag in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            expire(us(t))
            known, said = judge.step(known, us(t), flag)
            out.extend((str(key), event, us(t), *x) for x in said)
        expire(10**17)
    return sorted(out, key=str)


def write(spark, rows, path):
    spark.createDataFrame(rows, "key long, event_id long, ts timestamp, flag boolean").coalesce(1).write.mode("append").parquet(path)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("judge", [ordered.Bucket(2), ordered.Grace(5), ordered.Once(7200), ordered.Expiry(10_000)], ids=lambda j: type(j).__name__)
def test_files_dont_matter(spark, tmp_path, judge):
    """Three files that each hold all times, one a batch, give what a walk over all gives."""
    rows = made()
    for part in range(3):
        write(spark, rows[part::3], f"{tmp_path}/in")
    s = jobs.stream(spark, f"{tmp_path}/in", 1)
    assert got(ordered.judged(s, judge, "4 days", f"{tmp_path}/out")) == plain(rows, judge)


def test_a_restart_goes_on_and_late_rows_are_named(spark, tmp_path):
    judge, rows = ordered.Grace(5), made()
    early = [r for r in rows if r[2] < T0 + dt.timedelta(days=1)]
    later = [r for r in rows if r[2] >= T0 + dt.timedelta(days=1)]
    write(spark, early, f"{tmp_path}/in")
    stream = lambda: jobs.stream(spark, f"{tmp_path}/in", 1)
    first = ordered.judged(stream(), judge, "1 hour", f"{tmp_path}/out", close=False)
    n = first.filter("what = 'judged'").count()
    assert 0 < n < len(early)
    write(spark, later, f"{tmp_path}/in")
    # an hour before the end of what was judged of its key
    write(spark, [(0, 5000, T0, True)], f"{tmp_path}/in")
    done = ordered.judged(stream(), judge, "1 hour", f"{tmp_path}/out")
    late = [r for r in got(done) if r[3] == "late"]
    assert [r[1] for r in late] == [5000]
    assert [r for r in got(done) if r[3] != "late"] == plain(rows, judge)


def test_a_grace_that_ends_unbroken_is_told_once(spark, tmp_path):
    rows = [(1, 1, T0, True), (1, 2, T0 + dt.timedelta(hours=3), True), (2, 3, T0, True), (2, 4, T0 + dt.timedelta(hours=4), False), (3, 5, T0, True), (3, 6, T0 + dt.timedelta(hours=9), True)]
    write(spark, rows, f"{tmp_path}/in")
    done = ordered.judged(jobs.stream(spark, f"{tmp_path}/in", 1), ordered.Grace(5), "1 hour", f"{tmp_path}/out")
    told = {(r.key, r.since): r.us for r in done.filter("what = 'timer'").collect()}
    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    assert told == {("1", start): start + 5 * 3_600_000_000 + 1, ("3", start): start + 5 * 3_600_000_000 + 1}
    assert {r.event_id: r.verdict for r in done.filter("what = 'judged'").collect()} == {1: False, 2: False, 3: False, 4: False, 5: False, 6: True}
    assert done.filter(F.col("what") == "late").count() == 0
