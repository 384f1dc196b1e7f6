"""The join of moments with intervals against comparing all with all."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import intervals, joins, retrieval

DAY = dt.datetime(2020, 1, 1)


def made(spark):
    r = np.random.default_rng(11)
    rows = []
    for i in range(400):
        start = DAY + dt.timedelta(seconds=int(r.integers(0, 10**7)))
        # from a microsecond to decades, a third without an end
        length = dt.timedelta(microseconds=int(10 ** r.uniform(0, 15)))
        rows.append((i, int(r.integers(3)), start, None if i % 3 == 0 else start + length))
    rows += [(900, 0, DAY, DAY), (901, 0, DAY + dt.timedelta(1), DAY), (902, 1, None, None), (903, None, DAY, None), (904, 1, dt.datetime(1900, 1, 1), dt.datetime(1969, 1, 1))]
    asks = [(i, int(r.integers(3)), DAY + dt.timedelta(seconds=int(r.integers(0, 10**7)))) for i in range(60)]
    asks += [(100, 1, rows[1][2]), (101, 1, rows[1][3]), (102, 1, None), (103, 1, dt.datetime(1950, 6, 1)), (104, 1, dt.datetime(1969, 1, 1)), (105, None, DAY)]
    a = spark.createDataFrame(rows, "id long, k int, valid_from timestamp, valid_to timestamp")
    b = spark.createDataFrame(asks, "q long, k int, moment timestamp")
    return rows, asks, a, b


@pytest.mark.parametrize("most", [100_000, 5])
@pytest.mark.parametrize("hot", [100_000, 7])
def test_moments_meet_what_holds_them(spark, monkeypatch, most, hot):
    rows, asks, a, b = made(spark)
    monkeypatch.setattr(intervals, "HOT", hot)
    monkeypatch.setattr(intervals, "small", lambda df: joins.small(df, most))
    want = {(q, i) for q, _, m in asks for i, _, s, e in rows if m and s and s <= m and (e is None or e > m)}
    got = [(r.q, r.id) for r in intervals.join_moments(b.drop("k"), a).collect()]
    assert len(got) == len(want) and set(got) == want
    keyed = {(q, i) for q, kq, m in asks for i, k, s, e in rows if m and s and k == kq and k is not None and s <= m and (e is None or e > m)}
    assert {(r.q, r.id) for r in intervals.join_moments(b, a, keys=["k"]).collect()} == keyed
    assert intervals.join_moments(b, a.limit(0), keys=["k"]).count() == 0 == intervals.join_moments(b.limit(0), a, keys=["k"]).count()


def test_no_interval_is_copied_more_than_once(spark):
    *_, a, _ = made(spark)
    level = intervals._level(F.col("valid_from"), F.col("valid_to"))
    assert a.filter("valid_to > valid_from").select(F.max(F.pow(F.lit(2.0), level) / F.greatest(F.unix_micros("valid_to") - F.unix_micros("valid_from"), F.lit(1)))).first()[0] <= 2.0


def test_moments_of_questions_decide_in_one_plan(spark):
    """Entities and edges of different times: each question sees those of its own moment."""
    t = lambda d: DAY + dt.timedelta(days=d)
    names = spark.createDataFrame([(1, "alpha one", t(0), t(10)), (1, "beta one", t(10), None), (2, "alpha two", t(5), None), (3, "gamma", t(0), None)], "entity_id long, name string, valid_from timestamp, valid_to timestamp")
    edges = spark.createDataFrame(
        [(1, 3, "k", 1.0, 100, t(0), t(4)), (1, 3, "k", 1.0, 101, t(4), t(20)), (2, 3, "k", 1.0, 102, t(5), None), (3, 4, "k", 1.0, 103, t(8), None)],
        "from_id long, to_id long, kind string, confidence double, page_id long, valid_from timestamp, valid_to timestamp",
    )
    q = spark.createDataFrame([(1, "alpha", t(1)), (2, "alpha", t(6)), (3, "alpha", t(30)), (4, "beta", None), (5, "alpha", None)], "question_id long, text string, as_of timestamp")
    found = retrieval.seeds(q, names, 5)
    assert {(r.question_id, r.entity_id) for r in found.collect()} == {(1, 1), (2, 1), (2, 2), (3, 2), (4, 1), (5, 2)}
    now = edges.filter("valid_to IS NULL")
    assert {(r.question_id, r.page_id) for r in retrieval.entity_weights(found, now, edges).collect()} == {(1, 100), (2, 101), (2, 102), (3, 102), (5, 102)}
    walked = {(r.question_id, r.page_id) for r in retrieval.expansion_weights(found, now, 2, ["k"], 40, edges).collect()}
    # entity 3 leads on to page 103 from day 8; hubs are judged by the present
    assert walked == {(1, 100), (2, 101), (2, 102), (3, 102), (3, 103), (5, 102), (5, 103)}
