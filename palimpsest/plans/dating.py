"""Dates: canonical forms, anchors, as-of points and arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..sources.tables import table
from .base import query


def dated_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), "o_orderdate")
    d, k = F.col("o_orderdate"), F.col("item_id") % 5
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "MMMM d, yyyy")).when(k == 3, F.date_format(d, "d MMMM yyyy")).otherwise("no date")
    return o.select("item_id", F.concat(F.lit("Session on "), text).alias("text"), F.to_date("o_orderdate").alias("day"))


_T = """t AS (SELECT o_orderkey AS item_id, o_orderdate::DATE AS day FROM orders)"""


@query(f"WITH {_T} SELECT item_id, CASE WHEN item_id % 5 <> 4 THEN strftime(day, '%Y-%m-%d') ELSE '' END AS found FROM t")
def canonical_dates(spark, sf_dir):
    return dated_text(spark, sf_dir).select("item_id", F.array_join(dates.canonical_dates(F.col("text")), " ").alias("found"))


@query(f"WITH {_T} SELECT item_id, CASE WHEN item_id % 5 <> 4 THEN strftime(day, 'd%Y%m%d') ELSE '' END AS tokens FROM t")
def date_tokens(spark, sf_dir):
    return dated_text(spark, sf_dir).select("item_id", F.array_join(dates.date_tokens(F.col("text")), " ").alias("tokens"))


@query("""WITH s AS (SELECT o_orderkey AS item_id, o_custkey AS page, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE END AS day FROM orders)
SELECT item_id, strftime(day, '%Y-%m-%d') AS session_day, row_number() OVER (PARTITION BY page ORDER BY day DESC NULLS LAST, item_id) AS position FROM s""")
def session_date_order(spark, sf_dir):
    from ..operators.ranking import ranked

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("page"), "o_orderdate")
    mark = F.when(F.col("item_id") % 4 != 0, F.concat(F.lit("[Session date: "), F.date_format("o_orderdate", "yyyy/M/d"), F.lit("] hello"))).otherwise("hello [session date: x]")
    s = o.select("item_id", "page", dates.session_date(mark).alias("day"))
    return ranked(s, ["page"], [F.col("day").desc_nulls_last(), F.col("item_id")], "position").select("item_id", F.date_format("day", "yyyy-MM-dd").alias("session_day"), "position")


#: Questions that orders ask: with their date, a number and a weekday of their own, as of forty days later.
WORDS = ["two", "three", "four"]
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_DAYS_EN = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
_DAYS_PT = ["domingo", "segunda", "terça", "quarta", "quinta", "sexta", "sábado"]
_ASK = """o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d, o_orderdate::DATE + 40 AS now, o_orderkey % 17 + 2 AS n, (o_orderkey // 10) % 7 AS w FROM orders)"""
_BACK_MONTHS = "(date_trunc('month', now) - to_months(n::INT) + to_days((day(now) - 1)::INT))::DATE"
_PT_DAY = f"day(d) || ' de ' || {_LIST(dates.MONTHS_PT)}[month(d)] || ' de ' || year(d)"
_EN_DAY = "strftime(d, '%B ') || day(d)"


def _asking(spark, sf_dir):
    """(id, d, now, n, w) and what texts are made of: the date in English and Portuguese, words of the number and the weekday."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    o = o.select("*", F.date_add("d", 40).alias("now"), (F.col("id") % 17 + 2).cast("int").alias("n"), F.pmod(F.floor(F.col("id") / 10), F.lit(7)).cast("int").alias("w"))
    of = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), k.cast("int"))
    return o.select("*", F.date_format("d", "MMMM d").alias("en"), F.concat_ws(" de ", F.dayofmonth("d"), of(dates.MONTHS_PT, F.month("d")), F.year("d")).alias("pt"), F.date_format("d", "yyyy-MM-dd").alias("iso"),
        of(WORDS, F.col("id") % 30 / 10 + 1).alias("word"), of(_DAYS_EN, F.col("w") + 1).alias("day_en"), of(_DAYS_PT, F.col("w") + 1).alias("day_pt"))


def _said(kinds: int, *texts):
    """Of texts, each a list of literals and columns, the one of the order's kind."""
    out = None
    for k, parts in enumerate(texts):
        one = F.concat(*[x if not isinstance(x, str) else F.col(x[1:]).cast("string") if x.startswith("$") else F.lit(x) for x in parts])
        out = F.when(F.col("id") % kinds == k, one) if out is None else out.when(F.col("id") % kinds == k, one)
    return out


@query(f"""WITH {_ASK} SELECT id, strftime(CASE id % 10 WHEN 0 THEN d WHEN 1 THEN try_cast(printf('%04d-%02d-%02d', year(now), month(d), day(d)) AS DATE) WHEN 2 THEN d WHEN 3 THEN now - n::INT WHEN 4 THEN now - 7 * ((id % 30) // 10 + 2)::INT
  WHEN 5 THEN {_BACK_MONTHS} WHEN 6 THEN now - ((dayofweek(now) - w + 6) % 7 + 1)::INT WHEN 7 THEN now - 7 WHEN 8 THEN now - ((dayofweek(now) - w + 6) % 7 + 1)::INT END, '%Y-%m-%d') AS anchor FROM o""")
def date_anchor_detect(spark, sf_dir):
    q = _asking(spark, sf_dir)
    text = _said(10, ["what happened on ", "$iso", "?"], ["notes from ", "$en"], ["o que fiz em ", "$pt"], ["what I did ", "$n", " days ago"], ["and ", "$word", " weeks ago?"],
        ["where was I ", "$n", " months ago"], ["what happened last ", "$day_en"], ["what happened last week"], ["o que fiz na ultima ", "$day_pt"], ["tell me about order ", "$id"])
    return q.select("id", F.date_format(dates.detect_anchor(text, F.col("now")), "yyyy-MM-dd").alias("anchor"))


@query(f"""WITH {_ASK} SELECT id, strftime(CASE id % 8 WHEN 0 THEN d + INTERVAL '23:59:59' HOUR TO SECOND WHEN 1 THEN make_date(year(d), 12, 31) + INTERVAL '23:59:59' HOUR TO SECOND WHEN 2 THEN (now - n::INT) + INTERVAL 12 HOUR WHEN 3 THEN {_BACK_MONTHS} + INTERVAL 12 HOUR
  WHEN 4 THEN d + INTERVAL '23:59:59' HOUR TO SECOND WHEN 5 THEN d + INTERVAL '23:59:59' HOUR TO SECOND WHEN 6 THEN make_date(year(now) - (month(d) > month(now))::INT, month(d), 1)::TIMESTAMP END, '%Y-%m-%d %H:%M:%S') AS as_of FROM o""".replace("INTERVAL '23:59:59' HOUR TO SECOND", "INTERVAL 86399 SECOND"))
def as_of_detect(spark, sf_dir):
    q = _asking(spark, sf_dir).withColumns({"year": F.year("d"), "month": F.element_at(F.array(*[F.lit(x) for x in dates.MONTHS_PT]), F.month("d"))})
    text = _said(8, ["what did I use before ", "$iso", "?"], ["where did I live in ", "$year", "?"], ["where was I ", "$n", " days ago"], ["what did I own ", "$n", " months ago"],
        ["as of ", "$en", ", ", "$year"], ["antes de ", "$pt"], ["onde morava em ", "$month"], ["on ", "$iso"])
    noon = F.timestamp_seconds(F.unix_seconds(F.col("now").cast("timestamp")) + 12 * 3600)
    return q.select("id", F.date_format(dates.detect_as_of(text, noon), "yyyy-MM-dd HH:mm:ss").alias("as_of"))


_SPAN = """CASE WHEN e - s BETWEEN 14 AND 59 THEN (e - s) || ' days (≈' || (e - s) // 7 || ' weeks)' WHEN e - s >= 60 THEN (e - s) || ' days (≈' || greatest((year(e) - year(s)) * 12 + month(e) - month(s) - (day(e) < day(s))::INT, 0) || ' months)' ELSE (e - s) || ' days' END"""


@query(f"""WITH {_ASK}, x AS (SELECT id, id % 6 AS k, now, CASE WHEN id % 6 = 3 THEN now - 7 * n::INT ELSE d END AS s, CASE id % 6 WHEN 0 THEN d + (id % 200)::INT WHEN 5 THEN d + (id % 200)::INT ELSE now END AS e FROM o)
SELECT id, CASE WHEN k IN (0, 5) THEN CASE WHEN e = s THEN '' ELSE {_SPAN} || ' between ' || s || ' and ' || e END WHEN k IN (1, 3) THEN {_SPAN} || ' since ' || s || ' (today: ' || e || ')'
  WHEN k = 2 THEN '40 days from today (today: ' || s || ', target: ' || e || ')' ELSE '' END AS facts FROM x""")
def date_math(spark, sf_dir):
    q = _asking(spark, sf_dir).withColumn("other", F.date_add("d", (F.col("id") % 200).cast("int")))
    other = lambda c: F.concat_ws(" de ", F.dayofmonth(c), F.element_at(F.array(*[F.lit(x) for x in dates.MONTHS_PT]), F.month(c)), F.year(c))
    q = q.withColumns({"other_iso": F.date_format("other", "yyyy-MM-dd"), "other_pt": other("other"), "now_iso": F.date_format("now", "yyyy-MM-dd")})
    text = _said(6, ["days between ", "$iso", " and ", "$other_iso", "?"], ["days since ", "$iso"], ["until ", "$now_iso"], ["$n", " weeks ago"], ["what is order ", "$id"], ["entre ", "$pt", " e ", "$other_pt"])
    # what lies ahead is asked on the day of the order
    today = F.when(F.col("id") % 6 == 2, F.col("d")).otherwise(F.col("now"))
    return q.select("id", F.array_join(dates.date_math(text, today), "; ").alias("facts"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate::DATE, '%Y-%m-%d 00:00:00') END AS valid_at FROM orders""")
def valid_time_parse(spark, sf_dir):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    s = F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, "yesterday").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(dates.valid_time(s), "yyyy-MM-dd HH:mm:ss").alias("valid_at"))


@query("SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS period, count(*) AS n FROM events GROUP BY 1")
def month_period(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format(F.trunc("ts", "month"), "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS day FROM orders")
def bench_date_normalize(spark, sf_dir):
    raw = F.concat(F.date_format("o_orderdate", "yyyy/M/d"), F.lit(" (Mon) 10:00"))
    part = lambda i: F.regexp_extract(raw, r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", i)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")).alias("day"))


@query("""SELECT o_orderkey, strftime(o_orderdate::DATE - CASE WHEN (dayofweek(o_orderdate) - o_orderkey % 7 + 7) % 7 = 0 THEN 7 ELSE ((dayofweek(o_orderdate) - o_orderkey % 7 + 7) % 7) END::INT, '%Y-%m-%d') AS day FROM orders""")
def last_weekday(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(dates.last_weekday(F.to_date("o_orderdate"), F.col("o_orderkey") % 7), "yyyy-MM-dd").alias("day"))


@query("""WITH p AS (SELECT o_orderkey, (year(o_orderdate) - 100 * (o_orderkey % 3))::INT AS y, (o_orderkey % 14)::INT AS m, (o_orderkey % 34)::INT AS d FROM orders)
SELECT o_orderkey, CASE WHEN y >= 1900 THEN strftime(try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE), '%Y-%m-%d') END AS day FROM p""")
def safe_date(spark, sf_dir):
    k = F.col("o_orderkey")
    parts = ((F.year("o_orderdate") - 100 * (k % 3)).cast("int"), (k % 14).cast("int"), (k % 34).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(dates.safe_date(*parts), "yyyy-MM-dd").alias("day"))
