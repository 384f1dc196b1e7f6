"""Functions against literal cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import dates, kinds, questions, scores, text
from palimpsest.functions.regex import re2
from palimpsest.operators import ingest
from palimpsest.streaming.jobs import ThinkStripper


def value(spark, column, **literals):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]).select(column).first()[0]


@pytest.mark.parametrize(
    "said, found",
    [
        ("on 01/06/2026", ["2026-06-01"]), ("2026.6.1 and 2026-06-01", ["2026-06-01"]), ("1 de junho de 2026", ["2026-06-01"]), ("June 1, 2026", ["2026-06-01"]), ("1 June 2026", ["2026-06-01"]),
        ("março 3 2024", ["2024-03-03"]), ("Sept. 9, 2021", ["2021-09-09"]), ("June 1", []), ("2026-02-31", ["2026-02-31"]), ("", []), ("1899-01-01", []), ("5 de maio de 2020, 2019-01-02", ["2019-01-02", "2020-05-05"]),
    ],
)
def test_canonical_dates(spark, said, found):
    assert value(spark, dates.canonical_dates(F.col("t")), t=said) == found


def test_months_run_over(spark):
    day = F.lit("2026-03-31").cast("date")
    assert str(value(spark, dates.add_months(day, F.lit(-1)))) == "2026-03-03"
    assert str(value(spark, dates.add_months(day, F.lit(-2)))) == "2026-01-31"


def test_word_edges_and_folding(spark):
    assert not value(spark, F.lit("vou até hoje").rlike(re2(r"(?i)\b(until|at[eé])\b")))
    assert value(spark, F.lit("ÁGUA").rlike(re2("(?i)água")))


def test_trigram_similarity(spark):
    assert value(spark, F.round(scores.similarity(F.lit("word"), F.lit("two words")), 6)) == 0.363636
    assert value(spark, scores.similarity(F.lit(""), F.lit(""))) == 0


def test_recency(spark):
    at = lambda age, durable=False: value(spark, scores.recency(F.lit(1.0), F.lit(age).cast("double"), F.lit(durable)))
    assert at(0) == 1 and at(-5) == 1 and at(None) == 1
    assert abs(at(30) - 2.718281828**-1) < 1e-6 and abs(at(60) - 2.718281828**-2) < 1e-6
    assert at(600, True) == 0.5


def test_rrf_of_rank_two_twice(spark):
    rows = spark.createDataFrame([(1, 7, "a", 2, 1.0), (1, 7, "b", 2, 1.0)], "q int, item int, channel string, rank int, weight double")
    from palimpsest.operators.ranking import fuse

    assert abs(fuse(rows, ["q"], "item").first().score - 2 / 62) < 1e-12


@pytest.mark.parametrize("kind, canonical", [(" USED_BY ", "relates_to"), ("used", "uses"), ("", "relates_to"), ("married_to", "married_to"), ("is_a", "part_of")])
def test_edge_kind(spark, kind, canonical):
    assert value(spark, kinds.edge_kind(F.col("k")), k=kind) == canonical


@pytest.mark.parametrize(
    "raw, clean",
    [("<final> 42 </final>", "42"), ("<scratch>x</scratch>y", "y"), ("<scratch>only", "only"), ("<final></final>", ""), ("plain", "plain"), ("<FINAL>a\nb</FINAL> tail", "a\nb")],
)
def test_extract_final(spark, raw, clean):
    got = value(spark, text.extract_final(F.col("s")), s=raw)
    assert got == (clean or "<final></final>")


def test_slugs(spark):
    assert value(spark, text.normalize(F.lit("  Ção & Ünïted--Ñ! "))) == "cao-united-n"
    assert value(spark, text.sanitize_slug(F.lit(" --A b/C__d-- "))) == "a-b-c__d"
    assert value(spark, text.slug(F.lit("!!!"), F.lit(1))).startswith("untitled-")


def test_zero_vectors_have_no_distance(spark):
    a = F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, scores.cosine_distance(a, a)) is None


@given(st.text(alphabet="ab .\n!", max_size=400), st.integers(20, 60))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_the_text(s, size):
    got = ingest.chunk(s, size, size // 4, 5)
    assert [p for p, _ in got] == list(range(len(got)))
    for c in set(s.split()):
        # a word no longer than the overlap is whole in some chunk
        if len(c) <= size // 4 and len(c) < 8:
            assert any(c in x for _, x in got)


@given(st.lists(st.sampled_from(["<think>", "</think>", "a", "<", "b>", "think"]), max_size=12), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_stripper_does_not_care_about_pieces(parts, size):
    s = "".join(parts)
    whole, pieces = ThinkStripper(), ThinkStripper()
    one = whole.feed(s) + whole.close()
    two = "".join(pieces.feed(s[i : i + size]) for i in range(0, len(s), size)) + pieces.close()
    assert one == two


def test_a_link_that_begins_another_is_masked_alone(spark):
    answer = "see https://evil.com and https://evil.com.good.org/x, https://evil.com"
    masked, n = (value(spark, c, a=answer, g="as evil.com.good.org says") for c in text.egress_filter(F.col("a"), F.col("g")))
    assert (masked, n) == ("see https://evil.com and https://evil.com.good.org/x, https://evil.com", 0)
    masked, n = (value(spark, c, a=answer, g="good.org") for c in text.egress_filter(F.col("a"), F.col("g")))
    assert n == 3 and masked == "see [link removed] and [link removed] [link removed]"
    masked, n = (value(spark, c, a="a https://z.com b https://z.com.y.org/2", g="at z.com.y.org/2".replace("z.com", "Z.COM")) for c in text.egress_filter(F.col("a"), F.col("g")))
    assert (masked, n) == ("a https://z.com b https://z.com.y.org/2", 0)


def test_the_first_portuguese_weekday_counts(spark):
    now = F.lit("2026-03-31").cast("date")
    day = lambda s: str(value(spark, dates.detect_anchor(F.col("t"), now), t=s))
    assert day("sexta passada ou ultima terça") == "2026-03-27"
    assert day("ultima terça ou sexta passada") == "2026-03-24"


@given(st.text(alphabet="xy. \n", max_size=300), st.integers(1, 120), st.integers(0, 130))
@settings(max_examples=200, deadline=None)
def test_chunks_end_for_any_overlap(s, size, overlap):
    got = ingest.chunk(s, size, overlap)
    assert got and len(got) <= len(s) + 1


def test_english_stems():
    from palimpsest.functions.stem import english

    # pairs that were published with the rules
    known = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
    consistent consist consistently consist consolation consol consolations consol consolatory consolatori console consol consoled consol
    consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol conspicuous conspicu conspicuously
    conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir constable constabl constables constabl
    constancy constanc constant constant knack knack knackeries knackeri knavish knavish kneaded knead kneel kneel knees knee knell knell
    knelt knelt knew knew knick knick knife knife knight knight knightly knight knights knight knit knit knits knit knitting knit
    knives knive knocked knock knots knot knotted knot knowledge knowledg generate generat generously generous communism communism
    dying die skies sky happy happi enjoying enjoy hopping hop hoped hope falling fall relational relat digitizer digit""".split()
    for word, stem in zip(known[::2], known[1::2], strict=True):
        assert english(word) == stem, (word, english(word))
    assert english("generously") == english("generous") and english("generate") == english("generating")


@pytest.mark.parametrize("secret", ["sk-" + "a" * 20, "sk_live_" + "b" * 16, "rk_test_" + "b" * 16, "gho_" + "c" * 20, "ghr_" + "c" * 20, "xoxb-" + "1" * 10, "AKIA" + "D" * 16, "AIza" + "e" * 30, "eyJ" + "f" * 10 + "." + "g" * 10 + "." + "h" * 6, "-----BEGIN RSA PRIVATE KEY-----"])
def test_every_kind_of_secret_is_masked(spark, secret):
    masked, n = (value(spark, c, s=f"x {secret} and {secret}.") for c in text.redact(F.col("s")))
    assert (masked, n) == (f"x {text.MASK} and {text.MASK}.", 2)
    assert value(spark, text.redact(F.col("s"))[0], s="no sk- or AKIA here") == "no sk- or AKIA here"


NOW = "2026-03-31"
# Questions with what they are about, on that day.
ANCHORS = [
    ("what happened on 2026-01-15?", "2026-01-15"), ("notes from June 3", "2026-06-03"), ("notes from June 3, 2024", "2024-06-03"), ("o que fiz em 5 de maio de 2025", "2025-05-05"),
    ("5 days ago", "2026-03-26"), ("four weeks ago", "2026-03-03"), ("a month ago", "2026-03-03"), ("há dois meses atrás", "2026-01-31"), ("last friday", "2026-03-27"), ("last tuesday", "2026-03-24"),
    ("na ultima segunda", "2026-03-30"), ("sexta passada", "2026-03-27"), ("last week", "2026-03-24"), ("last month", "2026-03-03"), ("last weekend", "2026-03-28"), ("hello there", None), ("on 2026-02-31", None),
]
AS_OF = [
    ("what did I use before 2025-08-15?", "2025-08-15 23:59:59"), ("where did I live in 2024?", "2024-12-31 23:59:59"), ("3 days ago", "2026-03-28 12:00:00"), ("2 months ago", "2026-01-31 12:00:00"), ("1 year ago", "2025-03-31 12:00:00"),
    ("as of June 3, 2024", "2024-06-03 23:59:59"), ("antes de 5 de maio de 2025", "2025-05-05 23:59:59"), ("em janeiro", "2026-01-01 00:00:00"), ("em dezembro", "2025-12-01 00:00:00"), ("on 2025-08-15", None), ("what now?", None),
]
MATH = [
    ("how many days between 2026-01-01 and 2026-01-11?", "10 days between 2026-01-01 and 2026-01-11"), ("between June 1 and May 1", "31 days (≈4 weeks) between 2026-05-01 and 2026-06-01"), ("days since 2026-03-21", "10 days since 2026-03-21 (today: 2026-03-31)"),
    ("how long since 2025-03-31", "365 days (≈12 months) since 2025-03-31 (today: 2026-03-31)"), ("3 weeks ago", "21 days (≈3 weeks) since 2026-03-10 (today: 2026-03-31)"), ("until 2026-04-10", "10 days from today (today: 2026-03-31, target: 2026-04-10)"), ("entre 1 de março e 31 de março", "30 days (≈4 weeks) between 2026-03-01 and 2026-03-31"), ("what is this", ""), ("since forever", ""),
]
QUESTIONS = [
    ("How many books did I read?", 1, 1, 0, 0), ("what is my current job", 0, 1, 0, 0), ("Which city did I visit first?", 0, 1, 0, 1), ("Any good restaurants you can suggest?", 0, 0, 1, 0), ("Quantas vezes fui ao médico?", 1, 1, 0, 0),
    ("Tell me about Paris", 0, 0, 0, 0), ("days between June 1 and June 5", 0, 0, 0, 1), ("the total cost of it", 1, 1, 0, 0), ("What should I cook?", 0, 0, 1, 0), ("vou até hoje", 0, 0, 0, 0), ("o que vale a pena ler", 0, 0, 1, 0), ("what happened last friday", 0, 0, 0, 1),
]


def test_questions_about_dates(spark):
    """Anchors, moments and differences of literal questions, all in one pass each."""
    now = F.lit(NOW).cast("date")
    for cases, of in (
        (ANCHORS, lambda q: F.date_format(dates.detect_anchor(q, now), "yyyy-MM-dd")),
        (AS_OF, lambda q: F.date_format(dates.detect_as_of(q, F.lit(f"{NOW} 12:00:00").cast("timestamp")), "yyyy-MM-dd HH:mm:ss")),
        (MATH, lambda q: F.array_join(dates.date_math(q, now), "; ")),
    ):
        got = {r.q: r.x for r in spark.createDataFrame([(q,) for q, _ in cases], "q string").select("q", of(F.col("q")).alias("x")).collect()}
        assert got == dict(cases)


def test_kinds_of_questions(spark):
    q, now = F.col("q"), F.lit(NOW).cast("date")
    rows = spark.createDataFrame([(x[0],) for x in QUESTIONS], "q string").select("q", questions.is_count(q).alias("a"), questions.needs_reasoning(q).alias("b"), questions.is_preference(q).alias("c"), questions.is_temporal(q, now).alias("d"), questions.effective_limit(q, F.lit(5)).alias("e"), questions.effective_limit(q, F.lit(50)).alias("f"))
    for r, (said, *want) in zip(rows.collect(), QUESTIONS, strict=True):
        assert (r.q, [int(r.a), int(r.b), int(r.c), int(r.d)]) == (said, want)
        assert (r.e, r.f) == (40 if r.b or r.c else 5, 50)
