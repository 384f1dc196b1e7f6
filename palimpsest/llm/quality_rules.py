"""Line-first quality rules in DataFrame functions alone.

Every line with a word is judged by itself: punctuation (shouting, symbol tails, or a short line without an end mark),
navigation (mostly separators) and boilerplate (fixed phrases in four languages, in a line of at most ``NOTICE_WORDS`` words for
each of them: a longer line that names one is prose). Failing lines are removed, and a document that loses more
than ``MAX_LOST`` of its words, or fails the whole-text counts (too few words, too many repeated windows), is rejected.

Null texts have no words, as empty ones do; both are rejected by the word count. Rows are independent, so repeated rows
give repeated results. Only doc_id and text are read. Windows are compared by 64-bit hashes of word hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A document may lose this percentage of its words with the lines removed.
MAX_LOST_PERCENT = 50

# Fixed values.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words that end in repeated marks or symbols.
MARKED = r"(!!|\?\?|[#*$%&]{3})([\x20\x09-\x0D]|$)"
SEPARATORS = r"[|»›>·•]"
END_MARK = r"""[.!?:;,…"'”’)\]][\x20\x09-\x0D]*$"""
BOILERPLATE = (
    r"(cookie|privacy policy|terms of (use|service)|all rights reserved|enable javascript|subscribe now|click here|log ?in to|sign up|lorem ipsum|powered by|copyright ©|"
    r"politique de confidentialité|conditions d['’]utilisation|tous droits réservés|activer javascript|cliquez ici|abonnez-vous|se connecter|"
    r"datenschutzerklärung|nutzungsbedingungen|alle rechte vorbehalten|javascript aktivieren|hier klicken|jetzt abonnieren|einloggen|"
    r"política de privacidad|términos (de uso|del servicio)|todos los derechos reservados|activar javascript|haga clic aquí|suscríbase|iniciar sesión)"
)
#: A line is boilerplate if it has a phrase for each so many words.
NOTICE_WORDS = 12


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


#: What a text must have, in lower case, for a phrase to stand in it: plain searches come before patterns.
HINTS = """cookie;privacy policy;terms of;rights reserved;enable javascript;subscribe now;click here;log in to;login to;sign up;lorem ipsum;powered by;copyright ©;
politique de;conditions d;tous droits;activer javascript;cliquez ici;abonnez-vous;se connecter;datenschutzerkl;nutzungsbeding;alle rechte;javascript aktivieren;
hier klicken;jetzt abonnieren;einloggen;tica de privacidad;rminos de;todos los derechos;activar javascript;haga clic;suscr;iniciar sesi""".replace("\n", "").split(";")
#: At most three words; the rest of a longer line isn't looked at.
FEW_WORDS = r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){0,3}+$"


def _signs(text: Column) -> Column:
    """What is at all in a text of that its lines can fail by: most texts have neither marks nor separators nor phrases."""
    # letters that patterns without regard to case take for others
    low = F.lower(F.translate(text, "İıſ\u212a", "iisk"))
    notice = F.contains(low, F.lit(HINTS[0]))
    for hint in HINTS[1:]:
        notice = notice | F.contains(low, F.lit(hint))
    return F.struct(text.rlike(r"!!|\?\?|[#*$%&]{3}").alias("marked"), text.rlike(SEPARATORS).alias("separated"), notice.alias("notice"))


def _line_fails(line: Column, signs: Column) -> Column:
    n = F.size(split_words(line))
    shouting = signs["marked"] & (F.regexp_count(line, F.lit(MARKED)) * 3 >= n)
    navigation = signs["separated"] & (F.regexp_count(line, F.lit(SEPARATORS)) >= F.greatest(F.lit(2), F.ceil(n / 3)))
    unfinished = line.rlike(FEW_WORDS) & ~line.rlike(END_MARK)
    # the phrases are counted only where there is one
    notice = signs["notice"] & line.rlike(f"(?iu){BOILERPLATE}") & (F.regexp_count(line, F.lit(f"(?iu){BOILERPLATE}")) * NOTICE_WORDS >= n)
    return shouting | navigation | unfinished | notice


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, n_lost_words, kept; a row per row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select("doc_id", text.alias("t"), split_words(text).alias("w"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"), _signs(text).alias("signs"))
    two = one.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.aggregate(F.filter("lines", lambda x: _line_fails(x, F.col("signs"))), F.lit(0).cast("long"), lambda a, x: a + F.size(split_words(x))).alias("n_lost_words"),
    )
    window = lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)])
    none = F.array().cast("array<long>")
    three = two.withColumn("win", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), window)).otherwise(none)).drop("h")
    # only texts with repeated windows sort them; equal neighbours then are repeats
    pairs = F.when(F.size(F.array_distinct("win")) < F.size("win"), F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    four = three.withColumn("pairs", pairs).drop("win")
    same = lambda p, k, step: F.coalesce(F.get("pairs", k + step)["h"] == p["h"], F.lit(False))
    five = four.withColumn("at", F.array_sort(F.transform(F.filter("pairs", lambda p, k: same(p, k, -1) | same(p, k, 1)), lambda p: p["i"]))).drop("pairs")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
    six = five.withColumn("n_repeat_words", F.aggregate("at", start, step, lambda a: a["n"])).drop("at")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    seven = six.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (100 * F.col("n_lost_words") <= MAX_LOST_PERCENT * F.col("n_words"))
    return seven.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", kept.alias("kept"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without rejected rows, and without the failing lines in ``text``."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    verdict = judge(docs.select(F.struct(*every).alias("doc_id"), "text")).filter("kept").select(F.col("doc_id.*"))
    signs = fresh(docs, "signs")
    keep = F.filter(F.split("text", "\n", -1), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & _line_fails(x, F.col(signs))))
    return verdict.withColumn(signs, _signs(F.col("text"))).withColumn("text", F.array_join(keep, "\n")).select(*every)
