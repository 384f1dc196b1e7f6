"""What kind of question it is: patterns in English and Portuguese."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates
from .regex import re2

# Fixed values.
COUNT = r"(?i)\b(how many|how much|how often|number of|count of|total\s+\w+|combined|altogether|in total|all together|quant[oa]s|quantas vezes|n[úu]mero de|total de|no total|ao todo|com que frequ[êe]ncia)\b"
REASONING = (
    r"(?i)(\bwhich\b.{0,40}\b(most|least|best|top|highest|lowest)\b|\b(most|least)\b.{0,30}\b(money|spend|spent|time|often|frequent)\b|"
    r"\bcurrent(ly)?\b|\brecord\b|\blatest\b|\bto-?watch\b|\border of\b|\bin what order\b|\bwhich\b.{0,40}\b(first|earliest|latest)\b|"
    r"happened first|came first|\bwho\b.{0,30}\b(first|second|third)\b|\bhow long\b.{0,30}\b(before|since|been)\b|"
    r"\bhow many (weeks?|months?|days?|years?|hours?)\b.{0,45}\b(since|before|passed|ago|between)\b|"
    r"qual.{0,40}\b(mais|menos|maior|menor)\b|atual(mente)?|recorde|qual a ordem|quem .{0,20}primeiro)"
)
TEMPORAL = (
    r"(?i)(\border of\b|\bin what order\b|\bearliest\b|\bchronological\b|\bcame (first|last|before|after)\b|happened (first|last|before|after)|"
    r"\bwhich\b.{0,40}\b(first|second|third|earliest)\b|\bhow long\b|"
    r"\bhow many (days?|weeks?|months?|years?|hours?|minutes?)\b.{0,45}\b(since|before|after|ago|passed|between|until|till)\b|"
    r"\bdays?\b.{0,15}\b(since|before|after|between|until)\b|"
    r"qual a ordem|quem .{0,20}primeiro|h[áa] quanto tempo|quantos? (dias|semanas|meses|anos)\b.{0,30}\b(desde|antes|atr[áa]s|entre))"
)
PREFERENCE = (
    r"(?i)(recommend|suggest|advice|advis|\btips?\b|\bideas?\b|what (can|should|could|would|might) i\b|\bshould i\b|do you think|good idea|"
    r"thinking (of|about)|trying to (decide|choose|pick)|deciding\b|any (good|new|other|better)\b|"
    r"\b(i\s+)?(love|like|likes|hate|enjoy|prefer|avoid|dislike)\b|"
    r"recomend|sugest|sugere|me indica|alguma (dica|ideia|sugest)|\bdicas?\b|o que (devo|posso|eu (devo|posso))\b|o que voc[eê] acha|vale a pena|"
    r"gosto de|odeio|prefiro|evito|adoro|detesto)"
)
RECALL_LIMIT = 40


def is_count(q: Column) -> Column:
    return q.rlike(re2(COUNT))


def needs_reasoning(q: Column) -> Column:
    return is_count(q) | q.rlike(re2(REASONING))


def is_preference(q: Column) -> Column:
    return q.rlike(re2(PREFERENCE))


def is_date_math(q: Column) -> Column:
    return q.rlike(re2(dates.BETWEEN)) | q.rlike(re2(dates.SINCE)) | q.rlike(re2(dates.AGO_WORD)) | q.rlike(re2(dates.UNTIL))


def is_temporal(q: Column, now: Column) -> Column:
    return q.rlike(re2(TEMPORAL)) | is_date_math(q) | dates.detect_anchor(q, now).isNotNull()


def effective_limit(q: Column, requested: Column) -> Column:
    return F.when(needs_reasoning(q) | is_preference(q), F.greatest(requested, F.lit(RECALL_LIMIT))).otherwise(requested)
