"""Decisions about one word, as columns: correct it now, wait for a pause, or leave it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layoutlens.functions import text as T
from layoutlens.functions.layout import ENGLISH, PERSIAN

NONE, WAIT, NOW = 0, 1, 2
LIVE, IDLE, BOUNDARY = 0, 1, 2


def other_language(language: Column) -> Column:
    return F.when(language == ENGLISH, PERSIAN).otherwise(ENGLISH)


def _by_side(active: Column, name: str) -> tuple[Column, Column]:
    """A flag of the active reading and of the other one."""
    en, fa = F.col(f"en_{name}"), F.col(f"fa_{name}")
    return F.when(active == ENGLISH, en).otherwise(fa), F.when(active == ENGLISH, fa).otherwise(en)


def _decision(made: Column, action: Column, confidence: Column, active: Column) -> Column:
    """What is to be replaced by what; the reading keeps the case and the spelling that were typed."""
    english, persian = F.col("en"), F.col("fa")
    original = F.when(active == ENGLISH, english).otherwise(persian)
    replacement = F.when(active == ENGLISH, persian).otherwise(english)
    return F.struct(
        action.alias("action"),
        made.alias("should_correct"),
        F.when(made, F.length("en")).otherwise(0).alias("key_count"),
        F.when(made, confidence).otherwise(0).alias("confidence"),
        F.when(made, active).otherwise(0).alias("source"),
        F.when(made, other_language(active)).otherwise(0).alias("target"),
        F.when(made, original).otherwise("").alias("original"),
        F.when(made, replacement).otherwise("").alias("replacement"),
    )


def collision_evidence(active: Column, context: Column, strength: Column, sentence_start: Column, phase: Column) -> Column:
    """Points for the other reading where both are words, before any threshold."""
    target = other_language(active)
    learned = F.greatest(F.least(strength, F.lit(4)), F.lit(0)) * 30
    from_context = F.when(context == target, learned).when(context == active, -learned).otherwise(0)
    often, target_often = _by_side(active, "frequent")
    from_frequency = F.when(target_often & ~often, 45).when(often & ~target_often, -45).otherwise(0)
    prior = F.when(target == ENGLISH, -F.col("prior")).otherwise(F.col("prior"))
    # Two keys say too little at the start of a sentence: a quarter (towards zero) counts, as inside one.
    quarter = (F.signum(prior) * F.floor(F.abs(prior) / 4)).cast("int")
    from_prior = F.when(sentence_start & (F.length("en") >= 3), prior).otherwise(quarter)
    from_phase = F.when(phase == IDLE, 5).when(phase == BOUNDARY, 10).otherwise(0)
    return from_context + from_frequency + from_prior + from_phase


def contextual(active: Column, sensitivity: Column, context: Column, strength: Column, sentence_start: Column, phase: Column) -> Column:
    """The full rule over classified words with priors (en, fa, FLAGS, prior): struct of action and decision."""
    n = F.length("en")
    known, target_known = _by_side(active, "known")
    considered = (n >= T.least_length(sensitivity)) & (n <= T.MOST_KEYS) & active.isin(ENGLISH, PERSIAN) & target_known
    one_sided = F.when(n >= 5, 100).when(n >= 3, 95).otherwise(90)
    preferred = strength >= 5
    evidence = F.when(preferred, 100).otherwise(collision_evidence(active, context, strength, sentence_start, phase))
    threshold = T.ambiguity_threshold(sensitivity)
    enough = F.when(preferred, context == other_language(active)).otherwise(evidence >= threshold)
    almost = known & ~preferred & (phase == LIVE) & ~enough & (evidence + 5 >= threshold)
    made = considered & (~known | enough)
    confidence = F.when(~known, one_sided).otherwise(F.greatest(F.least(evidence, F.lit(100)), F.lit(0)))
    prefix, _ = _by_side(active, "prefix")
    common_prefix, _ = _by_side(active, "common_prefix")
    sure = known & (context == other_language(active)) & (strength >= 4)
    live = F.when(n == 2, WAIT).when(sure, NOW).when(prefix, WAIT).otherwise(NOW)
    idle = F.when((n != 2) & ~known & common_prefix, WAIT).otherwise(NOW)
    acted = F.when(phase == BOUNDARY, NOW).when(phase == LIVE, live).otherwise(idle)
    action = F.when(made, acted).when(considered & almost, WAIT).otherwise(NONE)
    return _decision(made, action, confidence, active)


def reduced(words: DataFrame, common: bool = True) -> DataFrame:
    """Classified words as the reduced rules see them: no frequent words and no prefixes of common ones.

    Without `common` tiers as well, classify against a lexicon whose `is_common` is false throughout.
    """
    off = {"en_frequent": F.lit(False), "fa_frequent": F.lit(False), "en_common_prefix": F.lit(False), "fa_common_prefix": F.lit(False)}
    return words.withColumns(off)


def without_common(lexicon: DataFrame) -> DataFrame:
    return lexicon.withColumns({"is_common": F.lit(False), "is_common_prefix": F.lit(False), "is_frequent": F.lit(False)})


def basic(active: Column, least: Column) -> Column:
    """One-sided matches alone, from a given length; the confidence is 0."""
    n = F.length("en")
    known, target_known = _by_side(active, "known")
    made = (n >= F.greatest(least, F.lit(1))) & (n <= T.MOST_KEYS) & active.isin(ENGLISH, PERSIAN) & target_known & ~known
    return _decision(made, F.when(made, NOW).otherwise(NONE), F.lit(0), active)


def basic_live(active: Column, least: Column) -> Column:
    """The same while typing: wait while what was typed may become a word."""
    decision = basic(active, least)
    prefix, _ = _by_side(active, "prefix")
    return decision.withField("action", F.when(decision["should_correct"], F.when(prefix, WAIT).otherwise(NOW)).otherwise(NONE))
