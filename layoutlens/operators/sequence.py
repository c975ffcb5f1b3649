"""Sentence decisions: scores of word runs that end at the current word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layoutlens.functions import text as T
from layoutlens.functions.layout import ENGLISH, OTHER, PERSIAN, in_language
from layoutlens.operators.ordered import let

#: Before the current word a history holds at most these words and characters (spaces between them included).
HISTORY_WORDS = T.MOST_WORDS - 1
HISTORY_CHARS = T.MOST_CHARS - T.MOST_KEYS - 1


def word_score(known: Column, frequent: Column, length: Column) -> Column:
    return F.when(known, 30 + F.when(frequent, 18).otherwise(0)).otherwise(F.when(length <= 2, -16).otherwise(-26))


def decide_run(words: Column, en_sum: Column, fa_sum: Column, en_known: Column, fa_known: Column, sensitivity: Column, context: Column, strength: Column) -> Column:
    """struct<language, confidence, en_score, fa_score, en_known, fa_known> of a run from its sums."""
    coherent = lambda known: F.when(known == words, 12 + words * 8).otherwise(0)
    learned = lambda lang: F.when(strength.between(1, 4) & (context == lang), strength * 8).otherwise(0)
    en = (en_sum + coherent(en_known) + learned(ENGLISH)).cast("int")
    fa = (fa_sum + coherent(fa_known) + learned(PERSIAN)).cast("int")
    threshold = T.sequence_threshold(sensitivity)
    fits = words.between(2, T.MOST_WORDS)
    language = (
        F.when(fits & (en - fa >= threshold) & (en_known == words), ENGLISH)
        .when(fits & (fa - en >= threshold) & (fa_known == words), PERSIAN)
        .otherwise(OTHER)
    )
    confidence = F.when(language == OTHER, 0).otherwise(F.least(F.abs(en - fa), F.lit(100)))
    return F.struct(
        language.alias("language"), confidence.alias("confidence"), en.alias("en_score"), fa.alias("fa_score"),
        en_known.cast("int").alias("en_known"), fa_known.cast("int").alias("fa_known"),
    )


def sequence_sums(words: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, words and the sums of each group of classified words that `scored` decides by, whatever the settings."""
    n = F.length("en")
    return words.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("words"),
        F.sum(word_score(F.col("en_known"), F.col("en_frequent"), n)).alias("__en"),
        F.sum(word_score(F.col("fa_known"), F.col("fa_frequent"), n)).alias("__fa"),
        F.count_if(F.col("en_known")).alias("__en_known"),
        F.count_if(F.col("fa_known")).alias("__fa_known"),
        F.bool_and(n.between(1, T.MOST_KEYS)).alias("__usable"),
    )


def scored(sums: DataFrame, sensitivity: Column, context: Column, strength: Column) -> DataFrame:
    """`sums` with the fields of `decide_run` in place of the sums."""
    names = ["__en", "__fa", "__en_known", "__fa_known"]
    made = decide_run(F.when(F.col("__usable"), F.col("words")).otherwise(0), *[F.col(n) for n in names], sensitivity, context, strength)
    return sums.withColumn("__d", made).drop(*names, "__usable").select("*", "__d.*").drop("__d")


def score_sequences(words: DataFrame, keys: list[str], sensitivity: Column, context: Column, strength: Column) -> DataFrame:
    """One decision for each group of classified words: `keys` and the fields of `decide_run`."""
    return scored(sequence_sums(words, keys), sensitivity, context, strength)


def bounded_history(words: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Words of a sentence (numbered from 1) up to where its history is abandoned, by words or by characters."""
    order = Window.partitionBy(*keys).orderBy(pos)
    chars = F.sum(F.length("en") + 1).over(order) - 1
    before = F.coalesce(F.lag(chars_column := "__chars").over(order), F.lit(0))
    found = words.withColumn(chars_column, chars).withColumn("__before", before)
    return found.filter((F.col(pos) <= T.MOST_WORDS) & (F.col("__before") <= HISTORY_CHARS)).drop("__chars", "__before")


def _sentences(words: DataFrame, keys: list[str], sensitivity: Column, context: Column, strength: Column, pos: str, more: list[str]) -> DataFrame:
    """keys, __w (the words of a sentence, 32 at most), __runs: for each word the longest decided run that ends with it, or null.

    A sentence is first cut where its history would be abandoned; sums up to each word are taken before its words are gathered once, and those of
    all runs come from them. A decided run holds known words of its language alone, so no run that begins before the latest unknown one is tried, and
    none after the first one that is decided.
    """
    n = F.length("en")
    parts = {
        "e": word_score(F.col("en_known"), F.col("en_frequent"), n), "f": word_score(F.col("fa_known"), F.col("fa_frequent"), n),
        "ke": F.col("en_known").cast("int"), "kf": F.col("fa_known").cast("int"),
    }
    order = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    after = lambda known: F.coalesce(F.max(F.when(~F.coalesce(F.col(known), F.lit(False)), F.col(pos))).over(order), F.lit(0)) + 1
    sums = {k: F.sum(v).over(order).cast("int").alias(k) for k, v in parts.items()}
    row = F.struct(F.col(pos).alias("pos"), "en", "fa", *more, *parts, "first")
    held = bounded_history(words, keys, pos).select(*keys, F.col(pos), "en", "fa", *more, *sums.values(), F.least(after("en_known"), after("fa_known")).cast("int").alias("first"))
    gathered = held.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__w"))

    def longest(word: Column) -> Column:
        end = word["pos"].cast("int")

        def run(start: Column) -> Column:
            before = lambda k: F.coalesce(F.get(F.col("__w"), start - 2)[k], F.lit(0))
            part = lambda k: word[k] - before(k)
            made = lambda p: decide_run(end - start + 1, *[p[k] for k in parts], sensitivity, context, strength)
            run = lambda d: F.when(d["language"] != OTHER, F.struct(start.alias("start"), d.alias("decision")))
            return let(let(F.struct(*[part(k).alias(k) for k in parts]), made), run)

        starts = F.when(word["first"] < end, F.sequence(word["first"], end - 1)).otherwise(F.array().cast("array<int>"))
        none = F.lit(None).cast(_RUN)
        return F.aggregate(starts, none, lambda found, start: F.when(found.isNotNull(), found).otherwise(run(start)).cast(_RUN))

    return gathered.withColumn("__runs", F.transform("__w", longest))


_RUN = "struct<start:int,decision:struct<language:int,confidence:int,en_score:int,fa_score:int,en_known:int,fa_known:int>>"


def suffix_runs(words: DataFrame, keys: list[str], sensitivity: Column, context: Column, strength: Column, pos: str = "pos") -> DataFrame:
    """For each word the longest run ending at it that is decided: keys, pos, start, words and the decision."""
    each = _sentences(words, keys, sensitivity, context, strength, pos, []).select(*keys, F.posexplode("__runs").alias("__at", "__run"))
    found = each.filter("__run IS NOT NULL").withColumn(pos, F.col("__at") + 1)
    return found.select(*keys, pos, "__run.start", (F.col(pos) - F.col("__run.start") + 1).alias("words"), "__run.decision.*")


def repaired_runs(words: DataFrame, keys: list[str], sensitivity: Column, context: Column, strength: Column, pos: str = "pos") -> DataFrame:
    """What is done at each word with a decided run: keys, pos, start, language, confidence, needs_change, original, replacement.

    `words` also have `visible`, the language that a word was typed in. A run leaves its words in its language (either it changes them or they were), so a
    word stands in the language of the latest run before that holds it, and in its own if there is none: `original` is
    what is on the screen, and a run whose words all stand in its language already needs no change. The longest decided run is
    final: shorter ones are not tried where it needs no change. The word that is being typed stands in its own language.
    """
    sentences = _sentences(words, keys, sensitivity, context, strength, pos, ["visible"])

    def bits(start: Column, end: Column) -> Column:
        """A number with the bits of the places (from 1) `start` to `end`."""
        one = F.lit(1).cast("bigint")
        return F.call_function("shiftleft", one, end) - F.call_function("shiftleft", one, start - 1)

    def left(now: Column, run: Column) -> Column:
        """What is held by runs, and what of that stands in Persian, after one more run."""
        own = bits(run["run"]["start"], run["at"])
        persian = F.when(run["run"]["decision"]["language"] == PERSIAN, now["persian"].bitwiseOR(own)).otherwise(now["persian"].bitwiseAND(F.bitwise_not(own)))
        return F.struct(now["held"].bitwiseOR(own).alias("held"), persian.alias("persian"))

    def walked(so_far: Column, run: Column) -> Column:
        """The runs so far with this one, which knows how its words stand before it."""
        step = F.struct(run["at"].alias("at"), run["run"].alias("run"), so_far["now"].alias("now"))
        return F.struct(left(so_far["now"], run).alias("now"), F.concat(so_far["runs"], F.array(step)).alias("runs")).cast(_WALK)

    made = F.filter(F.transform("__runs", lambda run, at: F.struct((at + 1).cast("int").alias("at"), run.alias("run"))), lambda r: r["run"].isNotNull())
    nothing = F.struct(F.struct(F.lit(0).alias("held"), F.lit(0).alias("persian")).alias("now"), F.array().alias("runs")).cast(_WALK)
    walk = F.aggregate(made, nothing, walked, lambda found: found["runs"])
    each = sentences.select(*keys, "__w", F.explode(walk).alias("__r"))
    end, language = F.col("__r.at"), F.col("__r.run.decision.language")

    def shown(word: Column, i: Column) -> Column:
        place = (F.col("__r.run.start") - 1 + i).cast("int")
        persian = F.when(F.getbit(F.col("__r.now.persian"), place) == 1, PERSIAN).otherwise(ENGLISH)
        now = F.when(F.getbit(F.col("__r.now.held"), place) == 1, persian).otherwise(word["visible"])
        return let(now, lambda now: F.struct(
            in_language(now, word["en"], word["fa"]).alias("a"), in_language(language, word["en"], word["fa"]).alias("b"), (now != language).alias("other")
        ))

    # Exploded, so that a filter on what is made of the texts does not make them once more.
    texts = each.withColumn("__t", F.explode(F.array(F.transform(F.slice("__w", F.col("__r.run.start"), end - F.col("__r.run.start") + 1), shown))))
    # A history and the word after it always fit a phrase, so every decided run has its texts.
    return texts.select(
        *keys, end.alias(pos), "__r.run.start", language.alias("language"), F.col("__r.run.decision.confidence").alias("confidence"), F.exists("__t", lambda t: t["other"]).alias("needs_change"),
        T.phrase(F.transform("__t", lambda t: t["a"])).alias("original"), T.phrase(F.transform("__t", lambda t: t["b"])).alias("replacement"),
    )


_WALK = f"struct<now:struct<held:bigint,persian:bigint>,runs:array<struct<at:int,run:{_RUN},now:struct<held:bigint,persian:bigint>>>>"
