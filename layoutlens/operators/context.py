"""Order-dependent folds: the language context, also where it runs out, and the typing cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layoutlens.functions import text as T
from layoutlens.functions.layout import ENGLISH, OTHER, PERSIAN
from layoutlens.operators import ordered as O

TTL_MS = 90_000
STATE = "struct<language:int,strength:int,observed_words:bigint>"


def observe(state: Column, language: Column, evidence: Column) -> Column:
    """The context after one more word; only English and Persian words are observed."""
    weight = F.greatest(F.least(evidence, F.lit(4)), F.lit(1)).cast("int")
    lang, strength, seen = state["language"], state["strength"], state["observed_words"]
    empty = (lang == OTHER) | (strength <= 0)
    same = lang == language
    left = strength - weight
    new_language = F.when(empty | same, language).when(left > 0, lang).when(left == 0, OTHER).otherwise(language)
    grown = F.when(strength < weight, weight).otherwise(F.least(strength + 1, F.lit(4)))
    new_strength = F.when(empty, weight).when(same, F.greatest(grown, F.least(strength, F.lit(4)))).otherwise(F.abs(left))
    updated = F.struct(new_language.cast("int").alias("language"), new_strength.cast("int").alias("strength"), (seen + 1).alias("observed_words"))
    return F.when(language.isin(ENGLISH, PERSIAN), updated).otherwise(state).cast(STATE)


def fold_context(observations: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The final context of each group of (language, evidence) in `order` (a column that sorts, a struct for instance): keys, language, strength, observed_words.

    What a run of words does to a context depends on nothing but the context before it, and there are few: none, and
    four strengths of either language. Each segment of words is folded from all of them at once, so segments of one group
    are folded apart and only their tables (nine entries) are put together: no row holds a whole group. A group's first segment is folded from no context alone.
    """
    rows = observations.select(*keys, F.col(order).alias("__order"), "language", "evidence")
    return O.each_way(rows, keys, lambda few: _folded(O.numbered(few, keys, "__order"), keys, True), lambda many: _folded(O.dealt(many, keys, ["__order"]), keys))


def _folded(rows: DataFrame, keys: list[str], whole: bool = False) -> DataFrame:
    """The contexts after dealt rows, or (`whole`) after rows of groups that are one task's."""
    starts = F.array(*[F.struct(F.lit(lang).alias("language"), F.lit(s).alias("strength")) for lang, s in _CONTEXTS])
    as_state = lambda x: F.struct(x["language"].alias("language"), x["strength"].alias("strength"), F.lit(0).cast("bigint").alias("observed_words")).cast(STATE)
    if whole:
        starts = F.when(F.col("__s") == 0, F.slice(starts, F.lit(1), F.lit(1))).otherwise(starts)
    step = lambda a, r: O.let(a, lambda a: observe(a, r["language"], r["evidence"]))
    folded = F.transform(starts, lambda s: F.aggregate(F.col("__rows"), as_state(s), step))
    tables = O.segment_lists(rows, keys, ["language", "evidence"]).withColumn("__to", folded)
    found = (O.chained if whole else O.composed)(tables, keys, lambda a, b: F.transform(a, lambda s: _after(s, b)))
    return found.select(*keys, F.get("__to", F.lit(0)).alias("__s")).select(*keys, "__s.*")


_CONTEXTS = [(OTHER, 0)] + [(lang, s) for lang in (ENGLISH, PERSIAN) for s in (1, 2, 3, 4)]


def _after(state: Column, table: Column) -> Column:
    """What a later segment's table makes of a state."""
    spot = F.when((state["language"] == OTHER) | (state["strength"] <= 0), 0).otherwise((state["language"] - 1) * 4 + state["strength"])
    later = F.get(table, spot)
    return F.struct(
        later["language"].alias("language"), later["strength"].alias("strength"), (state["observed_words"] + later["observed_words"]).alias("observed_words")
    ).cast(STATE)


def fold_sessions(observations: DataFrame, keys: list[str], time: str = "ts_ms", window: str = "window_id", tie: str | None = None, ttl_ms: int = TTL_MS) -> DataFrame:
    """The contexts that each group goes through: keys, session (from 1), window, since_ms, until_ms (first and last word), language, strength, observed_words.

    Words (language, evidence) of one window go on with the context until more than `ttl_ms` have passed without one (exactly `ttl_ms` still counts), or
    another window is written in; then it is forgotten. Words of other languages are not observed and keep nothing alive. `tie` orders words of one time.
    """
    own = observations.filter(F.col("language").isin(ENGLISH, PERSIAN)).select(
        *keys, F.col(time).cast("bigint").alias("__ts"), F.col(window).alias("__window"), "language", "evidence", (F.col(tie) if tie else F.lit(0)).alias("__tie")
    )
    rows = O.before(O.dealt(own, keys, ["__ts", "__tie"]), keys, ["__ts", "__window"], "__prev")
    goes_on = F.col("__prev__ts").isNotNull() & F.col("__prev__window").eqNullSafe(F.col("__window")) & (F.col("__ts") - F.col("__prev__ts") <= ttl_ms)
    numbered = O.running_sum(rows, keys, (~goes_on).cast("int"), "session")
    facts = numbered.groupBy(*keys, "session").agg(F.first("__window").alias(window), F.min("__ts").alias("since_ms"), F.max("__ts").alias("until_ms"))
    same = F.expr(" AND ".join(f"l.`{k}` <=> r.`{k}`" for k in [*keys, "session"]))
    words = numbered.select(*keys, "session", F.struct("__p", "__i").alias("order"), "language", "evidence")
    joined = facts.alias("l").join(fold_context(words, [*keys, "session"], "order").alias("r"), same)
    return joined.select("l.*", "r.language", "r.strength", "r.observed_words")


def current(language: Column, strength: Column, age_ms: Column, mode: Column) -> Column:
    """struct<language, strength> in force: a chosen mode (1 Persian, 2 English) with strength 5, else what is not outdated."""
    fresh = (age_ms <= TTL_MS) & (strength > 0) & language.isin(ENGLISH, PERSIAN)
    return F.struct(
        F.when(mode == 1, PERSIAN).when(mode == 2, ENGLISH).when(fresh, language).otherwise(OTHER).alias("language"),
        F.when(mode.isin(1, 2), 5).when(fresh, strength).otherwise(0).alias("strength"),
    )


def key_intervals(events: DataFrame, keys: list[str], time: str = "ts_ms", tie: str | None = None) -> DataFrame:
    """`events` with `interval`: ms since the key before in the same word, null for a word's first. `tie` orders events of one time."""
    order = Window.partitionBy(*keys).orderBy(time, *([tie] if tie else []))
    return events.withColumn("interval", F.col(time) - F.lag(time).over(order))


#: Cadences that a step starts from: others count as the middle one.
SLOWEST, FASTEST, MIDDLE = 500, 40, 150
#: Steps after which the cadences that a segment may have begun with have mostly become the same few.
_MERGED = 40


def fold_cadence(intervals: DataFrame, keys: list[str], order: str = "pos", start: int = MIDDLE) -> DataFrame:
    """The running key interval of each group after its intervals in `order`: keys, cadence.

    Every step rounds down, so intervals cannot be summed up; but a step starts from one of 461 cadences only. Each segment
    of intervals is a table from those to the cadence that it ends with, and the tables of a group are put together. Most cadences become the same within
    _MERGED steps (each brings two of them closer by a quarter), so the rest of a segment is folded from the few that are left.
    """
    rows = intervals.filter(F.col("interval").isNotNull()).select(*keys, F.col(order).alias("__order"), F.col("interval").cast("bigint").alias("__x"))
    step = lambda x, r: T.next_cadence(x, r["__x"])
    fold = lambda states, steps: F.aggregate(steps, states, lambda a, r: F.transform(a, lambda x: step(x, r)))
    every = F.sequence(F.lit(FASTEST).cast("bigint"), F.lit(SLOWEST).cast("bigint"))
    first, rest = F.slice("__rows", F.lit(1), F.lit(_MERGED)), F.slice("__rows", F.lit(_MERGED + 1), F.lit(O.SEGMENT))
    ends = lambda a, few: O.let(fold(few, rest), lambda b: F.transform(a, lambda x: F.get(b, F.array_position(few, x).cast("int") - 1)))
    table = O.let(fold(every, first), lambda a: O.let(F.array_distinct(a), lambda few: ends(a, few)))
    spot = lambda x: F.when(x.between(FASTEST, SLOWEST), x).otherwise(MIDDLE).cast("int") - FASTEST
    after = lambda a, b: F.transform(a, lambda x: F.get(b, spot(x)))

    def small(few: DataFrame) -> DataFrame:
        """A group's first segment begins with `start`, so it is a table of one entry."""
        known = F.array(F.aggregate("__rows", F.lit(start).cast("bigint"), step))
        tables = O.segment_lists(O.numbered(few, keys, "__order"), keys, ["__x"]).withColumn("__to", F.when(F.col("__s") == 0, known).otherwise(table))
        return O.chained(tables, keys, after).select(*keys, F.get("__to", F.lit(0)).alias("cadence"))

    def large(many: DataFrame) -> DataFrame:
        tables = O.segment_lists(O.dealt(many, keys, ["__order"]), keys, ["__x"]).withColumn("__to", table)
        return O.composed(tables, keys, after).select(*keys, F.get("__to", spot(F.lit(start))).alias("cadence"))

    return O.each_way(rows, keys, small, large)


def with_sentence_start(words: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """`words` with `sentence_start`: whether a word is the first of its sentence."""
    return words.withColumn("sentence_start", F.row_number().over(Window.partitionBy(*keys).orderBy(pos)) == 1)
