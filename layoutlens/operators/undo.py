"""Which edits are taken back: the next key after an edit, if it comes in time and in the same window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layoutlens.operators import ordered as O

TTL_MS = 15_000
EDIT, BACK, HOTKEY, MODIFIER = "edit", "back", "hotkey", "modifier"


def undone(events: DataFrame, keys: list[str], order: str = "seq", time: str = "ts_ms", ttl_ms: int = TTL_MS) -> DataFrame:
    """keys, the order and time of each undo, age_ms, delete_count, restored, delimiter, target_language.

    `events` are edits (kind, window_id, original, replacement, delimiter, source_language) and what else is typed. A plain Backspace or the undo
    hotkey undoes the edit before it in the same window within `ttl_ms` (which still counts); modifiers in between do not matter, anything else, a click too,
    makes an edit final. What the edit wrote is deleted with its delimiter; the hotkey types the delimiter again, Backspace does not.
    """
    wrote = ["kind", "window_id", time, "original", "replacement", "delimiter", "source_language"]

    def small(few: DataFrame) -> DataFrame:
        last = F.lag(F.struct(*wrote)).over(Window.partitionBy(*keys).orderBy(order))
        return few.withColumn("__e", last).select("*", *[F.col("__e")[c].alias(f"__e_{c}") for c in wrote]).drop("__e")

    def large(many: DataFrame) -> DataFrame:
        return O.before(O.dealt(many, keys, [order]), keys, wrote, "__e_").drop("__p", "__i")

    rows = O.each_way(events.filter(F.col("kind") != MODIFIER), keys, small, large)
    age = F.col(time) - F.col(f"__e_{time}")
    asked = F.col("kind").isin(BACK, HOTKEY) & (F.col("__e_kind") == EDIT) & F.col("window_id").eqNullSafe(F.col("__e_window_id")) & (age <= ttl_ms)
    return rows.filter(asked).select(
        *keys, order, time, age.alias("age_ms"), (F.length("__e_replacement") + F.coalesce(F.length("__e_delimiter"), F.lit(0))).cast("bigint").alias("delete_count"),
        F.col("__e_original").alias("restored"), F.when(F.col("kind") == HOTKEY, F.col("__e_delimiter")).alias("delimiter"), F.col("__e_source_language").alias("target_language"),
    )
