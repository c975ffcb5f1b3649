"""Streams of words looked up in a lexicon of any size, and counts of what passes.

Each micro-batch is a batch: the lexicon is read again for it, so that one written meanwhile is taken up, and joined by the operators that batches use (broadcast
only where it was counted to be small, else by shuffle). The batch's id makes the output idempotent: its rows replace those of an earlier try.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from layoutlens.operators import classify as C
from layoutlens.operators import decide as D

COUNTERS = "typing"


def classified(words: DataFrame, lexicon: Callable[[SparkSession], DataFrame], path: str) -> DataStreamWriter:
    """A stream of words (en, fa and more) with their flags, written to `path` as Parquet with a folder for each batch.

    `lexicon` reads the lexicon (see `operators.lexicon.build_lexicon`) anew for every batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        C.classify(batch, lexicon(batch.sparkSession)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return words.writeStream.foreachBatch(run)


def counted(words: DataFrame) -> DataFrame:
    """Words as `operators.typing.words` gives them, with flags and `active`, watched: strokes, words and repairs are told to listeners of COUNTERS as they pass."""
    made = D.basic(F.col("active"), F.lit(2))["should_correct"]
    return words.observe(
        COUNTERS, F.coalesce(F.sum("strokes"), F.lit(0)).cast("bigint").alias("keys_seen"), F.count(F.lit(1)).alias("words_checked"), F.count_if(made).alias("corrections")
    )


class Counters(StreamingQueryListener):
    """Sums of what the batches of all queries with `counted` have told."""

    def __init__(self) -> None:
        self.totals = {"keys_seen": 0, "words_checked": 0, "corrections": 0}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if row := event.progress.observedMetrics.get(COUNTERS):
            self.totals = {name: total + row[name] for name, total in self.totals.items()}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
