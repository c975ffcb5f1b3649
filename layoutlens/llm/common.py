"""What several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. One of our own is set only where none is configured (tests)."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        set_already = context._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            return set_already.get()
        configured = tempfile.mkdtemp(prefix="layoutlens-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(configured)
    return configured


class Scratch:
    """Tables that one run of an operator writes to the shared folder, and drops as soon as nothing reads them.

    With `like`, the rows that the run is about, a table has no more files than these fill: small inputs that come in hundreds of
    partitions would else be written, table after table, as thousands of tiny files. Partitions are put together, never dealt anew,
    and none are where the input is large.
    """

    ROWS, BYTES = 5_000, 16_000_000

    def __init__(self, spark: SparkSession, like: DataFrame | None = None) -> None:
        self.spark, self.paths, self.most = spark, {}, None
        if like is not None:
            size = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            self.most = min(1 << 30, max(spark.sparkContext.defaultParallelism, like.select().count() // self.ROWS, size // self.BYTES))
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"

    def keep(self, frame: DataFrame, label: str, rows: int | None = None) -> DataFrame:
        """Write a frame and read it back: cuts lineage, survives lost executors. `rows`: how many it has at most, if that is known."""
        path = f"{self.root}/{label}-{len(self.paths)}"
        self.paths[path] = label
        most = max(1, min(rows // self.ROWS, self.most or 1 << 30)) if rows is not None else self.most
        frame = frame.coalesce(most) if most else frame
        frame.write.options(compression="zstd", **{"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *but: str) -> None:
        """Delete all tables written so far but those of the labels `but`."""
        for path in [p for p, label in self.paths.items() if label not in but]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            del self.paths[path]


def runs_of(texts, size: int, *more):
    """Ranges (from, to) of rows of an Arrow array (with the arrays `more` beside it) with some `size` bytes of text; a longer row is a range of its own."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = [pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (texts, *more)]
    ends = np.cumsum(sum(lengths))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield a, b
        a = b


def trim() -> None:
    """Give memory that is no longer used back to the system, where the platform can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def released(run):
    """A function over Arrow batches after which its worker gives its memory back.

    Workers outlive their tasks, so what one stage held would otherwise still count in the next. (Functions over groups
    call `trim` themselves: Spark wants to see their arguments.)
    """

    def over(batches):
        yield from run(batches)
        trim()

    return over


def _labelled(spark: SparkSession, sf_dir: str, label: str, most: dict[int, int], modulus: int) -> DataFrame:
    """rank (a hash of id and text), doc_id, text, label of rows whose remainder is not 0, of at most `most[value]` ids of each label value, those of least hash."""
    rows = table(spark, sf_dir, "labels").filter((remainder(F.col("doc_id"), modulus) != 0) & F.col("doc_id").isNotNull())
    rank = F.xxhash64("doc_id")
    chosen = None
    for value, limit in most.items():
        part = rows.filter(F.col(label) == value).select("doc_id", F.lit(value).alias("label")).distinct().orderBy(rank, "doc_id").limit(limit)
        chosen = part if chosen is None else chosen.union(part)
    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").withColumn("rank", F.xxhash64("doc_id", "text"))


def labelled_sample(spark: SparkSession, sf_dir: str, label: str, most: dict[int, int], modulus: int = 5) -> list[tuple[str, int]]:
    """Texts with their labels, of rows whose remainder is not 0, for fitting a model on the driver.

    Bounded: at most `most[value]` ids of each label value, those of least hash, and of their texts as many as ids at
    most, in the order of a hash of id and text, whatever ids repeat. Texts come whole.
    """
    found = _labelled(spark, sf_dir, label, most, modulus).orderBy("rank", "doc_id", "label").limit(sum(most.values())).select("text", "label").toArrow()
    return list(zip(found["text"].to_pylist(), found["label"].to_pylist(), strict=True))


def labelled_texts(spark: SparkSession, sf_dir: str, label: str, most: dict[int, int], modulus: int = 5) -> DataFrame:
    """rank, doc_id, label, text: the rows of `labelled_sample` (there by rank, doc_id and label), for fitting a model on the executors.

    Only keys are sorted and cut; the texts, however long, come to no single task and not to the driver.
    """
    keys = ["rank", "doc_id", "label"]
    rows = _labelled(spark, sf_dir, label, most, modulus)
    chosen = rows.select(*keys).orderBy(*keys).limit(sum(most.values())).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(chosen), keys).dropDuplicates(keys).select(*keys, "text", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).drop("copy")


def label_shares(spark: SparkSession, sf_dir: str, label: str, rows: int, modulus: int = 5) -> dict[int, int]:
    """How many of `rows` labelled rows each label value would have in its natural share."""
    labels = table(spark, sf_dir, "labels").filter((remainder(F.col("doc_id"), modulus) != 0) & F.col("doc_id").isNotNull())
    found = {r[label]: r["count"] for r in labels.filter(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    total = sum(found.values())
    return {value: -(-rows * n // max(rows, total)) for value, n in sorted(found.items())} or {0: 0, 1: 0}
