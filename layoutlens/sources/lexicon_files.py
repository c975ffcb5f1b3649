"""Dictionary, frequency, package and Bloom files, and the checks on them."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from layoutlens.functions import text as T
from layoutlens.operators.lexicon import TIERS, require_same

# Fixed values of the file format.
MAGIC = "KSWB"
HEADER = 16
MOST_HASHES = 16


def dictionary_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: the lines of UTF-8 dictionaries (a file or a folder of them) without each file's first (a count) and without byte order marks.

    A file's first line is the least row of its block at 0: rows of a block are numbered in order, whatever the partition.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    first = raw.filter("block = 0").groupBy(F.col("file").alias("of")).agg(F.min("row").alias("first"))
    kept = raw.join(first, (F.col("file") == F.col("of")) & (F.col("row") == F.col("first")), "left_anti")
    return kept.select(F.regexp_replace("value", "^\ufeff", "").alias("line"))


def ranked_words(spark: SparkSession, path: str) -> DataFrame:
    """word, rank from a frequency list with a header."""
    return spark.read.csv(path, header=True, schema="word string, rank bigint")


def require_version(spark: SparkSession, path: str, expected: str) -> None:
    found = spark.read.json(path, multiLine=True, schema="version string").first()
    if found is None or found["version"] != expected:
        raise ValueError(f"{path}: expected {expected}, found {found and found['version']}")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def require_checksums(spark: SparkSession, expected: dict[str, str]) -> None:
    for path, digest in expected.items():
        if (found := checksums(spark, path).first()) is None or found["sha256"] != digest:
            raise ValueError(f"checksum mismatch: {path}")


def bloom_files(spark: SparkSession, path: str) -> DataFrame:
    """path, bits, hashes, valid, content of Bloom files: magic, version 1, bits a power of two, 1 to 16 hashes, exact size."""
    files = spark.read.format("binaryFile").load(path)
    number = lambda at: F.conv(_little(at), 16, 10).cast("bigint")
    read = files.select("path", "content", "length", number(5).alias("version"), number(9).alias("bits"), number(13).alias("hashes"))
    valid = (
        (F.col("length") >= HEADER)
        & (F.substring("content", 1, 4) == F.lit(MAGIC).cast("binary"))
        & (F.col("version") == 1)
        & (F.col("bits") > 0)
        & (F.col("bits").bitwiseAND(F.col("bits") - 1) == 0)
        & F.col("hashes").between(1, MOST_HASHES)
        & (F.col("length") == HEADER + F.floor(F.col("bits") / 8))
    )
    return read.select("path", "bits", "hashes", F.coalesce(valid, F.lit(False)).alias("valid"), "content")


def _little(at: int):
    """Hexadecimal digits of the little-endian 32-bit number at a place (from 1)."""
    return F.concat(*[F.hex(F.substring("content", at + k, 1)) for k in (3, 2, 1, 0)])


def bloom_positions(files: DataFrame) -> DataFrame:
    """path, bit: the set positions of valid Bloom files."""
    body = F.hex(F.substring("content", HEADER + 1, 1 << 30))
    places = files.filter("valid").select("path", F.posexplode(F.split(F.regexp_replace(body, "(..)", "$1 "), " ")).alias("byte", "digits")).filter("digits <> '' AND digits <> '00'")
    bits = F.expr("filter(sequence(0, 7), k -> (shiftright(cast(conv(digits, 16, 10) AS int), k) & 1) = 1)")
    return places.select("path", F.explode(bits).alias("k"), "byte").select("path", (F.col("byte") * 8 + F.col("k")).cast("bigint").alias("bit"))


#: Bits of one packed chunk, as `bitmap_construct_agg` makes them: bit k of a chunk is bit k % 8 of byte k / 8, as in the files.
CHUNK = 32_768


def bloom_chunks(words: DataFrame, filters: dict) -> DataFrame:
    """name, bits, hashes, chunk, bitmap: the Bloom filters of the words (form and more) in packed chunks of CHUNK bits; chunk -1 (without bitmap) stands for each file.

    `filters` has for each name a condition on the words that it holds, its bits (a power of two) and its hashes. Every word is hashed once for
    all of them, and bits are packed before they are shuffled.
    """
    nothing = F.array().cast("array<struct<file:int,bit:bigint>>")
    own = words.withColumn("pair", F.explode(F.array(T.hash_pair(F.col("form")))))

    def mark(k: int, holds: Column, bits: int, hashes: int) -> Column:
        spots = T.bit_positions(F.col("pair"), bits, hashes)
        return F.when(holds, F.transform(spots, lambda b: F.struct(F.lit(k).alias("file"), b.alias("bit")))).otherwise(nothing)

    marks = [mark(k, *each) for k, each in enumerate(filters.values())]
    found = own.select(F.explode(F.concat(*marks)).alias("m")).select("m.*")
    packed = found.groupBy("file", F.expr(f"cast(bit div {CHUNK} AS int)").alias("chunk")).agg(F.bitmap_construct_agg(F.col("bit") % CHUNK).alias("bitmap"))
    rows = [(k, name, bits, hashes) for k, (name, (_, bits, hashes)) in enumerate(filters.items())]
    files = F.broadcast(words.sparkSession.createDataFrame(rows, "file int, name string, bits bigint, hashes bigint"))
    every = packed.unionByName(files.select("file", F.lit(-1).alias("chunk"), F.lit(None).cast("binary").alias("bitmap")))
    return every.join(files, "file").select("name", "bits", "hashes", "chunk", "bitmap")


class BloomFiles(DataSource):
    """A batch sink for `bloom_chunks`: executors write the files, and a commit gives them their names."""

    @classmethod
    def name(cls) -> str:
        return "bloom_files"

    def schema(self) -> str:
        raise ValueError("this is a sink")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return BloomWriter(self.options["path"])


class Drafts(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]) -> None:
        self.names = names


class BloomWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def _opened(self) -> tuple[fs.FileSystem, str]:
        files, folder = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        return files, folder.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Drafts:
        """Rows come by name and chunk: a task holds one chunk. Chunks that no word has set are zeros."""
        files, folder = self._opened()
        files.create_dir(folder, recursive=True)
        made, out, at, size = [], None, 0, 0

        def close() -> None:
            if out is not None:
                out.write(bytes(size - at))
                out.close()

        for batch in iterator:
            for name, bits, hashes, chunk, bitmap in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if chunk < 0:
                    close()
                    made.append((f"{folder}/{uuid.uuid4().hex}.draft", f"{folder}/{name}.bloom"))
                    out, at, size = files.open_output_stream(made[-1][0]), 0, bits // 8
                    out.write(MAGIC.encode() + struct.pack("<III", 1, bits, hashes))
                    continue
                start = chunk * CHUNK // 8
                out.write(bytes(start - at) + bitmap[: size - start])
                at = min(size, start + CHUNK // 8)
        close()
        return Drafts(made)

    def commit(self, messages: list[Drafts | None]) -> None:
        files, _ = self._opened()
        for draft, name in (pair for m in messages if m for pair in m.names):
            if files.get_file_info(name).type == fs.FileType.File:
                files.delete_file(name)
            files.move(draft, name)

    def abort(self, messages: list[Drafts | None]) -> None:
        files, _ = self._opened()
        for draft, _name in (pair for m in messages if m for pair in m.names):
            files.delete_file(draft)


def write_blooms(words: DataFrame, filters: dict, path: str) -> None:
    """The Bloom files NAME.bloom of `filters` (see `bloom_chunks`) in a folder that driver and executors reach."""
    words.sparkSession.dataSource.register(BloomFiles)
    chunks = bloom_chunks(words, filters).repartition("name").sortWithinPartitions("name", "chunk")
    chunks.write.format("bloom_files").mode("append").option("path", path).save()


# Bits and hashes of the filters of either language.
FILTERS = {
    (1, "is_word"): (1 << 21, 9), (2, "is_word"): (1 << 22, 9), (1, "is_prefix"): (1 << 21, 14), (2, "is_prefix"): (1 << 21, 14),
    (1, "is_common"): (1 << 20, 10), (2, "is_common"): (1 << 20, 10), (1, "is_frequent"): (1 << 17, 10), (2, "is_frequent"): (1 << 17, 10),
    (1, "is_common_prefix"): (1 << 20, 14), (2, "is_common_prefix"): (1 << 20, 14),
}


def write_package(lexicon: DataFrame, priors: DataFrame, path: str) -> None:
    """The lexicon, the priors in order of the English word, and the ten Bloom files (each of a fixed size)."""
    spark = lexicon.sparkSession
    lexicon.write.mode("overwrite").parquet(f"{path}/lexicon")
    priors.orderBy("english").write.mode("overwrite").parquet(f"{path}/priors")
    stored = spark.read.schema(lexicon.schema).parquet(f"{path}/lexicon")
    wanted = {f"{lang}-{tier}": ((F.col("lang") == lang) & F.col(tier), bits, hashes) for (lang, tier), (bits, hashes) in FILTERS.items()}
    write_blooms(stored, wanted, f"{path}/bloom")


def read_package(spark: SparkSession, path: str, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lexicon, priors and Bloom files of a package. All ten filters must be valid and all tiers there, or nothing is loaded; with `expected`, so must its rows."""
    lexicon, priors = spark.read.parquet(f"{path}/lexicon"), spark.read.parquet(f"{path}/priors")
    files = bloom_files(spark, f"{path}/bloom")
    name = F.element_at(F.split("path", "/"), -1)
    valid = {r["name"] for r in files.filter("valid").select(name.alias("name")).collect()}
    missing = [f"{lang}-{tier}.bloom" for lang, tier in FILTERS if f"{lang}-{tier}.bloom" not in valid]
    present = {r["lang"]: [r[t] for t in TIERS] for r in lexicon.groupBy("lang").agg(*[F.bool_or(t).alias(t) for t in TIERS]).collect()}
    missing += [f"lexicon {lang}" for lang in (1, 2) if not all(present.get(lang, [False]))]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    if expected is not None:
        require_same(lexicon, expected)
    return lexicon, priors, files
