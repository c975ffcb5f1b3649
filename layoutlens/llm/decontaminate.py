"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

Words are maximal runs of letters and digits, lower-cased. An item's shingles are its distinct five-word
runs (an item of fewer words has one shingle of all of them; one without words matches nothing). Items
are partitioned by the power of two below their number of shingles; an item's sketch holds the m smallest
hashes of its shingles, where m is one more than the most shingles that an item of its partition may lack
at the wanted containment. A document that contains the item therefore meets the sketch at least once:
the search has no false negatives, at any length of the document. What it finds is verified by exact
comparison of shingle texts.

Joins are broadcast only after their bytes were summed up, up to BROADCAST_BYTES (a row of hashes or of an item's shingles may be
long); beyond that they are shuffled joins, which adaptive execution splits where a shingle or item is hot.

Edge cases: null texts count as empty; texts without words match nothing; documents are told apart by
text, so null or repeated doc_ids and repeated rows each get their own result rows; repeated item_ids are
separate items; an empty benchmark or table of documents gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutlens.llm.common import Scratch, table

SHINGLE = 5
CONTAINMENT = 0.8
#: Bytes of sketches, found pairs or items that may be broadcast.
BROADCAST_BYTES = 20_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _starts(tokens: Column, length: int) -> Column:
    last = F.size(tokens) - length
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shingles(tokens: Column, length: int) -> Column:
    return F.array_distinct(F.transform(_starts(tokens, length), lambda i: F.array_join(F.slice(tokens, i + 1, length), " ")))


def shingle_hashes(tokens: Column, lengths: list[int]) -> Column:
    """Distinct hashes of all runs of these numbers of words."""

    def runs(length: int) -> Column:
        return F.transform(_starts(tokens, length), lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(length)]))

    return F.array_distinct(F.concat(*[runs(n) for n in lengths]))


def _items(benchmark: DataFrame, containment: float) -> DataFrame:
    """item key, item_id, its shingles, their number, and the sketch."""
    tokens = benchmark.select("item_id", F.md5(F.coalesce("text", F.lit(""))).alias("item_key"), words(F.col("text")).alias("w"))
    sized = tokens.withColumn("length", F.least(F.size("w"), F.lit(SHINGLE)))
    own, hashes = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    for n in range(1, SHINGLE + 1):
        own = F.when(F.col("length") == n, shingles(F.col("w"), n)).otherwise(own)
        hashes = F.when(F.col("length") == n, shingle_hashes(F.col("w"), [n])).otherwise(hashes)
    sized = sized.withColumns({"shingles": own, "hashes": hashes})
    partition_top = F.pow(F.lit(2), F.floor(F.log2(F.size("shingles"))) + 1) - 1
    # The small constant keeps (1 - 0.8) * 5 at one: fewer misses than allowed must never be assumed.
    may_lack = F.floor((1 - containment) * partition_top + 1e-9).cast("int")
    return sized.filter(F.size("w") > 0).select(
        "item_id", "item_key", "length", "shingles", F.slice(F.array_sort("hashes"), F.lit(1), may_lack + 1).alias("sketch")
    )


def _small(frame: DataFrame, size: int) -> DataFrame:
    return F.broadcast(frame) if size <= BROADCAST_BYTES else frame


def contained_items(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment: one row for each document row and contained item."""
    scratch = scratch or Scratch(documents.sparkSession, documents)
    items = scratch.keep(_items(benchmark, containment), "items")
    sketch = items.select("item_key", F.explode("sketch").alias("hash")).distinct()
    bytes_of = F.aggregate("shingles", F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x) + 20) + 100
    facts = items.agg(F.collect_set("length").alias("lengths"), F.coalesce(F.sum(F.size("sketch") * 60), F.lit(0)).alias("sketches"), F.coalesce(F.sum(bytes_of), F.lit(0)).alias("items")).first()
    keyed = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    lengths = sorted(facts["lengths"]) or [SHINGLE]
    # The words are a column of their own: inside the lambdas below they would be split anew for each shingle.
    probes = keyed.select("text_key", words(F.col("text")).alias("w")).select("text_key", F.explode(shingle_hashes(F.col("w"), lengths)).alias("hash"))
    found = probes.join(_small(sketch, facts["sketches"]), "hash").select("text_key", "item_key").distinct()
    found = scratch.keep(found, "found")
    # A row for each text and item: no row gathers all items of a text that meets many.
    by_text = found.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"))
    suspects = keyed.join(_small(by_text.select("text_key"), 60 * by_text.count()), "text_key", "left_semi").withColumn("w", words(F.col("text")))
    for n in lengths:
        suspects = suspects.withColumn(f"s{n}", shingles(F.col("w"), n))
    own = F.coalesce(*[F.when(F.col("length") == n, F.col(f"s{n}")) for n in lengths])
    pairs = suspects.select("doc_id", "text_key", *[f"s{n}" for n in lengths]).join(_small(found, 120 * found.count()), "text_key")
    checked = pairs.join(_small(items.select("item_id", "item_key", "length", "shingles"), facts["items"]), "item_key").select(
        "doc_id",
        "item_id",
        F.size(F.array_intersect("shingles", own)).cast("bigint").alias("n_shared"),
        F.size("shingles").cast("bigint").alias("n_shingles"),
    )
    share = F.col("n_shared") / F.col("n_shingles")
    return checked.withColumn("containment", share).filter(share >= containment)


def leaked_texts(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, scratch: Scratch | None = None) -> DataFrame:
    """text_key (md5 of the text) of every text that contains an item."""
    by_text = documents.select(F.md5(F.coalesce("text", F.lit(""))).alias("doc_id"), "text")
    return contained_items(by_text, benchmark, containment, scratch).select(F.col("doc_id").alias("text_key")).distinct()


def without_leaks(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that contain no item, with all their columns, whatever their names."""
    scratch = Scratch(documents.sparkSession, documents)
    leaked = scratch.keep(leaked_texts(documents, benchmark, containment, scratch), "leaked")
    scratch.drop("leaked")
    rows = documents.select(F.struct("*").alias("row"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    return rows.join(_small(leaked, 60 * leaked.count()), "text_key", "left_anti").select("row.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
OP4_SQL = f"""
WITH b AS (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item, item_id, least(len(w), 5) AS k, w FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT item, item_id, k, array_to_string(w[p : p + k - 1], ' ') AS shingle
      FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
n AS (SELECT item, count(*) AS n_shingles FROM s GROUP BY item),
d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT row, doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM s)),
ds AS (SELECT DISTINCT row, doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS shingle FROM g),
m AS (SELECT row, doc_id, item, item_id, count(*) AS n_shared FROM ds JOIN s USING (k, shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM m JOIN n USING (item) WHERE n_shared / n_shingles >= {CONTAINMENT}
"""
