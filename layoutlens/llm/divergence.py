"""Source divergence audit: sketch-prefiltered counting, then sparse pair joins.

Terms are runs of ASCII letters (A-Z lower-cased) and of anything beyond ASCII. Each language keeps the terms that at least LEAST of its documents hold.

1. Every task counts document frequencies of (lang, term) into count-min cells; the cells of all tasks are added up. They never
   underestimate, so a term whose least cell is under LEAST is impossible. The cells' number follows the table's size up to MOST_CELLS a row;
   beyond that fewer terms are told to be impossible, and the results stay the same.
2. A second pass counts, per task, occurrences and documents of (lang, source, term), and sends only possible terms to the
   shuffle, a row for each with its sources, dealt by (lang, term). There they are counted exactly and terms of too few documents go.
3. A term's share is p = 1 + floor(10**9 * (count + 1) / (N + V)). For two sources of a language, floor((p - q)**2 / q) summed over all V terms
   falls into terms that neither has (one value times their number), that one has (which depends on its count alone: a histogram
   of counts is enough), and that both have: only these are joined, by (lang, term).

Shares are worked out in decimals of 38 digits, sums too; nothing is rounded. No task holds a language, a source or a document's words beyond CHUNK_BYTES of text;
groups' totals are broadcast only if they were counted to be few.

Edge cases: null text, lang and source count as ''; a group without terms has rows for its pairs, and none for terms; a
language without kept terms has values of 0; repeated rows count each time; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layoutlens.llm.common import Scratch, released, table
from layoutlens.llm.sketches import SCHEMA, Cells, cells_for, cut, merged

LEAST = 3
SCALE = 1_000_000_000
TOP = 200
DEPTH = 2
MOST_CELLS = 1 << 24
#: Bytes of one text that are split into words at once, and terms that a task counts before it sends them on.
CHUNK_BYTES, HELD_TERMS = 4_000_000, 400_000
BROADCAST_ROWS = 100_000

#: Other bytes become spaces, A-Z their lower case.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_OTHER = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")


def _terms(text: bytes) -> Iterator[list[bytes]]:
    for part in cut(text, CHUNK_BYTES, _OTHER):
        yield part.translate(_FOLD).split()


def _hashes(lang: str, terms: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), dtype=np.uint64, count=len(terms))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, str, bytes]]:
    lang, source = (batch.column(k).to_pylist() for k in (0, 1))
    for k, text in enumerate(batch.column(2)):
        yield lang[k], source[k], text.as_buffer().to_pybytes() if text.is_valid else b""


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))


def document_frequencies(documents: DataFrame, width: int) -> Cells:
    """Merged count-min cells of how many documents of its language hold a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held = Cells(width, DEPTH), defaultdict(Counter)

        def settle() -> None:
            for lang, counts in held.items():
                terms = list(counts)
                cells.add(_hashes(lang, terms), np.fromiter(counts.values(), dtype=np.int64, count=len(terms)))
            held.clear()

        for batch in batches:
            for lang, _, text in _rows(batch):
                held[lang].update(set().union(*_terms(text)))
                if sum(map(len, held.values())) > HELD_TERMS:
                    settle()
        settle()
        yield from cells.blocks(TaskContext.get().partitionId())

    return merged(_plain(documents).mapInArrow(released(run), SCHEMA), width, DEPTH)


def _by_term(lang: str, found: list[tuple[str, list[bytes], list[int], list[int]]]) -> pa.RecordBatch:
    """Counts of several sources as a row for each term."""
    codes = pa.array([t for _, terms, _, _ in found for t in terms], pa.binary()).dictionary_encode()
    at = codes.indices.to_numpy()
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(codes.dictionary) + 1))
    owner = np.repeat(np.arange(len(found), dtype=np.int32), [len(terms) for _, terms, _, _ in found])[order]
    columns = [np.array([x for f in found for x in f[k]], dtype=np.int64)[order] for k in (2, 3)]
    each = pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()).take(pa.array(owner)), *map(pa.array, columns)], names=["source", "n", "df"])
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), each)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(lists), pa.string()), codes.dictionary.cast(pa.string()), lists], names=["lang", "term", "sources"])


def term_counts(documents: DataFrame, cells: Cells, least: int = LEAST) -> DataFrame:
    """lang, term, sources (source, n occurrences, df documents): partial counts of the terms that may be in `least` documents."""
    width, sketch = cells.width, documents.sparkSession.sparkContext.broadcast(cells.table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cells(width, DEPTH, sketch.value)
        counts, holders = defaultdict(Counter), defaultdict(Counter)

        def send() -> Iterator[pa.RecordBatch]:
            by_lang = defaultdict(list)
            for (lang, source), found in counts.items():
                terms = list(found)
                chosen = [terms[k] for k in np.flatnonzero(own.least(_hashes(lang, terms)) >= least).tolist()]
                by_lang[lang].append((source, chosen, [found[t] for t in chosen], [holders[lang, source][t] for t in chosen]))
            counts.clear()
            holders.clear()
            for lang, found in by_lang.items():
                yield _by_term(lang, found)

        for batch in batches:
            for lang, source, text in _rows(batch):
                seen: set[bytes] = set()
                for words in _terms(text):
                    counts[lang, source].update(words)
                    seen.update(words)
                holders[lang, source].update(seen)
                if sum(map(len, counts.values())) > HELD_TERMS:
                    yield from send()
        yield from send()

    return _plain(documents).mapInArrow(released(run), "lang string, term string, sources array<struct<source:string,n:bigint,df:bigint>>")


def kept_terms(documents: DataFrame, least: int = LEAST, width: int | None = None) -> DataFrame:
    """lang, source, term, n, lang_n (its occurrences in the language), first (one row of each term of a language): terms in at least `least` documents of their language."""
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cells = document_frequencies(documents, width or cells_for(size // 128, most=MOST_CELLS))
    # Dealt once, by (lang, term): what follows needs no other exchange.
    dealt = term_counts(documents, cells, least).repartition("lang", "term").select("lang", "term", F.explode("sources").alias("s")).select("lang", "term", "s.*")
    exact = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    known = exact.withColumns({"lang_n": F.sum("n").over(term), "all_df": F.sum("df").over(term), "least_source": F.min("source").over(term)})
    return known.filter(F.col("all_df") >= least).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("least_source")).alias("first"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / (total + terms)), without rounding."""
    wide = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + _div(wide, (total + terms).cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); shares are within 10**9 + 1, so that squares fit in 64 bits."""
    return _div((p - q) * (p - q), q)


def _exact_sum(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,0)"))


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    chosen = ranked.filter(F.col("rank") <= most) if most else ranked
    return chosen.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _small(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def divergence(documents: DataFrame, least: int = LEAST, top: int = TOP, width: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and by which terms from the language."""
    scratch = scratch or Scratch(documents.sparkSession, documents)
    kept = scratch.keep(kept_terms(documents, least, width), "kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    langs = kept.filter("first").groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    found = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = found.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "own", "lang_total", "terms"])
    # p0: the share of a term that the group lacks.
    none = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1)
    groups = scratch.keep(totals.withColumn("p0", none), "groups")
    few = groups.count()
    shared = scratch.keep(kept.join(_small(groups.select("lang", "source", "total", "lang_total", "terms"), few), ["lang", "source"]).select(
        "lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("lang_p")
    ), "shares")

    other = lambda frame: frame.select("lang", *[F.col(c).alias(f"other_{c}") for c in frame.columns if c != "lang"])
    pairs = groups.join(_small(other(groups.select("lang", "source", "total", "own", "p0")), few), "lang").filter(F.col("source") != F.col("other_source"))
    # What terms of one side add, were they lacking in the other: by their count alone.
    counts = shared.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    sides = counts.join(_small(other(groups.select("lang", "source", "p0")), few), "lang").filter(F.col("source") != F.col("other_source"))
    k, p, p0 = F.col("k").cast("decimal(19,0)"), F.col("p"), F.col("other_p0")
    mine = sides.groupBy("lang", "source", "other_source").agg(_exact_sum(k * _apart(p, p0)).alias("mine"), _exact_sum(k * _apart(p0, p)).alias("theirs"))
    theirs = mine.select("lang", F.col("other_source").alias("source"), F.col("source").alias("other_source"), "theirs")
    # Terms that both have: what they add instead.
    here = shared.select("lang", "term", "source", "p").join(_small(groups.select("lang", "source", "p0"), few), ["lang", "source"])
    there = other(here.select("lang", "source", "p", "p0", "term")).withColumnRenamed("other_term", "term")
    both = here.join(there, ["lang", "term"]).filter(F.col("source") != F.col("other_source"))
    own_p0, q = F.col("p0"), F.col("other_p")
    instead = _apart(p, q) - _apart(p, p0) - _apart(own_p0, q)
    common = both.groupBy("lang", "source", "other_source").agg(_exact_sum(instead).alias("instead"), F.count(F.lit(1)).alias("common"))
    keys = ["lang", "source", "other_source"]
    every = pairs.join(mine.drop("theirs"), keys, "left").join(theirs, keys, "left").join(common, keys, "left").fillna(0, ["mine", "theirs", "instead", "common"])
    neither = (F.col("terms") - F.col("own") - F.col("other_own") + F.col("common")).cast("decimal(19,0)") * _apart(F.col("p0"), F.col("other_p0"))
    value = F.coalesce("mine", F.lit(0)) + F.coalesce("theirs", F.lit(0)) + F.coalesce("instead", F.lit(0)) + neither
    by_pair = every.select("lang", "source", F.col("other_source").alias("item"), F.when(F.col("terms") > 0, value).otherwise(0).cast("bigint").alias("value"))
    by_term = shared.filter(F.col("p") > F.col("lang_p")).select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("lang_p")).alias("value"))
    return _ranked(by_pair, "pair").union(_ranked(by_term, "term", top))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST}),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
ln AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, term),
gt AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (gt.total + v.v)::HUGEINT AS p
      FROM gt JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
q AS (SELECT ln.lang, ln.term, 1 + ({SCALE}::HUGEINT * (ln.n + 1)::HUGEINT) // (ln.total + v.v)::HUGEINT AS q FROM ln JOIN v USING (lang)),
terms AS (SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS r FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= {TOP}
"""
