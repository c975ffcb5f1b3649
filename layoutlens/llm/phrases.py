"""Phrase collocation mining over vertical positional inverted lists.

1. Documents are cut into segments of one language (some SEGMENT_WORDS words; a longer text into several). A segment is kept as an
   inverted list: its words, and for each the ascending positions where it stands. Between pieces a position is left free, so
   neighbours in number are neighbours in a piece. Where a piece goes on in the next segment, that segment begins with the last words
   before it, whose positions extend phrases but are not counted again.
2. The lengths of a word's lists, summed over all segments, are its exact frequency. Words of at least LEAST are frequent.
3. In every segment the lists of frequent words are merged by position; a position that follows another extends that word to a
   pair. Lists of equal pairs give their counts, which are summed by shuffle: a row for each bucket of first words, with all that follows each, dealt by
   bucket; where a first word is hot, the second one decides the bucket too. There are the more buckets the more words there are. Frequent pairs are extended alike, by merging their
   end positions with the lists of words one further on, where the last two words are a frequent pair too.
4. Which words and pairs are frequent is told to tasks by membership cells of bounded size (`sketches`): they never deny a frequent
   one, and what they let through in vain fails the exact count. So there is no size at which the way changes.
5. Candidates get the frequencies of their parts by joins, which are broadcast only where the parts were counted to be few.

Scores are worked out in decimals of 38 digits. No task holds more than a segment for each language it meets (all are put away when they hold
SEGMENT_WORDS together), one part of a text, and the distinct phrases of one segment.

Edge cases: null texts have no words; null lang is `und` (and one with rows of that name); repeated rows count each time; a language without
candidates has no rows; an empty table gives none; words may hold any other character; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layoutlens.llm.common import Scratch, released, table
from layoutlens.llm.sketches import SCHEMA, Cells, cells_for, cut, merged

LEAST = 10
MOST_WORDS = 3
TOP = 2_000
INSIDE = 50
SEGMENT_WORDS = 600_000
PART_BYTES = 1_000_000
DEPTH = 2
MOST_CELLS = 1 << 24
#: Words with more than 1 / HOT of all places have their phrases dealt by the second word too; a bucket of first words has some BUCKET_WORDS of all places.
HOT, BUCKET_WORDS = 2_000, 1_000_000
BROADCAST_ROWS = 200_000

_ENDS = re.compile(rb"[.,;:!?\x0a-\x0d]")
_BLANK = re.compile(rb"[\x20\x09]")
#: A-Z their lower case, tabs spaces, and one character for all that end a piece.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_END = b"."


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


class _Segment:
    """Words of one language, numbered as they come; number 0 is the end of a piece."""

    def __init__(self, before: list[bytes] | None = None) -> None:
        self.ids, before = _Ids({_END: 0}), before or []
        self.runs = [np.array([self.ids[w] for w in before], dtype=np.int32)]
        self.own_from = self.size = len(before)

    def add(self, part: bytes) -> None:
        tokens = part.translate(_FOLD).replace(_END, b" . ").split()
        self.runs.append(np.fromiter(map(self.ids.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
        self.size += len(tokens)

    def lists(self, lang: str) -> tuple[pa.RecordBatch | None, list[bytes]]:
        """The inverted lists as a row, and the words that the next segment of the piece begins with."""
        at = np.concatenate(self.runs)
        words, sizes = list(self.ids), np.bincount(at, minlength=len(self.ids))
        tail = at[-(MOST_WORDS - 1) :]
        ends = np.flatnonzero(tail == 0)
        before = [words[k] for k in (tail[ends[-1] + 1 :] if len(ends) else tail)]
        if len(words) == 1:
            return None, before
        own = np.bincount(at[self.own_from :], minlength=len(words))
        positions = np.argsort(at, kind="stable")[sizes[0] :].astype(np.int32)
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
        columns = [pa.array([lang]), pa.array([self.own_from], pa.int32()), one(pa.array(words[1:], pa.binary()).cast(pa.string()), None), one(sizes[1:], pa.int32()), one(own[1:], pa.int64()), pa.array([positions.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "own_from", "words", "sizes", "own", "positions"]), before


SEGMENTS = "lang string, own_from int, words array<string>, sizes array<int>, own array<bigint>, positions binary"


def _parts(text: bytes) -> Iterator[bytes]:
    for piece in cut(text, PART_BYTES, _ENDS):
        yield from cut(piece, PART_BYTES, _BLANK) if len(piece) > 2 * PART_BYTES else (piece,)


def segments(documents: DataFrame, size: int = SEGMENT_WORDS) -> DataFrame:
    """The inverted lists (SEGMENTS) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Segment] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in _parts(text.as_buffer().to_pybytes()) if text.is_valid else ():
                    held.setdefault(lang, _Segment()).add(part)
                    if sum(s.size for s in held.values()) > size:
                        # The text goes on in a segment that knows the words before.
                        done = {name: s.lists(name) for name, s in held.items()}
                        yield from (row for row, _ in done.values() if row)
                        held = {lang: _Segment(done[lang][1])}
                if lang in held:
                    held[lang].add(_END)
        yield from (row for row, _ in (s.lists(name) for name, s in held.items()) if row)

    return documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(released(run), SEGMENTS)


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a pair of words from theirs."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def membership(phrases: DataFrame, entries: int, most: int = MOST_CELLS) -> Cells:
    """Cells that are set for every (lang, phrase) of a frame: phrases of one or two words."""
    width = cells_for(8 * entries, most=most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(width, DEPTH)
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            words = [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
            for lang in set(langs):
                at = np.flatnonzero(langs == lang).tolist()
                first, last = _hashes(lang, [words[k][0] for k in at]), _hashes(lang, [words[k][-1] for k in at])
                single = np.array([len(words[k]) == 1 for k in at])
                cells.add(np.where(single, first, _joined(first, last)), np.ones(len(at), dtype=np.int64))
        yield from cells.blocks(TaskContext.get().partitionId())

    return merged(phrases.select("lang", "phrase").mapInArrow(released(run), SCHEMA), width, DEPTH)


def _joined_runs(texts: pa.Array, starts: np.ndarray, end: int, separator: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[starts, end], pa.int32()), texts), separator)


def _counted(lang: str, words: pa.Array, hot: np.ndarray, hashes: np.ndarray, buckets: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of word numbers with their counts: a row for each bucket of first words, `head tail,tail:count;head ...`."""
    key, base = columns[0].astype(np.int64), len(words)
    for column in columns[1:]:
        # Numbers of prefixes are made dense first, so that keys stay within 64 bits.
        _, inverse = np.unique(key, return_inverse=True)
        key = inverse.astype(np.int64) * base + column
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    if not len(first):
        return
    # Phrases that begin with a hot word are dealt by their second one too.
    head, second = columns[0][first], columns[1][first]
    bucket = (np.where(hot[head], hashes[head] ^ hashes[second], hashes[head]) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((head, bucket))
    first, counts, head, bucket = first[order], counts[order], head[order], bucket[order]
    tails = [words.take(pa.array(c[first])) for c in columns[1:]]
    tail = pc.binary_join_element_wise(*tails, " ") if len(tails) > 1 else tails[0]
    entries = pc.if_else(pa.array(counts > 1), pc.binary_join_element_wise(tail, pa.array(counts).cast(pa.string()), ":"), tail)
    by_head = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (bucket[1:] != bucket[:-1])])
    groups = pc.binary_join_element_wise(words.take(pa.array(head[by_head])), _joined_runs(entries, by_head, len(head), ","), " ")
    by_bucket = np.flatnonzero(np.r_[True, bucket[by_head][1:] != bucket[by_head][:-1]])
    yield pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(by_bucket), pa.string()), pa.array(bucket[by_head][by_bucket], pa.int32()), _joined_runs(groups, by_bucket, len(by_head), ";")], names=["lang", "bucket", "groups"]
    )


def extended(lists: DataFrame, frequent: Cells, hot_words: set[tuple[str, bytes]], buckets: int, pairs: Cells | None = None) -> DataFrame:
    """lang, bucket, groups: counts, by segment, of pairs of frequent words; with `pairs`, of three words whose neighbours are frequent pairs."""
    context = lists.sparkSession.sparkContext
    sent = [context.broadcast((c.width, c.table)) if c else None for c in (frequent, pairs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, of_pairs = (Cells(s.value[0], DEPTH, s.value[1]) if s else None for s in sent)
        for batch in batches:
            for k in range(batch.num_rows):
                lang, own_from = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                words, sizes = batch.column(2)[k].values, batch.column(3)[k].values.to_numpy()
                spelled = words.cast(pa.binary()).to_pylist()
                hashes = _hashes(lang, spelled)
                hot = np.fromiter(((lang, w) in hot_words for w in spelled), dtype=bool, count=len(spelled))
                known = of_words.least(hashes) > 0
                chosen = np.repeat(known, sizes)
                at = np.frombuffer(batch.column(4)[k].as_buffer(), dtype=np.int32)[chosen]
                word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[chosen]
                # Lists merged by position: who stands right behind whom.
                order = np.argsort(at, kind="stable")
                at, word = at[order], word[order]
                left = np.flatnonzero(at[1:] == at[:-1] + 1)
                if of_pairs is not None:
                    left = left[of_pairs.least(_joined(hashes[word[left]], hashes[word[left + 1]])) > 0]
                    # Pairs whose end is where the next pair begins.
                    left = left[np.flatnonzero(left[1:] == left[:-1] + 1)]
                width = 2 if of_pairs is None else 3
                left = left[at[left] + width - 1 >= own_from]
                yield from _counted(lang, words, hot, hashes, buckets, [word[left + j] for j in range(width)])

    return lists.select("lang", "own_from", "words", "sizes", "positions").mapInArrow(released(run), "lang string, bucket int, groups string")


def _frequent(buckets: DataFrame, least: int) -> DataFrame:
    """lang, phrase, n of the phrases that come `least` times: rows are dealt by bucket and only then taken apart."""
    groups = buckets.repartition("lang", "bucket").select("lang", "bucket", F.explode(F.split("groups", ";")).alias("g"))
    head = F.substring_index("g", " ", 1)
    each = groups.select("lang", "bucket", head.alias("head"), F.explode(F.split(F.substr("g", F.length(head) + 2), ",")).alias("e"))
    n = F.when(F.col("e").contains(":"), F.substring_index("e", ":", -1).cast("bigint")).otherwise(1)
    counts = each.select("lang", "bucket", "head", F.substring_index("e", ":", 1).alias("tail"), n.alias("n")).groupBy("lang", "bucket", "head", "tail").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least).select("lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "n")


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def _with_parts(candidates: DataFrame, parts: DataFrame, few: int, words: Column, name: str) -> DataFrame:
    """Candidates with the frequency `name` of a part (always there: a part is as frequent as the whole)."""
    side = parts.select("lang", F.col("phrase").alias("__part"), F.col("n").alias(name))
    return candidates.withColumn("__part", words).join(F.broadcast(side) if few <= BROADCAST_ROWS else side, ["lang", "__part"]).drop("__part")


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, size: int = SEGMENT_WORDS, most_cells: int = MOST_CELLS, scratch: Scratch | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of two and three words."""
    scratch = scratch or Scratch(documents.sparkSession, documents)
    lists = scratch.keep(segments(documents, size), "lists")
    every = lists.select("lang", F.explode(F.arrays_zip("words", "own")).alias("w"))
    counts = every.groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.own").alias("n"))
    words = scratch.keep(counts.filter(F.col("n") >= least), "words")
    totals = lists.select("lang", F.aggregate("own", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("__total"))
    n_words = words.count()
    of_words = membership(words, n_words, most_cells)
    # No more than HOT words can hold a share of 1 / HOT of all places.
    total = totals.agg(F.sum("__total").alias("n")).first()["n"] or 0
    hot = {(r["lang"], r["phrase"].encode()) for r in words.filter(F.col("n") > total / HOT).select("lang", "phrase").collect()}
    buckets = cells_for(total // BUCKET_WORDS, 1 << 10, 1 << 24)
    pairs = scratch.keep(_frequent(extended(lists, of_words, hot, buckets), least), "pairs")
    n_pairs = pairs.count()
    triples = scratch.keep(_frequent(extended(lists, of_words, hot, buckets, membership(pairs, n_pairs, most_cells)), least), "triples")

    word = lambda k: F.get(F.split("phrase", " "), F.lit(k))
    head = F.concat_ws(" ", word(0), word(1))
    rest = F.concat_ws(" ", word(1), word(2))
    two = _with_parts(_with_parts(pairs.withColumnRenamed("n", "a"), words, n_words, word(0), "l"), words, n_words, word(1), "r").withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    longer = triples.withColumnRenamed("n", "a")
    for parts, few, words_of, name in ((words, n_words, word(0), "l1"), (pairs, n_pairs, rest, "r1"), (pairs, n_pairs, head, "l2"), (words, n_words, word(2), "r2")):
        longer = _with_parts(longer, parts, few, words_of, name)
    longer = longer.withColumns({"s1": _score(F.col("a"), F.col("l1"), F.col("r1")), "s2": _score(F.col("a"), F.col("l2"), F.col("r2"))})
    first = F.col("s1") <= F.col("s2")
    choose = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    three = longer.select("lang", "phrase", "a", choose("l1", "l2").alias("l"), choose("r1", "r2").alias("r"), choose("s1", "s2").alias("score"))
    holders = triples.select("lang", F.explode(F.array(head, rest)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("__inside"))
    alone = two.join(holders, ["lang", "phrase"], "left").filter(F.col("__inside").isNull() | (100 * F.col("__inside") < INSIDE * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    both = alone.select("lang", "phrase", "a", "l", "r", "score").union(three.select("lang", "phrase", "a", "l", "r", "score"))
    best = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("__total").alias("n"), "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_JOIN = "JOIN f {0} ON {0}.lang = {1}.lang AND {0}.phrase = {2}"
OP11_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, h.a AS l, t.a AS r, cut, (1000000::HUGEINT * c.a * c.a) // (h.a::HUGEINT * t.a) AS score
         FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c {_JOIN.format("h", "c", "array_to_string(c.s[1 : cut], ' ')")} {_JOIN.format("t", "c", "array_to_string(c.s[cut + 1 : ], ' ')")}),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, phrase, max(a) AS m FROM (SELECT lang, unnest([array_to_string(s[1 : 2], ' '), array_to_string(s[2 : 3], ' ')]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN inside ON inside.lang = low.lang AND inside.phrase = low.phrase WHERE m IS NULL OR 100 * m < {INSIDE} * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""
