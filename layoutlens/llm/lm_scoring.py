"""Language-model scoring: a word base line and a byte model by logistic context mixing (see `mixing`).

Learning covers every training document; nothing is sampled, and nothing that is kept has a fixed size but order 1 and the tree:

1. One pass over the documents makes chunks of CHUNK_BYTES of text. A chunk lists its distinct places (a byte with the six before
   it) with their training counts, and its distinct words (as hashes of 63 bits) with theirs.
2. The lists are dealt to shards, one for each SHARD_PLACES of them, by hash of the last two bytes of a context, words by their
   own hash. Contexts that hold too much for one shard, as counted over all chunks, are dealt by three to six bytes
   (their orders up to the split then count what their shard has).
3. A shard adds the counts of all chunks up, learns its weights and its refining map from all its training decisions, and sends
   back to each chunk what its places cost and how often its words occur, in the order of the chunk's own list.
4. A chunk adds up its texts' places and words; the probabilities go on to adapt to each text as it is read (in a long text, within a
   piece).

So what is gathered from the corpus grows with it, in the number of shards alone; a task holds one shard or one chunk.
Broadcast are the tree with the table of order 1 (256 x 256 counts) and the marks of split contexts (at most
len(LEVELS) x SPLIT_SHARE): both of a fixed size. Texts and lists travel compressed.

Edge cases: null texts count as empty and have one token, the end; a null doc_id counts as the text '' for the
split; without training documents all counts are 0 and so is the base score, and every place costs what the start of the
model gives it; repeated rows get a row each; extra columns are not read, whatever their names. Texts are read whole, a long one in
pieces that know the bytes before them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutlens.llm import mixing
from layoutlens.llm.common import Scratch, released, remainder, runs_of, table, trim

CHUNK_BYTES = 10_000_000
SHARD_PLACES, LEAST_SHARDS = 600_000, 16
#: A context is split where it holds more than a shard's places and than this part of all.
SPLIT_SHARE = 1_024
_INTS, _BLOB, _MANY = pa.int64(), pa.binary(), pa.list_(pa.int64())
#: Rows of texts (chunk to texts: a run of texts, compressed) and of chunks (lists from keys on).
_CHUNKS = pa.schema(
    [("chunk", _INTS), ("doc_ids", _MANY), ("sizes", _MANY), ("texts", _BLOB), ("keys", _BLOB), ("counts", _BLOB), ("words", _BLOB), ("word_counts", _BLOB)]
    + [("marks", _MANY), ("marked", _MANY), ("n_words", _INTS), ("n_places", _INTS)]
)
_CHUNKS_DDL = "chunk bigint, doc_ids array<bigint>, sizes array<bigint>, texts binary, keys binary, counts binary, words binary, word_counts binary, marks array<bigint>, marked array<bigint>, n_words bigint, n_places bigint"
_DEALT = pa.schema([("shard", _INTS), ("chunk", _INTS), ("keys", _BLOB), ("counts", _BLOB), ("words", _BLOB), ("word_counts", _BLOB)])
_DEALT_DDL = "shard bigint, chunk bigint, keys binary, counts binary, words binary, word_counts binary"
_ANSWERS_DDL = "shard bigint, chunk bigint, losses binary, word_counts binary, n_distinct bigint"
_SCORES_DDL = "doc_id bigint, n_tokens bigint, n_known bigint, part double, score double, n_bytes bigint, n_distinct bigint"


def _pressed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _open(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _keys_out(keys: np.ndarray) -> bytes:
    return _pressed(mixing.packed(keys))


def _keys_in(data: bytes) -> np.ndarray:
    return mixing.unpacked(_open(data))


def _counts_out(counts: np.ndarray) -> bytes:
    return _pressed(mixing.packed_counts(counts))


def _counts_in(data: bytes) -> np.ndarray:
    return mixing.unpacked_counts(_open(data))


def _losses_out(losses: np.ndarray) -> bytes:
    """Steps of 1/2048 (or larger, where the largest loss needs it) in 16 bits, as planes of bytes, the step first."""
    step = max(1 / 2048, float(losses.max(initial=0.0)) / 65_535)
    whole = np.round(losses / step).astype("<u2")
    return _pressed(np.float64(step).tobytes() + np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 2).T).tobytes())


def _losses_in(data: bytes) -> np.ndarray:
    raw = _open(data)
    planes = np.frombuffer(raw, dtype=np.uint8, offset=8).reshape(2, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u2") * np.frombuffer(raw, dtype=np.float64, count=1)


class Chunk:
    """The places and words of some texts, and which of them are learned from."""

    def __init__(self) -> None:
        self.size, self.places, self.words = 0, [], []

    def add(self, texts: list[bytes], learn: list[bool]) -> None:
        for owner, run in mixing.segments(texts):
            keys, of = mixing.places(run)
            self.places.append(mixing.marked(keys, np.array([learn[k] for k in owner])[of]))
        words, n = mixing.words(texts)
        self.words.append(mixing.marked(words, np.repeat(np.array(learn), n)))
        self.size += sum(map(len, texts))

    def row(self, chunk: int, ends: int) -> pa.RecordBatch:
        (keys, counts), (words, word_counts) = mixing.taught(self.places), mixing.taught(self.words)
        marks, sizes = mixing.heavy(keys)
        pairs = np.bincount((mixing.context(keys, 1) << np.uint64(8) | keys & np.uint64(255)).astype(np.int64), weights=counts, minlength=1 << 16).astype(np.int64)
        some = np.flatnonzero(pairs)
        row = {
            "chunk": chunk, "keys": _keys_out(keys), "counts": _counts_out(counts), "words": _keys_out(words), "word_counts": _counts_out(word_counts),
            "marks": np.concatenate([some, marks]).tolist(), "marked": np.concatenate([pairs[some], sizes]).tolist(), "n_words": int(word_counts.sum()) + ends, "n_places": len(keys),
        }
        return pa.RecordBatch.from_pylist([row], schema=_CHUNKS)


def chunks(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """Of the rows (doc_id, text, learn): rows of texts, and one of each chunk of texts (`keys` not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, ends = Chunk(), TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for a, b in runs_of(batch.column(1), mixing.PIECE_BYTES):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).slice(a, b - a).to_pylist()]
                learn = batch.column(2).slice(a, b - a).to_pylist()
                if own.size and own.size + sum(map(len, texts)) > CHUNK_BYTES:
                    yield own.row(number, ends)
                    own, number, ends = Chunk(), number + 1, 0
                own.add(texts, learn)
                ends += sum(learn)
                row = {"chunk": number, "doc_ids": batch.column(0).slice(a, b - a).to_pylist(), "sizes": list(map(len, texts)), "texts": _pressed(b"".join(texts))}
                yield pa.RecordBatch.from_pylist([row], schema=_CHUNKS)
        if own.places:
            yield own.row(number, ends)

    # Put together before chunks are numbered by partition, so that small partitions share a chunk as well.
    rows = documents.select("doc_id", "text", "learn").coalesce(scratch.most)
    return scratch.keep(rows.mapInArrow(released(run), _CHUNKS_DDL), "chunks")


def shares(keys: np.ndarray, words: np.ndarray, shards: int, split: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, the places of `keys` and the words that it gets) of a chunk's lists, by shard."""
    nothing = np.zeros(0, dtype=np.int64)
    places = dict(mixing.by_shard(mixing.dealt(keys, shards, split)))
    spoken = dict(mixing.by_shard((words % np.uint64(shards)).astype(np.int64)))
    for shard in sorted(places.keys() | spoken.keys()):
        yield shard, places.get(shard, nothing), spoken.get(shard, nothing)


def dealt(listed: DataFrame, shards: int, split: np.ndarray) -> DataFrame:
    """The lists of all chunks, cut into what each shard gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, counts, words, word_counts = _keys_in(r["keys"]), _counts_in(r["counts"]), _keys_in(r["words"]), _counts_in(r["word_counts"])
                rows = [
                    (shard, r["chunk"], _keys_out(keys[at]), _counts_out(counts[at]), _keys_out(words[to]), _counts_out(word_counts[to]))
                    for shard, at, to in shares(keys, words, shards, split)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DEALT, strict=True)], schema=_DEALT)

    return listed.select("chunk", "keys", "counts", "words", "word_counts").mapInArrow(released(run), _DEALT_DDL)


def answers(rows: DataFrame, common) -> DataFrame:
    """For each shard and chunk what the chunk's places cost and how often its words occur in training.

    n_distinct, the number of a shard's words that do occur, stands in one of its rows.
    """

    def answer(rows: pa.Table) -> pa.Table:
        asked = rows.to_pylist()
        wanted, spoken = [_keys_in(r["keys"]) for r in asked], [_keys_in(r["words"]) for r in asked]
        keys, counts = mixing.merged([(k, _counts_in(r["counts"])) for k, r in zip(wanted, asked, strict=True)])
        losses = mixing.costs(keys, counts, common.value)
        words, total = mixing.merged([(w, _counts_in(r["word_counts"])) for w, r in zip(spoken, asked, strict=True)])
        found = pa.table(
            {
                "shard": rows["shard"],
                "chunk": rows["chunk"],
                "losses": pa.array([_losses_out(losses[np.searchsorted(keys, k)]) for k in wanted], _BLOB),
                "word_counts": pa.array([_counts_out(total[np.searchsorted(words, w)]) for w in spoken], _BLOB),
                "n_distinct": pa.array([int((total > 0).sum()), *[0] * (len(asked) - 1)], _INTS),
            }
        )
        trim()
        return found

    return rows.groupBy("shard").applyInArrow(answer, _ANSWERS_DDL)


def _texts(row: dict) -> list[bytes]:
    data, stops = _open(row["texts"]), np.cumsum(row["sizes"])
    return [data[b - size : b] for b, size in zip(stops.tolist(), row["sizes"], strict=True)]


def chunk_scores(texts: DataFrame, answered: DataFrame, shards: int, split: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, n_known, part, score, n_bytes of every text, and n_distinct of the chunk's answers on one of its rows.

    `part` is the sum of log10(c + 1) over a text's words without its end, `score` log10 of the probability of the text
    with its end.
    """

    def add(texts: pa.Table, answered: pa.Table) -> pa.Table:
        # The chunk's lists are made again from its texts, which is cheaper than to send them once more.
        runs, keys, spoken = texts.to_pylist(), [], []
        for r in runs:
            found = _texts(r)
            keys += [mixing.distinct(mixing.places(run)[0]) for _, run in mixing.segments(found)]
            spoken.append(mixing.distinct(mixing.words(found)[0]))
        keys, spoken = mixing.distinct(np.concatenate(keys)), mixing.distinct(np.concatenate(spoken))
        of = {r["shard"]: r for r in answered.to_pylist()}
        losses, logs = np.zeros(len(keys)), np.zeros(len(spoken))
        for shard, at, to in shares(keys, spoken, shards, split):
            losses[at] = _losses_in(of[shard]["losses"])
            logs[to] = np.log10(_counts_in(of[shard]["word_counts"]) + 1.0)
        place, word = mixing.Found(keys), mixing.Found(spoken)
        rows = {name: [] for name in ("doc_id", "n_tokens", "n_known", "part", "score", "n_bytes")}
        for r in runs:
            found, n = _texts(r), len(r["sizes"])
            score = np.zeros(n)
            for owner, run in mixing.segments(found):
                numbers, segment = mixing.places(run)
                own = mixing.adapted(numbers, segment, losses[place(numbers)])
                np.add.at(score, owner, np.bincount(segment, weights=own, minlength=len(owner)))
            words, sizes = mixing.words(found)
            log, text = logs[word(words)] if len(words) else np.zeros(0), np.repeat(np.arange(n), sizes)
            rows["doc_id"].append(pa.array(r["doc_ids"], _INTS))
            rows["n_tokens"].append(sizes + 1)
            rows["n_known"].append(np.bincount(text, weights=log > 0, minlength=n).astype(np.int64))
            rows["part"].append(np.bincount(text, weights=log, minlength=n).astype(np.float64))
            rows["score"].append(score / -math.log(10))
            rows["n_bytes"].append(np.array(r["sizes"], dtype=np.int64))
        made = {name: pa.chunked_array(parts) for name, parts in rows.items()}
        n = len(made["doc_id"])
        made["n_distinct"] = pa.array([sum(r["n_distinct"] for r in of.values()), *[0] * (n - 1)], _INTS)
        trim()
        return pa.table(made)

    return texts.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(add, _SCORES_DDL)


def score(documents: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes of every row of `documents` (doc_id, text).

    The rows for which `learn` holds are the training documents.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    scratch = Scratch(spark, documents.select("doc_id", "text"))
    every = chunks(rows, scratch)
    listed = every.filter(F.col("keys").isNotNull())
    facts = listed.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("total"), F.coalesce(F.sum("n_places"), F.lit(0)).alias("places")).first()
    shards = max(LEAST_SHARDS, -(-facts["places"] // SHARD_PLACES))
    least = max(SHARD_PLACES, facts["places"] // SPLIT_SHARE)
    marks = listed.select(F.explode(F.arrays_zip("marks", "marked")).alias("m")).groupBy("m.marks").agg(F.sum("m.marked").alias("n"))
    pairs, marked = np.zeros((256, 256)), []
    for mark, n in marks.filter((F.col("marks") < 1 << 16) | (F.col("n") > least)).collect():
        if mark < 1 << 16:
            pairs.flat[mark] = n
        else:
            marked.append(mark)
    split = np.array(sorted(marked), dtype=np.int64)
    common = spark.sparkContext.broadcast(mixing.Common(pairs))
    answered = answers(dealt(listed, shards, split), common)
    texts = every.filter(F.col("texts").isNotNull()).select("chunk", "doc_ids", "sizes", "texts")
    # Some 50 bytes a document, and complete only with the numbers of words of all shards.
    scores = scratch.keep(chunk_scores(texts, answered, shards, split), "scores")
    scratch.drop("scores")
    total, ends = facts["total"], int(pairs[:, mixing.END].sum())
    distinct = (scores.agg(F.coalesce(F.sum("n_distinct"), F.lit(0)).alias("n")).first()["n"]) + (ends > 0)
    return scores.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("part") + math.log10(ends + 1) - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        "score",
        "n_bytes",
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 7) == 2
    scored = score(table(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", held_out)
    bits = -F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))
