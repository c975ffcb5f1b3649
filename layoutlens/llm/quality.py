"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Words are runs of letters, of digits or of other marks (A-Z as a-z), kept in SLOTS hashed slots. Each slot
has a fixed sparse ternary index vector; a word's vector is the sum of its neighbours' index vectors over a
bounded sample of labelled texts, less the mean, at unit length (its own index vector if it was not seen).
The shapes of the words (kind, case, length) are words too and get vectors the same way. A document is
the mean of its words' vectors, the mean of its shapes' vectors, the lengths of both means (which tell
repetitive from varied text) and its number of words. A network with one hidden layer, trained in numpy,
gives a logit; a temperature fitted on rows kept from the training turns it into a calibrated probability.
Executors add up the vectors and pool the sample's texts: the driver gets sums of a fixed size (6 MB) and a row
of 99 numbers for each text, which the network is trained on, but no text.

Edge cases: null texts count as empty, and a text without words has a zero vector like any other input;
without labels of both kinds every score is the share of 1 among the labels (0.5 without any). Repeated
rows and null doc_ids get a row each; extra columns are not read. Memory per task: CHUNK_BYTES of text at a
time, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutlens.llm.common import Scratch, label_shares, labelled_texts, released, remainder, runs_of, table, trim
from layoutlens.llm.shingles import run_hashes

#: Labelled rows to learn from, at most.
ROWS = 8_000
SLOTS = 1 << 15
SHAPES = 96
#: The tables of vectors: name, rows, seed.
TABLES = (("words", SLOTS, 1), ("shapes", SHAPES, 2))
#: Rows of both tables that are added up together, and tasks that the sample is dealt to at most.
BLOCK, PARTS = 256, 8
WIDTH = 48
NONZERO = 6
REACH = 2
HIDDEN = 32
THRESHOLD = 0.3
CHUNK_BYTES = 300_000


def index_vectors(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    found = np.zeros((n, WIDTH), dtype=np.float32)
    places = np.argsort(rng.random((n, WIDTH)), axis=1)[:, :NONZERO]
    np.put_along_axis(found, places, rng.choice(np.array([-1, 1], dtype=np.float32), size=places.shape), axis=1)
    return found


def _add_rows(target: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    where, starts = np.unique(at[order], return_index=True)
    target[where] += np.add.reduceat(rows[order], starts, axis=0, dtype=np.int32)


def _slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, shapes, counts = run_hashes(texts)
    return (hashes % np.uint64(SLOTS)).astype(np.int64), shapes, counts


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    return runs_of(pa.array(texts, pa.large_string()), CHUNK_BYTES)


def neighbours(parts: Iterable[list[str]]) -> dict[str, np.ndarray]:
    """The sum of the index vectors beside each word slot and each shape: whole numbers, which add up exactly over parts of the texts in any order."""
    index = {name: index_vectors(n, seed).astype(np.int8) for name, n, seed in TABLES}
    sums = {name: np.zeros((n, WIDTH), dtype=np.int64) for name, n, _ in TABLES}
    for texts in parts:
        slots, shapes, counts = _slots(texts)
        owner = np.repeat(np.arange(len(texts)), counts)
        for name, at in (("words", slots), ("shapes", shapes)):
            for reach in range(1, REACH + 1):
                same = owner[reach:] == owner[:-reach]
                left, right = at[:-reach][same], at[reach:][same]
                if len(left):
                    _add_rows(sums[name], left, index[name][right])
                    _add_rows(sums[name], right, index[name][left])
    return sums


def unit_vectors(sums: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The vectors of all word slots and of all shapes, of the sums beside them."""
    made = {}
    for name, n, seed in TABLES:
        index, context = index_vectors(n, seed), sums[name].astype(np.float32)
        seen = np.abs(context).sum(axis=1) > 0
        if seen.any():
            context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
            context[seen] -= context[seen].mean(axis=0)
        context[~seen] = index[~seen]
        made[name] = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return made


def word_vectors(texts: list[str]) -> dict[str, np.ndarray]:
    return unit_vectors(neighbours(texts[a:b] for a, b in _chunks(texts)))


def pooled(texts: list[str], vectors: dict[str, np.ndarray]) -> np.ndarray:
    """One row for each text: the two mean vectors, their lengths, and the logarithm of the number of words."""
    out = np.zeros((len(texts), 2 * WIDTH + 3), dtype=np.float32)
    for a, b in _chunks(texts):
        slots, shapes, counts = _slots(texts[a:b])
        some = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[some]
        for k, (name, at) in enumerate((("words", slots), ("shapes", shapes))):
            if len(some):
                mean = np.add.reduceat(vectors[name][at], starts, axis=0) / counts[some][:, None]
                out[a + some, k * WIDTH : (k + 1) * WIDTH] = mean
                out[a + some, 2 * WIDTH + k] = np.linalg.norm(mean, axis=1)
        out[a:b, -1] = np.log1p(counts)
    return out


def _logits(x: np.ndarray, net: dict) -> np.ndarray:
    hidden = np.tanh(((x - net["mean"]) / net["scale"]) @ net["w1"] + net["b1"])
    return hidden @ net["w2"] + net["b2"]


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, seed: int = 3) -> dict:
    """Two layers by Adam on the logistic loss, then a temperature on every fifth row, which is not trained on."""
    rng = np.random.default_rng(seed)
    held = np.arange(len(x)) % 5 == 0
    tx, ty = x[~held], y[~held].astype(np.float32)
    net = {"mean": tx.mean(axis=0), "scale": tx.std(axis=0) + 1e-3}
    net["w1"] = (rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1])).astype(np.float32)
    net["b1"] = np.zeros(HIDDEN, dtype=np.float32)
    net["w2"] = (rng.normal(size=HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32)
    net["b2"] = np.zeros(1, dtype=np.float32)
    moments = {k: [np.zeros_like(net[k]), np.zeros_like(net[k])] for k in ("w1", "b1", "w2", "b2")}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(tx))
        for k in range(0, len(order), 128):
            part = order[k : k + 128]
            z = (tx[part] - net["mean"]) / net["scale"]
            h = np.tanh(z @ net["w1"] + net["b1"])
            p = 1 / (1 + np.exp(-np.clip(h @ net["w2"] + net["b2"], -30, 30)))
            d = (p - ty[part]) / len(part)
            dh = np.outer(d, net["w2"]) * (1 - h * h)
            grads = {"w2": h.T @ d + decay * net["w2"], "b2": d.sum(keepdims=True), "w1": z.T @ dh + decay * net["w1"], "b1": dh.sum(axis=0)}
            step += 1
            for name, g in grads.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    logits, hy = _logits(x[held], net), y[held]
    losses = [(float(np.mean(np.logaddexp(0, logits / t) - hy * logits / t)), t) for t in np.geomspace(0.25, 8, 41)]
    net["temperature"] = min(losses)[1]
    return net


def _constant(y: np.ndarray) -> dict | None:
    """The model where there is too little to learn from."""
    return {"constant": float(y.mean()) if len(y) else 0.5} if len(set(y.tolist())) < 2 or len(y) < 20 else None


def train(sample: list[tuple[str, int]]) -> dict:
    y = np.array([v for _, v in sample])
    if constant := _constant(y):
        return constant
    texts = [t for t, _ in sample]
    vectors = word_vectors(texts)
    return {"vectors": vectors, "net": fit_network(pooled(texts, vectors), y)}


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    logits = _logits(pooled(texts, model["vectors"]), model["net"]) / model["net"]["temperature"]
    return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))


def score(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, node (md5 of the text) and score (0 to 1, higher: good likelier) of every whole text.

    The model has a fixed size of some 6 MB (SLOTS vectors of WIDTH numbers), so it is broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs_of(batch.column(2), CHUNK_BYTES):
                part = batch.slice(a, b - a)
                found = score_texts([t or "" for t in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.float64())], names=["doc_id", "node", "score"])

    rows = documents.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"), "text")
    return rows.mapInArrow(released(run), "doc_id bigint, node binary, score double")


def summed_vectors(sample: DataFrame) -> dict[str, np.ndarray]:
    """`word_vectors` of a frame's texts: sums by task, added up block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = neighbours(batch.column(0).slice(a, b - a).to_pylist() for batch in batches for a, b in runs_of(batch.column(0), CHUNK_BYTES))
        parts = [sums[name][k : k + BLOCK] for name, n, _ in TABLES for k in range(0, n, BLOCK)]
        for k, part in enumerate(parts):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()])], names=["block", "sums"])

    def add(block: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in block["sums"].to_pylist())
        trim()
        return pa.table([block["block"].slice(0, 1), pa.array([total.astype(np.float32).tobytes()])], names=["block", "sums"])

    kind = "block int, sums binary"
    found = sample.select("text").mapInArrow(released(run), kind).groupBy("block").applyInArrow(add, kind).toArrow().sort_by("block")
    whole = np.frombuffer(b"".join(found["sums"].to_pylist()) or bytes(4 * WIDTH * (SLOTS + SHAPES)), dtype=np.float32).reshape(-1, WIDTH)
    return unit_vectors({"words": whole[:SLOTS], "shapes": whole[SLOTS:]})


def pooled_sample(sample: DataFrame, vectors: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """`pooled` of a frame's texts and their labels, by rank, doc_id and label."""
    shared = sample.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs_of(batch.column(3), CHUNK_BYTES):
                part = batch.slice(a, b - a)
                rows = pooled(part.column(3).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([r.tobytes() for r in rows], pa.binary())], names=["rank", "doc_id", "label", "row"])

    rows = sample.select("rank", "doc_id", "label", "text").mapInArrow(released(run), "rank bigint, doc_id bigint, label int, row binary")
    found = rows.toArrow().sort_by([(k, "ascending") for k in ("rank", "doc_id", "label")])
    shared.destroy()
    x = np.frombuffer(b"".join(found["row"].to_pylist()), dtype=np.float32).reshape(-1, 2 * WIDTH + 3)
    return x, found["label"].to_numpy()


def fitted(spark: SparkSession, sf_dir: str) -> dict:
    """The model of `train` on the texts of `labelled_sample`, without bringing these to the driver."""
    scratch = Scratch(spark)
    sample = scratch.keep(labelled_texts(spark, sf_dir, "quality", label_shares(spark, sf_dir, "quality", ROWS)).coalesce(PARTS), "sample")
    vectors = summed_vectors(sample)
    x, y = pooled_sample(sample, vectors)
    scratch.drop()
    model = _constant(y) or {"vectors": vectors, "net": fit_network(x, y)}
    trim()
    return model


def keep_good(documents: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score `threshold` or more, in one pass over the table and with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs_of(batch.column(at), CHUNK_BYTES):
                part = batch.slice(a, b - a)
                found = score_texts([t or "" for t in part.column(at).to_pylist()], shared.value)
                yield part.filter(pa.array(found >= threshold))

    return documents.mapInArrow(released(run), documents.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), fitted(spark, sf_dir))
    held_out = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
