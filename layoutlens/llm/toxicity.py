"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text.

Windows are words: runs of letters (or of digits) of the lower-cased text, at most 32 bytes each. A window
is compressed with either dictionary; how much shorter it gets with the toxic one is its distance. So short
a window saves only a byte or two, so its bytes are first spread, each to four fixed pseudo-random ones (of words below
four bytes, which a match would hardly pay for, to ten): a letter then weighs more, a match still costs the same, and
lengths resolve fractions of a letter.

Training (driver, bounded samples of labelled rows): each dictionary holds its class's words whose share of
documents is OVER times the other class's and that LEAST documents have, most frequent nearest the end, up to its size. A third of the sample is kept from
the dictionaries; on it the distance threshold is chosen and a logistic curve over the share, number and size
of far windows is fitted, which gives the score.

Edge cases: null texts count as empty; a text without windows gets the curve's value for no far windows;
without labels of both kinds every score is the share of toxic labels (0.5 without any). Repeated rows and
null doc_ids get a row each; extra columns are not read.
"""

from __future__ import annotations

import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutlens.llm.common import labelled_sample, released, remainder, runs_of, table

#: Labelled rows to learn from, at most.
TOXIC_ROWS = 2_500
ORDINARY_ROWS = 7_500
#: Bytes of words in each dictionary, before spreading.
TOXIC_BYTES = 10_000
ORDINARY_BYTES = 30_000
#: Documents of its class that a telling word must be in, and how many times over.
LEAST = 3
OVER = 6.0
SPREAD, SHORT, SHORT_SPREAD = 4, 4, 10
CHUNK_BYTES = 1_000_000
CACHE_WORDS = 500_000
_WINDOW = re.compile(rb"[a-z\x80-\xff]{1,32}|[0-9]{1,32}")
_END = b"\n" * 8


def windows(text: str) -> list[bytes]:
    return _WINDOW.findall(text.lower().encode("utf-8", "surrogatepass"))


def _spreading(width: int) -> list[bytes]:
    rng = random.Random(16 + width)
    return [bytes(rng.randrange(256) for _ in range(width)) for _ in range(256)]


class Distances:
    """Distances of windows under two dictionaries (lists of words, the most telling last)."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]) -> None:
        self.spread = {False: _spreading(SPREAD), True: _spreading(SHORT_SPREAD)}
        self.toxic, self.ordinary = self._compressor(toxic), self._compressor(ordinary)
        self.cache: dict[bytes, int] = {}

    def _wide(self, word: bytes, end: bytes = b"") -> bytes:
        spread = self.spread[len(word) < SHORT]
        return b"".join([spread[b] for b in b" " + word + b" " + end])

    def _compressor(self, words: list[bytes]):
        import zstandard as zs

        raw = b"".join(map(self._wide, words)) or b"\0" * 8
        dictionary = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
        settings = zs.ZstdCompressionParameters.from_level(
            19, write_content_size=False, write_dict_id=False, write_checksum=False, format=zs.FORMAT_ZSTD1_MAGICLESS,
            min_match=4, source_size=len(raw) + 64, strategy=zs.STRATEGY_BTULTRA,
        )
        dictionary.precompute_compress(compression_params=settings)
        return zs.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress

    def of(self, found: list[bytes]) -> list[int]:
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in {w for w in found if w not in cache}:
            wide = self._wide(w, _END)
            cache[w] = len(self.ordinary(wide)) - len(self.toxic(wide))
        return list(map(cache.__getitem__, found))


def features(distances: list[int], threshold: int) -> list[float]:
    """Share of far windows, their number, the furthest and the mean of the three furthest."""
    far = sorted([d for d in distances if d >= threshold], reverse=True)
    n = len(far)
    top = far[:3]
    return [min(1.0, 20.0 * n / max(1, len(distances))), min(3.0, n) / 3.0, (top[0] - threshold + 1) / 8.0 if n else 0.0, (sum(top) / n if n < 3 else sum(top) / 3) / 16.0 if n else 0.0]


def _logistic(x, y, steps: int = 400, decay: float = 1e-4):
    """Weights and bias of a logistic curve, by Newton's method with a small ridge."""
    import numpy as np

    x = np.hstack([np.asarray(x, dtype=float), np.ones((len(x), 1))])
    y, w = np.asarray(y, dtype=float), np.zeros(x.shape[1])
    for _ in range(min(steps, 50)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + decay * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + decay * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _word_documents(texts: list[str]) -> Counter:
    found: Counter = Counter()
    for text in texts:
        found.update(set(windows(text)))
    return found


def _telling(own: Counter, n: int, other: Counter, m: int, least: int, over: float, room: int) -> list[bytes]:
    """Words of `least` documents whose share of `own` documents is `over` times that of `other`, the most frequent last."""
    found = sorted((k, w) for w, k in own.items() if k >= least and k / n >= over * (other.get(w, 0) + 1) / m)
    kept, size = [], 0
    for _, w in reversed(found):
        size += len(w) + 2
        if size > room:
            break
        kept.append(w)
    return kept[::-1]


def train(sample: list[tuple[str, int]]) -> dict:
    """The dictionaries, the threshold and the curve: plain values that can be sent to tasks."""
    import numpy as np

    fit = [r for i, r in enumerate(sample) if i % 3]
    held = [r for i, r in enumerate(sample) if i % 3 == 0]
    toxic, ordinary = [t for t, y in fit if y == 1], [t for t, y in fit if y == 0]
    share = sum(y for _, y in sample) / len(sample) if sample else 0.5
    if not toxic or not ordinary or len({y for _, y in held}) < 2:
        return {"constant": share}
    a, b = _word_documents(toxic), _word_documents(ordinary)
    model = {
        "toxic": _telling(a, len(toxic), b, len(ordinary), LEAST, OVER, TOXIC_BYTES),
        "ordinary": _telling(b, len(ordinary), a, len(toxic), LEAST, 0.8, ORDINARY_BYTES),
    }
    measure = Distances(model["toxic"], model["ordinary"])
    distances = [measure.of(windows(t)) for t, _ in held]
    y = np.array([v for _, v in held])
    # Toxic rows are sampled more densely than ordinary ones; equal weight for the two errors suits both.
    best = None
    for threshold in range(5, 15):
        x = [features(d, threshold) for d in distances]
        w = _logistic(x, y)
        z = np.clip(np.hstack([np.array(x), np.ones((len(x), 1))]) @ w, -30, 30)
        loss = float(np.mean(np.log1p(np.exp(z)) - y * z))
        if best is None or loss < best[0]:
            best = (loss, threshold, w.tolist())
    return model | {"threshold": best[1], "weights": best[2], "loss": best[0]}


_LOADED: dict[int, Distances] = {}


def _measure(packed: bytes, model: dict) -> Distances:
    """One pair of compressors, and one cache, for each worker process and model."""
    key = hash(packed)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Distances(model["toxic"], model["ordinary"])
    return _LOADED[key]


def score_texts(texts: list[str], model: dict, measure: Distances | None) -> list[float]:
    import math

    if "constant" in model:
        return [model["constant"]] * len(texts)
    *w, bias = model["weights"]
    out = []
    for text in texts:
        x = features(measure.of(windows(text)), model["threshold"])
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, sum(p * q for p, q in zip(w, x, strict=True)) + bias)))))
    return out


def score(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier) of every whole text."""
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed)
        measure = None if "constant" in own else _measure(packed, own)
        for batch in batches:
            for a, b in runs_of(batch.column(1), CHUNK_BYTES):
                scores = score_texts([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()], own, measure)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(released(run), "doc_id bigint, score double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(labelled_sample(spark, sf_dir, "toxic", {1: TOXIC_ROWS, 0: ORDINARY_ROWS}))
    scored = score(table(spark, sf_dir, "documents"), model)
    held_out = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
