"""Language identification by a convolutional network over bytes, trained and applied in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes (the last one padded). Filters of several widths
see the bytes one-hot, so a filter is one table of 256 numbers for each of its places; each filter's
largest response in the window, rectified, goes to a softmax over the learned languages. A text gets the
mean of its windows' logarithms, weighted by their bytes. For application, neighbouring places are merged
into tables over byte pairs, which changes nothing but the number of look-ups.

Training (driver): a sample of at most ROWS rows with a language, the same number of each language where there
are enough, in the order of a hash of id and text, whatever ids repeat; up to WINDOWS_PER_TEXT windows of each text.

Edge cases: `und` with score 0 for null texts and texts without a letter, and where nothing could be
learned; texts of any length are read whole, some CHUNK_WINDOWS windows at a time; repeated rows and null
doc_ids get a row each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutlens.llm.common import released, remainder, runs_of, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Rows to learn from, at most, and windows of each.
ROWS = 4_000
WINDOWS_PER_TEXT = 3
CHUNK_WINDOWS = 96
CHUNK_BYTES = 1_000_000
UNKNOWN = "und"


def cut(data: bytes) -> np.ndarray:
    """uint8[windows, WINDOW]; padding bytes are 0."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, WINDOW)


def _responses(net: dict, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each filter's largest response in each window, and where it is."""
    most, places = [], []
    for k, width in enumerate(WIDTHS):
        span = WINDOW - width + 1
        total = net["tables"][k][0][windows[:, :span]]
        for j in range(1, width):
            total = total + net["tables"][k][j][windows[:, j : j + span]]
        at = total.argmax(axis=1)
        places.append(at)
        most.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0, :])
    return np.concatenate(most, axis=1) + net["bias"], places


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(texts: list[str], langs: list[str], epochs: int = 8, rate: float = 0.01, seed: int = 5) -> dict | None:
    """The network, or None if there is nothing to learn from."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    parts, labels = [], []
    for text, lang in zip(texts, langs, strict=True):
        windows = cut(text.encode("utf-8", "surrogatepass"))
        chosen = windows if len(windows) <= WINDOWS_PER_TEXT else windows[rng.choice(len(windows), WINDOWS_PER_TEXT, replace=False)]
        parts.append(chosen)
        labels += [names.index(lang)] * len(chosen)
    if not parts:
        return None
    x, y = np.concatenate(parts), np.array(labels)
    n = FILTERS * len(WIDTHS)
    net = {"names": names, "bias": np.zeros(n, dtype=np.float32), "out": (rng.normal(size=(n, len(names))) * 0.2).astype(np.float32), "base": np.zeros(len(names), dtype=np.float32)}
    net["tables"] = [(rng.normal(size=(w, 256, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
    values = [net["bias"], net["out"], net["base"], *net["tables"]]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step = 0
    for _ in range(max(epochs, -(-600 * 64 // len(x)) if len(x) < 64 * 75 else epochs)):
        order = rng.permutation(len(x))
        for k in range(0, len(order), 64):
            part = order[k : k + 64]
            most, places = _responses(net, x[part])
            pooled = np.maximum(most, 0)
            d = np.exp(_log_softmax(pooled @ net["out"] + net["base"]))
            d[np.arange(len(part)), y[part]] -= 1
            d /= len(part)
            back = (d @ net["out"].T) * (most > 0)
            grads = [back.sum(axis=0), pooled.T @ d + 1e-4 * net["out"], d.sum(axis=0)]
            for k2, width in enumerate(WIDTHS):
                g = np.zeros_like(net["tables"][k2])
                own = back[:, k2 * FILTERS : (k2 + 1) * FILTERS]
                for j in range(width):
                    bytes_at = np.take_along_axis(x[part], places[k2] + j, axis=1)
                    np.add.at(g[j], (bytes_at, np.arange(FILTERS)[None, :]), own)
                grads.append(g)
            step += 1
            for v, g, (m, s) in zip(values, grads, moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net


class Applied:
    """A trained network over byte pairs."""

    def __init__(self, net: dict) -> None:
        self.net = net
        self.pairs = []
        for table_, width in zip(net["tables"], WIDTHS, strict=True):
            merged = [(j, (table_[j][:, None, :] + table_[j + 1][None, :, :]).reshape(65536, FILTERS)) for j in range(0, width - 1, 2)]
            self.pairs.append((merged, table_[width - 1] if width % 2 else None))

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(windows), CHUNK_WINDOWS):
            part = windows[k : k + CHUNK_WINDOWS]
            pair = part[:, :-1].astype(np.int32) << 8 | part[:, 1:]
            most = []
            for (merged, single), width in zip(self.pairs, WIDTHS, strict=True):
                span = WINDOW - width + 1
                total = None
                for j, rows in merged:
                    found = rows[pair[:, j : j + span]]
                    total = found if total is None else np.add(total, found, out=total)
                if single is not None:
                    total += single[part[:, width - 1 : width - 1 + span]]
                most.append(total.max(axis=1))
            pooled = np.maximum(np.concatenate(most, axis=1) + self.net["bias"], 0)
            out.append(_log_softmax(pooled @ self.net["out"] + self.net["base"]))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        held, windows, size = [], [], 0

        def flush() -> None:
            found = self.log_probabilities(np.concatenate([w for _, w, _ in windows]))
            start = 0
            for at, w, n in windows:
                weight = np.full(len(w), float(WINDOW))
                weight[-1] = n - WINDOW * (len(w) - 1)
                mean = weight @ found[start : start + len(w)] / weight.sum()
                start += len(w)
                p = np.exp(mean - mean.max())
                names[at], scores[at] = self.net["names"][int(p.argmax())], float(p.max() / p.sum())

        for at, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                data = text.encode("utf-8", "surrogatepass")
                windows.append((at, cut(data), len(data)))
                size += len(data)
            if size > CHUNK_BYTES:
                flush()
                windows, size = [], 0
        if windows:
            flush()
        return names, scores


_APPLIED: dict = {}


def identify(documents: DataFrame, net: dict | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text. The network (some 150 KB) is of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        if net is not None:
            key = net["out"].tobytes()
            if key not in _APPLIED:
                _APPLIED.clear()
                _APPLIED[key] = Applied(net)
            own = _APPLIED[key]
        for batch in batches:
            for a, b in runs_of(batch.column(1), CHUNK_BYTES):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                names, scores = own.predict(texts) if own else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(released(run), "doc_id bigint, lang_pred string, score double")


def training_rows(spark: SparkSession, sf_dir: str, rows: int = ROWS, modulus: int = 4, held: int = 2) -> tuple[list[str], list[str]]:
    """Texts and languages to learn from: of each language those of least hash, `rows` in all at most.

    One pass finds the hash of id and text below which a language's share lies, another keeps what is below, and of that the first
    2 x `rows`; the driver takes each language's share of them. The distinct languages come to the driver, a row each.
    """
    known = table(spark, sf_dir, "documents").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000))
    hashed = known.select("text", "lang", dealt.alias("dealt"))
    facts = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("dealt", [k / 1_000 for k in range(1_001)]).alias("at")).collect()
    if not facts:
        return [], []
    share = max(1, rows // len(facts))
    # The hash up to which a language has half as many rows again as it may give, or more.
    bounds = [(r["lang"], r["at"][min(1_000, 1_500 * share // r["n"] + 1)]) for r in facts]
    sample = hashed.join(F.broadcast(spark.createDataFrame(bounds, "lang string, bound long")), "lang").filter("dealt <= bound")
    found = sample.orderBy(F.col("dealt") / (F.col("bound") + 1), "lang", "text").limit(2 * rows).select("text", "lang").toArrow()
    taken: dict[str, list[str]] = {lang: [] for lang in sorted(r["lang"] for r in facts)}
    for text, lang in zip(found["text"].to_pylist(), found["lang"].to_pylist(), strict=True):
        if len(taken[lang]) < share:
            taken[lang].append(text)
    return [t for texts in taken.values() for t in texts], [lang for lang, texts in taken.items() for _ in texts]


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"), train(*training_rows(spark, sf_dir)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
