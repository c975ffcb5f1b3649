"""Secret scans: fixed patterns, and a character network over every candidate and its context.

Patterns (leftmost, non-overlapping for each kind; too short matches are dropped after matching):
assign, access and hex as in PATTERNS. Candidates of the network are all runs of key characters that are 16 or longer,
or 6 or longer with a digit in them (shorter runs of letters alone are words), whether or not a pattern touches them.
The network sees 24 characters before a candidate, the candidate and 8 after it; a candidate over 40 is seen in pieces of 40
that overlap, all of it, and counts as its likeliest piece. One bank of filters slides over all places, and the
largest and mean responses in each of the three segments go to a logistic output.

Training (driver, in numpy, on views that executors cut) is on labelled findings alone: made in the formats of known keys and of harmless
look-alikes, and the pattern findings of a bounded sample of documents, their context hidden half the time. On a third kept aside a
logistic curve calibrates the output, and the threshold is the highest that still finds RECALL of the labelled
secrets; `precision` and `recall` there are kept with the network. What passes and does not lie within a pattern's span is reported as kind `learned`.

Edge cases: null and empty texts have no spans; positions are code points, ends exclusive; repeated rows and
null doc_ids get a row each; texts are read whole at any length; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutlens.llm.common import released, runs_of, table, trim

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
WITH_DIGIT = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z+/_.=-]*+[0-9][A-Za-z0-9+/_.=-]*")
LEAST = 6
_WORDS = ("passw", "secret", "token", "api")
BEFORE, INSIDE, AFTER, STEP = 24, 40, 8, 28
CHUNK_BYTES = 2_000_000
SPAN = BEFORE + INSIDE + AFTER
WIDTH = 3
FILTERS = 24
RECALL = 0.98
#: Documents to draw findings from for training, at most.
SAMPLE_ROWS = 2_000


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    # Runs of 20 capitals and digits or 24 hexadecimal digits lie inside runs of 16 or more.
    for run in RUN.finditer(text):
        a, b = run.span()
        if b - a >= 20 and text.find("AKIA", a, b) >= 0:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        if b - a >= 24:
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """All runs that may be keys, in order."""
    found = {m.span() for m in RUN.finditer(text)}
    found.update(m.span() for m in WITH_DIGIT.finditer(text) if m.end() - m.start() >= LEAST)
    return sorted(found)


def pieces(start: int, stop: int) -> list[tuple[int, int]]:
    """Parts of INSIDE characters at most that cover a candidate."""
    if stop - start <= INSIDE:
        return [(start, stop)]
    return [(a, a + INSIDE) for a in [*range(start, stop - INSIDE, STEP), stop - INSIDE]]


def view(text: str, start: int, stop: int) -> bytes:
    """What the network sees of a piece, SPAN bytes: other than ASCII counts as one byte value."""
    shown = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start:stop].ljust(INSIDE, "\0") + text[stop : stop + AFTER].ljust(AFTER, "\0")
    return shown.encode("latin-1", "replace")


def covered(spans: list[tuple[int, int, int]], places: list[tuple[int, int]]) -> list[bool]:
    """Whether each place (in order) lies within the span that reaches furthest of those that begin no later."""
    out, k, reach = [], 0, -1
    for a, b in places:
        while k < len(spans) and spans[k][0] <= a:
            reach = max(reach, spans[k][2])
            k += 1
        out.append(b <= reach)
    return out


_SEGMENTS = ((0, BEFORE - 2), (BEFORE, BEFORE + INSIDE - 2), (BEFORE + INSIDE, SPAN - 2))


def _forward(net: dict, x: np.ndarray):
    span = SPAN - WIDTH + 1
    total = net["table"][0][x[:, :span]]
    for j in range(1, WIDTH):
        total = total + net["table"][j][x[:, j : j + span]]
    active = np.maximum(total + net["bias"], 0)
    tops, means = [], []
    for a, b in _SEGMENTS:
        tops.append(active[:, a:b].argmax(axis=1) + a)
        means.append(active[:, a:b].mean(axis=1))
    most = [np.take_along_axis(active, t[:, None, :], axis=1)[:, 0] for t in tops]
    return active, tops, np.concatenate([*most, *means], axis=1)


def _fit(x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 4) -> dict:
    rng = np.random.default_rng(seed)
    n = 2 * len(_SEGMENTS) * FILTERS
    net = {"table": (rng.normal(size=(WIDTH, 256, FILTERS)) * 0.2).astype(np.float32), "bias": np.zeros(FILTERS, np.float32), "out": np.zeros(n, np.float32), "base": np.zeros(1, np.float32)}
    net["out"][:] = rng.normal(size=n) * 0.1
    names = ("table", "bias", "out", "base")
    moments = {k: (np.zeros_like(net[k]), np.zeros_like(net[k])) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(order), 64):
            part = order[k : k + 64]
            active, tops, pooled = _forward(net, x[part])
            p = 1 / (1 + np.exp(-np.clip(pooled @ net["out"] + net["base"], -30, 30)))
            d = (p - y[part]) / len(part)
            back = np.outer(d, net["out"]).reshape(len(part), 2, len(_SEGMENTS), FILTERS)
            through = np.zeros_like(active)
            for s, (a, b) in enumerate(_SEGMENTS):
                through[:, a:b] += back[:, 1, s][:, None, :] / (b - a)
                rows = np.arange(len(part))[:, None]
                through[rows, tops[s], np.arange(FILTERS)[None, :]] += back[:, 0, s]
            through *= active > 0
            grads = {"out": pooled.T @ d + 1e-4 * net["out"], "base": d.sum(keepdims=True), "bias": through.sum(axis=(0, 1)), "table": np.zeros_like(net["table"])}
            for j in range(WIDTH):
                np.add.at(grads["table"][j], x[part][:, j : j + active.shape[1]], through)
            step += 1
            for name in names:
                m, v = moments[name]
                g = grads[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net


def made_findings(n: int, seed: int = 9) -> list[tuple[bytes, int]]:
    """Labelled views: keys in the formats of common issuers, and harmless runs of the same and other lengths."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choices(letters, k=k))
    alnum, low, digits = string.ascii_letters + string.digits, string.ascii_lowercase, string.digits
    word = lambda: pick(low, rng.randrange(2, 10))
    number = lambda a, b: str(rng.randrange(a, b))
    secret = [
        lambda: pick("0123456789abcdef", rng.choice([32, 40, 64])), lambda: pick(alnum + "+/", 40), lambda: "ghp_" + pick(alnum, 36), lambda: "sk-" + pick(alnum, 48),
        lambda: "xoxb-" + pick(digits, 12) + "-" + pick(alnum, 24), lambda: "eyJ" + pick(alnum, 30) + "." + pick(alnum + "_-", 40), lambda: "AIza" + pick(alnum + "_-", 35), lambda: pick(alnum, rng.randrange(20, 48)),
        lambda: "key=" + pick(alnum, rng.randrange(20, 60)), lambda: "x=" + pick("0123456789abcdef", 24) + pick(alnum, 24), lambda: "AKIA" + pick(string.ascii_uppercase + digits, 16), lambda: "AKIA" + pick(string.ascii_uppercase + digits, 16) + "/" + pick(alnum + "+/", 40),
        lambda: pick("0123456789ABCDEF", rng.choice([32, 40, 64])), lambda: pick(alnum + "+/", rng.randrange(60, 120)) + "==",
    ]
    short = lambda: pick(alnum, rng.randrange(6, 15)) + pick(digits, 1)
    plain = [
        lambda: pick(digits, rng.randrange(6, 24)), lambda: "-".join(word() for _ in range(4)) + pick(low, 8), lambda: "/".join(word() for _ in range(5)) + pick(low, 6) + ".html", lambda: "_".join(word() for _ in range(4)) + pick(low, 8),
        lambda: pick(low, rng.randrange(16, 30)), lambda: rng.choice("-=._") * rng.randrange(16, 60), lambda: f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}" + rng.choice(["", "T10", f"-{rng.randrange(10000):05}"]),
        lambda: ".".join(number(0, 256) for _ in range(4)) + rng.choice(["", "/24", "." + pick(digits, 6)]), lambda: word().capitalize() + word().capitalize() + word().capitalize() + pick(low, 10), lambda: word() * 6 + pick(low, 8), lambda: pick(string.ascii_uppercase, rng.randrange(16, 30)) + rng.choice(["", "."]),
        lambda: word() + word() + rng.choice([".", "-", "_", "/"]) + number(0, 2_000), lambda: word() + number(0, 100) + "." + word() + ".com", lambda: number(100, 1_000) + "-" + number(1_000, 10_000), lambda: number(1, 30) + "." + number(0, 100) + "." + number(0, 1_000),
        lambda: "www." + word() + word() + ".org/" + word() + "/" + number(1, 10_000), lambda: word() + word() + word() + rng.choice(["", ".", "-" + word()]) + pick(low, 8), lambda: f"{word()}_{word()}_{number(1, 10_000)}.{rng.choice(['jpg', 'csv', 'tar.gz'])}",
    ]
    out = []
    for k in range(n):
        own = rng.choice(secret)() if k % 2 else rng.choice(plain)()
        before = " ".join(word() for _ in range(rng.randrange(5))) + rng.choice([" ", " ", ": ", " = ", "(", '"', " id="])
        if rng.random() < 0.1:
            # Short runs of letters and digits are told apart by what stands before them alone.
            own, before = short(), word() + (rng.choice([" pwd: ", " pass = ", " secret key: ", " login token "]) if k % 2 else rng.choice([" room ", " part no. ", " flight ", " item ", " see "]))
        text = before + own + rng.choice([" ", '" ', ", ", "\n", ""]) + word()
        stop = len(before) + len(own)
        parts = pieces(len(before), stop)
        a, b = parts[rng.randrange(len(parts))]
        out.append((view(text, a, b), k % 2))
    return out


def pattern_findings(texts: list[str], first: int = 0) -> list[bytes]:
    """Views of what the patterns find, the context of every other one hidden; `first`: the number of the first text."""
    views = []
    for k, text in enumerate(texts, first):
        spans = pattern_spans(text)
        own = candidates(text) if spans else []
        for j, (start, stop) in enumerate(own):
            if any(a < stop and start < b for a, _, b in spans):
                hidden = text if (k + j) % 2 else " " * start + text[start:]
                views += [view(hidden, a, b) for a, b in pieces(start, stop)]
    return views


def train(views: list[bytes], made: int = 4_000) -> dict:
    """The network with its calibration and threshold, of made findings and of `views` of secrets."""
    examples = [*made_findings(made), *((v, 1) for v in views)]
    x = np.frombuffer(b"".join(v for v, _ in examples), dtype=np.uint8).reshape(-1, SPAN)
    y = np.array([v for _, v in examples], dtype=np.float32)
    held = np.arange(len(x)) % 3 == 0
    net = _fit(x[~held], y[~held])
    logits = _forward(net, x[held])[2] @ net["out"] + net["base"]
    grid = [(float(np.mean(np.logaddexp(0, logits / t) - y[held] * logits / t)), t) for t in np.geomspace(0.25, 8, 41)]
    net["temperature"] = min(grid)[1]
    p = 1 / (1 + np.exp(-logits / net["temperature"]))
    found = np.sort(p[y[held] == 1])
    net["threshold"] = float(found[int((1 - RECALL) * len(found))])
    passed = p >= net["threshold"]
    net["recall"], net["precision"] = float(passed[y[held] == 1].mean()), float(y[held][passed].mean())
    return net


def probabilities(net: dict, views: list[bytes]) -> np.ndarray:
    out = []
    for k in range(0, len(views), 512):
        x = np.frombuffer(b"".join(views[k : k + 512]), dtype=np.uint8).reshape(-1, SPAN)
        out.append(1 / (1 + np.exp(-np.clip((_forward(net, x)[2] @ net["out"] + net["base"]) / net["temperature"], -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def scan(texts: list[str], net: dict) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind number, end) of each text, in order."""
    spans, views, owners = [pattern_spans(t) for t in texts], [], []
    for k, text in enumerate(texts):
        places = candidates(text)
        for (a, b), inside in zip(places, covered(spans[k], places), strict=True):
            for start, stop in pieces(a, b):
                views.append(view(text, start, stop))
                owners.append((k, a, b, inside))
    added = {(k, a, b) for (k, a, b, inside), p in zip(owners, probabilities(net, views), strict=True) if p >= net["threshold"] and not inside}
    for k, a, b in added:
        spans[k].append((a, 3, b))
    return [sorted(s) for s in spans]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(documents: DataFrame, net: dict) -> DataFrame:
    """doc_id and spans (array of start, kind, stop) of every whole text. The network (some 80 KB) has a fixed size."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in runs_of(batch.column(1), CHUNK_BYTES):
                found = scan([t or "" for t in batch.column(1).slice(x, y - x).to_pylist()], net)
                rows = [[{"start": a, "kind": KINDS[k], "stop": b} for a, k, b in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(rows, kind)], names=["doc_id", "spans"])

    return documents.select("doc_id", "text").mapInArrow(released(run), "doc_id bigint, spans array<struct<start:int,kind:string,stop:int>>")


def fitted(documents: DataFrame) -> dict:
    """A network trained on made findings and on those of at most SAMPLE_ROWS documents with findings, by a hash of id and text.

    One pass finds the hash below which half as many rows again lie, another takes what is below, so no task sorts more than that.
    The driver gets views of the findings (SPAN bytes each), no text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0  # the rows lie in one partition, in order
        for batch in batches:
            for x, y in runs_of(batch.column(0), CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(pattern_findings(batch.column(0).slice(x, y - x).to_pylist(), k), pa.binary())], names=["view"])
                k += y - x

    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000)).alias("dealt"), text.alias("text"))
    telling = F.col("text").rlike("AKIA|[0-9a-f]{24}|(?i)(passw|secret|token|api_?key)")
    facts = rows.filter(telling).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("dealt", [k / 1_000 for k in range(1_001)]).alias("at")).first()
    bound = facts["at"][min(1_000, 1_500 * SAMPLE_ROWS // facts["n"] + 1)] if facts["n"] else -1
    found = rows.filter(F.col("dealt") <= bound).filter(telling).orderBy("dealt", "text").limit(SAMPLE_ROWS).select("text")
    net = train(found.mapInArrow(released(run), "view binary").toArrow()["view"].to_pylist())
    trim()
    return net


def redact(documents: DataFrame, net: dict) -> DataFrame:
    """The documents with every secret replaced by [secret:kind]; n_chars, where there is one, follows the new text."""
    at = documents.columns.index("text")

    def clean(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not spans:
            return text
        parts, done = [], 0
        for start, k, stop in spans:
            if start >= done:
                parts += [text[done:start], f"[secret:{KINDS[k]}]"]
            done = max(done, stop)
        return "".join(parts) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in runs_of(batch.column(at), CHUNK_BYTES):
                part = batch.slice(x, y - x)
                texts = part.column(at).to_pylist()
                found = scan([t or "" for t in texts], net)
                fresh = pa.array([clean(t, s) for t, s in zip(texts, found, strict=True)], pa.string())
                yield part.set_column(at, part.schema.field(at), fresh.cast(part.schema.field(at).type))

    out = documents.mapInArrow(released(run), documents.schema)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)).select(*documents.columns)
    return out


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    spans = scan_documents(documents, fitted(documents))
    mark = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "learned")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return spans.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(F.array_join(F.transform(base, mark), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", mark), ",").alias("spans"),
    )


def digest(spans: list[tuple[int, int, int]]) -> str:
    """base_sha256 of a text's spans."""
    return hashlib.sha256(_joined([s for s in spans if s[1] < 3]).encode()).hexdigest()
