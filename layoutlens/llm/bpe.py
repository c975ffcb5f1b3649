"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

Encoding: a text is cut into the matches of a pattern. The distinct matches that a partition has not met
yet become token-position rows, one per byte; each step of a recursive query joins neighbouring positions
with the merge table, contracts each match's leftmost pair of least rank, and stops a match that has none left.
Decoding: id-position rows of whole texts join the vocabulary, and an ordered aggregation joins the bytes.

A match of more than LONG bytes is first cut where two bytes meet that stand together in no token: no token can reach
over such a place, so the parts are encoded apart. What is still longer is encoded in windows of LONG bytes that overlap by half. Where two windows have
a token in common at the same place, the first one's tokens up to it and the second one's after it are put together: that is the
encoding of the whole, since a row of tokens is one if and only if all its neighbours are (the first merge that would join parts of two neighbours would
join them alone, too). Windows without a common token (long repetitions) are encoded together: up to GROUP bytes at once by LONG_SQL, whose steps
contract all places of the least pair from left to right where that is the same (where no pair with the new token has a lower rank, `safe`,
worked out from the vocabulary; else the leftmost alone); longer ones in windows that each begin with a token of the one before, for the same reason.

Memory is bounded: texts are taken some CHUNK_BYTES at a time, a longer text's matches MATCH_CHUNK at a time, new matches STATE_CELLS of recursion at a time, ids to be
decoded ID_CHUNK at a time, and the cache of encoded matches is emptied at CACHE_WORDS entries; DuckDB has a limit and no folder to spill to. What grows with
one text is the text, its ids and its decoded bytes. A partition keeps nothing that a lost executor could take along; recomputing it gives the same rows.

Edge cases: null and empty texts have no ids (the digests are those of no bytes); special tokens' strings
are ordinary text; repeated rows and null doc_ids give a row each; extra columns are not read.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutlens.llm.common import released, runs_of, table

CHUNK_BYTES = 400_000
WORD_CHUNK, MATCH_CHUNK, ID_CHUNK = 40_000, 200_000, 200_000
#: Sum of squared lengths of the matches that one recursion takes: it keeps each step's tokens.
STATE_CELLS = 12_000_000
CACHE_WORDS = 600_000
LONG, GROUP = 64, 16_384

ENCODE_SQL = """
WITH RECURSIVE state AS (
    SELECT word, list(token ORDER BY pos) AS ids, true AS live FROM bytes_in GROUP BY word
    UNION ALL
    (WITH pair AS (
        SELECT word, unnest(range(1, len(ids))) AS pos, unnest(ids[:-2]) AS token, unnest(ids[2:]) AS next_token FROM state WHERE live),
     best AS (
        SELECT word, min(merged::BIGINT * 4294967296 + pos) AS chosen
        FROM pair JOIN merges ON merges.l = token AND merges.r = next_token GROUP BY word)
     SELECT word,
            CASE WHEN chosen IS NULL THEN ids
                 ELSE ids[: (chosen & 4294967295) - 1] || [(chosen >> 32)::INTEGER] || ids[(chosen & 4294967295) + 2 :] END,
            chosen IS NOT NULL
     FROM state LEFT JOIN best USING (word) WHERE live))
SELECT word, ids FROM state WHERE NOT live ORDER BY word
"""
LONG_SQL = """
WITH RECURSIVE state(word, ids, live) USING KEY (word) AS (
    SELECT word, list(token ORDER BY pos), true FROM bytes_in GROUP BY word
    UNION
    (WITH pair AS (
        SELECT word, unnest(range(1, len(ids))) AS pos, unnest(ids[:-2]) AS token, unnest(ids[2:]) AS next_token FROM state WHERE live),
     found AS (SELECT word, pos, merged, safe FROM pair JOIN merges ON merges.l = token AND merges.r = next_token),
     best AS (SELECT word, min(merged) AS merged, arg_min(safe, merged) AS safe, arg_min(pos, merged::BIGINT * 4294967296 + pos) AS leftmost FROM found GROUP BY word),
     hit AS (SELECT word, pos, pos - row_number() OVER (PARTITION BY word ORDER BY pos) AS run FROM found JOIN best USING (word, merged) WHERE best.safe OR pos = leftmost),
     -- Of hits side by side (one token repeated) every other one begins a new token.
     start AS (SELECT word, pos FROM (SELECT word, pos, pos - min(pos) OVER (PARTITION BY word, run) AS place FROM hit) WHERE place % 2 = 0),
     placed AS (SELECT word, unnest(ids) AS token, unnest(range(1, len(ids) + 1)) AS pos FROM state WHERE live AND word IN (SELECT word FROM best)),
     fresh AS (
        SELECT placed.word, placed.pos, CASE WHEN here.pos IS NULL THEN token ELSE merged END AS token
        FROM placed JOIN best USING (word) LEFT JOIN start here ON here.word = placed.word AND here.pos = placed.pos
        LEFT JOIN start before ON before.word = placed.word AND before.pos = placed.pos - 1 WHERE before.pos IS NULL)
     SELECT word, list(token ORDER BY pos), true FROM fresh GROUP BY word
     UNION ALL SELECT word, ids, false FROM state WHERE live AND word NOT IN (SELECT word FROM best)))
SELECT word, ids FROM state ORDER BY word
"""
DECODE_SQL = """
SELECT text, string_agg(hex, '' ORDER BY pos) AS hex FROM ids_in JOIN vocabulary USING (token) GROUP BY text ORDER BY text
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """A DuckDB database in memory with the merge table and the vocabulary of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: str = "220MB") -> None:
        import duckdb
        import numpy as np
        import regex

        self.np, self.find, self.walk = np, regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = [
            (ranks[token[:i]], ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        columns = np.array(pairs, dtype=np.int32).reshape(-1, 3).T
        least = np.full(max(ranks.values()) + 1, np.iinfo(np.int32).max, dtype=np.int32)
        for side in columns[:2]:
            np.minimum.at(least, side, columns[2])
        self._load("merges", pa.table({"l": columns[0], "r": columns[1], "merged": columns[2], "safe": least[columns[2]] > columns[2]}))
        #: Whether two bytes stand together in some token.
        self.joined = np.zeros(1 << 16, dtype=bool)
        for token in ranks:
            data = np.frombuffer(token, dtype=np.uint8).astype(np.int64)
            self.joined[data[:-1] << 8 | data[1:]] = True
        self._load("vocabulary", pa.table({"token": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        #: match -> its ids as the bytes of 32-bit numbers: a text's ids are their concatenation.
        self.cache: dict[str, bytes] = {}
        self.long: list[str] = []

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("rows_in", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows_in")
        self.db.unregister("rows_in")

    def _query(self, name: str, rows: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, rows)
        found = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return found

    def _parts(self, data: bytes) -> list[bytes]:
        """Cut where no token can reach over."""
        np = self.np
        codes = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        cuts = [0, *(np.flatnonzero(~self.joined[codes[:-1] << 8 | codes[1:]]) + 1).tolist(), len(data)]
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _run(self, words: list[bytes], sql: str) -> list[bytes]:
        """The ids of byte strings, as the bytes of 32-bit numbers."""
        np = self.np
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        tokens = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found = self._query("bytes_in", pa.table({"word": word, "pos": pos.astype(np.int32), "token": tokens}), sql)
        ids = found["ids"].combine_chunks()
        flat = ids.flatten().to_numpy().astype(np.int32, copy=False).tobytes()
        ends = (4 * (ids.offsets.to_numpy() - ids.offsets[0].as_py())).tolist()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _short(self, words: list[bytes]) -> list[bytes]:
        """The ids of byte strings of LONG bytes at most, many at a time."""
        np, out, a = self.np, [], 0
        cells = np.cumsum(np.fromiter((len(w) ** 2 for w in words), dtype=np.int64, count=len(words)))
        while a < len(words):
            b = int(np.searchsorted(cells, (cells[a - 1] if a else 0) + STATE_CELLS, side="right"))
            b = min(max(a + 1, b), a + WORD_CHUNK)
            out += self._run(words[a:b], ENCODE_SQL)
            a = b
        return out

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of different byte strings, as the bytes of 32-bit numbers."""
        out = [b""] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        for k, ids in zip(short, self._short([words[k] for k in short]), strict=True):
            out[k] = ids
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        spans = {k: [(a, min(a + LONG, len(words[k]))) for a in range(0, len(words[k]) - LONG // 2, LONG // 2)] for k in long}
        windows = iter(self._short([words[k][a:b] for k in long for a, b in spans[k]]))
        for k in long:
            parts = [self._placed(next(windows), a) for a, _ in spans[k]]
            out[k] = self._stitched(words[k], spans[k], parts).astype(self.np.int32).tobytes()
        return out

    def _placed(self, ids: bytes, start: int):
        """Tokens and where each begins."""
        np = self.np
        tokens = np.frombuffer(ids, dtype=np.int32).astype(np.int64)
        sizes = self.sizes[tokens]
        return start + np.cumsum(sizes) - sizes, tokens

    def _common(self, left, right):
        """Index in either of the first token that both have at the same place, or None."""
        np = self.np
        codes = [(at << 20) | tokens for at, tokens in (left, right)]
        _, i, j = np.intersect1d(codes[0], codes[1], assume_unique=True, return_indices=True)
        return (int(i[0]), int(j[0])) if len(i) else None

    def _stitched(self, data: bytes, spans: list[tuple[int, int]], parts: list):
        """The ids of a long byte string from those of overlapping windows."""
        np = self.np
        while True:
            meets = [self._common(parts[k], parts[k + 1]) for k in range(len(parts) - 1)]
            if None not in meets:
                break
            # Neighbours that have nothing in common become one.
            joined_spans, joined, k = [], [], 0
            while k < len(parts):
                end = k
                while end < len(meets) and meets[end] is None:
                    end += 1
                a, b = spans[k][0], spans[end][1]
                joined_spans.append((a, b))
                joined.append(parts[k] if end == k else self._group(data, a, b))
                k = end + 1
            spans, parts = joined_spans, joined
        out, begin = [], 0
        for k, (_, tokens) in enumerate(parts):
            end = meets[k][0] + 1 if k < len(meets) else len(tokens)
            out.append(tokens[begin:end])
            begin = meets[k][1] + 1 if k < len(meets) else 0
        return np.concatenate(out)

    def _group(self, data: bytes, start: int, end: int):
        """Tokens and places of data[start:end], whose windows have none in common: each window begins with a token of the one before."""
        np, size, at, places, found = self.np, GROUP, start, [], []
        while True:
            own = self._placed(self._run([data[at : min(end, at + size)]], LONG_SQL)[0], at)
            if places:
                # The token that both begin with is the last one taken so far.
                if own[1][0] != found[-1][-1]:
                    places, found, at, size = [], [], start, 2 * size
                    continue
                own = own[0][1:], own[1][1:]
            if at + size >= end:
                return np.concatenate([*places, own[0]]), np.concatenate([*found, own[1]])
            # What comes after the middle might be otherwise with more to read.
            cut = max(1, len(own[0]) // 2) if not places else max(2, len(own[0]) // 2)
            places.append(own[0][:cut])
            found.append(own[1][:cut])
            at = int(own[0][cut - 1])

    def _learn(self, words: list[str]) -> None:
        encoded = [w.encode() for w in words]
        cut = {k: self._parts(w) for k, w in enumerate(encoded) if len(w) > LONG}
        different = list(dict.fromkeys([w for k, w in enumerate(encoded) if k not in cut] + [p for parts in cut.values() for p in parts]))
        ids = dict(zip(different, self._encoded(different), strict=True))
        self.cache.update((word, b"".join([ids[p] for p in cut[k]]) if k in cut else ids[encoded[k]]) for k, word in enumerate(words))

    def _matches(self, text: str) -> Iterator[list[str]]:
        """A text's matches, MATCH_CHUNK at a time."""
        if len(text) <= CHUNK_BYTES:
            yield self.find(text)
            return
        found = (m[0] for m in self.walk(text))
        while chunk := list(itertools.islice(found, MATCH_CHUNK)):
            yield chunk

    def _known(self, wanted: set[str]) -> None:
        if len(self.cache) + len(wanted) > CACHE_WORDS:
            self.cache = {}
        new = sorted(w for w in wanted if w not in self.cache)
        # Long matches are not likely to come again, and are not kept.
        self.long += [w for w in new if len(w) > 4 * LONG]
        self._learn(new)

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        np, ids, short = self.np, [], [t for t in texts if len(t) <= CHUNK_BYTES]
        found = {t: self.find(t) for t in short}
        wanted = set().union(*found.values()) if found else set()
        self._known(wanted)
        for text in texts:
            if text in found:
                ids.append(b"".join(map(self.cache.__getitem__, found[text])))
                continue
            parts = []
            for words in self._matches(text):
                self._known(set(words) | wanted)
                parts.append(b"".join(map(self.cache.__getitem__, words)))
            ids.append(b"".join(parts))
        for word in self.long:
            self.cache.pop(word, None)
        self.long = []
        ends = np.cumsum([0, *map(len, ids)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))

    def decode(self, texts: pa.ListArray) -> list[bytes]:
        """The bytes of each list of ids; ids are taken some at a time, as a token's bytes need no neighbour."""
        np = self.np
        ends = texts.offsets.to_numpy()
        tokens = texts.values.to_numpy()[ends[0] : ends[-1]]
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
        parts: list[list[bytes]] = [[] for _ in range(len(texts))]
        for a in range(0, len(tokens), ID_CHUNK):
            rows = pa.table({"text": owner[a : a + ID_CHUNK], "pos": np.arange(a, min(a + ID_CHUNK, len(tokens)), dtype=np.int32), "token": tokens[a : a + ID_CHUNK]})
            found = self._query("ids_in", rows, DECODE_SQL)
            for k, digits in zip(found["text"].to_pylist(), found["hex"].to_pylist(), strict=True):
                parts[k].append(bytes.fromhex(digits))
        return [b"".join(p) for p in parts]


_CODECS: dict[tuple, Codec] = {}


def codec(ranks: bytes | str, pattern: str) -> Codec:
    """One codec for each worker process and rank file."""
    key = (hash(ranks), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec({base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines())}, pattern)
    return _CODECS[key]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded binary: every whole text encoded, and its ids decoded again."""
    default = default_vocabulary() if path is None or pattern is None else ("", "")
    pattern = pattern or default[1]
    with open(path or default[0], "rb") as f:
        ranks = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for a, b in runs_of(batch.column(1), CHUNK_BYTES):
                ids = own.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), ids, pa.array(own.decode(ids), pa.binary())], names=["doc_id", "ids", "decoded"]
                )

    return documents.select("doc_id", "text").mapInArrow(released(run), "doc_id bigint, ids array<int>, decoded binary")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of the bytes that they decode to."""
    encoded = encode_documents(table(spark, sf_dir, "documents"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
