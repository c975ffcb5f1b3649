import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from layoutlens.llm import lm_scoring, mixing

LETTERS = b"abcdefghijklmnopqrstuvwxyz \xc3\xa9"


def some_texts(n, size, seed):
    rng = random.Random(seed)
    return [bytes(rng.choices(LETTERS, k=rng.randrange(size))) for _ in range(n)]


def counted(texts):
    parts = [mixing.summed(mixing.places(run)[0]) for _, run in mixing.segments(texts)]
    return mixing.merged(parts)


def common_of(keys, counts):
    at = (mixing.context(keys, 1) << np.uint64(8) | keys & np.uint64(255)).astype(np.int64)
    return mixing.Common(np.bincount(at, weights=counts, minlength=1 << 16).reshape(256, 256))


def taken(texts, code):
    """(order, context, depth, node, bit) of every decision, text by text."""
    for t in texts:
        symbols = [*t.lower(), mixing.END]
        for place, s in enumerate(symbols):
            before = tuple([-1] * 6 + symbols[:place])[-6:]
            for depth in range(code.length[s]):
                for order in mixing.ORDERS:
                    yield order, before[-order:], depth, code.node[depth, s], code.bit[depth, s]


def test_counts_are_exact_whatever_is_asked():
    texts = [*some_texts(60, 900, 1), b"", b"A bA", b"AAAA"]
    keys, counts = counted(texts)
    common = common_of(keys, counts)
    seen, ones = Counter(), Counter()
    for order, before, depth, node, bit in taken(texts, common.code):
        seen[order, before, depth, node] += 1
        ones[order, before, depth, node] += int(bit)
    # Places of other texts, most of them never met, are looked up among those that were.
    other, _ = counted(some_texts(60, 900, 2))
    every, n = mixing.merged([(keys, counts), (other, np.zeros(len(other), dtype=np.int64))])
    checked = 0
    for depth, on, bit, o, s in mixing.decisions(every, n, common):
        for j, at in enumerate(on):
            key = int(every[at])
            before = tuple(-1 if b == mixing.BEFORE else b for b in (key >> 8).to_bytes(6, "little"))
            node = common.code.node[depth, key & 255]
            assert bit[j] == common.code.bit[depth, key & 255]
            for k, order in enumerate(mixing.ORDERS):
                name = (order, before[-order:], depth, node)
                assert (s[k][j], o[k][j]) == (seen[name], ones[name])
                checked += 1
    assert checked > 100_000


def test_probabilities_sum_to_one():
    keys, counts = counted([b"abracadabra, abra cadabra\xc3\xa9"] * 20)
    for before in (b"", b"abr", b"zz", b"acadab"):
        own = mixing.places([(b"", before[-6:], True)])[0] & ~np.uint64(255)
        asked = own + mixing.SYMBOLS.astype(np.uint64)
        every, n = mixing.merged([(keys, counts), (asked, np.zeros(len(asked), dtype=np.int64))])
        cost = mixing.costs(every, n, common_of(keys, counts))[np.searchsorted(every, asked)]
        assert len(asked) == 231 and abs(np.exp(-cost).sum() - 1) < 1e-9


def test_a_text_makes_what_it_repeats_likelier():
    line = b"a line that nobody knows: zqx vwk jjq. "
    keys, owner = mixing.places([(line * 6, b"", True), (line, b"", True)])
    loss = np.full(len(keys), math.log(231))
    found = mixing.adapted(keys, owner, loss)
    size = len(line)
    assert found[: size - 6].mean() > 4 * found[4 * size : 5 * size].mean() and np.allclose(found[owner == 1][:size], loss[0], atol=0.2)
    # Whatever came before, the 231 probabilities of the next byte add up to one.
    before = line * 3 + b"a line"
    total = 0.0
    for b in mixing.SYMBOLS.tolist():
        keys, owner = mixing.places([(before + (b"" if b == mixing.END else bytes([b])), b"", b == mixing.END)])
        total += math.exp(-mixing.adapted(keys, owner, np.full(len(keys), math.log(231)))[-1])
    assert abs(total - 1) < 1e-9


def test_learning_lowers_the_cost_of_new_text():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=60)).encode() for _ in range(120)]
    keys, counts = counted(texts[:100])
    other, n = counted(texts[100:])
    every, both = mixing.merged([(keys, counts), (other, np.zeros(len(other), dtype=np.int64))])
    cost = mixing.costs(every, both, common_of(keys, counts))[np.searchsorted(every, other)] @ n
    plain = sum(map(len, texts[100:])) * math.log(9)
    assert cost < 0.75 * plain


def test_long_texts_in_pieces_have_the_places_of_whole_ones():
    text = some_texts(1, 9_000, 3)[0] + b"END of it"
    whole = mixing.places(next(mixing.segments([text]))[1])[0]
    parts = np.concatenate([mixing.places(run)[0] for _, run in mixing.segments([text], 700)])
    assert (whole == parts).all() and len(whole) == len(text) + 1


def test_split_contexts_stay_whole_below_the_split():
    keys, _ = counted(some_texts(200, 900, 4))
    marks, sizes = mixing.heavy(keys, 2_000)
    split = np.sort(marks[sizes > len(keys) // 750])
    shard = mixing.dealt(keys, 64, split)
    assert len(split) and len(set(shard.tolist())) > 50
    opened = {int(m) & ((1 << 16) - 1) for m in split if m >> 48 == 2}
    by_pair = {}
    for k, s in zip(keys.tolist(), shard.tolist(), strict=True):
        by_pair.setdefault(k >> 40, set()).add(s)
    assert all(len(s) == 1 for p, s in by_pair.items() if p not in opened) and any(len(by_pair[p]) > 1 for p in opened)


def brute(rows):
    tokens = {k: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] for k, t in rows}
    counts, ends = Counter(), 0
    for k, _ in rows:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            counts.update(tokens[k])
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = {}
    for k, _ in rows:
        c = [counts[w] for w in tokens[k]] + [ends]
        out[k] = (len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c))
    return out


def test_base_line_and_score_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = brute(rows)
    found = {r.doc_id: r for r in lm_scoring.op2(spark, "/root/testdata/sf0.001").collect()}
    assert found.keys() == want.keys()
    for doc_id, r in found.items():
        n_tokens, n_known, n, base = want[doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n_tokens, n_known, n, zlib.crc32(str(doc_id).encode()) % 7 == 2)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    # The same model without Spark: places of all training rows, dealt to as many shards.
    texts = {k: (t or "").encode() for k, t in rows}
    keys, counts = counted([t for k, t in texts.items() if not found[k].held_out])
    every, n = mixing.merged([(keys, counts), *((k, np.zeros(len(k), dtype=np.int64)) for k in [counted([t])[0] for t in texts.values()])])
    cost, common = np.zeros(len(every)), common_of(keys, counts)
    for _, part in mixing.by_shard(mixing.dealt(every, lm_scoring.LEAST_SHARDS, np.zeros(0, dtype=np.int64))):
        cost[part] = mixing.costs(every[part], n[part], common)
    for doc_id, text in texts.items():
        seen, both, total = Counter(), Counter(), 0.0
        for key in mixing.places([(text, b"", True)])[0].tolist():
            p = math.exp(-cost[np.searchsorted(every, np.uint64(key))])
            total += math.log10((both[key] + mixing.MODEL_WEIGHT * p) / (seen[key >> 8] + mixing.MODEL_WEIGHT))
            seen[key >> 8] += 1
            both[key] += 1
        assert math.isclose(total, found[doc_id].score, rel_tol=1e-4, abs_tol=1e-3)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.bits_per_byte * (len(texts[r.doc_id]) + 1) for r in held) / sum(len(texts[r.doc_id]) + 1 for r in held) < 2.6


def test_chunks_and_pieces_change_nothing(spark, make_documents, monkeypatch):
    texts = [t.decode("utf-8", "replace") for t in some_texts(60, 400, 4)]
    documents = make_documents([(k, t) for k, t in enumerate([*texts, "", None, texts[0]])]).repartition(3)
    learn = F.col("doc_id") % 3 != 1
    want = {r.doc_id: r for r in lm_scoring.score(documents, learn).collect()}
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 1_000)
    monkeypatch.setattr(mixing, "PIECE_BYTES", 700)
    assert max(map(len, texts)) < 700
    found = {r.doc_id: r for r in lm_scoring.score(documents, learn).collect()}
    assert len(want) == 63
    for k, v in want.items():
        assert math.isclose(found[k].score, v.score, rel_tol=1e-4, abs_tol=2e-3) and math.isclose(found[k].base_score, v.base_score, rel_tol=1e-9)


def test_edge_cases(make_documents):
    rows = [(None, None), (1, ""), (2, "A a"), (2, "A a"), (3, "word " * 30_000)]
    documents = make_documents(rows).withColumn("chunk", F.lit("own")).withColumn("learn", F.lit(7))
    found = lm_scoring.score(documents, F.lit(True)).collect()
    assert sorted(r.n_tokens for r in found) == [1, 1, 3, 3, 30_001]
    assert all(r.base_score == 0 or r.n_known == r.n_tokens for r in found)
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score < 0 for r in lm_scoring.score(documents, F.lit(False)).collect())
    assert lm_scoring.score(make_documents([]), F.lit(True)).count() == 0
