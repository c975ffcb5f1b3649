import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from layoutlens.llm import secrets


def plain(text):
    """The patterns as they are written down, one after the other."""
    low = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    spans = [(m.start(), 0, m.end()) for m in re.finditer(low + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_patterns_match_the_plain_ones():
    rng = random.Random(3)
    parts = ["password", "TOKEN", "apı_key", "api_key", "ApiKey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJ0123456789", "deadbeef" * 3, "ab12", "é", "ſecret", "/", "."]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert secrets.pattern_spans(text) == plain(text), text


def test_network_finds_unseen_keys_and_leaves_plain_runs():
    net = secrets.train([])
    held = secrets.made_findings(900, seed=77)
    p = secrets.probabilities(net, [v for v, _ in held]) >= net["threshold"]
    found = [bool(q) for q, (_, y) in zip(p, held, strict=True) if y]
    wrong = [bool(q) for q, (_, y) in zip(p, held, strict=True) if not y]
    assert sum(found) / len(found) >= 0.95 and sum(wrong) / len(wrong) <= 0.08
    assert net["recall"] >= 0.97 and net["precision"] >= 0.9


def test_every_candidate_reaches_the_network():
    """Runs that a pattern touches, the middle of long runs, short runs with a digit."""
    rng = random.Random(1)
    tail = "".join(rng.choices("GHJKLMNPQRSTUVWXYZghjkmnpqrstuvwxyz23456789", k=24))
    text = "set x=" + "0f1e2d3c4b5a69788796a5b4" + tail + " now"
    assert secrets.candidates(text) == [(4, 54)]
    assert [k for _, k, _ in secrets.scan([text], secrets.train([]))[0]] == [3, 2]
    assert [("room a1b2c3 word longerwords 12345 abcdefghijklmnopq"[a:b]) for a, b in secrets.candidates("room a1b2c3 word longerwords 12345 abcdefghijklmnopq")] == ["a1b2c3", "abcdefghijklmnopq"]
    a, b = 10, 200
    shown = set()
    for x, y in secrets.pieces(a, b):
        assert y - x <= secrets.INSIDE
        shown |= set(range(x, y))
    assert shown == set(range(a, b))
    assert secrets.covered([(0, 0, 30), (5, 2, 10)], [(1, 9), (6, 31), (40, 50)]) == [True, False, False]


def test_many_spans_take_no_longer_than_their_number():
    text = " ".join("deadbeef" * 3 + f" a{k}bcde" for k in range(20_000))
    net = secrets.train([], made=300)
    began = time.time()
    assert len([s for s in secrets.scan([text], net)[0] if s[1] == 2]) == 20_000
    assert time.time() - began < 30


def test_learned_spans_on_the_whole_table(spark):
    """Whatever is learned is a candidate, scored by a plain forward pass, and no clean run of words is taken."""
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    net = secrets.fitted(documents)
    found = {r.doc_id: {(s.start, s.stop) for s in r.spans if s.kind == "learned"} for r in secrets.scan_documents(documents, net).collect()}
    for doc_id, text in texts.items():
        want = set()
        for a, b in secrets.candidates(text):
            if any(s <= a and b <= e for s, _, e in plain(text)):
                continue
            if max(forward(net, secrets.view(text, x, y)) for x, y in secrets.pieces(a, b)) >= net["threshold"]:
                want.add((a, b))
        assert found[doc_id] == want
    assert sum(map(len, found.values())) < 0.1 * sum(len(secrets.candidates(t)) for t in texts.values()) + 5


def forward(net, shown):
    """One view through the network, place by place."""
    acts = [[max(0.0, float(net["bias"][f]) + sum(float(net["table"][j][shown[k + j]][f]) for j in range(secrets.WIDTH))) for f in range(secrets.FILTERS)] for k in range(secrets.SPAN - secrets.WIDTH + 1)]
    pooled = [max(acts[k][f] for k in range(a, b)) for a, b in secrets._SEGMENTS for f in range(secrets.FILTERS)]
    pooled += [sum(acts[k][f] for k in range(a, b)) / (b - a) for a, b in secrets._SEGMENTS for f in range(secrets.FILTERS)]
    z = (sum(w * x for w, x in zip(net["out"].tolist(), pooled, strict=True)) + float(net["base"][0])) / net["temperature"]
    return 1 / (1 + math.exp(-z))


def test_whole_table_base_spans(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in secrets.op9(spark, "/root/testdata/sf0.001").collect():
        base = plain(texts[r.doc_id])
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("learned")] == [s for s in joined.split(",") if s]


def test_edge_cases_and_redaction(make_documents):
    net = secrets.train([])
    rows = [(None, None), (1, ""), (2, "é token = 'abcdef12' end"), (2, "é token = 'abcdef12' end"), (3, "plain words " * 50_000 + "AKIA" + "A1" * 10)]
    documents = make_documents(rows).withColumn("spans", F.lit("clash"))
    found = sorted(secrets.scan_documents(documents, net).collect(), key=lambda r: r.doc_id or 0)
    assert [len(r.spans) for r in found] == [0, 0, 1, 1, 1]
    clean = sorted(secrets.redact(documents, net).collect(), key=lambda r: r.doc_id or 0)
    assert clean[0].text is None and clean[2].text == "é [secret:assign]' end" and clean[2].n_chars == len(clean[2].text)
    assert clean[4].text.endswith("words [secret:access]")
    assert secrets.scan_documents(make_documents([]), net).count() == 0


def test_no_text_comes_to_the_driver(spark, make_documents, monkeypatch):
    """The network is that of views taken from the texts in order, and only views are collected."""
    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame

    rows = [(k, "word " * 2_000 + f"password={'abc' * (k % 4 + 2)}{k} AKIA{k:016} " + "0123456789abcdef" * 2) for k in range(60)]
    documents = make_documents(rows).repartition(5)
    taken, collect = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: (taken.append(collect(self)), taken[-1])[1])
    net = secrets.fitted(documents)
    assert sum(t.nbytes for t in taken) < 60 * 1_000 < sum(len(t) for _, t in rows)
    order = [r.text for r in documents.orderBy(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000)), "text").collect()]
    want = secrets.train(secrets.pattern_findings(order))
    assert set(net) == set(want) and all(np.array_equal(net[k], want[k]) for k in want)
