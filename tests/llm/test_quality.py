import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from layoutlens.llm import common, quality, shingles


def corpus(n, rng):
    rows = []
    for _ in range(n):
        words = [rng.choice(["stone", "river", "garden", "window"]) + rng.choice(["ing", "er", "ly", "s", "ful"]) for _ in range(rng.randrange(20, 80))]
        good = rng.random() < 0.8
        if not good:
            words = rng.choice([lambda w: [x.upper() + "!!" for x in w], lambda w: [x + rng.choice(["***", "$$$"]) for x in w], lambda w: [w[0]] * len(w)])(words)
        rows.append((" ".join(words) + ".", int(good)))
    return rows


def test_runs_match_a_plain_splitter():
    texts = ["Ab12!! cd", "", "  ", "ÉÀ x--9", "THE end"]
    hashes, shapes, counts = shingles.run_hashes(texts)
    plain = [re.findall(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|[^\sA-Za-z0-9\x80-\U0010ffff]+", t) for t in texts]
    assert counts.tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    again, _, _ = shingles.run_hashes(flat)
    assert hashes.tolist() == again.tolist() and shapes.max() < quality.SHAPES
    assert len(set(hashes.tolist())) == len({w.lower() for w in flat})


def test_held_out_accuracy_and_calibration():
    rng = random.Random(8)
    model = quality.train(corpus(600, rng))
    held = corpus(300, rng)
    found = quality.score_texts([t for t, _ in held], model)
    y = np.array([v for _, v in held])
    assert ((found >= quality.THRESHOLD) == y).mean() >= 0.97
    assert ((found - y) ** 2).mean() < 0.03


def test_edge_cases(make_documents):
    model = quality.train(corpus(200, random.Random(9)))
    rows = [(None, None), (1, ""), (2, "same text"), (2, "same text"), (3, "x" * 700_000), (4, "RIVERING!! STONELY!! GARDENER!!")]
    documents = make_documents(rows).withColumns({"score": F.lit("clash"), "node": F.lit(1)})
    found = quality.score(documents, model).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    kept = quality.keep_good(documents, model)
    assert kept.columns == documents.columns
    want = sorted(str(r.doc_id) for r in found if r.score >= quality.THRESHOLD)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert quality.score(make_documents([]), model).count() == 0
    assert quality.train([("a", 1)] * 30) == {"constant": 1.0} and quality.train([]) == {"constant": 0.5}


def test_query_matches_a_plain_pass(spark):
    """Every tenth row of the query word by word, and its accuracy where labels are held out."""
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    model, found = quality.fitted(spark, d), {r.doc_id: r for r in quality.op7(spark, d).collect()}
    assert found.keys() == rows.keys()
    net, vectors = model["net"], model["vectors"]
    for doc_id in sorted(rows)[::10]:
        runs = re.findall(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|[^\sA-Za-z0-9\x80-\U0010ffff]+", rows[doc_id])
        means = [np.zeros(quality.WIDTH), np.zeros(quality.WIDTH)]
        for w in runs:
            hashes, shapes, _ = shingles.run_hashes([w])
            means[0] += vectors["words"][int(hashes[0]) % quality.SLOTS] / len(runs)
            means[1] += vectors["shapes"][int(shapes[0])] / len(runs)
        x = np.concatenate([*means, [np.linalg.norm(m) for m in means], [np.log1p(len(runs))]])
        hidden = np.tanh(((x - net["mean"]) / net["scale"]) @ net["w1"] + net["b1"])
        z = float((hidden @ net["w2"] + net["b2"])[0]) / net["temperature"]
        assert abs(found[doc_id].score - 1 / (1 + np.exp(-z))) < 1e-3
    for doc_id, r in found.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [k for k, r in found.items() if r.held_out and labels.get(k) in (0, 1)]
    assert sum(found[k].predicted == labels[k] for k in held) / len(held) >= 0.9


def test_no_text_comes_to_the_driver(spark, tmp_path, monkeypatch):
    """The model is that of the plain pass, also over long, repeated and null texts, and what is collected does not grow with them."""
    from pyspark.sql.classic.dataframe import DataFrame

    rng = random.Random(10)
    rows = [(k, t, v) for k, (t, v) in enumerate(corpus(300, rng))]
    rows = [(k, t * 40 if k % 3 else None if k % 7 == 0 else t, v) for k, t, v in rows]
    rows += rows[:40]
    spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, v) for k, _, v in rows], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    shares = common.label_shares(spark, str(tmp_path), "quality", 250)
    plain = common.labelled_sample(spark, str(tmp_path), "quality", shares)
    taken, collect = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: (taken.append(self.columns), collect(self))[1])
    monkeypatch.setattr(quality, "ROWS", 250)
    model = quality.fitted(spark, str(tmp_path))
    assert taken and not any("text" in columns for columns in taken)
    want = quality.train(plain)
    assert len(plain) > 100 and all((model["vectors"][k] == want["vectors"][k]).all() for k in ("words", "shapes"))
    assert all(np.array_equal(model["net"][k], want["net"][k]) for k in want["net"])


def test_too_few_labels(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in (1, 2)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert quality.fitted(spark, str(tmp_path)) == {"constant": 1.0}
    spark.createDataFrame([], "doc_id bigint, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert quality.fitted(spark, str(tmp_path)) == {"constant": 0.5}
