import math
import random
import zlib

from pyspark.sql import functions as F

from layoutlens.llm import toxicity
from layoutlens.llm.common import labelled_sample


def corpus(n, rng, words=("vile", "grimy", "rotten", "hateful")):
    rows = []
    for _ in range(n):
        text = [rng.choice(["stone", "river", "garden", "window", "letter", "market"]) + rng.choice(["ing", "er", "ly", ""]) for _ in range(rng.randrange(10, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((" ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy():
    rng = random.Random(4)
    model = toxicity.train(corpus(300, rng))
    held = corpus(150, rng)
    found = toxicity.score_texts([t for t, _ in held], model, toxicity.Distances(model["toxic"], model["ordinary"]))
    assert sum((s >= 0.5) == y for s, (_, y) in zip(found, held, strict=True)) >= 143


def test_without_labels_the_score_is_constant(make_documents):
    model = toxicity.train([("text", 0)])
    assert [r.score for r in toxicity.score(make_documents([(1, "a"), (None, None)]), model).collect()] == [0.0, 0.0]
    assert toxicity.train([]) == {"constant": 0.5}


def test_edge_cases(make_documents):
    model = toxicity.train(corpus(200, random.Random(6)))
    rows = [(None, None), (1, ""), (2, "vile rotten hateful vile"), (2, "vile rotten hateful vile"), (3, "x" * 200_000), (4, "stone " * 40_000)]
    found = toxicity.score(make_documents(rows).withColumn("score", F.lit("clash")), model).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert all(r.score > 0.5 for r in found if r.doc_id == 2) and all(r.score < 0.5 for r in found if r.doc_id in (1, 4))
    assert toxicity.score(make_documents([]), model).count() == 0


def test_short_words_count():
    rng = random.Random(9)
    model = toxicity.train(corpus(400, rng, words=("ugh", "bah", "vex")))
    assert {b"ugh", b"bah", b"vex"} <= set(model["toxic"])
    held = corpus(150, rng, words=("ugh", "bah", "vex"))
    found = toxicity.score_texts([t for t, _ in held], model, toxicity.Distances(model["toxic"], model["ordinary"]))
    assert sum((s >= 0.5) == y for s, (_, y) in zip(found, held, strict=True)) >= 140


def test_query_matches_a_plain_pass(spark):
    """Every row of the query by compressing each window anew, and its accuracy where labels are held out."""
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    model = toxicity.train(labelled_sample(spark, d, "toxic", {1: toxicity.TOXIC_ROWS, 0: toxicity.ORDINARY_ROWS}))
    found = {r.doc_id: r for r in toxicity.op3(spark, d).collect()}
    assert found.keys() == rows.keys()
    own = toxicity.Distances(model["toxic"], model["ordinary"])
    for doc_id in sorted(rows)[::20]:
        distances = []
        for w in toxicity.windows(rows[doc_id]):
            wide = own._wide(w, toxicity._END)
            distances.append(len(own.ordinary(wide)) - len(own.toxic(wide)))
        far = sorted((x for x in distances if x >= model["threshold"]), reverse=True)
        x = [min(1.0, 20 * len(far) / max(1, len(distances))), min(3, len(far)) / 3, (far[0] - model["threshold"] + 1) / 8 if far else 0.0, sum(far[:3]) / min(3, len(far)) / 16 if far else 0.0]
        z = sum(a * b for a, b in zip(model["weights"], [*x, 1.0], strict=True))
        assert abs(found[doc_id].score - 1 / (1 + math.exp(-z))) < 1e-9
    for doc_id, r in found.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [k for k, r in found.items() if r.held_out and labels.get(k) in (0, 1)]
    assert sum(found[k].predicted == labels[k] for k in held) / len(held) >= 0.9
