import random

import numpy as np
from pyspark.sql import functions as F

from layoutlens.llm import near_dedup, shingles
from llm_helpers import brute_classes, similarity


def invented(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n)]


def near_copies(rng):
    rows, key = [], 0
    for _ in range(12):
        words = invented(rng, rng.randrange(30, 200))
        for _ in range(rng.randrange(1, 6)):
            own = list(words)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = "edit" + str(rng.randrange(1000))
            rows.append((key, " ".join(own)))
            key += 1
    return rows


def test_overlap_is_exact():
    rng = random.Random(3)
    rows = near_copies(rng)
    left, right = [t for _, t in rows[:-1]] + ["", "a", "one two"], [t for _, t in rows[1:]] + ["x", "A ", "one, two!"]
    assert np.allclose(shingles.overlap(left, right), [similarity(a, b) for a, b in zip(left, right, strict=True)])


def test_signatures_are_unbiased_for_weights():
    rng = random.Random(5)
    words = invented(rng, 300)
    a = " ".join(words[:100] * 7 + words[100:])
    b = " ".join(words[:100] * 2 + words[100:250] + invented(rng, 80))
    found = near_dedup.signatures([a, b], 4000)
    assert abs((found[0] == found[1]).mean() - similarity(a, b)) < 0.03


def test_classes_match_brute_force(make_documents):
    rows = near_copies(random.Random(11))
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, ""), (1003, ""), (1004, "!!"), (1005, "two words"), (1006, "two  Words")]
    found = {r.doc_id: r.class_id for r in near_dedup.classes(make_documents(rows)).collect()}
    assert found == brute_classes(rows)


def test_on_whole_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = {r.doc_id: r.class_id for r in near_dedup.classes(documents).collect()}
    assert found == brute_classes(rows)


def test_keeps_one_of_each_class_whatever_the_columns(make_documents):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, None), (3, text), (3, text), (1, text), (None, text), (7, "other " + text * 3)]
    documents = make_documents(rows).withColumns({"node": F.lit("clash"), "class_id": F.lit(9), "__own": F.lit("mine"), "__node": F.lit("mine"), "__id": F.lit(1), "__n": F.lit(2), "row": F.lit(3), "own": F.lit(4), "n": F.lit(5)})
    kept = near_dedup.keep_one(documents)
    assert kept.columns == documents.columns
    assert {(r["__own"], r["__node"], r["__id"], r["__n"], r.row, r.own, r.n) for r in kept.collect()} == {("mine", "mine", 1, 2, 3, 4, 5)}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()) == [(False, 1, text), (False, 7, rows[-1][1]), (True, 0, None)]


def test_letters_of_any_script_and_case(make_documents):
    text = "Über die große Straße geht der Élève früh nach Hause und liest «Bücher» – viele Bücher"
    rows = [(1, text), (2, text.upper().replace("SS", "ß").lower()), (3, text.replace("«", '"').replace("»", '"').replace("–", "-")), (4, text.replace(" ", "\u00a0"))]
    found = {r.doc_id: r.class_id for r in near_dedup.classes(make_documents(rows)).collect()}
    assert found == brute_classes(rows) and set(found.values()) == {1}


def test_long_texts(make_documents):
    rng = random.Random(8)
    words = invented(rng, 60_000)
    edited = [w if k % 500 else "edit" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(invented(rng, 50_000)))]
    found = {r.doc_id: r.class_id for r in near_dedup.classes(make_documents(rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3}


def test_query_and_recall(spark):
    """Every class of sf0.01 by all pairs that share a shingle: recall of documents that are linked to another."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found, want = {r.doc_id: r.class_id for r in near_dedup.op8(spark, "/root/testdata/sf0.01").collect()}, brute_classes(rows)
    linked = [k for k, c in want.items() if c != k]
    assert len(linked) > 50 and sum(found[k] == want[k] for k in linked) / len(linked) == 1.0 and all(found[k] == k for k, c in want.items() if c == k)


def test_empty_table(make_documents):
    assert near_dedup.classes(make_documents([])).count() == 0
    assert near_dedup.keep_one(make_documents([])).count() == 0
