import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from layoutlens.llm import language_id as li


def corpus(n, rng):
    kinds = {"xx": "ka lo mi nu ra te".split(), "yy": "sch ber ung ein zu ge".split(), "zz": "ção ñe ria çal ões mi".split()}
    rows = []
    for _ in range(n):
        lang = rng.choice(sorted(kinds))
        rows.append((" ".join("".join(rng.choices(kinds[lang], k=3)) for _ in range(rng.randrange(5, 90))), lang))
    return rows


def net():
    rows = corpus(300, random.Random(1))
    return li.train([t for t, _ in rows], [g for _, g in rows])


def test_held_out_accuracy():
    held = corpus(200, random.Random(2))
    names, scores = li.Applied(net()).predict([t for t, _ in held])
    assert sum(a == g for a, (_, g) in zip(names, held, strict=True)) >= 198
    assert min(scores) > 0.3 and max(scores) <= 1


def test_pair_tables_change_nothing():
    own = net()
    windows = np.random.default_rng(3).integers(0, 256, size=(50, li.WINDOW), dtype=np.uint8)
    most, _ = li._responses(own, windows)
    plain = li._log_softmax(np.maximum(most, 0) @ own["out"] + own["base"])
    assert np.allclose(li.Applied(own).log_probabilities(windows), plain, atol=1e-4)


def test_edge_cases(make_documents):
    rows = [(None, None), (1, ""), (2, "123 !? ½ ² ① Ⅷ _"), (3, "kalo minu"), (3, "kalo minu"), (4, "kalo minu " * 50_000)]
    found = li.identify(make_documents(rows).withColumn("score", F.lit("clash")), net()).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in found) == [(0, "und"), (1, "und"), (2, "und"), (3, "xx"), (3, "xx"), (4, "xx")]
    assert all(0 <= r.score <= 1 for r in found)
    assert li.identify(make_documents([]), net()).count() == 0
    assert li.train([], []) is None
    assert [r.lang_pred for r in li.identify(make_documents(rows), None).collect()] == ["und"] * 6


def test_training_rows_are_bounded_whatever_repeats(spark, tmp_path):
    rows = [(None, "ka lo mi nu", "xx")] * 900 + [(7, "sch ber", "yy")] * 900 + [(k, f"ção {k}", "zz") for k in range(50)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    texts, langs = li.training_rows(spark, str(tmp_path), rows=60)
    assert len(texts) == len(langs) <= 60 and all(langs.count(g) <= 60 // len(set(langs)) for g in set(langs)) and langs.count("zz") >= 15


def test_query_matches_a_plain_pass(spark):
    """Every row of the query by a forward pass that walks over windows and filters one by one, and its accuracy where labels are held out."""
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    own = li.train(*li.training_rows(spark, d))
    found = {r.doc_id: r for r in li.op5(spark, d).collect()}
    assert found.keys() == rows.keys()
    for doc_id, r in found.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
    for doc_id in sorted(rows)[::10]:
        text, total, size = rows[doc_id].text or "", np.zeros(len(own["names"])), 0
        data = text.encode()
        for a in range(0, max(1, len(data)), li.WINDOW):
            part = data[a : a + li.WINDOW].ljust(li.WINDOW, b"\0")
            pooled = []
            for k, width in enumerate(li.WIDTHS):
                pooled.append(np.max([sum(own["tables"][k][j][part[i + j]] for j in range(width)) for i in range(li.WINDOW - width + 1)], axis=0))
            z = np.maximum(np.concatenate(pooled) + own["bias"], 0) @ own["out"] + own["base"]
            weight = min(li.WINDOW, len(data) - a)
            total += weight * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
            size += weight
        p = np.exp(total / size - (total / size).max())
        assert found[doc_id].lang_pred == own["names"][int(p.argmax())] and abs(found[doc_id].score - p.max() / p.sum()) < 1e-3
    held = [k for k, r in found.items() if r.held_out and rows[k].lang]
    assert sum(found[k].lang_pred == rows[k].lang for k in held) / len(held) > 0.95
