import random

from pyspark.sql import functions as F

from layoutlens.llm import decontaminate as dc
from llm_helpers import contained


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def brute(documents, benchmark):
    found = [(d, i, contained(t, x)) for d, x in documents for i, t in benchmark]
    return sorted((str(d), str(i), round(c, 9)) for d, i, c in found if c >= 0.8)


def test_matches_brute_force_in_both_ways(spark, make_documents, monkeypatch):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(30))
    benchmark = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 14, 30])))) for k in range(25)]
    benchmark += [(0, benchmark[0][1]), (90, ""), (91, None), (None, "one two three four five six")]
    documents = []
    for k in range(60):
        words = [word() for _ in range(rng.randrange(0, 200))]
        own = rng.choice(benchmark)[1] or ""
        cut = own.split()
        if rng.random() < 0.4 and len(cut) > 8:
            cut[rng.choice([0, -1])] = "changed"
        documents.append((k, " ".join(words) + "; " + " ".join(cut).upper() + ". " + " ".join(words[:5])))
    documents += [(None, documents[0][1]), (1, documents[1][1]), (70, None), (71, "")]
    want = brute(documents, benchmark)
    for limit in (dc.BROADCAST_BYTES, 0):
        monkeypatch.setattr(dc, "BROADCAST_BYTES", limit)
        frame = make_documents(documents).withColumn("item_id", F.lit("clash"))
        found = dc.contained_items(frame, items(spark, benchmark)).collect()
        assert sorted((str(r.doc_id), str(r.item_id), round(r.containment, 9)) for r in found) == want
    extra = make_documents(documents).withColumns({"__key": F.lit("mine"), "__leak": F.lit(3), "text_key": F.lit("own"), "row": F.lit(4)})
    clean = dc.without_leaks(extra, items(spark, benchmark))
    assert clean.columns == extra.columns and {(r["__key"], r["__leak"], r.text_key, r.row) for r in clean.collect()} == {("mine", 3, "own", 4)}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, x in documents if not any(contained(t, x) >= 0.8 for _, t in benchmark))


def test_long_text_and_the_query(spark, make_documents):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    long = "word " * 60_000 + item + " tail" * 60_000
    found = dc.contained_items(make_documents([(1, long), (2, "word " * 1_000)]), items(spark, [(7, item)])).collect()
    assert [(r.doc_id, r.item_id, r.containment) for r in found] == [(1, 7, 1.0)]
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert sorted((str(r.doc_id), str(r.item_id), round(r.containment, 9)) for r in dc.op4(spark, d).collect()) == brute(rows, bench)


def test_empty_tables(spark, make_documents):
    assert dc.contained_items(make_documents([]), items(spark, [(1, "a b")])).count() == 0
    assert dc.contained_items(make_documents([(1, "a b")]), items(spark, [])).count() == 0
