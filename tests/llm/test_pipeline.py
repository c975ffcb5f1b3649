import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from layoutlens.llm import bpe, quality, secrets
from llm_helpers import brute_classes, contained

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, raw_schema, kept = docs.columns, docs.schema, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema) if name != "bpe" else stage(spark, docs, SF)
        kept[name] = docs.collect()
        assert name == "bpe" or docs.columns == columns
    raw = spark.read.parquet(f"{SF}/documents.parquet").collect()
    model = quality.fitted(spark, SF)
    scores = quality.score_texts([r.text or "" for r in raw], model)
    assert {r.doc_id for r in kept["quality"]} == {r.doc_id for r, s in zip(raw, scores, strict=True) if s >= quality.THRESHOLD}
    classes = brute_classes([(r.doc_id, r.text) for r in kept["quality"]])
    assert sorted(r.doc_id for r in kept["near_dedup"]) == sorted(set(classes.values()))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in kept["decontaminate"]} == {r.doc_id for r in kept["near_dedup"] if not any(contained(i, r.text) >= 0.8 for i in items)}
    before = {r.doc_id: r.text for r in kept["decontaminate"]}
    assert {r.doc_id for r in kept["secrets"]} == set(before)
    net = secrets.fitted(spark.createDataFrame(kept["decontaminate"], raw_schema))
    for r in kept["secrets"]:
        assert r.text == redacted(before[r.doc_id], secrets.scan([before[r.doc_id]], net)[0]) and r.n_chars == len(r.text)
        assert not secrets.pattern_spans(r.text)
    path, pattern = bpe.default_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text for r in kept["secrets"]}
    assert {r.doc_id: (r.ids, r.text) for r in kept["bpe"]} == {k: (library.encode_ordinary(t), t) for k, t in texts.items()}


    # The same rows by `run`, which hands tables over by itself.
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "ids", "text"]
    assert {r.doc_id: (r.ids, r.text) for r in found.collect()} == {r.doc_id: (r.ids, r.text) for r in kept["bpe"]} and len(kept["bpe"]) > 50


def redacted(text, spans):
    """Whatever lies in a span goes; the kind of the first span of a stretch stands for it."""
    out, k = "", 0
    while k < len(text):
        here = [s for s in spans if s[0] == k]
        if not here:
            out, k = out + text[k], k + 1
            continue
        stop = here[0][2]
        while inner := [e for a, _, e in spans if k <= a < stop < e]:
            stop = max(inner)
        out, k = out + f"[secret:{secrets.KINDS[here[0][1]]}]", stop
    return out


def test_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, clashing columns, empty tables."""
    text = "Entry one: the quick brown fox jumps over the lazy dog, and then some more words follow it here."
    rows = [(None, None, "en"), (1, text, "en"), (1, text, "en"), (2, "", None), (3, "Another entry with words of its own, which nobody copied, holds api_key = abcdef123456", "en"), (4, "word " * 50_000, "en")]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, frame in {"documents": spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "empty": spark.createDataFrame([], "doc_id bigint, text string, lang string")}.items():
        d = str(tmp_path / name)
        frame.withColumn("node", F.lit("mine")).withColumn("n", F.lit(1)).write.parquet(f"{d}/documents.parquet")
        labels.limit(0).write.parquet(f"{d}/labels.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
        found = corpus_pipeline.run(spark, d).collect()
        if name == "empty":
            assert found == []
        else:
            # Without labels nothing is rejected; one of the equal rows and of the empty texts stays, and the secret goes.
            assert sorted(r.doc_id or 0 for r in found) == [1, 2, 3, 4]
            assert next(r.text for r in found if r.doc_id == 3).endswith("[secret:assign]")
