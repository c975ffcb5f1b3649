import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from layoutlens.llm import fingerprints as fp


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_root(text):
    nodes = []
    for block in text.split("\n\n"):
        paragraphs = [sha("P" + "".join(sha(x) for x in re.findall(fp.PIECE_PATTERN, p))) for p in block.split("\n")]
        for k in range(0, len(paragraphs), fp.SECTION):
            nodes.append(sha(("T" if k else "S") + "".join(paragraphs[k : k + fp.SECTION])))
    return sha("R" + "".join(nodes))


def test_roots_and_changes(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(60):
        lines = [rng.choice(["", "a b.", "c d! e?", "x" * 400]) for _ in range(rng.randrange(50))]
        edited = list(lines)
        if lines:
            edited[rng.randrange(len(lines))] = "changed"
        rows.append(("\n".join(lines), "\n".join(edited)))
    frame = spark.createDataFrame(rows, "a string, b string")
    trees = frame.withColumns({"ta": fp.tree(F.col("a")), "tb": fp.tree(F.col("b"))})
    made = trees.select("a", "b", fp.root(F.col("ta")).alias("ra"), fp.root(F.col("tb")).alias("rb"), fp.changed_paragraphs(F.col("ta"), F.col("tb")).alias("new"), fp.changed_paragraphs(F.col("tb"), F.col("ta")).alias("gone"))
    for r in made.collect():
        assert r.ra == plain_root(r.a) and r.rb == plain_root(r.b) and (r.ra == r.rb) == (r.a == r.b)
        a, b = ([p for block in t.split("\n\n") for p in block.split("\n")] for t in (r.a, r.b))
        assert r.new == [k for k, p in enumerate(b) if p not in a] and r.gone == [k for k, p in enumerate(a) if p not in b]


def test_an_inserted_or_removed_paragraph_alone_is_changed(spark):
    lines = [f"line {k}." for k in range(100)]
    rows = [("\n".join(lines), "\n".join([*lines[:20], "new one", *lines[20:]])), ("\n".join(lines), "\n".join(lines[:90])), ("\n".join(lines), "\n".join(lines[50:] + lines[:50]))]
    trees = spark.createDataFrame(rows, "a string, b string").withColumns({"ta": fp.tree(F.col("a")), "tb": fp.tree(F.col("b"))})
    found = trees.select(fp.changed_paragraphs(F.col("ta"), F.col("tb")).alias("new"), fp.changed_paragraphs(F.col("tb"), F.col("ta")).alias("gone")).collect()
    assert [(r.new, r.gone) for r in found] == [([20], []), ([], list(range(90, 100))), ([], [])]


@pytest.mark.parametrize("rows_per_range", [2, 512])
def test_successors(make_documents, rows_per_range):
    rng = random.Random(2)
    ids = rng.sample(range(-500, 500), 90)
    rows = [(k, f"text {k}") for k in ids] + [(ids[0], "tie"), (None, "none")]
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {r: ordered[(k + 1) % len(ordered)][1] for k, r in enumerate(ordered)}
    found = fp.with_next(make_documents(rows), rows_per_range).collect()
    assert {(r.doc_id, r.text): r.next_text for r in found} == want and len(found) == len(rows)


def test_edge_cases(make_documents):
    rows = [(1, None)]
    only = fp.with_next(make_documents(rows)).collect()
    assert [(r.text, r.next_text) for r in only] == [("", "")]
    assert fp.with_next(make_documents([])).count() == 0
    marked = make_documents([(1, None), (2, ""), (3, "a\n\nb"), (3, "a\n\nb"), (4, "word " * 60_000)]).withColumns({"fingerprint": F.lit("clash"), "row": F.lit("mine"), "__tree": F.lit(5), "tree": F.lit(6)})
    found = fp.fingerprints(marked).collect()
    assert all((r.row, r["__tree"], r.tree) == ("mine", 5, 6) for r in found)
    by_id = {r.doc_id: r.fingerprint for r in found}
    assert by_id[1] == by_id[2] == plain_root("") and len({r.fingerprint for r in found}) == 3
    assert {r.doc_id: (r.n_sections, r.n_paragraphs) for r in found}[3] == (2, 2)


def test_likeness(spark):
    texts = spark.createDataFrame([("one. two. three.", "one. two. four."), ("", ""), ("a", ""), ("same", "same")], "a string, b string")
    found = texts.select(fp.likeness(fp.leaves(fp.tree(F.col("a"))), fp.leaves_of(F.col("b"))).alias("x")).collect()
    assert found[0].x == pytest.approx(2 / 3) and [r.x for r in found[1:]] == [1.0, 0.0, 1.0]


def test_whole_table_matches_sql(spark):
    path = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    found = fp.op1(spark, path)
    want = db.execute(f"SELECT {', '.join(found.columns)} FROM ({fp.OP1_SQL})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
