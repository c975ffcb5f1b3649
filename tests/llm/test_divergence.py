import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from layoutlens.llm import divergence, sketches


def brute(rows, least=divergence.LEAST, top=divergence.TOP):
    """All result rows for (lang, source, text) rows, term by term."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    split = [(lang, source, [lower(w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]) for lang, source, text in rows]
    df, n, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, words in split:
        df.update((lang, w) for w in set(words))
        groups[lang].add(source)
    for lang, source, words in split:
        kept = [w for w in words if df[lang, w] >= least]
        n[lang, source].update(kept)
        n[lang, None].update(kept)
    out = []
    for lang, sources in groups.items():
        terms = sorted(w for own, w in df if own == lang and df[own, w] >= least)
        share = {s: {w: 1 + 10**9 * (n[lang, s][w] + 1) // (sum(n[lang, s].values()) + len(terms)) for w in terms} for s in [*sources, None]}
        apart = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pair = [(-sum(apart(share[s][w], share[o][w]) for w in terms), o.encode()) for o in sources if o != s]
            term = [(-apart(share[s][w], share[None][w]), w.encode()) for w in terms if n[lang, s][w] and share[s][w] > share[None][w]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def documents(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id bigint, lang string, source string, text string")


def found(frame, **more):
    return sorted(tuple(r) for r in divergence.divergence(frame, **more).select("lang", "source", "part", "item", "value", "rank").collect())


ROWS = [
    ("en", "a", "the cat Sat on the mat, the CAT's"), ("en", "a", "the cat sat; a dog ran"), ("en", "b", "the dog ran and the cat ran"), ("en", "b", "été 日本 the-dog x1x"), ("en", "b", "Été ÉTÉ été 日本"), ("en", "c", "été 日本"),
    ("en", "d", None), ("en", None, "the cat"), (None, "a", "q q q"), (None, None, "q"), ("", "b", "q w"), ("de", "a", "only here"), ("fr", "a", ""), ("fr", "b", "1234 !!"),
]


@pytest.mark.parametrize("held,rows", [(divergence.HELD_TERMS, 100_000), (2, 0)])
def test_against_brute_force(spark, monkeypatch, held, rows):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", rows)
    assert found(documents(spark, ROWS * 2)) == brute(ROWS * 2)
    assert found(documents(spark, ROWS), top=2, least=2) == brute(ROWS, 2, 2)


def test_few_cells_let_more_through_but_change_nothing(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = found(frame)
    assert one == found(frame, width=1 << 14) == brute([(r.lang, r.source, r.text) for r in frame.collect()])


def test_cells_never_underestimate(spark):
    frame = documents(spark, ROWS * 4).repartition(7)
    df = Counter((lang or "", w) for lang, _, text in ROWS * 4 for w in set(re.findall(r"[a-zé日本]+", (text or "").lower())))
    cells = divergence.document_frequencies(frame, 1 << 14)
    for (lang, w), n in df.items():
        assert cells.least(divergence._hashes(lang, [w.encode()]))[0] >= min(n, sketches.FULL)


def test_counters_stop_instead_of_wrapping():
    cells = sketches.Cells(1 << 14, 2)
    for _ in range(3):
        cells.add(np.array([5, 5, 9], dtype=np.uint64), np.array([100, 27, 3]))
    assert cells.least(np.array([5, 9], dtype=np.uint64)).tolist() == [255, 9]


def test_edge_cases(spark):
    assert found(documents(spark, [])) == []
    long = [("en", "a", "word " * 400_000 + "é" * 5_000_000), ("en", "a", "word"), ("en", "b", "word é")]
    frame = documents(spark, long * 3).withColumns({"term": F.lit("x"), "n": F.lit(1), "p": F.lit(2)})
    assert found(frame) == brute(long * 3)


def test_large_counts_are_exact(spark):
    """Shares of counts beyond what 64 bits could multiply."""
    n, total, terms = 10**15 + 7, 3 * 10**15 + 1, 12_345
    row = spark.createDataFrame([(n, total, terms)], "n bigint, total bigint, terms bigint")
    assert row.select(divergence._share(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 10**9 * (n + 1) // (total + terms)
