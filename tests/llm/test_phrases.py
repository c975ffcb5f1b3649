import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from layoutlens.llm import phrases


def brute(rows, least, top=phrases.TOP):
    """All result rows, from counts of every phrase."""
    freq, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in (1, 2, 3):
                freq.update((lang, tuple(words[k : k + n])) for k in range(len(words) - n + 1))
    out = []
    for lang in totals:
        kept = []
        for (own, phrase), a in freq.items():
            if own != lang or len(phrase) < 2 or a < least:
                continue
            if any(o == lang and len(p) == 3 and len(phrase) == 2 and b >= least and 100 * b >= 50 * a and phrase in (p[:2], p[1:]) for (o, p), b in freq.items()):
                continue
            cuts = [(1_000_000 * a * a // (freq[lang, phrase[:k]] * freq[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(phrase).encode(), freq[lang, phrase[:k]], freq[lang, phrase[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def found(frame, **more):
    return sorted(tuple(r) for r in phrases.collocations(frame, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("size", [phrases.SEGMENT_WORDS, 7])
def test_against_brute_force(make_documents, monkeypatch, size):
    """The same rows however texts are cut into segments and parts, and however few cells tell frequent phrases."""
    if size == 7:
        monkeypatch.setattr(phrases, "PART_BYTES", 16)
        monkeypatch.setattr(phrases, "HOT", 3)
    texts = [("a b c a b c a b c a b\tc", "en"), ("New York city, new york CITY. new york", "en"), ("x x x x x x x x", None), ("x x x! x x; y", "und"), ("été à Été à été", "fr"), (None, "de"), ("", "en"), ("a\x00b q\x1cz a\x00b q\x1cz \x0b a\x00b", "en")] * 2
    frame = make_documents([(k, text, lang) for k, (text, lang) in enumerate(texts)])
    assert found(frame, least=3, size=size, most_cells=1 << 14) == brute([(lang, text) for text, lang in texts], 3)


def test_a_piece_over_many_segments(make_documents, monkeypatch):
    monkeypatch.setattr(phrases, "PART_BYTES", 50)
    text = "p q r s " * 400
    assert found(make_documents([(1, text, "en")]), size=20) == brute([("en", text)], 10)


def test_whole_table_through_few_cells(spark):
    """Cells too few to tell anything let everything through; the counts stay exact."""
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = found(documents)
    assert one == found(documents, size=5_000, most_cells=1 << 14)


def test_edge_cases(make_documents):
    assert found(make_documents([])) == []
    rows = [(None, "one two " * 20, None), (None, "one two " * 20, None), (1, None, "en"), (2, "z" * 3_000_000 + " " + "b c" * 5, "en")]
    frame = make_documents(rows).withColumns({"phrase": F.lit("x"), "n": F.lit(1), "head": F.lit(2)})
    assert found(frame) == brute([(r[2], r[1]) for r in rows], 10)


def test_top_is_by_language(make_documents):
    rows = [(1, "a b, c d, e f, " * 10, "en"), (2, "g h, i j, " * 10, "fr")]
    assert found(make_documents(rows), top=2) == brute([(r[2], r[1]) for r in rows], 10, 2)
