import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from layoutlens.llm import pii
from layoutlens.llm.common import Scratch

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if holds(kind, m[0])]
    return sorted(found)


def candidates(text):
    """Runs of digits with up to two separators between them, and handles, that stand alone and touch no base span."""
    base, out = base_spans(text), []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*|(?<![A-Za-z0-9])\+?[0-9](?:[\x20().-]{0,2}[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        useful = "@" in m[0] or len(digits) >= 7 or re.search(r"\.[0-9]+\.", m[0])
        if useful and not re.match("[A-Za-z0-9]", text[m.end() :]) and all(e <= m.start() or s >= m.end() for s, _, e in base):
            out.append((m.start(), m.end()))
    return out


def allowed(kind, value):
    n = len(re.sub("[^0-9]", "", value))
    if kind == 0 or "@" in value:
        return kind == 0 and "@" in value
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){2,4}", value))
    return 12 <= n <= 19 if kind == 2 else 7 <= n <= 15


def brute(texts):
    """spans by row, for texts whose places stand far apart (so that the words before a place are whole)."""
    places = []
    for row, text in enumerate(texts):
        places += [(row, s, e, k, False) for s, k, e in base_spans(text)] + [(row, s, e, 4, True) for s, e in candidates(text)]
    edges, seeds = Counter(), {}
    for row, s, e, kind, candidate in places:
        value = texts[row][s:e].lower()
        before = texts[row][:s].lower().split()
        if not candidate:
            seeds[value, kind] = 1.0
        for n in range(1, 4):
            if len(before) >= n:
                edges[" ".join(before[-n:]), value, candidate] += 1
    total = Counter()
    for text in texts:
        words = text.lower().split()
        for n in range(1, 4):
            total.update(" ".join(words[k : k + n]) for k in range(len(words) - n + 1))
    places_of = Counter()
    for (pattern, _, _), n in edges.items():
        places_of[pattern] += n
    scores, found = dict(seeds), {}
    for _ in range(pii.ROUNDS):
        weight, mass = defaultdict(float), defaultdict(float)
        for (pattern, value, _), n in edges.items():
            for kind in range(4):
                weight[pattern, kind] += scores.get((value, kind), 0)
                mass[pattern, kind] += n * scores.get((value, kind), 0)
        sure = {key: mass[key] / (max(total[key[0]], places_of[key[0]]) + 1) for key in mass if weight[key] >= pii.SUPPORT}
        found = defaultdict(float)
        for (pattern, value, candidate), _ in edges.items():
            for kind in range(4):
                # The operator drops patterns that could not reach the confidence at all.
                if candidate and allowed(kind, value) and places_of[pattern] >= pii.CONFIDENCE * (max(total[pattern], places_of[pattern]) + 1):
                    found[value, kind] = max(found[value, kind], sure.get((pattern, kind), 0))
        scores = seeds | found
    best = {}
    for (value, kind), score in sorted(found.items(), key=lambda x: (x[1], -x[0][1])):
        if score >= pii.CONFIDENCE:
            best[value] = kind
    out = [[] for _ in texts]
    for row, s, e, kind, candidate in places:
        value = texts[row][s:e].lower()
        if not candidate or value in best:
            out[row].append((s, best[value] if candidate else kind, e))
    return [sorted(x) for x in out]


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


ODD = [
    "", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0004", "a@b.co_x@d.org .@-.- a@b..c x@y.z@w.v", "+1 (743) 555-3824 +12 3 +1--------9",
    "4539578763621486 4539 5787 6362 1486 4539-5787-6362-1486 1111", "émile@a.b 日本語9@例.jp ٣٤٥ +٣4", "1-2 3--4 5 6", "+4539578763621486 1.4539578763621486.1.1", "a@b.c@d.e.f", "😀 x@y.zz 😀 10.0.0.1😀",
]


def op_rows(frame, scratch=None):
    found = pii.personal_data(frame).select("doc_id", pii._written(F.col("places")).alias("spans")).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.spans) for r in found)


def test_base_spans_of_odd_texts(make_documents):
    found = dict(op_rows(make_documents(list(enumerate(ODD)))))
    assert found == {k: written(base_spans(t)) for k, t in enumerate(ODD)}


def test_base_spans_of_random_texts(make_documents):
    """The patterns as they are written here find what the plain ones find, in 4,000 texts of the characters that matter."""
    rng = random.Random(31)
    texts = ["".join(rng.choices("aZ09.@-+ _%()1é,", weights=[4, 2, 3, 3, 4, 3, 2, 2, 2, 1, 1, 1, 1, 5, 1, 1], k=rng.randrange(1, 60))) for _ in range(4_000)]
    found = dict(op_rows(make_documents(list(enumerate(texts)))))
    for k, text in enumerate(texts):
        own = found[k].split(",") if found[k] else []
        assert set(filter(None, written(base_spans(text)).split(","))) <= set(own), text


def test_long_runs_take_linear_time_and_little_stack(make_documents):
    size = 1_000_000
    texts = ["a" * size, "1" * size, "1 " * size, "a@" * size, "a@b" + ".c" * size, "+1" * size, "1." * size, "+1" + " " * size, "x@" + "b" * size, "-" * size, "1a" * size]
    found = dict(op_rows(make_documents(list(enumerate(texts)))))
    assert found[4] == f"email:0:{len(texts[4])}" and found[0] == found[1] == found[9] == found[10] == ""
    assert found[6].count("ip:") == size // 4


def test_words_before_seeds_find_unseen_identifiers(make_documents):
    rows = [(k, f"word{k} and my phone number is +1 (555) 010-2{k:03d} as ever") for k in range(8)]
    rows += [(20, "so my phone number is 555-0199-77 today"), (21, "version 555-0199-78 of it"), (22, "again 555-0199-77 alone")]
    rows += [(30 + k, f"reach us: mail to user{k}@mail.example.com please") for k in range(6)] + [(40, "or mail to bob@localhost please"), (41, "not eve@localhost at all")]
    # A second step: this pattern only introduces what the first one has found.
    rows += [(50 + k, f"my phone number is 555-0300-7{k} then") for k in range(4)] + [(60 + k, f"ring desk line 555-0300-7{k} then") for k in range(4)] + [(70, "ring desk line 555-0411-00 then")]
    found = dict(op_rows(make_documents(rows)))
    assert found == {r[0]: written(s) for r, s in zip(rows, brute([r[1] for r in rows]), strict=True)}
    assert found[20].startswith("phone:") and found[22].startswith("phone:") and not found[21] and found[40].startswith("email:") and not found[41] and found[70].startswith("phone:")


def test_copies_are_no_support(make_documents):
    rows = [(k, "the same call desk at +1 (555) 010-2000 for all") for k in range(50)] + [(99, "the same call desk at 555-0199-77 for all")]
    assert dict(op_rows(make_documents(rows)))[99] == ""


def test_query_against_plain_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = pii.op12(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(texts)
    for r in found:
        base = base_spans(texts[r.doc_id])
        kinds = Counter(k for _, k, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in range(4))
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest() and set(filter(None, written(base).split(","))) <= set(r.spans.split(","))


def test_edge_cases(make_documents):
    rows = [(None, None), (1, ""), (2, "a@b.cd"), (2, "a@b.cd"), (None, "a@b.cd"), (3, "x " * 300_000 + "10.0.0.1")]
    frame = make_documents(rows).withColumns({"row": F.lit(1), "found": F.lit(2), "kind": F.lit("x"), "value": F.lit(3)})
    assert op_rows(frame) == sorted([(-1, ""), (1, ""), (2, "email:0:6"), (2, "email:0:6"), (-1, "email:0:6"), (3, "ip:600000:600008")])
    assert op_rows(make_documents([])) == []


@pytest.mark.parametrize("rows", [0, 200_000])
def test_joins_without_broadcasts(make_documents, monkeypatch, rows):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", rows)
    texts = [(k, f"call me at +1 (555) 010-2{k:03d} now") for k in range(6)] + [(9, "call me at 555-0199-77 now")]
    assert dict(op_rows(make_documents(texts)))[9].startswith("phone:")
