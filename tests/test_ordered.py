"""Order-dependent work on groups that fill many ranges, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from layoutlens.functions.layout import ENGLISH as EN
from layoutlens.functions.layout import PERSIAN as FA
from layoutlens.operators import context as X
from layoutlens.operators import ordered as O
from layoutlens.operators import sequence as S
from layoutlens.operators import typing as K
from layoutlens.operators import undo as U


@pytest.fixture
def many_ranges(spark):
    """Ranges stay as they are dealt: adaptive execution would put small ones together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sums_and_neighbours_across_ranges(spark, many_ranges):
    rng = random.Random(4)
    sizes = {"hot": 900, "b": 1, None: 40}
    rows = [(k, i, rng.randrange(-3, 4)) for k, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, i int, v int")
    dealt = O.dealt(frame, ["k"], ["i"])
    assert dealt.filter("k = 'hot'").select("__p").distinct().count() > 5
    found = O.before(O.running_sum(dealt, ["k"], F.col("v"), "total"), ["k"], ["i", "v"]).collect()
    assert len(found) == len(rows)
    for k, n in sizes.items():
        own, total, last = sorted((r for r in found if r.k == k), key=lambda r: r.i), 0, (None, None)
        for r in own:
            total += r.v
            assert (r.total, (r.prev_i, r.prev_v)) == (total, last)
            last = (r.i, r.v)


def pace(steps, now=150):
    for x in steps:
        now = now if 40 <= now <= 500 else 150
        now = (3 * now + x) // 4 if 20 <= x <= 1_500 else now
    return now


def test_cadence_of_a_group_of_100000(spark, many_ranges):
    rng = random.Random(9)
    groups = {1: [rng.choice([20, 21, 35, 90, 140, 400, 1_500, 1_501, 19, 0, rng.randrange(2_000)]) for _ in range(100_000)], 2: [20] * 50 + [1_500] * 3, 3: [1_600], 4: [1_500] * 39 + [20], 5: [30] * 41}
    rows = [(k, i, x) for k, steps in groups.items() for i, x in enumerate(steps)] + [(1, -1, None), (6, 0, None)]
    frame = spark.createDataFrame(rows, "k int, pos int, interval int")
    assert {r.k: r.cadence for r in X.fold_cadence(frame, ["k"]).collect()} == {k: pace(steps) for k, steps in groups.items()}
    assert {r.k: r.cadence for r in X.fold_cadence(frame, ["k"], start=9_999).collect()} == {k: pace(steps, 9_999) for k, steps in groups.items()}
    assert "Python" not in X.fold_cadence(frame, ["k"])._jdf.queryExecution().toString()


@pytest.mark.parametrize("segment", [O.SEGMENT, 3])
def test_contexts_that_run_out(spark, many_ranges, monkeypatch, segment):
    monkeypatch.setattr(O, "SEGMENT", segment)
    monkeypatch.setattr(O, "FAN", 2 if segment == 3 else O.FAN)
    rng, rows, want = random.Random(7), [], []
    for typist in range(3):
        at, window, state, since, last, n = 0, "a", None, 0, None, 0
        for _ in range(400):
            at += rng.choice([0, 1_000, 89_999, 90_000, 90_001, 200_000] if typist else [5, 90_000])
            window = rng.choice("ab") if rng.random() < 0.05 else window
            language, e = rng.choice([EN, FA, FA, 0]), rng.randrange(0, 6)
            rows.append((typist, window, at, len(rows), language, e))
            if language == 0:
                continue
            if last is None or at - last[0] > 90_000 or last[1] != window:
                n += 1
                state, since = (0, 0, 0), at
                want.append(None)
            w = min(4, max(1, e))
            lang, s, seen = state
            if lang == 0:
                lang, s = language, w
            elif lang == language:
                s = w if s < w else min(4, s + 1)
            else:
                lang, s = (lang, s - w) if s > w else (0, 0) if s == w else (language, w - s)
            state, last = (lang, s, seen + 1), (at, window)
            want[-1] = (typist, n, window, since, at, *state)
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "typist int, window_id string, ts_ms bigint, seq int, language int, evidence int")
    found = X.fold_sessions(frame, ["typist"], tie="seq").select("typist", "session", "window_id", "since_ms", "until_ms", "language", "strength", "observed_words").collect()
    assert sorted(map(tuple, found)) == sorted(want)
    assert X.fold_sessions(frame.limit(0), ["typist"], tie="seq").collect() == []


def typed(strokes, most=32):
    """Words of one session by a plain stack: (span, strokes, erased, emptied, overflow, en, fa, intervals)."""
    out, span, word, facts, last = [], 0, [], [0, 0, False, 0], None
    for stroke, en, fa, ts in [*strokes, (K.END, "", "", 0)]:
        if stroke == K.KEY:
            word.append((en, fa))
            facts[0] += 1
            facts[3] += last == K.KEY
        elif stroke == K.BACK:
            word = word[:-1]
            facts[1] += 1
            facts[2] |= not word
        else:
            if facts[0]:
                out.append((span, *facts[:3], max(0, len(word) - most), "".join(a for a, _ in word[:most]), "".join(b for _, b in word[:most]), facts[3]))
            span, word, facts = span + 1, [], [0, 0, False, 0]
        last = stroke
    return out


def test_words_with_backspace(spark, many_ranges):
    rng, rows, want = random.Random(11), [], []
    for session, n in enumerate([3, 700, 2_000, 1]):
        weights = [8, 3, 1] if session % 2 else [30, 6, 1]
        strokes, at = [], 0
        for _ in range(n):
            at += rng.randrange(1, 400)
            c = rng.choice("abcxyz")
            strokes.append((rng.choices([K.KEY, K.BACK, K.END], weights)[0], c, c.upper(), at))
        rows += [(session, i, ts, stroke, en, fa) for i, (stroke, en, fa, ts) in enumerate(strokes)]
        want += [(session, *w) for w in typed(strokes)]
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "s int, seq int, ts_ms bigint, stroke string, english string, persian string")
    found = K.words(frame, ["s"]).select("s", "span", "strokes", "erased", "emptied", "overflow", "en", "fa", "intervals").collect()
    assert sorted(map(tuple, found)) == sorted(want)
    assert any(w[5] for w in want) and any(w[4] for w in want) and any(not w[6] for w in want)
    measured = {(r.s, r.seq): r.interval for r in K.key_intervals(frame, ["s"]).collect()}
    for (s, i, ts, stroke, _, _), nxt in zip(rows, rows[1:], strict=False):
        if nxt[0] == s and nxt[3] == K.KEY:
            assert measured[s, nxt[1]] == (nxt[2] - ts if stroke == K.KEY else None)


def scores(word):
    en = 30 + 18 * word["ef"] if word["ek"] else -16 if len(word["en"]) <= 2 else -26
    fa = 30 + 18 * word["ff"] if word["fk"] else -16 if len(word["en"]) <= 2 else -26
    return en, fa


def corrected(words, sensitivity, context, strength):
    """Sentence repair word by word on a list of what each word stands in."""
    stands, out, chars = [w["visible"] for w in words], [], 0
    for end in range(1, len(words) + 1):
        if end > 32 or chars > 479:
            break
        chars += len(words[end - 1]["en"]) + (end > 1)
        for start in range(1, end):
            run = words[start - 1 : end]
            n = len(run)
            en, fa = (sum(scores(w)[k] for w in run) + (12 + 8 * n if all(w[known] for w in run) else 0) + (8 * strength if context == lang and 1 <= strength <= 4 else 0) for k, known, lang in ((0, "ek", EN), (1, "fk", FA)))
            least = {0: 55, 1: 40, 2: 30}[sensitivity]
            language = EN if en - fa >= least and all(w["ek"] for w in run) else FA if fa - en >= least and all(w["fk"] for w in run) else 0
            if language:
                shown = lambda w, lang: w["fa"] if lang == FA else w["en"]
                original = " ".join(shown(w, x) for w, x in zip(run, stands[start - 1 : end], strict=True))
                needs = any(x != language for x in stands[start - 1 : end])
                out.append((end, start, language, min(100, abs(en - fa)), needs, original, " ".join(shown(w, language) for w in run)))
                if needs:
                    stands[start - 1 : end] = [language] * n
                break
    return out


def test_corrections_see_earlier_corrections(spark):
    rng, rows, want = random.Random(13), [], []
    for k in range(120):
        n = rng.choice([2, 5, 9, 33, 40])
        lean = rng.choice([0.1, 0.5, 0.9])
        words = []
        for pos in range(1, n + 1):
            fk = rng.random() < lean
            words.append({"en": "w" * rng.randrange(1, 25 if k % 7 else 33), "fa": f"f{pos}", "ek": rng.random() < 0.9 - 0.6 * fk, "fk": fk, "ef": rng.random() < 0.2, "ff": rng.random() < 0.3, "visible": rng.choice([EN, FA])})
        sensitivity, context, strength = k % 3, k % 2 + 1, k % 6
        rows += [(k, sensitivity, context, strength, pos, w["en"], w["fa"], w["ek"], w["fk"], w["ek"] and w["ef"], w["fk"] and w["ff"], w["visible"]) for pos, w in enumerate(words, 1)]
        want += [(k, *r) for r in corrected(words, sensitivity, context, strength)]
    frame = spark.createDataFrame(rows, "k int, sensitivity int, context int, strength int, pos int, en string, fa string, en_known boolean, fa_known boolean, en_frequent boolean, fa_frequent boolean, visible int")
    made = S.repaired_runs(frame, ["k", "sensitivity", "context", "strength"], F.col("sensitivity"), F.col("context"), F.col("strength"))
    found = made.select("k", "pos", "start", "language", "confidence", "needs_change", "original", "replacement").collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_a_later_run_meets_corrected_words(spark):
    """Two Persian words typed in English are corrected; the third's run finds them corrected, itself not; a fourth finds nothing to do."""
    rows = [(1, p, "abcd", "سلام", False, True, False, False, v) for p, v in ((1, EN), (2, EN), (3, EN), (4, FA))]
    frame = spark.createDataFrame(rows, "k int, pos int, en string, fa string, en_known boolean, fa_known boolean, en_frequent boolean, fa_frequent boolean, visible int")
    found = S.repaired_runs(frame, ["k"], F.lit(1), F.lit(0), F.lit(0)).orderBy("pos").collect()
    assert [(r.pos, r.start, r.needs_change, r.original) for r in found] == [(2, 1, True, "abcd abcd"), (3, 1, True, "سلام سلام abcd"), (4, 1, False, "سلام سلام سلام سلام")]


def test_undo_by_the_next_key_alone(spark, many_ranges):
    """Backspace and hotkey on both sides of 15,000 ms, with modifiers, keys, clicks and other windows in between; an edit is undone once."""
    rng, rows, want = random.Random(19), [], []
    for s in range(3):
        at, undo = 0, None
        for seq in range(600):
            at += rng.choice([5, 7_000, 15_000, 15_001])
            kind, window = rng.choice([U.EDIT, U.EDIT, U.BACK, U.HOTKEY, U.MODIFIER, "key", "click"]), rng.choice("aaab")
            edit = ("was", f"now{seq}", rng.choice([" ", None]), 1 + seq % 2) if kind == U.EDIT else (None,) * 4
            rows.append((s, seq, at, kind, window, *edit))
            if kind == U.MODIFIER:
                continue
            if kind in (U.BACK, U.HOTKEY) and undo and undo[0] == window and at - undo[1] <= 15_000:
                _, since, original, replacement, delimiter, language = undo
                want.append((s, seq, at, at - since, len(replacement) + bool(delimiter), original, delimiter if kind == U.HOTKEY else None, language))
            undo = (window, at, *edit) if kind == U.EDIT else None
    schema = "s int, seq int, ts_ms bigint, kind string, window_id string, original string, replacement string, delimiter string, source_language int"
    found = U.undone(spark.createDataFrame(rng.sample(rows, len(rows)), schema), ["s"]).select("s", "seq", "ts_ms", "age_ms", "delete_count", "restored", "delimiter", "target_language").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want)) and len(want) > 50
