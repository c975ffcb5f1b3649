"""Groups that are one task's are dealt once by their keys, neither sampled for ranges nor kept; sentences take one fold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from layoutlens.operators import context as X
from layoutlens.operators import ordered as O
from layoutlens.operators import sequence as S
from layoutlens.operators import typing as K
from layoutlens.operators import undo as U
from layoutlens.streaming import session
from test_ordered import pace, typed


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def dealt(frame):
    """How often rows are dealt by keys; none may be dealt by ranges or kept."""
    made = plan(frame)
    assert "rangepartitioning" not in made and "ExistingRDD" not in made
    return len(re.findall(r"Exchange hashpartitioning", made))


def test_undone_edits_are_dealt_once(spark):
    events = spark.range(400).select(
        (F.col("id") % 7).alias("k"), F.col("id").alias("seq"), (F.col("id") * 10).alias("ts_ms"), F.when(F.col("id") % 14 < 7, U.EDIT).otherwise(U.BACK).alias("kind"), F.lit("one").alias("window_id"),
        F.lit("a").alias("original"), F.lit("bc").alias("replacement"), F.lit(" ").alias("delimiter"), F.lit(1).alias("source_language"),
    )
    found = U.undone(events, ["k"])
    assert dealt(found) == 1
    assert {(r.k, r.seq, r.age_ms, r.delete_count) for r in found.collect()} == {(i % 7, i, 70, 3) for i in range(400) if i % 14 >= 7}


def test_strokes_are_dealt_once(spark):
    strokes = spark.range(900).select(
        (F.col("id") % 3).alias("k"), F.col("id").alias("seq"), (F.col("id") * 90).alias("ts_ms"),
        F.when(F.col("id") % 31 < 3, K.END).when(F.col("id") % 11 == 0, K.BACK).otherwise(K.KEY).alias("stroke"), F.lit("a").alias("english"), F.lit("ش").alias("persian"),
    )
    assert dealt(K.words(strokes, ["k"])) == 1
    assert dealt(X.fold_cadence(K.key_intervals(strokes, ["k"]), ["k"], "seq")) == 1


@pytest.mark.parametrize("group", [O.GROUP, 50])
def test_words_of_sessions_of_either_size(spark, monkeypatch, group):
    monkeypatch.setattr(O, "GROUP", group)
    rng, rows = random.Random(3), []
    for k, n in (("a", 300), ("b", 20), (None, 90), ("c", 1)):
        rows += [(k, i, i * 100, rng.choice([K.KEY] * 7 + [K.BACK] * 2 + [K.END]), e := rng.choice("abc"), {"a": "ش", "b": "ذ", "c": "ز"}[e]) for i in range(n)]
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, seq bigint, ts_ms bigint, stroke string, english string, persian string")
    found = K.words(frame, ["k"]).collect()
    for k in {r[0] for r in rows}:
        want = typed([(r[3], r[4], r[5], r[2]) for r in rows if r[0] == k])
        own = sorted((r.span, r.strokes, r.erased, r.emptied, r.overflow, r.en, r.fa, r.intervals) for r in found if r.k == k)
        assert own == sorted(want)


@pytest.mark.parametrize(("group", "segment"), [(O.GROUP, O.SEGMENT), (O.GROUP, 60), (70, 60)])
def test_cadences_of_groups_of_either_size(spark, monkeypatch, group, segment):
    monkeypatch.setattr(O, "GROUP", group)
    monkeypatch.setattr(O, "SEGMENT", segment)
    rng = random.Random(8)
    groups = {k: [rng.choice([20, 35, 90, 1_500, 1_501, 0, rng.randrange(2_000)]) for _ in range(n)] for k, n in enumerate((1, 59, 60, 61, 70, 71, 500))}
    rows = [(k, i, x) for k, steps in groups.items() for i, x in enumerate(steps)]
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "k int, pos int, interval int")
    for start in (150, 77, 9_999):
        assert {r.k: r.cadence for r in X.fold_cadence(frame, ["k"], start=start).collect()} == {k: pace(steps, start) for k, steps in groups.items()}


def test_session_events_are_dealt_once(spark):
    texts = spark.range(40).select(F.col("id").cast("string").alias("s"), F.lit("hello thar. lg;v").alias("text"))
    events = session.keystrokes(texts, F.col("s"), F.lit(0x409))
    found = session.repair_sessions(events, session.Lexicon({}, {}), counters=True, dealt=True)
    made = plan(found)
    assert len(re.findall(r"Exchange hashpartitioning", made)) == 1 and made.count("Sort [session_id") == 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, session.repair_sessions(events, session.Lexicon({}, {}), counters=True).collect()))


def test_a_sentence_is_walked_once(spark):
    """How words stand is carried from run to run: no list of earlier runs is searched for each word of each run."""
    words = spark.range(64).select(
        (F.col("id") % 2).alias("k"), (F.expr("id div 2") + 1).cast("int").alias("pos"), F.lit("ab").alias("en"), F.lit("شذ").alias("fa"), F.lit(1).alias("visible"),
        (F.col("id") % 5 != 0).alias("en_known"), F.lit(True).alias("fa_known"), F.lit(False).alias("en_frequent"), F.lit(True).alias("fa_frequent"),
    )
    made = S.repaired_runs(words, ["k"], F.lit(2), F.lit(0), F.lit(0))
    assert "slice(__runs" not in plan(made)
    assert made.filter("needs_change").count() == made.filter("original <> replacement").count() > 0


def test_all_cases_of_sentences_come_from_one_pass(spark, monkeypatch):
    from layoutlens.plans import registry

    words = spark.range(60).select(
        (F.col("id") % 6).alias("conv_id"), F.lit(1).alias("turn"), F.lit(0).alias("sentence"), F.lit(0).alias("part"), F.lit("abc").alias("en"),
        (F.col("id") % 5 > 0).alias("en_known"), (F.col("id") % 7 > 0).alias("fa_known"), F.lit(True).alias("en_frequent"), F.lit(False).alias("fa_frequent"),
    )
    monkeypatch.setattr(registry, "_classified_sentences", lambda *a: words)
    found = registry.sequence_scores(spark, "")
    assert dealt(found) == 1 and plan(found).count("Range (") == 1
    for (sensitivity, context, strength) in ((0, 1, 2), (2, 2, 5)):
        one = S.score_sequences(words, registry._SENTENCE, F.lit(sensitivity), F.lit(context), F.lit(strength))
        own = found.filter((F.col("sensitivity") == sensitivity) & (F.col("strength") == strength)).drop("sensitivity", "strength")
        assert own.exceptAll(one).count() == 0 == one.exceptAll(own).count()


def test_cadence_fold_asks_no_time_zone(spark, tmp_path):
    """Intervals across the hours that a session's zone leaves out or has twice; 2024-03-10 02:30 does not exist in New York."""
    from layoutlens.plans import registry

    times = [f"2024-{day} 0{h}:{m:02d}:07.{h}{m:02d}999" for day in ("03-10", "11-03") for h in range(5) for m in range(0, 60, 1 + h)]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "user_id bigint, event_id bigint, t string").select("user_id", "event_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    ms = [r.ms for r in rows.select(((F.col("ts") - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second").cast("decimal(20,6)") * 1_000).cast("bigint").alias("ms")).collect()]
    want = pace([(b - a) // 20_000 for a, b in zip(ms, ms[1:], strict=False)])
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r.cadence for r in registry.cadence_fold(spark, str(tmp_path)).collect()] == [want]
            assert [r.ms for r in rows.orderBy("event_id").select(registry.T.epoch_ms(rows, "ts").alias("ms")).collect()] == ms
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stretches_hold_all_runs_in_a_row_for_each_word(spark):
    """Sessions that take back, go on after it and type more letters than a word may have: every candidate lies in a stretch, and there are few of them."""
    rng = random.Random(11)
    names = {k[1]: k[0] for k in session.KEYS}
    rows, seq = [], 0
    for s in ("a", "b", None):
        for c in "".join(rng.choice(["abc", "wrld <<<x ", "qwertyuiopas" * 9 + "<" * 40 + "zz ", "<", " ", "hj"]) for _ in range(60)):
            vk = {"<": "Back", " ": "Space"}.get(c, "Letter")
            rows.append((s, "w", seq, seq * 100, "key_down", vk, names.get(c, 0), 0x409))
            seq += 1
    events = spark.createDataFrame(rows, "session_id string, window_id string, seq bigint, ts_ms bigint, kind string, vk string, scan int, layout int")
    want = {tuple(r) for r in session.candidates(events).collect()}
    found = session.stretches(events)
    kept = found.collect()
    assert len(kept) * 20 < len(want)
    every = spark.createDataFrame(list({(r[1], r[2], 5, 7 if r[1] == 1 else None) for r in want}), "lang int, form string, bits int, points int")
    held = set()
    for r in session.entries(found, every).collect():
        own = session.Lexicon({}, {})
        own.take(r.packed)
        held |= {(r.session_id, *key) for key in own.rows}
        assert all(b == 5 for b in own.rows.values()) and own.priors == {form: 7 for lang, form in own.rows if lang == 1}
    assert {w for w in want if w[0] is not None} <= held
