"""Ordered folds over long groups, order keys beyond a million, and the two forms of the decision rules against each other."""

import random

from pyspark.sql import functions as F

from layoutlens.functions import layout as Y
from layoutlens.operators import classify as C
from layoutlens.operators import context as X
from layoutlens.operators import decide as D
from layoutlens.operators import ordered as O
from layoutlens.operators import sequence as S
from layoutlens.plans import registry
from layoutlens.streaming import machine as M
from layoutlens.streaming import session

EN, FA = Y.ENGLISH, Y.PERSIAN


def observe(state, language, e):
    lang, s = state
    if lang == 0:
        return language, e
    if lang == language:
        return lang, e if s < e else min(4, s + 1)
    return (lang, s - e) if s > e else (0, 0) if s == e else (language, e - s)


def test_context_of_long_groups(spark, monkeypatch):
    monkeypatch.setattr(O, "SEGMENT", 7)
    monkeypatch.setattr(O, "FAN", 3)
    rng, rows, want = random.Random(1), [], {}
    for k, n in enumerate([1, 6, 7, 8, 50, 1_500]):
        state = (0, 0)
        for pos in range(n):
            language, e = rng.choice((EN, FA)), rng.randrange(1, 5)
            rows.append((k, pos // 100, pos % 100, language, e))
            state = observe(state, language, e)
        want[k] = (*state, n)
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k int, sentence int, pos int, language int, evidence int").withColumn("order", F.struct("sentence", "pos"))
    found = {r.k: (r.language, r.strength, r.observed_words) for r in X.fold_context(frame, ["k"], "order").collect()}
    assert found == want


def test_words_beyond_a_thousand_keep_their_sentence(spark, tmp_path):
    """Sentences of 1,500 words: what comes last in the first must not come after the second."""
    lines = ["one two three four five six seven"] * 3
    long = " ".join(["stone"] * 1_500)
    texts = [(0, 0, "user", f"{long}. " + " ".join(lines) + "."), (2, 0, "user", "stone " * 1_500 + "x" * 40 + " stone stone. stone")]
    d = str(tmp_path)
    spark.createDataFrame(texts, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/conversations.parquet")
    words = registry._sentences(spark, d).collect()
    assert max(r.pos for r in words if r.conv_id == 0) == 1_500
    assert sorted({(r.sentence, r.part) for r in words if r.conv_id == 2}) == [(0, 0), (0, 1), (1, 0)]
    ordered = sorted((r for r in words if r.conv_id == 0), key=lambda r: (r.sentence, r.part, r.pos))
    assert [r.en for r in ordered] == ["stone"] * 1_500 + " ".join(lines).split()


def test_cadence_of_late_event_ids(spark):
    rng, rows, want = random.Random(3), [], {}
    for user in range(4):
        at, pace, last = 1_700_000_000_000, 150, None
        for k in range(3_000):
            at += rng.choice([0, 15, 90, 140, 400, 1_600])
            rows.append((user, 5_000_000 + k * 977, at))
            if last is not None:
                pace = pace if 40 <= pace <= 500 else 150
                pace = (3 * pace + at - last) // 4 if 20 <= at - last <= 1_500 else pace
            last = at
        want[user] = pace
    rng.shuffle(rows)
    steps = X.key_intervals(spark.createDataFrame(rows, "user_id int, event_id bigint, ts_ms bigint"), ["user_id"], tie="event_id")
    found = X.fold_cadence(steps.withColumn("pos", F.struct("ts_ms", "event_id")), ["user_id"]).collect()
    assert {r.user_id: r.cadence for r in found} == want


def test_machine_and_columns_decide_alike(spark):
    """judge and judge_run against contextual and decide_run on every word of sf0.001 in all cases."""
    d = "/root/testdata/sf0.001"
    own = registry.counts(spark, d)
    lexicon, priors = registry.lexicon(spark, d, own), registry.priors(spark, d, own)
    book = session.load_lexicon(lexicon, priors)
    words = C.with_priors(C.classify(registry._typed_words(own), lexicon), priors).filter("crc32(en) % 4 = 0")
    every = words.join(registry._cases(spark))
    checked = set()
    for phase in (M.LIVE, M.IDLE, M.BOUNDARY):
        made = D.contextual(F.col("active"), F.col("sensitivity"), F.col("context"), F.col("strength"), F.col("sentence_start"), F.lit(phase))
        for r in every.select("en", "fa", *registry._CASE, made["action"].alias("action"), made["confidence"].alias("confidence")).collect():
            action, confidence = M.judge(book.look(r.en, r.fa), len(r.en), r.active, r.sensitivity, r.context, r.strength, r.sentence_start, phase)
            assert (action, confidence if action else 0) == (r.action, r.confidence if r.action else 0), r
            checked.add((phase, action))
    assert len(checked) >= 6
    sentences = C.classify(registry._sentences(spark, d), lexicon).persist()
    sums = {}
    for r in sentences.collect():
        key = tuple(r[k] for k in registry._SENTENCE)
        sums[key] = sums.get(key, M.Sums()).plus(book.look(r.en, r.fa), len(r.en))
    for sensitivity in (0, 1, 2):
        for context, strength in ((EN, 2), (FA, 4), (FA, 5), (0, 0)):
            for r in S.score_sequences(sentences, registry._SENTENCE, F.lit(sensitivity), F.lit(context), F.lit(strength)).collect():
                key = tuple(r[k] for k in registry._SENTENCE)
                assert M.judge_run(sums[key], sensitivity, context, strength) == (r.language, r.confidence)
