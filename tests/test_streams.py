"""Streams: declared state with restarts and late words, the journal source, the committing sink, look-ups and counters."""

import json
import random

import pytest
from pyspark.sql import functions as F

from layoutlens.functions.layout import ENGLISH as EN
from layoutlens.functions.layout import PERSIAN as FA
from layoutlens.operators import context as X
from layoutlens.operators import lexicon as L
from layoutlens.functions import text as T
from layoutlens.operators.typing import BACK, END, KEY
from layoutlens.operators import undo as U
from layoutlens.streaming import contexts, journal, lookups, pauses, undos

WORDS = "typist string, window_id string, ts_ms bigint, tie bigint, language int, evidence int"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    journal.register(spark)
    yield spark
    spark.conf.unset(name)


def append(path, name, rows):
    with open(path / name, "a") as out:
        out.writelines(json.dumps(r) + "\n" for r in rows)


def drained(stream, path, checkpoint, schema):
    """One run over all there is, into the committing sink."""
    query = stream.writeStream.format("committed").option("path", str(path)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert not query.isActive and query.exception() is None
    return query


def test_contexts_survive_restarts_and_out_of_order_words(rocks, tmp_path):
    """The contexts that the stream gives, over three runs with words that come late, are those of the batch; later words are dropped."""
    rng, at, words = random.Random(21), 1_000_000, []
    for k in range(150):
        at += rng.choice([500, 3_000, 89_000, 90_000, 90_001, 200_000])
        words.append({"typist": "t" + str(k % 2), "window_id": rng.choice("aaaaab"), "ts_ms": at, "tie": k, "language": rng.choice([EN, FA, FA, 0]), "evidence": rng.randrange(1, 5)})
    source, sink, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    schema = f"typist string, {contexts.CONTEXT}"

    def run():
        stream = rocks.readStream.format("journal").schema(WORDS).option("path", str(source)).load()
        return drained(contexts.context_stream(stream, "600 seconds"), sink, checkpoint, schema)

    for a in range(0, 150, 50):
        # Out of order within 600 seconds' reach: a few places back and forth.
        part = sorted(words[a : a + 50], key=lambda w: w["ts_ms"] + rng.randrange(0, 300_000))
        append(source, "one.jsonl", part)
        run()
    state = rocks.read.format("statestore").option("path", str(checkpoint)).option("stateVarName", "state").load()
    held = {r.key.typist: r.value.session for r in state.select("key", "value").collect()}
    assert set(held) == {"t0", "t1"}
    # Far later words close what is open; a word from long ago is not taken any more.
    end = words[-1]["ts_ms"] + 10_000_000
    append(source, "two.jsonl", [{"typist": t, "window_id": "z", "ts_ms": end, "tie": 0, "language": EN, "evidence": 1} for t in ("t0", "t1")])
    run()
    append(source, "two.jsonl", [{"typist": "t0", "window_id": "z", "ts_ms": 5, "tie": 0, "language": FA, "evidence": 4}])
    query = run()
    dropped = sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
    assert dropped == 1
    batch = X.fold_sessions(rocks.createDataFrame([tuple(w.values()) for w in words], WORDS), ["typist"], tie="tie")
    names = ["typist", *contexts.NAMES]
    found = journal.committed_rows(rocks, str(sink), schema).select(*names).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, batch.select(*names).collect()))


def test_one_step_is_the_columns_step(spark):
    rows = [(lang, s, word, e) for lang, s in X._CONTEXTS for word in (EN, FA) for e in range(0, 6)]
    state = F.struct(F.col("l").alias("language"), F.col("s").alias("strength"), F.lit(0).cast("bigint").alias("observed_words"))
    frame = spark.createDataFrame(rows, "l int, s int, w int, e int").withColumn("to", X.observe(state, F.col("w"), F.col("e")))
    for r in frame.collect():
        assert contexts.observed(r.l, r.s, r.w, r.e) == (r.to.language, r.to.strength)


def test_journal_loses_and_doubles_nothing(rocks, tmp_path, monkeypatch):
    """Files that grow between runs, with a line half written, in ranges of a few bytes."""
    monkeypatch.setattr(journal, "PART_BYTES", 64)
    source, sink, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    schema, want = "k bigint, w string", []

    def run():
        stream = rocks.readStream.format("journal").schema(schema).option("path", str(source)).load()
        drained(stream, sink, checkpoint, schema)
        return sorted((r.k, r.w) for r in journal.committed_rows(rocks, str(sink), schema).collect())

    for step in range(3):
        rows = [{"k": step * 100 + k, "w": "é" * (k % 50)} for k in range(20)]
        append(source, f"{step % 2}.jsonl", rows)
        want += [(r["k"], r["w"]) for r in rows]
        if step == 1:
            with open(source / "1.jsonl", "a") as out:
                out.write('{"k": 999')
        assert run() == sorted(want)
    with open(source / "1.jsonl", "a") as out:
        out.write(', "w": "late"}\n')
    assert run() == sorted([*want, (999, "late")])
    assert run() == sorted([*want, (999, "late")])


def test_lines_belong_to_the_range_they_begin_in(tmp_path, monkeypatch):
    from pyspark.sql.types import LongType, StructField, StructType

    append(tmp_path, "a.jsonl", [{"k": k} for k in range(40)])
    reader = journal.JournalReader(str(tmp_path), StructType([StructField("k", LongType())]))
    for size in (1, 7, 9, 10, 1_000):
        monkeypatch.setattr(journal, "PART_BYTES", size)
        found = [x for p in reader.partitions({}, reader.latestOffset()) for b in reader.read(p) for x in b.column(0).to_pylist()]
        assert found == list(range(40))


def test_a_batch_written_again_is_there_once(spark, tmp_path):
    """A batch that fails half-way leaves nothing; one that is committed again adds nothing."""
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    path = str(tmp_path / "out")
    writer = journal.CommittedWriter(path, StructType([StructField("k", LongType())]))
    part = lambda *k: writer.write(iter([pa.RecordBatch.from_pydict({"k": list(k)})]))
    part(1, 2)  # a task of a try that died: neither committed nor aborted
    writer.abort([part(3), None], 0)
    rows = lambda: sorted(r.k for r in journal.committed_rows(spark, path, "k bigint").collect())
    assert rows() == []
    writer.commit([part(1, 2), part(3), writer.write(iter([]))], 0)
    writer.commit([part(1, 2), part(3)], 0)
    writer.commit([part(4)], 1)
    assert rows() == [1, 2, 3, 4]


@pytest.mark.parametrize("most", [0, L.BROADCAST_ROWS])
def test_words_of_a_stream_meet_a_lexicon_of_any_size(rocks, tmp_path, monkeypatch, most):
    """With no row to be broadcast, too; a lexicon written between batches is taken up."""
    monkeypatch.setattr(L.small, "__defaults__", (most,))
    source = tmp_path / "in"
    source.mkdir()
    book = str(tmp_path / "lexicon")

    def write(words):
        tiers = {lang: {n: rocks.createDataFrame([(w,) for w in own], "form string") for n in ("words", "common", "frequent")} for lang, own in ((EN, words), (FA, ["سلام"]))}
        L.build_lexicon(tiers, rocks).write.mode("overwrite").parquet(book)

    def run(rows):
        append(source, "a.jsonl", rows)
        stream = rocks.readStream.format("journal").schema("en string, fa string").option("path", str(source)).load()
        query = lookups.classified(stream, lambda s: s.read.parquet(book), str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return {(r.batch, r.en): (r.en_known, r.fa_known) for r in rocks.read.parquet(str(tmp_path / "out")).collect()}

    write(["hello"])
    assert run([{"en": "hello", "fa": "اثممخ"}, {"en": "sghl", "fa": "سلام"}, {"en": "world", "fa": "صخقمی"}]) == {(0, "hello"): (True, False), (0, "sghl"): (False, True), (0, "world"): (False, False)}
    write(["hello", "world"])
    assert run([{"en": "world", "fa": "صخقمی"}])[(1, "world")] == (True, False)


def test_observed_counters(rocks, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "en string, fa string, strokes bigint, active int, en_known boolean, fa_known boolean"
    rows = [{"en": "word", "fa": "صخقی", "strokes": k, "active": 1 + k % 2, "en_known": k % 3 == 0, "fa_known": k % 5 == 0} for k in range(1, 60)]
    listener = lookups.Counters()
    rocks.streams.addListener(listener)
    try:
        for a in (0, 30):
            append(source, "a.jsonl", rows[a : a + 30])
            stream = lookups.counted(rocks.readStream.format("journal").schema(schema).option("path", str(source)).load())
            query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
        rocks.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        rocks.streams.removeListener(listener)
    repaired = [r for r in rows if (r["fa_known"] and not r["en_known"] if r["active"] == EN else r["en_known"] and not r["fa_known"])]
    assert listener.totals == {"keys_seen": sum(r["strokes"] for r in rows), "words_checked": len(rows), "corrections": len(repaired)}


def plain_pauses(strokes, sensitivity):
    """Pauses of one session's strokes in order: (ts, en, fa, cadence)."""
    out, word, cadence, last = [], [], 150, None
    for k, (at, stroke, en, fa) in enumerate(strokes):
        if stroke == KEY:
            if last is not None:
                cadence = cadence if 40 <= cadence <= 500 else 150
                cadence = (3 * cadence + at - last) // 4 if 20 <= at - last <= 1_500 else cadence
            word.append((en, fa))
            last = at
            pace = max(40, min(500, cadence))
            delay = {0: max(650, min(1_200, 4 * pace)), 1: max(450, min(900, 3 * pace)), 2: max(280, min(650, 2 * pace))}[sensitivity]
            nxt = strokes[k + 1][0] if k + 1 < len(strokes) else 1 << 60
            if 2 <= len(word) <= 32 and nxt > at + delay:
                out.append((at + delay, "".join(a for a, _ in word), "".join(b for _, b in word), cadence))
        elif stroke == BACK:
            word, last = word[:-1], None
        else:
            word, last = [], None
    return out


def test_pauses_by_event_time(rocks, tmp_path):
    """Strokes in small batches, out of order within reach of the watermark, with restarts: the pauses of a plain loop; a stroke beyond reach is dropped."""
    rng, source, sink, checkpoint = random.Random(23), tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    sessions, schema = {}, "session_id string, ts_ms bigint, tie bigint, stroke string, english string, persian string"
    for name in ("one", "two"):
        at, own = 100_000, []
        for k in range(160):
            at += rng.choice([30, 90, 140, 449, 450, 451, 600, 899, 900, 901, 1_600, 4_000] if rng.random() < 0.5 else [60, 120])
            c = rng.choice("abc")
            own.append((at, KEY if k in range(40, 90) else rng.choices([KEY, BACK, END], [12, 2, 1])[0], c, c.upper()))
        sessions[name] = own
    rows = [(name, at, k, stroke, en, fa) for name, own in sessions.items() for k, (at, stroke, en, fa) in enumerate(own)]
    rows.sort(key=lambda r: r[1] + rng.randrange(0, 8_000))
    columns = [part.split()[0] for part in schema.split(", ")]

    def run(part):
        append(source, "a.jsonl", [dict(zip(columns, r, strict=True)) for r in part])
        stream = rocks.readStream.format("journal").schema(schema).option("path", str(source)).load()
        return drained(pauses.pause_stream(stream, "10 seconds"), sink, checkpoint, pauses.Pauses.ROW)

    third = len(rows) // 3
    for a in (0, third, 2 * third):
        run(rows[a : a + third] if a < 2 * third else rows[a:])
    end = max(r[1] for r in rows) + 1_000_000
    run([(name, end, 9_999, END, "", "") for name in sessions])
    query = run([("one", 5, 0, KEY, "x", "X")])
    assert sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators) == 1
    found = sorted((r.session_id, r.ts_ms, r.en, r.fa, r.cadence) for r in journal.committed_rows(rocks, str(sink), pauses.Pauses.ROW).collect())
    assert found == sorted((name, *p) for name, own in sessions.items() for p in plain_pauses([*own, (end, END, "", "")], 1)) and len(found) > 20


def test_cadence_and_delay_are_the_columns(spark):
    rows = [(a, x, s) for a in (0, 39, 40, 41, 150, 499, 500, 501, 750) for x in (0, 19, 20, 21, 333, 1_500, 1_501) for s in (-1, 0, 1, 2, 3)]
    frame = spark.createDataFrame(rows, "a int, x int, s int").select("*", T.next_cadence(F.col("a"), F.col("x")).alias("next"), T.idle_delay(F.col("s"), F.col("a")).alias("delay"))
    for r in frame.collect():
        assert (pauses.next_cadence(r.a, r.x), pauses.idle_delay(r.s, r.a)) == (r.next, r.delay)


def test_undos_are_those_of_the_batch(rocks, tmp_path):
    rng, source, sink, checkpoint, at, rows = random.Random(29), tmp_path / "in", tmp_path / "out", tmp_path / "state", 1_000, []
    source.mkdir()
    schema = "session_id string, " + undos.Undos.EVENT
    for k in range(300):
        at += rng.choice([5, 1_000, 7_000, 8_000, 15_001])
        kind = rng.choice([U.EDIT, U.EDIT, U.BACK, U.HOTKEY, U.MODIFIER, "key"])
        edit = ("was", f"now{k}", rng.choice([" ", None]), 1 + k % 2) if kind == U.EDIT else (None,) * 4
        rows.append((f"s{k // 10 % 2}", at, k, kind, rng.choice("aaab"), *edit))
    columns = [part.split()[0] for part in schema.split(", ")]
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(0, 50_000))
    # A run ends without a batch of its own for the watermark it has reached; later keys move it on.
    for part in (late[:150], late[150:], *([(s, at + later, 0, "key", "z", None, None, None, None) for s in ("s0", "s1")] for later in (10_000_000, 20_000_000))):
        append(source, "a.jsonl", [dict(zip(columns, r, strict=True)) for r in part])
        stream = rocks.readStream.format("journal").schema(schema).option("path", str(source)).load()
        drained(undos.undo_stream(stream, "60 seconds"), sink, checkpoint, undos.Undos.ROW)
    names = ["session_id", "ts_ms", "age_ms", "delete_count", "restored", "delimiter", "target_language"]
    want = U.undone(rocks.createDataFrame(rows, schema), ["session_id"], "tie").select(*names).collect()
    found = journal.committed_rows(rocks, str(sink), undos.Undos.ROW).select(*names).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, map(tuple, want))) and len(want) > 10
