import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from layoutlens.llm import chat_format as cf

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "<</SYS>>", "<<SYS>>", "[TEXT]", "[/ROLE]", "ok", "\n", "é", "/"]


def test_escape_round_trip():
    rng = random.Random(1)
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[INST]", "a\n\\b<"]), "".join(rng.choices(PARTS, k=rng.randrange(8)))) for _ in range(rng.randrange(5))]
        shown = [cf.render(*t) for t in turns]
        assert cf.parse("".join(x[0] for x in shown)) == turns
        assert all(cf.unescape(x[0][x[1] : x[2]]) == t[1] for x, t in zip(shown, turns, strict=True))


def test_windows_hold_their_budget_and_every_target_once(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for conv in range(30):
        turns = [("system", "be brief")] if conv % 2 else []
        turns += [("user" if k % 2 == 0 else "assistant", " ".join(["word"] * rng.randrange(1, 60))) for k in range(rng.randrange(1, 40))]
        want[conv] = turns
        rows += [(conv, k, *t) for k, t in enumerate(turns)]
    frame = spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(3))
    found = cf.format_conversations(frame, budget=100, history=30).orderBy("conv_id", "window").collect()
    for conv, turns in want.items():
        own = [w for w in found if w.conv_id == conv]
        fresh = [t for w in own for t in cf.parse(w.text)[w.n_repeated :]]
        assert fresh == turns
        assert [cf.unescape(w.text[s.start : s.stop]) for w in own for s in w.loss] == [t for r, t in turns if r == "assistant"]
        for w in own:
            assert w.n_tokens <= 100 and not w.over_budget
            assert not turns[0][0] == "system" or cf.parse(w.text)[0] == turns[0]
        for w in own:
            repeats = cf.parse(w.text)[turns[0][0] == "system" : w.n_repeated]
            assert sum(cf.count_tokens(t) for _, t in repeats) <= 30
    assert any(w.n_repeated > 1 for w in found)


def test_whole_table_matches_sql(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}')")
    want = {r[0]: r[1:] for r in db.execute(cf.DIGESTS_SQL).fetchall()}
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.op6(spark, "/root/testdata/sf0.01").collect()}
    assert found == want and -7 in found


def test_edge_cases(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (1, 0, "system", "only"), (2, 0, "user", "word " * 900), (2, 0, "user", "word " * 900), (2, 1, "assistant", "")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("loss", F.lit(1))
    found = {r.conv_id: r for r in cf.read_back(cf.format_conversations(frame)).collect()}
    assert found[None].n_turns == 2 and found[None].loss_chars == 1
    assert found[1].n_turns == 1 and found[1].turns_sha256 == hashlib.sha256(b"system\nonly\n").hexdigest()
    assert found[2].n_turns == 3 and found[2].loss_chars == 0
    assert cf.format_conversations(frame.limit(0)).count() == 0
