"""Chat formatting into budgeted windows of whole turns, with loss masks.

Turns are dealt by conversation, sorted, and streamed: a task holds one window of one conversation at a
time, so a conversation may be of any length. Prefix sums of turn tokens choose the spans: a window has the
conversation's system turn (if it opens with one), then as many of the latest turns before it as fit
HISTORY tokens, then new turns up to BUDGET tokens. Only new assistant texts are under the loss mask, so
each is a target once. A turn over the budget gets a window of its own and is kept whole (`over_budget`).

Template: [INST]user[/INST], <s>assistant</s>, <<SYS>>system<</SYS>>, and for any other role
[ROLE]role[TEXT]text[/ROLE] with the role as a JSON string. Inside texts every backslash is doubled and every control
string gets a backslash after its first character, which `unescape` reverts.

Edge cases: null texts and null roles count as empty; turns are ordered by turn (nulls first), role, text,
so ties and repeated rows have a place each; null conv_ids are one conversation; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutlens.llm.common import released, table

BUDGET = 512
HISTORY = 128
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
_CONTROL = re.compile(r"(<|\[)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|/ROLE\]|TEXT\])")
_TURN = re.compile(
    r"\[INST\](?P<user>.*?)\[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>|<s>(?P<assistant>.*?)</s>|\[ROLE\](?P<role>.*?)\[TEXT\](?P<text>.*?)\[/ROLE\]",
    re.DOTALL,
)
_TOKEN = re.compile(r"\w+|[^\w\s]")
WINDOWS = "conv_id bigint, window int, n_repeated int, n_turns int, n_tokens int, over_budget boolean, text string, loss array<struct<start:int,stop:int>>"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as text, and where its own text starts and stops."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        name = json.dumps(role).replace("<", "\\u003c").replace("[", "\\u005b")
        before, after = f"[ROLE]{name}[TEXT]", "[/ROLE]"
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def parse(window: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    found = []
    for m in _TURN.finditer(window):
        kind = m.lastgroup
        role = json.loads(m["role"]) if kind == "text" else kind
        found.append((role, unescape(m[kind])))
    return found


def count_tokens(text: str) -> int:
    """Words and marks, and two for the turn's own marks."""
    return len(_TOKEN.findall(text)) + 2


class _Windows:
    """The windows of one conversation, made as its turns come in."""

    def __init__(self, budget: int, history: int, tokens: Callable[[str], int]) -> None:
        self.budget, self.history, self.tokens = budget, history, tokens
        self.system, self.turns, self.repeated, self.number, self.seen = None, [], 0, 0, 0
        self.sums = [0]

    def _room(self) -> int:
        return self.budget - (self.system[0] if self.system else 0)

    def add(self, role: str, text: str) -> Iterator[dict]:
        turn = (self.tokens(text), role, *render(role, text))
        if self.seen == 0 and role == "system":
            self.system = turn
        elif len(self.turns) > self.repeated and self.sums[-1] + turn[0] > self._room():
            yield self.close(False)
            least = self.sums[-1] - min(self.history, self._room() - turn[0])
            first = next((k for k, total in enumerate(self.sums) if total >= least), len(self.turns))
            self.turns = self.turns[min(first, len(self.turns)) :]
            self.repeated = len(self.turns)
            self.sums = [0]
            for old in self.turns:
                self.sums.append(self.sums[-1] + old[0])
        self.seen += 1
        if turn is not self.system:
            self.turns.append(turn)
            self.sums.append(self.sums[-1] + turn[0])

    def close(self, last: bool) -> dict | None:
        """The window so far; at the end also one of the system turn alone."""
        if last and len(self.turns) == self.repeated and not (self.system and self.number == 0):
            return None
        shown = ([self.system] if self.system else []) + self.turns
        fresh = len(shown) - (len(self.turns) - self.repeated) - (1 if self.system and self.number == 0 else 0)
        parts, loss, size = [], [], 0
        for k, (_, role, text, start, stop) in enumerate(shown):
            if role == "assistant" and k >= fresh:
                loss.append({"start": size + start, "stop": size + stop})
            parts.append(text)
            size += len(text)
        tokens = sum(t[0] for t in shown)
        self.number += 1
        return {"window": self.number - 1, "n_repeated": fresh, "n_turns": len(shown), "n_tokens": tokens, "over_budget": tokens > self.budget, "text": "".join(parts), "loss": loss}


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[str], int] = count_tokens) -> DataFrame:
    """The windows of every conversation (see WINDOWS): n_repeated leading turns are repeats of earlier windows'."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("window", pa.int32()), ("n_repeated", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int32()), ("over_budget", pa.bool_()), ("text", pa.string())]
        + [("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, of, some = None, None, False
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not some or conv != of:
                    if some and (end := state.close(True)):
                        rows.append({"conv_id": of, **end})
                    state, of, some = _Windows(budget, history, tokens), conv, True
                rows.extend({"conv_id": conv, **w} for w in state.add(role, text))
            yield from pa.Table.from_pylist(rows, schema).to_batches()
        if some and (end := state.close(True)):
            yield from pa.Table.from_pylist([{"conv_id": of, **end}], schema).to_batches()

    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(released(run), WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation from its windows alone, which must come as `format_conversations` gives them."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, of = False, None
        turns = targets = None
        n = [0, 0, 0, 0]

        def row() -> pa.RecordBatch:
            values = [[of], [n[0]], [turns.hexdigest()], [n[1]], [targets.hexdigest()], [n[2]], [n[3]]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[c.split(" ")[0] for c in schema.split(", ")])

        ready = []
        for batch in batches:
            for w in batch.to_pylist():
                if not some or w["conv_id"] != of or w["window"] == 0:
                    if some:
                        ready.append(row())
                    some, of, turns, targets, n = True, w["conv_id"], hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
                for role, text in parse(w["text"])[w["n_repeated"] :]:
                    turns.update(f"{role}\n{text}\n".encode())
                    n[0] += 1
                for span in w["loss"]:
                    text = unescape(w["text"][span["start"] : span["stop"]])
                    targets.update(text.encode())
                    n[1] += len(text)
                n[2] += len(w["text"])
                n[3] += 1
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        if some:
            yield row()

    return windows.mapInArrow(released(run), schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.union(extra)))


#: The digests from the rows themselves; what depends on the windows (their characters and number) is not SQL's to say.
DIGESTS_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256
FROM c GROUP BY conv_id
"""
