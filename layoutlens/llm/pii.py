"""Personal data: patterns, and identifiers found by the words before them; DataFrame functions only.

1. Plain patterns give the base spans of every text (email, ip, card, phone; leftmost, non-overlapping, failing matches dropped), and one more gives
   candidates: runs of digits with separators, and handles with an at sign, that no base span touches.
2. Base entities are seeds, each of its kind with score 1. The one, two and three words before an entity or a candidate are lexical
   patterns; the edges of the graph are (pattern, value) with the number of places.
3. All texts are searched for the patterns, so that each is known by how often it comes at all. Patterns with fewer than SUPPORT different values, or
   which even with all their values counted in full could not reach CONFIDENCE, go at once.
4. ROUNDS times: a pattern's confidence for a kind is the score of what it introduces over all its places (one more counted
   against it), if its values' scores add up to SUPPORT; a candidate's score for a kind that its form allows is the highest
   confidence of its patterns. New candidates count for further patterns in the next round.
5. Candidates with a score of CONFIDENCE or more are identifiers of their best kind (the first listed of equals), wherever they stand.

The plain patterns are written so that no part is tried twice (possessive, begun only where a run begins): time and stack are linear in a
text's length. Positions come from the lengths of what lies between matches, summed by window. The text is read twice and never shuffled; what is written
and dealt is found places only. Joins are broadcast only where a side was counted to be small; others are left to adaptive execution.

Edge cases: null texts are empty; repeated rows, null or repeated doc_ids have a row each; texts without spans have counts of 0 and the digest of
no bytes; a value and a pattern count once for each of its places, but support counts different values only, so copies of a text give none; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layoutlens.llm.common import Scratch, table

KINDS = ("email", "ip", "card", "phone")
CANDIDATE = len(KINDS)
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.5, 3
#: Code points before a place in which its words are looked for.
CONTEXT = 64
GRAMS = 3
BROADCAST_ROWS = 200_000

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: A run that fails from its first character fails from all others; one may also begin where the last match ended.
_RUN_START = rf"(?:(?<!{_LOCAL})|\G)"
PATTERNS = (
    rf"{_RUN_START}{_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    rf"{_RUN_START}{_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)*+|(?<![A-Za-z0-9])\+?[0-9](?:[\x20().-]{{0,2}}+[0-9])++",
)
#: What a text must hold for a pattern to be tried at all.
_NEEDS = ("@", ".", "", "+", "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    """Whether all parts between dots are at most 255, whatever zeros they begin with."""
    return F.forall(F.split(value, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.right(x, F.lit(4)).cast("int"), F.lit(256)) <= 255))


def _holds(kind: Column, value: Column) -> Column:
    """Whether a match of a pattern is an entity of its kind; candidates always hold."""
    n = F.length(_digits(value))
    card = n.between(12, 19) & F.call_function("luhn_check", F.left(_digits(value), F.lit(20)))
    return F.when(kind == 1, _octets(value)).when(kind == 2, card).when(kind == 3, n.between(9, 15)).otherwise(True)


def _allowed(kind: Column, value: Column) -> Column:
    """Whether a candidate's form allows an identifier of a kind."""
    n = F.length(_digits(value))
    at = value.contains("@")
    return (
        F.when(kind == 0, at).when(at, False).when(kind == 1, value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){2,4}$"))
        .when(kind == 2, n.between(12, 19)).otherwise(n.between(7, 15))
    )


def _found(text: Column) -> Column:
    """array<struct<kind, values, gaps>>: matches of all patterns, and of what lies before each (and after the last) the length, the end and the first character."""

    def of(kind: int) -> Column:
        pattern = PATTERNS[kind]
        gap = lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(CONTEXT)).alias("left"), F.left(g, F.lit(1)).alias("head"))
        tried = text.contains(_NEEDS[kind]) if _NEEDS[kind] else text.rlike("[0-9@]")
        values = F.when(tried, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        return F.struct(F.lit(kind).alias("kind"), values.alias("values"), F.when(tried, F.transform(F.split(text, pattern, -1), gap)).alias("gaps"))

    return F.filter(F.array(*map(of, range(len(PATTERNS)))), lambda x: F.size(x["values"]) > 0)


def _places(rows: DataFrame) -> DataFrame:
    """row, kind, start, end, value, left: entities, and candidates that no entity touches."""
    kinds = rows.select("row", F.explode("found").alias("f"))
    zipped = F.arrays_zip(F.col("f.values").alias("value"), F.slice("f.gaps", F.lit(1), F.size("f.values")).alias("gap"), F.slice("f.gaps", F.lit(2), F.size("f.values")).alias("next"))
    each = kinds.select("row", F.col("f.kind").alias("kind"), F.posexplode(zipped).alias("at", "x"))
    size = F.length("x.value").cast("bigint")
    end = F.sum(F.col("x.gap.n") + size).over(Window.partitionBy("row", "kind").orderBy("at"))
    placed = each.select("row", "kind", (end - size).alias("start"), end.alias("end"), F.col("x.value").alias("value"), F.col("x.gap.left").alias("left"), F.col("x.next.head").alias("head"))
    # A candidate that a letter or digit follows is a part of something else, and one of few digits says nothing.
    n = F.length(_digits(F.col("value")))
    fits = (F.col("value").contains("@") | (n >= 7) | F.col("value").rlike(r"\.[0-9]+\.")) & ~F.col("head").rlike("[A-Za-z0-9]")
    held = placed.filter(F.when(F.col("kind") == CANDIDATE, fits).otherwise(_holds(F.col("kind"), F.col("value")))).drop("head")
    # Two running frames: one that looks ahead would be worked out anew for every row.
    forth, back = (Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in (("start", "kind"), (F.desc("start"), F.desc("kind"))))
    base = F.col("kind") < CANDIDATE
    before = F.max(F.when(base, F.col("end"))).over(forth)
    after = F.min(F.when(base, F.col("start"))).over(back)
    touched = (F.coalesce(before, F.lit(0)) > F.col("start")) | (F.coalesce(after, F.col("end")) < F.col("end"))
    return held.withColumn("touched", touched).filter(base | ~F.col("touched")).drop("touched")


def _grams(words: Column, size: Column) -> Column:
    """The last one, two and three of an array's words, joined."""
    last = lambda n: F.when(size >= n, F.array_join(F.slice(words, F.greatest(size - (n - 1), F.lit(1)), F.lit(n)), " "))
    return F.array_compact(F.array(*[last(n) for n in range(1, GRAMS + 1)]))


def _edges(places: DataFrame) -> DataFrame:
    """pattern, value, candidate, n: how often a value stands behind the words of a pattern."""
    cut = F.when(F.length("left") < CONTEXT, F.col("left")).otherwise(F.regexp_replace("left", r"^\S+", ""))
    words = places.select("kind", F.lower("value").alias("value"), F.split(F.trim(F.regexp_replace(F.lower(cut), r"\s+", " ")), " ").alias("w"))
    behind = words.withColumn("w", F.array_remove("w", "")).select("kind", "value", F.explode(_grams(F.col("w"), F.size("w"))).alias("pattern"))
    return behind.groupBy("pattern", "value", (F.col("kind") == CANDIDATE).alias("candidate")).agg(F.count(F.lit(1)).alias("n"))


def _small(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else frame


def _pattern_counts(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, total: places of the patterns in all texts, whatever follows."""
    heads = patterns.select(F.substring_index("pattern", " ", -1).alias("w0")).distinct()
    words = documents.select(F.split(F.lower("text"), r"\s+").alias("w"))
    none = F.array(F.lit(None).cast("string"))
    zipped = F.arrays_zip(F.col("w").alias("w0"), F.concat(none, F.col("w")).alias("w1"), F.concat(none, none, F.col("w")).alias("w2"))
    three = words.select(F.explode(zipped).alias("x")).select("x.w0", "x.w1", "x.w2").filter("w0 <> ''").join(_small(heads), "w0", "left_semi")
    pair = F.concat("w1", F.lit(" "), "w0")
    grams = three.select(F.explode(F.array_compact(F.array("w0", pair, F.concat("w2", F.lit(" "), pair)))).alias("pattern"))
    return grams.join(_small(patterns.select("pattern")), "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))


def _kinds(value: Column) -> Column:
    return F.filter(F.array(*map(F.lit, range(len(KINDS)))), lambda k: _allowed(k, value))


def discovered(documents: DataFrame, places: DataFrame, scratch: Scratch, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """value, kind, score: candidates that confident patterns introduce."""
    edges = scratch.keep(_edges(places), "edges")
    known = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("places")).filter(F.col("values") >= support)
    known = scratch.keep(known, "patterns")
    counted = known.join(_pattern_counts(documents, known), "pattern", "left")
    # A place may be part of a longer word (`tel:+1`), which the search does not see.
    total = F.greatest(F.coalesce("total", F.lit(0)), F.col("places")) + 1
    able = counted.withColumn("total", total).filter(F.col("places") >= confidence * F.col("total")).select("pattern", "total")
    able = scratch.keep(able, "able")
    graph = scratch.keep(edges.join(_small(able), "pattern"), "graph")
    seeds = scratch.keep(places.filter(F.col("kind") < CANDIDATE).select(F.lower("value").alias("value"), "kind").distinct().withColumn("score", F.lit(1.0)), "seeds")
    scores, found = seeds, None
    open_ends = graph.filter("candidate").withColumn("kind", F.explode(_kinds(F.col("value"))))
    for k in range(rounds):
        met = graph.join(scores, "value").groupBy("pattern", "kind", "total").agg(F.sum("score").alias("weight"), F.sum(F.col("n") * F.col("score")).alias("mass"))
        sure = met.filter(F.col("weight") >= support).select("pattern", "kind", (F.col("mass") / F.col("total")).alias("confidence"))
        found = open_ends.join(sure, ["pattern", "kind"]).groupBy("value", "kind").agg(F.max("confidence").alias("score"))
        found = scratch.keep(found, f"found{k}")
        scores = seeds.union(found)
    best = found.filter(F.col("score") >= confidence).groupBy("value").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("kind"))).alias("b"))
    return best.select("value", "b.kind", "b.score")


def personal_data(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, places array<struct<start, kind, end, base>> of every row, by start and kind."""
    scratch = scratch or Scratch(documents.sparkSession, documents)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = scratch.keep(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", _found(F.col("text")).alias("found")), "rows")
    places = scratch.keep(_places(rows), "places")
    new = scratch.keep(discovered(texts, places, scratch), "new")
    candidates = places.filter(F.col("kind") == CANDIDATE).withColumn("value", F.lower("value")).drop("kind").join(_small(new), "value")
    every = places.filter(F.col("kind") < CANDIDATE).select("row", "start", "kind", "end", F.lit(True).alias("base")).union(candidates.select("row", "start", "kind", "end", F.lit(False)))
    gathered = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("places"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,base:boolean>>")
    return rows.select("row", "doc_id").join(gathered, "row", "left").select("doc_id", F.coalesce("places", none).alias("places"))


def _written(places: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(places, lambda p: F.concat_ws(":", F.get(names, p["kind"]), p["start"].cast("string"), p["end"].cast("string"))), ",")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    count = lambda kind: F.size(F.filter("places", lambda p: p["base"] & (p["kind"] == kind))).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("places")).alias("spans"))
