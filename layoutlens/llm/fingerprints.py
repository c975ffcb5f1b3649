"""Merkle fingerprints of documents: pieces -> paragraphs -> sections -> root, DataFrame functions only.

A text splits into blocks at empty lines, a block into paragraphs at line ends, a paragraph into pieces (sentences, cut at
PIECE code points), and every SECTION consecutive paragraphs of a block form one section, so each level is cut at the same places for the same
text. The leaves hash the pieces, a paragraph node hashes its leaves, a section node its paragraph nodes, the root its section
nodes; the first section of a block has its own tag, so the root determines the whole text. `likeness` compares the leaves of two trees;
`changed_paragraphs` descends only into sections that the other tree has not.

Edge cases: a null text counts as empty; an empty text is one block with one empty paragraph and has no
leaves; two texts without leaves are alike (1.0). Repeated rows get equal trees; extra columns keep their values, whatever their names.
Successors: equal ids are ordered by text, null ids come last; rows of one id are in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layoutlens.llm.common import table

#: Paragraphs in a section, code points in a piece.
SECTION = 16
PIECE = 160
PIECE_PATTERN = f"[^.!?]{{1,{PIECE}}}[.!?]*|[.!?]+"


def _paragraph(paragraph: Column) -> Column:
    """struct<node, leaves> of a paragraph."""
    leaves = F.transform(F.regexp_extract_all(paragraph, F.lit(PIECE_PATTERN), F.lit(0)), lambda x: F.sha2(x, 256))
    return F.struct(leaves.alias("leaves"))


def _section_nodes(block: Column) -> Column:
    paragraphs = F.transform(F.split(block, "\n"), _paragraph)
    nodes = F.transform(paragraphs, lambda p: F.struct(F.sha2(F.concat(F.lit("P"), F.array_join(p["leaves"], "")), 256).alias("node"), p["leaves"].alias("leaves")))
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / SECTION).cast("int"))
    parts = F.transform(starts, lambda i: F.struct(i.alias("i"), F.slice(nodes, i * SECTION + 1, SECTION).alias("paragraphs")))
    tagged = lambda s: F.concat(F.when(s["i"] == 0, "S").otherwise("T"), F.array_join(F.transform(s["paragraphs"], lambda p: p["node"]), ""))
    return F.transform(parts, lambda s: F.struct(F.sha2(tagged(s), 256).alias("node"), s["paragraphs"].alias("paragraphs")))


def tree(text: Column) -> Column:
    """array<struct<node, paragraphs: array<struct<node, leaves>>>>: the section nodes of a text with all that is below them."""
    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), _section_nodes))


def root(sections: Column) -> Column:
    """The fingerprint: equal exactly for equal texts."""
    return F.sha2(F.concat(F.lit("R"), F.array_join(F.transform(sections, lambda s: s["node"]), "")), 256)


def paragraphs(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: s["paragraphs"]))


def leaves(sections: Column) -> Column:
    """The distinct leaves of a tree."""
    return F.array_distinct(F.flatten(F.transform(paragraphs(sections), lambda p: p["leaves"])))


def leaves_of(text: Column) -> Column:
    """`leaves` of a text's tree, without the levels above."""
    found = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.regexp_extract_all(p, F.lit(PIECE_PATTERN), F.lit(0)))
    return F.array_distinct(F.transform(F.flatten(found), lambda x: F.sha2(x, 256)))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the `leaves` of two trees: 1 for equal texts, 0 where nothing is shared."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Indices (from 0) of the paragraphs of tree `b` that tree `a` has nowhere; the other way round, what was removed.

    Sections are matched by node, wherever they stand, and not descended into; paragraphs of the others likewise.
    """
    nodes = lambda xs: F.transform(xs, lambda x: x["node"])
    new_sections = F.array_except(nodes(b), nodes(a))
    fresh = F.filter(b, lambda s: F.array_contains(new_sections, s["node"]))
    new = F.array_except(nodes(paragraphs(fresh)), nodes(paragraphs(a)))
    own = nodes(paragraphs(b))
    return F.filter(F.transform(own, lambda x, i: F.when(F.array_contains(new, x), i)), lambda i: i.isNotNull())


def fingerprints(documents: DataFrame, text: str = "text") -> DataFrame:
    """`documents` with n_sections, n_paragraphs and fingerprint of `text`; columns so named are replaced."""
    own = documents.select(F.struct("*").alias("row"), tree(F.col(text)).alias("tree"))
    made = {"fingerprint": root(F.col("tree")), "n_sections": F.size("tree"), "n_paragraphs": F.size(paragraphs(F.col("tree")))}
    kept = [F.col("row")[c].alias(c) for c in documents.columns if c not in made]
    return own.select(*kept, *[value.alias(name) for name, value in made.items()])


def with_next(documents: DataFrame, rows_per_range: int = 512, least_ranges: int = 2048) -> DataFrame:
    """doc_id, text, next_text: each row's successor in descending doc_id; after the last comes the first.

    No global window: approximate quantiles of the ids (bounded, from the id column alone) cut the table
    into ranges that are ordered within themselves, and the rows at a range's upper bound are also sent to
    the range above it, whose lowest row they follow. Texts are shuffled once. Equal ids are ordered by
    text; null ids come last.
    """
    spark = documents.sparkSession
    most = max(least_ranges, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    levels = [i / most for i in range(1, most)]
    found = documents.agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"), F.percentile_approx("doc_id", levels, 10 * most).alias("cuts")
    ).first()
    ranges = max(1, min(most, found["n"] // rows_per_range))
    cuts = found["cuts"] or []
    cuts = sorted({cuts[min(len(cuts) - 1, i * most // ranges - 1)] for i in range(1, ranges)} - {found["top"]}) if cuts else []
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # A row's range is the number of cuts below its id, so a cut is the highest id of its range.
    span = F.coalesce(_cuts_below(cuts, F.col("doc_id")), F.lit(0))
    is_cut = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    homes = F.array_compact(
        F.array(
            F.struct(span.alias("range"), F.lit(0).alias("guest")),
            F.when(is_cut, F.struct((span + 1).alias("range"), F.lit(1).alias("guest"))),
            F.when(F.col("doc_id").eqNullSafe(F.lit(found["top"])), F.struct(F.lit(0).alias("range"), F.lit(2).alias("guest"))),
        )
    )
    order = Window.partitionBy("__home.range").orderBy(F.col("__home.guest"), F.col("doc_id").desc_nulls_last(), "text")
    placed = rows.withColumn("__home", F.explode(homes)).withColumn("next_text", F.lead("text").over(order))
    return placed.filter("__home.guest = 0").select("doc_id", "text", "next_text")


def _cuts_below(cuts: list[int], value: Column, step: int = 45) -> Column:
    """How many of the sorted `cuts` are less than `value`: every step-th one first, then one block."""
    if not cuts:
        return F.lit(0)
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = F.lit([b[-1] for b in blocks])
    passed = F.size(F.filter(coarse, lambda x: x < value))
    block = F.get(F.array(*[F.lit(b) for b in blocks]), passed)
    return passed * step + F.coalesce(F.size(F.filter(block, lambda x: x < value)), F.lit(0))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text against its edited form and its successor; see the module for edge cases."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = (
        with_next(table(spark, sf_dir, "documents"))
        .withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)))
        .withColumns({"own_tree": tree(F.col("text")), "edited_tree": tree(F.col("edited"))})
        .withColumn("own_leaves", leaves(F.col("own_tree")))
    )
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        root(F.col("own_tree")).alias("fingerprint"),
        root(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("own_leaves"), leaves(F.col("edited_tree"))).alias("near_edited"),
        likeness(F.col("own_leaves"), leaves_of(F.col("next_text"))).alias("near_next"),
        F.size(changed_paragraphs(F.col("own_tree"), F.col("edited_tree"))).cast("bigint").alias("changed_paragraphs"),
        F.size(changed_paragraphs(F.col("edited_tree"), F.col("own_tree"))).cast("bigint").alias("removed_paragraphs"),
    )


_LEAVES = f"list_transform(regexp_extract_all(p, '{PIECE_PATTERN}'), lambda x: sha256(x))"
_PARAGRAPHS = lambda text: f"list_transform(string_split({text}, chr(10) || chr(10)), lambda b: list_transform(string_split(b, chr(10)), lambda p: sha256('P' || array_to_string({_LEAVES}, ''))))"
_NODES = """list_transform(range(0, (len(ps) + 15) // 16), lambda i: sha256(CASE WHEN i = 0 THEN 'S' ELSE 'T' END || array_to_string(ps[i * 16 + 1 : i * 16 + 16], '')))"""
_ROOT = "sha256('R' || array_to_string(flatten(list_transform({0}, lambda ps: " + _NODES + ")), ''))"
_ALL = lambda text: f"list_distinct(flatten(list_transform(string_split({text}, chr(10)), lambda p: {_LEAVES})))"
_LIKE = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END"
_LACK = "CAST(len(list_filter(flatten({0}), lambda x: NOT list_contains(flatten({1}), x))) AS BIGINT)"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text,
             length(text) AS n_chars FROM d),
e AS (SELECT *, left(text, CAST(n_chars - n_chars // 2 AS BIGINT)) || left(next_text, CAST(n_chars // 2 AS BIGINT)) AS edited FROM n),
t AS (SELECT *, {_PARAGRAPHS("text")} AS own_tree, {_PARAGRAPHS("edited")} AS edited_tree,
             {_ALL("text")} AS a, {_ALL("edited")} AS b, {_ALL("next_text")} AS c FROM e)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_ROOT.format("own_tree")} AS fingerprint,
       {_ROOT.format("edited_tree")} AS edited_fingerprint,
       {_LIKE.format("a", "b")} AS near_edited, {_LIKE.format("a", "c")} AS near_next,
       {_LACK.format("edited_tree", "own_tree")} AS changed_paragraphs, {_LACK.format("own_tree", "edited_tree")} AS removed_paragraphs
FROM t
"""
