"""Near-duplicate classes by BagMinHash: signatures of shingle multisets, bands, exact verification.

A text is the multiset of its five-word shingles (see `shingles`). A shingle of multiplicity w has
one Poisson process for each dyadic block of levels [0,1), [1,2), [2,4), [4,8) ... that begins below w; a
block's process has the block's width as its rate, and each of its points falls on a level of the block
chosen by hash, so the points below level w are those of w independent unit processes, but only the points
up to the signature's present bound are ever made: a line repeated a thousand times costs ten processes.
Every point carries a register; a register's value is its earliest point. Two texts agree in a register
with the probability of their weighted Jaccard similarity.

Bands of ROWS registers make buckets. Within a bucket every text is verified (exact multiset overlap)
against the bucket's most central text; whatever fails, and is not connected with it otherwise, is
afterwards verified against those texts of the bucket that it may be linked to by exact bounds, so no link
between texts that share a bucket is lost and no bucket of alike texts is expanded into pairs. Classes are the connected components, found by repeated contraction.

Edge cases: null texts count as empty; equal texts are one class at any length, also without words; a text
without words links to nothing else; null doc_ids are kept, and a class's id is its least doc_id (null if it
has none); repeated rows each get their row; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layoutlens.llm.common import Scratch, released, runs_of, table

SIMILARITY = 0.8
#: 25 bands of 5 registers: at a similarity of 0.8 a pair shares no bucket once in 20,000 times.
BANDS = 25
ROWS = 5
CHUNK_BYTES = 400_000
#: Keys of 16 bytes (some 60 in a hash table) that may be broadcast.
BROADCAST_ROWS = 1_000_000


def _unit(x):
    """Uniform in (0, 1]."""
    import numpy as np

    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(texts: list[str], registers: int = BANDS * ROWS):
    """float64[len(texts), registers] of earliest points; inf throughout for a text without shingles."""
    import numpy as np

    from layoutlens.llm.shingles import mix, multisets, shingle_hashes

    hashes, counts = shingle_hashes(texts)
    owner, hashes, weight = multisets(hashes, counts)
    found = np.full((len(texts), registers), np.inf)
    # Blocks: number 0 is level 0, number b holds the levels from 2**(b-1) to below 2**b.
    blocks = np.where(weight == 1, 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1)
    block = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    owner, limit = np.repeat(owner, blocks), np.repeat(weight, blocks)
    width = np.where(block == 0, 1, 1 << np.maximum(block - 1, 0)).astype(np.int64)
    base = np.where(block == 0, 0, width)
    seed = mix(np.repeat(hashes, blocks) + block.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    total = np.maximum(counts, 1)
    bound = registers * (np.log(registers) + 3.0) / total
    flat = found.reshape(-1)
    todo = counts > 0
    while todo.any():
        mine = np.flatnonzero(todo[owner])
        state, x = seed[mine], np.zeros(len(mine))
        while len(mine):
            state = mix(state + np.uint64(0xE7037ED1A0B428DB))
            x = x - np.log(_unit(state)) / width[mine]
            near = x < bound[owner[mine]]
            mine, state, x = mine[near], state[near], x[near]
            spot = mix(state ^ np.uint64(0x8EBC6AF09C88C6E3))
            level = base[mine] + ((spot >> np.uint64(32)).astype(np.int64) & (width[mine] - 1))
            valid = level < limit[mine]
            register = ((spot & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(flat, owner[mine][valid] * registers + register[valid], x[valid])
        todo &= ~np.isfinite(found).all(axis=1)
        bound = bound * 2
    return found


def band_hashes(texts: list[str], bands: int = BANDS, rows: int = ROWS):
    """int64[len(texts), bands] and whether a text has shingles."""
    import numpy as np

    from layoutlens.llm.shingles import mix

    found = signatures(texts, bands * rows)
    bits = found.view(np.uint64).reshape(len(texts), bands, rows)
    joined = np.zeros((len(texts), bands), dtype=np.uint64)
    for r in range(rows):
        joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    joined += np.arange(bands, dtype=np.uint64)
    return mix(joined).view(np.int64), np.isfinite(found[:, 0])


def _banded(documents: DataFrame) -> DataFrame:
    """doc_id, node (md5 of the text), bands (empty for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for a, b in runs_of(batch.column(2), CHUNK_BYTES):
                hashes, some = band_hashes(batch.column(2).slice(a, b - a).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[some].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], names=["doc_id", "node", "bands"])

    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    return rows.mapInArrow(released(run), "doc_id bigint, node binary, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) with linked: whether the overlap of the two texts is `similarity` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from layoutlens.llm.shingles import overlap

        for batch in batches:
            for a, b in runs_of(batch.column(2), CHUNK_BYTES, batch.column(3)):
                linked = overlap(*(batch.column(k).slice(a, b - a).to_pylist() for k in (2, 3))) >= similarity
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(linked)], names=["a", "b", "linked"])

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(released(run), "a binary, b binary, linked boolean")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, root for each node of the links (a, b): every connected set shares its root.

    Each round replaces a node by the least node among itself and its neighbours, and that one by its own, so chains at
    least halve; it works on the links that are left, and nothing but how many there are comes to the driver.
    """
    scratch = scratch or Scratch(links.sparkSession)
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    edges, left = links.select("a", "b"), links.count()
    root = scratch.keep(nodes.withColumn("root", F.col("node")), "root", 2 * left)
    n_nodes = root.count()
    while left:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("next"))
        then = least.select(F.col("node").alias("next"), F.col("next").alias("then"))
        least = scratch.keep(least.join(then, "next").select("node", F.col("then").alias("next")), "least", 2 * left)
        step = least.select(F.col("node").alias("root"), "next")
        root = scratch.keep(root.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "root", n_nodes)
        to_a, to_b = least.select(F.col("node").alias("a"), F.col("next").alias("na")), least.select(F.col("node").alias("b"), F.col("next").alias("nb"))
        moved = edges.join(to_a, "a").join(to_b, "b").filter("na <> nb")
        edges = scratch.keep(moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "edges", left)
        left = edges.count()
    return root


def _small(keys: DataFrame) -> DataFrame:
    """Keys with a broadcast hint if counted to be few; else the join shuffles the documents."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _hubs(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """bucket, node, hub of every bucket of two texts or more.

    The hub is the member that shares most places with others over all its buckets: in a group of
    copies, the one nearest to them all.
    """
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    inside = scratch.keep(members.join(shared, "bucket"), "shared")
    central = inside.groupBy("node").agg(F.sum(F.col("n") - 1).alias("met"))
    hubs = inside.join(central, "node").groupBy("bucket").agg(F.max(F.struct("met", "node")).alias("most"))
    return inside.select("bucket", "node").join(hubs.select("bucket", F.col("most.node").alias("hub")), "bucket")


def _rare_first(texts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """node, element, place, size: what of each text must contain something that a linked text has too.

    A text is a set of elements (shingle, number of its occurrence). With the elements of all these texts in one
    order, the rarest first, two texts of this similarity share one of the first (1 - similarity) of either. Elements
    of one text only are left out, but count for the places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from layoutlens.llm.shingles import mix, multisets, shingle_hashes

        for batch in batches:
            for a, b in runs_of(batch.column(1), CHUNK_BYTES):
                owner, hashes, weight = multisets(*shingle_hashes(batch.column(1).slice(a, b - a).to_pylist()))
                number = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                elements = mix(np.repeat(hashes, weight) + number.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
                nodes = batch.column(0).slice(a, b - a).take(pa.array(np.repeat(owner, weight)))
                yield pa.RecordBatch.from_arrays([nodes, pa.array(elements.view(np.int64))], names=["node", "element"])

    parts = scratch.keep(texts.select("node", "text").mapInArrow(released(run), "node binary, element bigint"), "elements")
    met = parts.groupBy("element").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    order = Window.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "element")
    placed = parts.join(met, "element", "left").withColumns(
        {"place": F.row_number().over(order) - 1, "size": F.count(F.lit(1)).over(Window.partitionBy("node"))}
    )
    return placed.filter(F.col("n").isNotNull() & (F.col("place") <= (1 - similarity) * F.col("size") + 1e-6)).drop("n")


def _left_open(inside: DataFrame, root: DataFrame, failed: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Pairs (f, node) that may be linked although f failed against its hub, and that nothing connects so far.

    In play are the texts of all buckets that hold such an f. Exact: texts that share none of their rarest
    elements, or share the first one so late that too few remain, cannot be linked. A copy with many edits
    of its own so costs nothing, however large its group is.
    """
    rooted = inside.join(root, "node", "left").select("bucket", "hub", "node", F.coalesce("root", "node").alias("root"))
    hub_root = root.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    rooted = scratch.keep(rooted.join(hub_root, "hub", "left").withColumn("hub_root", F.coalesce("hub_root", "hub")), "rooted")
    open_ones = scratch.keep(rooted.filter("root <> hub_root").join(failed, ["hub", "node"]).select("bucket", "node", "root"), "open")
    mates = rooted.join(open_ones.select("bucket").distinct(), "bucket", "left_semi").select("node", "root").distinct()
    mates = scratch.keep(mates, "mates")
    elements = scratch.keep(_rare_first(texts.join(mates.select("node"), "node", "left_semi"), similarity, scratch).join(mates, "node"), "rare")
    remaining = lambda size, place: size - place
    enough = lambda shared, a, b: shared + 1e-6 >= similarity * (a + b - shared)
    least = elements.groupBy("element").agg(F.min("size").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    left = elements.join(open_ones.select("node").distinct(), "node", "left_semi").join(least, "element")
    rest = remaining(F.col("size"), F.col("place"))
    left = left.filter(enough(rest, F.col("size"), F.greatest("least", rest)))
    left = left.select(F.col("element").alias("e"), F.col("node").alias("f"), F.col("root").alias("f_root"), F.col("size").alias("f_size"), rest.alias("f_rest"))
    shared = F.least(F.col("f_rest"), rest)
    return left.join(elements, (F.col("e") == F.col("element")) & (F.col("f_root") != F.col("root")) & enough(shared, F.col("f_size"), F.col("size")))


def classes(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node, class_id, keep_node: every document row; `keep_node` is the text that stands for the class.

    The tables written on the way are dropped, but for the two that the result reads.
    """
    scratch = Scratch(documents.sparkSession, documents)
    banded = scratch.keep(_banded(documents), "banded")
    nodes = scratch.keep(banded.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "nodes")
    inside = scratch.keep(_hubs(nodes, scratch), "buckets")
    met = inside.count()
    pairs = scratch.keep(inside.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs", met)
    wanted = scratch.keep(inside.select("node").distinct(), "wanted", met)
    text = F.coalesce("text", F.lit(""))
    keyed = documents.select(F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    texts = scratch.keep(keyed.join(_small(wanted), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    first = scratch.keep(_verified(pairs, texts, similarity), "first")
    links = first.filter("linked").select("a", "b")
    root = components(links, scratch)
    failed = first.filter("NOT linked").select(F.col("a").alias("hub"), F.col("b").alias("node"))
    more = _left_open(inside, root, failed, texts, similarity, scratch)
    more = scratch.keep(more.select(F.least("f", "node").alias("a"), F.greatest("f", "node").alias("b")).distinct(), "more")
    if not more.isEmpty():
        second = scratch.keep(_verified(more, texts, similarity).filter("linked").select("a", "b"), "second")
        if not second.isEmpty():
            root = components(links.union(second), scratch)
    placed = nodes.join(root, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "node")).alias("least"))
    named = placed.join(least, "root").select("node", F.col("least.id").alias("class_id"), F.col("least.node").alias("keep_node"))
    named, own = scratch.keep(named, "named"), scratch.keep(banded.select("doc_id", "node"), "own")
    scratch.drop("named", "own")
    return own.join(named, "node")


def keep_one(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class with all its columns, whatever their names: the one with its least doc_id; of several equal rows, one."""
    found, scratch = classes(documents, similarity), Scratch(documents.sparkSession, documents)
    kept = found.filter("node = keep_node AND doc_id <=> class_id").groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = scratch.keep(kept.select("node", F.col("doc_id").alias("id"), "n"), "kept")
    own = documents.select(F.struct("*").alias("row"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("own"))
    rows = own.join(kept, (F.col("own") == F.col("node")) & F.col("row.doc_id").eqNullSafe(F.col("id")))
    single, several = rows.filter("n = 1"), rows.filter("n > 1").dropDuplicates(["node", "id"])
    return single.select("row.*").union(several.select("row.*"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.lower(F.hex("node")).alias("text_key"))
