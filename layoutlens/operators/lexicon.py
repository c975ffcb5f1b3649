"""Lexicon build: eligible words, tiers, prefixes, collisions and their priors, and Bloom bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutlens.functions import text as T
from layoutlens.functions.layout import ENGLISH, PERSIAN, physical_persian

LEAST_PREFIX = 3
COMMON, FREQUENT = 20_000, 2_000
#: Rows of a lookup table up to which it may be broadcast (some 40 bytes each).
BROADCAST_ROWS = 1_000_000

# The words of one or two letters that count as known.
SHORT_ENGLISH = """
a i ad ah ai am an as at be by do go he hi if in is it me my no of oh ok on or so to up us we
""".split()
SHORT_PERSIAN = """
و آب آن آه از او ای با بد بر به بی پا پر پس تا تب ته تو جا جز چه خب خط در دل دم ده دو را رو زن سر سن سه شب شد
حق حل کم کن که کل کی گل لب ما من نه نو هم هر هی یا یک وی
""".split()
# Fragments in ranked lists that are not accepted.
REJECTED_PERSIAN = "استفاد بارة بعری تول خیاه روب هبچ وگو پاعین".split()


def small(frame: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has been counted to be small; else the join is left to shuffle."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def short_words(spark: SparkSession) -> DataFrame:
    rows = [(ENGLISH, w) for w in SHORT_ENGLISH] + [(PERSIAN, w) for w in SHORT_PERSIAN]
    return spark.createDataFrame(rows, "lang int, form string")


def eligible_english(lines: DataFrame, column: str = "line") -> DataFrame:
    """The distinct dictionary words (form) of at least three letters."""
    word = F.lower(T.without_affix(F.col(column)))
    return lines.select(word.alias("form")).filter((F.length("form") >= LEAST_PREFIX) & T.english_shape(F.col("form"))).distinct()


def eligible_persian(lines: DataFrame, column: str = "line") -> DataFrame:
    word = T.normalise_persian(T.without_affix(F.col(column)))
    return lines.select(word.alias("form")).filter((F.length("form") >= LEAST_PREFIX) & T.alphabetic(F.col("form"))).distinct()


def ranked_english(ranked: DataFrame) -> DataFrame:
    """form, rank (the first) of the eligible words of a frequency list (word, rank)."""
    word = F.lower("word")
    return ranked.select(word.alias("form"), "rank").filter((F.length("form") >= LEAST_PREFIX) & T.english_shape(F.col("form"))).groupBy("form").agg(F.min("rank").alias("rank"))


def ranked_persian(ranked: DataFrame) -> DataFrame:
    """As for English; words with a joiner are refused, since no key gives one, and so are known fragments."""
    own = ranked.filter(~F.col("word").contains("‌")).select(T.normalise_persian(F.col("word")).alias("form"), "rank")
    refused = ranked.sparkSession.createDataFrame([(w,) for w in REJECTED_PERSIAN], "form string")
    kept = own.filter((F.length("form") >= LEAST_PREFIX) & T.alphabetic(F.col("form"))).join(F.broadcast(refused), "form", "left_anti")
    return kept.groupBy("form").agg(F.min("rank").alias("rank"))


def top_words(ranked: DataFrame, most: int, strict: bool = True) -> DataFrame:
    """The first `most` forms in order of rank, then form; with `strict`, fewer are an error."""
    found = ranked.orderBy("rank", "form").limit(most).select("form")
    if strict and (n := found.count()) < most:
        raise ValueError(f"expected {most} eligible words, found {n}")
    return found


def proper_prefixes(words: DataFrame) -> DataFrame:
    """The distinct prefixes (form) of at least three letters that are shorter than their word."""
    longer = words.filter(F.length("form") > LEAST_PREFIX)
    sizes = F.sequence(F.lit(LEAST_PREFIX), F.length("form") - 1)
    return longer.select(F.explode(F.transform(sizes, lambda n: F.left(F.col("form"), n))).alias("form")).distinct()


TIERS = ("is_short", "is_word", "is_common", "is_frequent", "is_prefix", "is_common_prefix")


def build_lexicon(tiers: dict[int, dict[str, DataFrame]], spark: SparkSession) -> DataFrame:
    """One row for each language and form with its flags, from frames (form) of words, common and frequent.

    All tiers must be there, or nothing is built; `require_complete` tells whether they have rows. Frequent words take in the short ones.
    """
    parts = []
    short = short_words(spark)
    for lang, own in tiers.items():
        missing = [name for name in ("words", "common", "frequent") if name not in own]
        if missing:
            raise ValueError(f"lexicon {lang} lacks {', '.join(missing)}")
        brief = short.filter(F.col("lang") == lang).select("form")
        named = {
            "is_short": brief, "is_word": own["words"], "is_common": own["common"], "is_frequent": own["frequent"].union(brief),
            "is_prefix": proper_prefixes(own["words"]), "is_common_prefix": proper_prefixes(own["common"]),
        }
        parts += [frame.select(F.lit(lang).alias("lang"), "form", F.lit(name).alias("tier")) for name, frame in named.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.groupBy("lang", "form").agg(*[F.max(F.col("tier") == name).alias(name) for name in TIERS])


def require_complete(lexicon: DataFrame, langs: tuple[int, ...] = (ENGLISH, PERSIAN)) -> DataFrame:
    """The lexicon, if words, common and frequent words (beyond the short ones) of every language have rows."""
    wanted = ("is_word", "is_common", "is_frequent")
    found = {r["lang"]: r for r in lexicon.groupBy("lang").agg(*[F.bool_or(F.col(t) & ~F.col("is_short")).alias(t) for t in wanted]).collect()}
    missing = [f"{lang} lacks {t}" for lang in langs for t in wanted if lang not in found or not found[lang][t]]
    if missing:
        raise ValueError(f"lexicon {', '.join(missing)}")
    return lexicon


def require_same(made: DataFrame, stored: DataFrame) -> None:
    """The reproducibility gate: any row that only one of the frames has ends the build."""
    if row := differences(made, stored.select(*made.columns)).first():
        raise ValueError(f"only {row['side']}: {row.asDict()}")


def differences(made: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of either frame that the other lacks; the reproducibility gate wants none."""
    return made.exceptAll(stored).withColumn("side", F.lit("made")).union(stored.exceptAll(made).withColumn("side", F.lit("stored")))


def collisions(english: DataFrame, persian: DataFrame) -> DataFrame:
    """english, persian: words of the two languages that the same keys give."""
    typed = english.select(F.col("form").alias("english"), physical_persian(F.col("form")).alias("persian")).filter("persian IS NOT NULL")
    return typed.join(persian.select(F.col("form").alias("persian")), "persian").select("english", "persian")


def collision_priors(pairs: DataFrame, english_zipf: DataFrame, persian_zipf: DataFrame) -> DataFrame:
    """english, persian, points, in order of the English word. A word without a frequency counts as 0."""
    en = english_zipf.select(F.col("form").alias("english"), F.col("zipf").alias("ze"))
    fa = persian_zipf.select(F.col("form").alias("persian"), F.col("zipf").alias("zp"))
    both = pairs.join(en, "english", "left").join(fa, "persian", "left")
    points = T.prior_points(F.coalesce("ze", F.lit(0.0)), F.coalesce("zp", F.lit(0.0)))
    return both.select("english", "persian", points.alias("points")).orderBy("english")


def zipf_frequencies(counts: DataFrame) -> DataFrame:
    """form, zipf (log10 of occurrences in a billion) from form, n. The total is one row."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("form", (F.log10(F.col("n") * 1e9 / F.col("total"))).alias("zipf"))


def _bits(words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """`words` (form) with each of their positions (bit). A word is hashed once: the pair is a column before positions are made of it."""
    hashed = words.withColumn("__pair", F.explode(F.array(T.hash_pair(F.col("form")))))
    return hashed.withColumn("bit", F.explode(T.bit_positions(F.col("__pair"), bits, hashes))).drop("__pair")


def bloom_bits(words: DataFrame, bits: int, hashes: int, keys: list[str] | None = None) -> DataFrame:
    """The distinct set positions (bit) of a Bloom filter of the words (form), or of one for each value of `keys`."""
    return _bits(words, bits, hashes).select(*(keys or []), "bit").distinct()


def bloom_contains(words: DataFrame, positions: DataFrame, bits: int, hashes: int) -> DataFrame:
    """`words` (form) with `contained`: whether all of a word's bits are set. Empty words are not."""
    own = _bits(words.select("form").distinct(), bits, hashes).withColumnRenamed("bit", "__bit").distinct()
    found = own.join(small(positions.select(F.col("bit").alias("__bit"), F.lit(1).alias("__set"))), "__bit", "left")
    flags = found.groupBy("form").agg((F.count(F.lit(1)) == F.count("__set")).alias("contained"))
    return words.join(flags, "form").withColumn("contained", F.col("contained") & (F.length("form") > 0))


def report(lexicon: DataFrame) -> DataFrame:
    """Counts of every tier by language."""
    return lexicon.groupBy("lang").agg(*[F.count_if(F.col(name)).alias(name.replace("is_", "n_")) for name in TIERS])


