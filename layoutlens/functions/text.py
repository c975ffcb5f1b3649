"""Word shapes and normal forms, hashes, and the small numeric rules."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_KEYS = 32
MOST_WORDS = 32
MOST_CHARS = 512
PREVIEW = 96
_MASK = 0xFFFFFFFF
GOLDEN = 0x9E3779B9


def english_shape(word: Column) -> Column:
    """Lower-case letters with at most one apostrophe, which is inside."""
    return word.rlike("^[a-z]+('[a-z]+)?$")


def alphabetic(word: Column) -> Column:
    return word.rlike(r"^\p{L}+$")


def _composed(words: Column) -> Column:
    # Spark has no normal forms of its own. Made here, since a pandas function needs a running session.
    def compose(found: pd.Series) -> pd.Series:
        return found.map(lambda w: None if w is None else unicodedata.normalize("NFC", w))

    return F.pandas_udf(compose, "string")(words)


def normalise_persian(word: Column) -> Column:
    """Arabic yeh and kaf as Persian, no joiners, composed, no marks. Only words beyond ASCII and Persian letters reach Python."""
    one = F.translate(word, "يىك‌", "ییک")
    plain = one.rlike(r"^[\x00-\x7fء-غف-يپچژکگی]*$")
    return F.regexp_replace(F.when(plain, one).otherwise(_composed(one)), r"\p{Mn}", "")


def without_affix(line: Column) -> Column:
    return F.substring_index(line, "/", 1)


def preview(text: Column, most: int = PREVIEW) -> Column:
    return F.left(text, F.lit(most))


def phrase(words: Column, most: int = MOST_CHARS) -> Column:
    """Words joined by spaces, or null if that exceeds the capacity."""
    joined = F.array_join(words, " ")
    return F.when(F.length(joined) <= most, joined)


def hash_pair(word: Column) -> Column:
    """struct<h1, h2>: 32-bit FNV-1a, and h * 33 xor byte from 5381, both over UTF-8 bytes in 64-bit arithmetic."""
    digits = F.hex(F.encode(word, "UTF-8"))
    byte = lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(2166136261).cast("bigint").alias("h1"), F.lit(5381).cast("bigint").alias("h2"))
    return F.aggregate(
        F.transform(places, byte),
        start,
        lambda s, b: F.struct(
            ((s["h1"].bitwiseXOR(b)) * 16777619).bitwiseAND(_MASK).alias("h1"),
            (s["h2"] * 33).bitwiseAND(_MASK).bitwiseXOR(b).alias("h2"),
        ),
    )


def bit_positions(pair: Column, bits: int, hashes: int) -> Column:
    """The positions of a word with these hashes in a filter of `bits` (a power of two) bits."""
    step = (F.shiftleft(pair["h2"], 1).bitwiseOR(F.lit(1).cast("bigint"))).bitwiseAND(_MASK)
    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(hashes - 1).cast("bigint")),
        lambda i: (pair["h1"] + i * step + (i * i * GOLDEN).bitwiseAND(_MASK)).bitwiseAND(bits - 1),
    )


def prior_points(english_zipf: Column, persian_zipf: Column) -> Column:
    """24 points for each order of magnitude by which Persian is more frequent, half to even, within 75; 0 without evidence."""
    points = F.bround(24.0 * (persian_zipf - english_zipf), 0).cast("int")
    return F.when((english_zipf <= 0) | (persian_zipf <= 0), 0).otherwise(F.greatest(F.least(points, F.lit(75)), F.lit(-75)))


def least_length(sensitivity: Column) -> Column:
    return F.when(sensitivity <= 0, 4).otherwise(2)


def ambiguity_threshold(sensitivity: Column) -> Column:
    return F.when(sensitivity <= 0, 45).when(sensitivity >= 2, 25).otherwise(35)


def sequence_threshold(sensitivity: Column) -> Column:
    return F.when(sensitivity <= 0, 55).when(sensitivity >= 2, 30).otherwise(40)


def next_cadence(average: Column, observed: Column) -> Column:
    """The running key interval in ms after one more; implausible intervals leave it as it is."""
    usable = F.when(average.between(40, 500), average).otherwise(150).cast("bigint")
    return F.when(observed.between(20, 1500), F.floor((usable * 3 + observed) / 4)).otherwise(usable)


def idle_delay(sensitivity: Column, average: Column) -> Column:
    """How long a pause must be, in ms."""
    pace = F.greatest(F.least(average, F.lit(500)), F.lit(40))
    within = lambda x, low, high: F.greatest(F.least(x, F.lit(high)), F.lit(low))
    return F.when(sensitivity == 2, within(pace * 2, 280, 650)).when(sensitivity == 0, within(pace * 4, 650, 1200)).otherwise(within(pace * 3, 450, 900))


def epoch_ms(rows: DataFrame, name: str) -> Column:
    """Milliseconds since 1970 of a column of `rows`. A time without a zone is taken as it stands: the session's zone, whose hours may jump, is not asked.

    Files may keep times in nanoseconds, which Spark reads as numbers (spark.sql.legacy.parquet.nanosAsLong).
    """
    at, kind = F.col(name), dict(rows.dtypes)[name]
    if kind == "bigint":
        return F.floor(at / F.lit(1_000_000).cast("decimal(7,0)")).cast("bigint")
    if kind != "timestamp_ntz":
        return F.unix_millis(at.cast("timestamp"))
    seconds = F.unix_date(at.cast("date")) * F.lit(86_400).cast("bigint") + F.hour(at) * 3_600 + F.minute(at) * 60
    return (seconds * 1_000 + F.floor(F.extract(F.lit("SECOND"), at) * 1_000)).cast("bigint")
