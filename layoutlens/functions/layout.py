"""The two readings of a physical key, and conversions between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OTHER, ENGLISH, PERSIAN = 0, 1, 2

# Scan code, English, English with shift, Persian, Persian with shift.
KEYS = [
    (0x1E, "a", "A", "ش", "ش"),
    (0x30, "b", "B", "ذ", "ذ"),
    (0x2E, "c", "C", "ز", "ژ"),
    (0x20, "d", "D", "ی", "ی"),
    (0x12, "e", "E", "ث", "ث"),
    (0x21, "f", "F", "ب", "ب"),
    (0x22, "g", "G", "ل", "ل"),
    (0x23, "h", "H", "ا", "آ"),
    (0x17, "i", "I", "ه", "ه"),
    (0x24, "j", "J", "ت", "ت"),
    (0x25, "k", "K", "ن", "ن"),
    (0x26, "l", "L", "م", "م"),
    (0x32, "m", "M", "پ", "پ"),
    (0x31, "n", "N", "د", "د"),
    (0x18, "o", "O", "خ", "خ"),
    (0x19, "p", "P", "ح", "ح"),
    (0x10, "q", "Q", "ض", "ض"),
    (0x13, "r", "R", "ق", "ق"),
    (0x1F, "s", "S", "س", "س"),
    (0x14, "t", "T", "ف", "ف"),
    (0x16, "u", "U", "ع", "ع"),
    (0x2F, "v", "V", "ر", "ر"),
    (0x11, "w", "W", "ص", "ص"),
    (0x2D, "x", "X", "ط", "ط"),
    (0x15, "y", "Y", "غ", "غ"),
    (0x2C, "z", "Z", "ظ", "ظ"),
    (0x1A, "[", "{", "ج", "ج"),
    (0x1B, "]", "}", "چ", "چ"),
    (0x27, ";", ":", "ک", "ک"),
    (0x28, "'", '"', "گ", "گ"),
    (0x33, ",", "<", "و", "و"),
]
# Scan code ranges of keys that may be part of a word (the last has no reading of its own).
WORD_RANGES = [(0x10, 0x1B), (0x1E, 0x28), (0x2C, 0x33), (0x2B, 0x2B)]
PERSIAN_PRIMARY, ENGLISH_PRIMARY = 0x29, 0x09

TYPED_ENGLISH = "".join(k[1] for k in KEYS) + "".join(k[2] for k in KEYS)
TYPED_PERSIAN = "".join(k[3] for k in KEYS) + "".join(k[4] for k in KEYS)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def is_word_key(scan: Column) -> Column:
    """Whether a scan code belongs to the keys that words are made of."""
    found = F.lit(False)
    for low, high in WORD_RANGES:
        found = found | scan.between(low, high)
    return found


def key_readings(shift: bool, caps: bool) -> dict[int, tuple[str, str]]:
    """scan -> (English, Persian): caps inverts shift for letters only, and only shift matters in Persian."""
    out = {}
    for scan, plain, shifted, persian, persian_shifted in KEYS:
        raised = shift != caps if plain.isalpha() else shift
        out[scan] = (shifted if raised else plain, persian_shifted if shift else persian)
    return out


def key_table(spark: SparkSession) -> DataFrame:
    """scan, shift, caps, english, persian: every reading (124 rows)."""
    rows = [(s, sh, ca, *r) for sh in (False, True) for ca in (False, True) for s, r in key_readings(sh, ca).items()]
    return spark.createDataFrame(rows, "scan int, shift boolean, caps boolean, english string, persian string")


def read_keys(events: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """`events` (scan, shift, caps, and with `variants` also variant) with english and persian; null: no token.

    A layout variant's own reading goes first if it is one printable character; each side falls back to
    the common map alone, and a token needs both sides. The common map is joined by broadcast (124 rows); a table
    of variants holds at most one row for each variant, key and shift state and is left to the optimiser.
    """
    base = key_table(events.sparkSession).withColumnsRenamed({"english": "__en", "persian": "__fa"})
    found = events.join(F.broadcast(base), ["scan", "shift", "caps"], "left")
    english, persian = F.col("__en"), F.col("__fa")
    if variants is not None:
        own = variants.withColumnsRenamed({"english": "__ven", "persian": "__vfa"})
        found = found.join(own, ["variant", "scan", "shift", "caps"], "left")
        printable = lambda c: F.when((F.length(c) == 1) & (F.ascii(c) >= 0x20), F.col(c))
        english, persian = F.coalesce(printable("__ven"), english), F.coalesce(printable("__vfa"), persian)
    valid = is_word_key(F.col("scan")) & english.isNotNull() & persian.isNotNull()
    return found.withColumns({"english": F.when(valid, english), "persian": F.when(valid, persian)}).drop("__en", "__fa", "__ven", "__vfa")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, _UPPER, _LOWER)


def typed_persian(english: Column) -> Column:
    """What the same keys give in the Persian layout."""
    return F.translate(english, TYPED_ENGLISH, TYPED_PERSIAN)


def typed_english(persian: Column) -> Column:
    """The unshifted English reading of Persian keys (shifted ones where only they give the letter)."""
    lowered = {k[3]: k[1] for k in KEYS} | {k[4]: k[2] for k in KEYS if k[4] != k[3]}
    return F.translate(persian, "".join(lowered), "".join(lowered.values()))


def physical_persian(word: Column) -> Column:
    """The Persian reading of a word of a-z and apostrophes; null for any other word."""
    return F.when(word.rlike("^[a-z']+$"), typed_persian(word))


def language_of_layout(layout: Column) -> Column:
    primary = layout.bitwiseAND(0x3FF)
    return F.when(primary == ENGLISH_PRIMARY, ENGLISH).when(primary == PERSIAN_PRIMARY, PERSIAN).otherwise(OTHER)


def language_name(language: Column) -> Column:
    return F.when(language == ENGLISH, "English").when(language == PERSIAN, "Persian").otherwise("Unsupported")


def in_language(language: Column, english: Column, persian: Column) -> Column:
    return F.when(language == PERSIAN, persian).otherwise(english)
