"""Word classification: which readings of a key sequence are words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layoutlens.functions.layout import ENGLISH, PERSIAN, ascii_lower
from layoutlens.functions.text import english_shape
from layoutlens.operators.lexicon import small

FLAGS = ("en_known", "fa_known", "en_frequent", "fa_frequent", "en_prefix", "fa_prefix", "en_common_prefix", "fa_common_prefix")
ALEF, MADDA = "ا", "آ"


def _side(lexicon: DataFrame, lang: int, tag: str) -> DataFrame:
    """Flags of one language's forms: known among long and among short words, frequent, prefixes."""
    own = lexicon.filter(F.col("lang") == lang)
    return own.select(
        F.col("form").alias(f"__{tag}_form"),
        (F.col("is_word") | F.col("is_common")).alias(f"__{tag}_long"),
        F.col("is_short").alias(f"__{tag}_short"),
        F.col("is_frequent").alias(f"__{tag}_frequent"),
        F.col("is_prefix").alias(f"__{tag}_prefix"),
        F.col("is_common_prefix").alias(f"__{tag}_common_prefix"),
    )


def classify(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """`words` (en, fa: the two readings, of equal length) with FLAGS.

    Up to two keys only the short lists count, from three the dictionary or the common words. English
    is looked up in lower case and must have the shape of a word. A Persian reading that is unknown and
    begins with alef is looked up with alef madda too, but only for being known: frequent and prefix
    flags are those of the literal reading. Frequent needs known.
    """
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    n = F.length("en")
    english, persian = _side(lexicon, ENGLISH, "e"), _side(lexicon, PERSIAN, "p")
    madda = persian.select(*[F.col(c).alias(c.replace("__p_", "__m_")) for c in ("__p_form", "__p_long", "__p_short")])
    lower = ascii_lower(F.col("en"))
    aliased = F.when(F.left("fa", F.lit(1)) == ALEF, F.concat(F.lit(MADDA), F.substring("fa", 2, 1_000_000)))
    found = (
        words.withColumns({"__lower": lower, "__alias": aliased})
        .join(small(english), F.col("__lower") == F.col("__e_form"), "left")
        .join(small(persian), F.col("fa") == F.col("__p_form"), "left")
        .join(small(madda), F.col("__alias") == F.col("__m_form"), "left")
    )
    by_length = lambda tag: F.when(n <= 2, flag(f"__{tag}_short")).otherwise(flag(f"__{tag}_long"))
    en_known = english_shape(F.col("__lower")) & by_length("e")
    fa_known = by_length("p") | by_length("m")
    flags = {
        "en_known": en_known, "fa_known": fa_known, "en_frequent": en_known & flag("__e_frequent"), "fa_frequent": fa_known & flag("__p_frequent"),
        "en_prefix": flag("__e_prefix"), "fa_prefix": flag("__p_prefix"), "en_common_prefix": flag("__e_common_prefix"), "fa_common_prefix": flag("__p_common_prefix"),
    }
    return found.select(*words.columns, *[value.alias(name) for name, value in flags.items()])


def with_priors(words: DataFrame, priors: DataFrame) -> DataFrame:
    """`words` with `prior`: the points of the lower-cased English reading, 0 without an entry."""
    own = priors.select(F.col("english").alias("__key"), F.col("points").alias("__points"))
    found = words.join(small(own), ascii_lower(F.col("en")) == F.col("__key"), "left")
    return found.select(*words.columns, F.coalesce("__points", F.lit(0)).alias("prior"))
