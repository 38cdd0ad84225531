"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(c: Column) -> Column:
    """Lower case, other characters to ``_``, runs of ``_`` joined, none at the ends."""
    c = F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_")
    return F.regexp_replace(F.regexp_replace(c, "_{2,}", "_"), "^_+|_+$", "")


def number_text(c: Column) -> Column:
    """A number's plain decimal text without trailing zeros: ``2.0`` -> ``2``, ``1.0E-7`` -> ``0.0000001``."""
    d = c.cast("string").cast("decimal(38,18)")
    # Without ANSI mode a decimal below 1e-6 is printed with an exponent; its 18 digits are then written out.
    digits = F.lpad((F.abs(d) * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)").cast("string"), 18, "0")
    small = F.concat(F.when(d < 0, "-").otherwise(""), F.lit("0."), digits)
    text = F.when(d.cast("string").contains("E"), small).otherwise(d.cast("string"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def parse_target_name(name: Column) -> Column:
    """``target_high_up_0.09p`` -> struct of price type, direction and threshold; null for any other shape."""
    shape = "^target_(high|low)_(up|down)_([^_]*)p$"
    threshold = F.regexp_extract(name, shape, 3).try_cast("double")
    return F.when(
        threshold.isNotNull(),
        F.struct(
            F.regexp_extract(name, shape, 1).alias("price_type"),
            F.regexp_extract(name, shape, 2).alias("direction"),
            threshold.alias("threshold"),
        ),
    )


def stored_pair(base: Column, quote: Column) -> Column:
    """The symbol form of every stored table: ``base_quote`` in lower case."""
    return F.concat_ws("_", F.lower(base), F.lower(quote))
