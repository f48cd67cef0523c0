"""Numbers that a text states, and the forms in which a fact may be restated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill.functions.numbers import round_binary

#: A number with commas or without, a sign, decimals, and a suffix (fixed values).
CLAIM = r"(?i)(?<![\w.])(-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)\s*((?:%|[kmb]|\b(?:million|billion|thousand)\b))?"
SCALES = {"K": 1e3, "M": 1e6, "B": 1e9, "THOUSAND": 1e3, "MILLION": 1e6, "BILLION": 1e9}


def claims(text: Column) -> Column:
    """array<struct<value double, suffix string>>: the suffix in upper case, a percent sign left out."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(CLAIM), 1).alias("n"), F.regexp_extract_all(text, F.lit(CLAIM), 2).alias("s"))

    def claim(x: Column) -> Column:
        suffix = F.replace(F.upper(F.coalesce(x["s"], F.lit(""))), F.lit("%"), F.lit(""))
        scale = F.lit(1.0)
        for name, times in SCALES.items():
            scale = F.when(suffix == name, F.lit(times)).otherwise(scale)
        return F.struct((F.replace(x["n"], F.lit(","), F.lit("")).cast("double") * scale).alias("value"), suffix.alias("suffix"))

    return F.transform(both, claim)


def fact_variants(fact: Column) -> Column:
    """array<double>: the fact, rounded to 0 to 4 places, a whole number in thousands, millions and
    billions, and a share as a percentage. NaN has none."""
    scaled = F.when(fact == F.floor(fact), F.array(*(fact / s for s in (1e3, 1e6, 1e9)))).otherwise(F.array().cast("array<double>"))
    percent = F.when((F.abs(fact) > 0) & (F.abs(fact) < 1), round_binary(fact * 100, 4, 2, 0)).otherwise(F.array().cast("array<double>"))
    every = F.array_distinct(F.concat(F.array(fact), round_binary(fact, 0, 1, 2, 3, 4), scaled, percent))
    return F.when(F.isnan(fact) | fact.isNull(), F.array().cast("array<double>")).otherwise(every)
