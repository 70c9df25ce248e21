"""Lists and maps written as text, as settings of experiments are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def items(text: Column) -> Column:
    """A comma list as an array: trimmed, without empty items."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def numbers(text: Column) -> Column:
    """A comma list of numbers; ``inf`` and ``infinity`` in any case are infinite, anything else that is no number raises."""

    def one(x: Column) -> Column:
        known = F.when(F.lower(x).isin("inf", "infinity"), F.lit(float("inf"))).otherwise(x.try_cast("double"))
        return F.when(known.isNull(), F.raise_error(F.concat(F.lit("no number: "), x)).cast("double")).otherwise(known)

    return F.transform(items(text), one)


def size_map(text: Column) -> Column:
    """``N:reps`` items as a map of positive whole numbers; anything else raises.  The empty text is an empty map."""

    def pair(x: Column) -> Column:
        n, reps = (F.trim(F.get(F.split(x, ":"), F.lit(i))).try_cast("long") for i in (0, 1))
        ok = (F.size(F.split(x, ":")) == 2) & (F.coalesce(n, F.lit(0)) > 0) & (F.coalesce(reps, F.lit(0)) > 0)
        bad = F.raise_error(F.concat(F.lit("no N:reps of positive numbers: "), x)).cast("long")
        return F.struct(F.when(ok, n).otherwise(bad).alias("key"), F.when(ok, reps).otherwise(bad).alias("value"))

    # Of items that repeat a size the last one holds, as in a list that is read through.
    pairs = F.transform(items(text), pair)
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)
