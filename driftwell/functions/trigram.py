"""Trigram similarity of short names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwell.functions.text import SPLIT
from driftwell.functions.vectors import let


def trigrams(name: Column) -> Column:
    """Distinct trigrams of the lower-case words of a name, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(name), SPLIT), lambda w: F.length(w) > 0)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 where neither has any."""
    ratio = lambda x, y: F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)).cast("double"), F.lit(0.0)), F.lit(0.0))
    return let(trigrams(a), lambda x: let(trigrams(b), lambda y: ratio(x, y)))
