"""Names that are alike by their trigrams (inventory F9, B1): an exact set-similarity join.

A name's set are the trigrams of its lower-case words, each padded by two spaces before and one after it.  Two names
are similar by the share of trigrams that they have in common.  Trigrams are ordered from rare to common over
all names; names that are similar enough share one among the first of each, so rows meet on rare trigrams only, and
sizes and places in the order rule most of these out.  A pair is verified on the first trigram that both have,
so it is found once and nothing is made distinct.  Names that fill a third of the table are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def trigrams(name: Column | str) -> Column:
    """Distinct trigrams of a name; none for a name without letters and digits, NULL for NULL."""
    words = F.regexp_extract_all(F.lower(name), F.lit(WORD), F.lit(0))

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(padded, i, 3))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def _ordered(names: DataFrame, frequency: DataFrame) -> DataFrame:
    """``name, grams`` (rare first) and their number ``n``."""
    return (names.select("name", F.explode("grams").alias("gram")).join(frequency, "gram").groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct("freq", "gram"))).alias("g"))
        .select("name", F.col("g.gram").alias("grams"), F.size("g").alias("n")))


def _first(names: DataFrame, percent: int, side: str) -> DataFrame:
    """Names at each trigram among which a similar name must have one."""
    most = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100)).cast("int") + 1
    return names.select(F.col("name").alias(side), F.col("grams").alias(f"grams_{side}"), F.col("n").alias(f"n_{side}"),
                        F.posexplode(F.slice("grams", F.lit(1), most)).alias(f"at_{side}", "gram"))


def similar_names(needles: DataFrame, hay: DataFrame, percent: int = 50) -> DataFrame:
    """Pairs of a needle and a name whose trigram similarity is ``percent`` or more.

    ``needles``: ``needle``; ``hay``: ``hay``; repeated and null names count once and not at all.  Result: ``needle,
    hay, shared, similarity``.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    a = needles.select(F.col("needle").alias("name")).distinct().select("name", trigrams("name").alias("grams"))
    b = hay.select(F.col("hay").alias("name")).distinct().select("name", trigrams("name").alias("grams"))
    frequency = a.unionByName(b).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("freq"))
    a, b = _ordered(a, frequency), _ordered(b, frequency)
    met = _first(a, percent, "needle").join(_first(b, percent, "hay"), "gram")
    n, m = F.col("n_needle"), F.col("n_hay")
    left = F.lit(1) + F.least(n - 1 - F.col("at_needle"), m - 1 - F.col("at_hay"))
    met = met.where((100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * left >= percent * (n + m)))
    both = F.array_intersect("grams_needle", "grams_hay")
    met = met.select("needle", "hay", "gram", both.alias("both"), (n + m).alias("total")).where(
        F.get("both", F.lit(0)) == F.col("gram"))
    shared = F.size("both")
    return met.where(100 * shared >= percent * (F.col("total") - shared)).select(
        "needle", "hay", shared.cast("long").alias("shared"), (shared / (F.col("total") - shared)).alias("similarity"))
