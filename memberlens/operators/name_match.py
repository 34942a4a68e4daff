"""Many contains-patterns against many names, as an equi-join instead of all pairs.

A pattern matches a name when the name contains it, ``%`` and ``_`` acting as wildcards. Every name
that contains a pattern also contains every piece of the pattern's literal runs. So each pattern is
keyed by one such piece, of the greatest length its longest run allows: the rarest one, by counts of the
names' pieces in a sketch of fixed size. Each name gives out those of its pieces that some pattern is keyed
by, and only pairs that share a key are tested. Patterns without any letter are keyed by the empty
piece, which every name holds.

A short pattern matches most names, of which a few are wanted. So matches are first counted by ranges of the
person's key, and only those of the ranges that hold the wanted ones are ranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.operators.lookup import top_per_key
from memberlens.session import stage

PIECES = (6, 3, 1)
#: cells of the sketch: 8 KB as one bit each
CELLS = 1 << 16
#: ranges of the person's key, each with about as many people
RANGES = 512


def _cut(text: Column, size: int) -> Column:
    """All pieces of ``size`` characters, none of a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    pieces = F.transform(starts, lambda at: F.substring(text, at, size))
    return F.when(F.length(text) >= size, pieces).otherwise(F.array().cast("array<string>"))


def pattern_pieces(pattern: Column) -> Column:
    """The pieces a pattern may be keyed by: of its longest literal run, as long as that allows."""
    runs = F.split(pattern, "[%_]")
    longest = F.aggregate(
        runs,
        F.lit(""),
        lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best),
    )
    pieces = F.array(F.lit(""))
    for size in reversed(PIECES):
        pieces = F.when(F.length(longest) >= size, _cut(longest, size)).otherwise(pieces)
    return F.array_distinct(pieces)


def _cell(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(CELLS))


def _asked(pieces: DataFrame) -> tuple[Column, list[int]]:
    """Which cells hold a piece, as an array of 64-bit words, and the lengths of the pieces; of fixed size."""
    at = _cell(F.col("piece"))
    words = dict(
        pieces.groupBy(F.floor(at / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(piece), {CELLS}) % 64 as int))")).alias("bits"))
        .collect()  # CELLS / 64 rows at most
    )
    sizes = [r[0] for r in pieces.select(F.length("piece")).distinct().collect()]
    return F.array(*(F.lit(words.get(k, 0)).cast("long") for k in range(CELLS // 64))), sizes


def _given(name: Column, asked: Column, sizes: list[int]) -> Column:
    """Pieces of ``name`` whose cell is asked for, each once."""
    cut = [F.array(F.lit("")) if size == 0 else _cut(name, size) for size in sizes]

    def wanted(piece: Column) -> Column:
        word = F.get(asked, F.floor(_cell(piece) / 64).cast("int"))
        return F.call_function("bit_get", word, (_cell(piece) % 64).cast("int")) == 1

    return F.array_distinct(reduce(lambda a, b: F.concat(a, b), [F.filter(c, wanted) for c in cut]))


def rarest_pieces(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(_query, _key): the piece of every pattern that the fewest names hold, as the sketch counts them."""
    choices = stage(patterns.select("_query", F.explode(pattern_pieces(F.col("_query"))).alias("piece")))
    given = names.select(F.explode(_given(F.col("_name"), *_asked(choices))).alias("piece"))
    counts = given.groupBy(_cell(F.col("piece")).alias("cell")).agg(F.count("*").alias("names"))
    held = choices.join(F.broadcast(counts), _cell(F.col("piece")) == F.col("cell"), "left")  # CELLS rows at most
    rarity = F.struct(F.coalesce("names", F.lit(0)), F.col("piece"))
    return stage(held.groupBy("_query").agg(F.min_by("piece", rarity).alias("_key")))


def _ranges(people: DataFrame, person_key: str) -> list:
    """The keys at which a new range starts, in ascending order: RANGES - 1 at most."""
    shares = [k / RANGES for k in range(1, RANGES)]
    starts = people.agg(F.percentile_approx(person_key, shares).alias("starts")).first()["starts"]
    return sorted(set(starts or []))


def _range_of(key: Column, starts: list, first: int = 0) -> Column:
    """The number of the range ``key`` lies in, by halving; a missing key comes before all."""
    if not starts:
        return F.lit(first)
    half = len(starts) // 2
    below, above = _range_of(key, starts[:half], first), _range_of(key, starts[half + 1 :], first + half + 1)
    return F.when(key.isNull() | (key < F.lit(starts[half])), below).otherwise(above)


def _last_ranges(matched: DataFrame, limit: int) -> DataFrame:
    """(_query, _last): the range in which the first ``limit`` matches of every query are complete."""
    counts = matched.groupBy("_query", "_range").agg(F.count("*").alias("matches"))
    lower = Window.partitionBy("_query").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("_before", F.coalesce(F.sum("matches").over(lower), F.lit(0))).where(F.col("_before") < limit)
    return needed.groupBy("_query").agg(F.max("_range").alias("_last"))


def match_names(
    queries: DataFrame, people: DataFrame, name: Column, person_key: str, limit: int
) -> DataFrame:
    """Up to ``limit`` people per row of ``queries(query_id, name_query)``, lowest key first.

    Case is ignored. A backslash in a query is an ordinary character. Equal texts are searched once,
    and their few matches handed to every query that asked for them. ``person_key`` names a column of numbers.
    """
    asked = queries.select("query_id", F.lower("name_query").alias("_query"))
    text = F.col("_query")
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    patterns = asked.select(text).where(text.isNotNull()).distinct().select(
        text,
        # only patterns with wildcards pay for LIKE, which compiles the pattern for every pair
        F.when(text.rlike("[%_]"), F.concat(F.lit("%"), escaped, F.lit("%"))).alias("_pattern"),
    )
    named = people.withColumn("_name", F.lower(name)).where(F.col("_name").isNotNull())
    keys = rarest_pieces(patterns.select("_query"), named.select("_name"))
    # staged, so that Spark knows how few they are and reads the names side by side
    patterns = stage(patterns.join(keys, "_query"))
    given = _given(F.col("_name"), *_asked(keys.select(F.col("_key").alias("piece"))))
    ranged = named.withColumn("_range", _range_of(F.col(person_key), _ranges(people, person_key)))
    # staged, as they are gone through twice and names are cut at some cost
    cut = stage(ranged.withColumn("_given", given))
    keyed = cut.withColumn("_key", F.explode("_given")).drop("_given")
    matches = F.when(F.col("_pattern").isNull(), F.contains("_name", "_query")).otherwise(
        F.like("_name", F.col("_pattern"))
    )
    last = _last_ranges(keyed.join(patterns, "_key").where(matches), limit)
    ending = stage(patterns.join(last, "_query"))
    near = keyed.join(ending, "_key").where(F.col("_range") <= F.col("_last")).where(matches)
    matched = near.drop("_key", "_name", "_pattern", "_range", "_last")
    first = top_per_key(matched, "_query", [F.asc(person_key)], limit).drop("_rank")
    return asked.join(first, "_query").drop("_query")
