"""What each filter of a chain removes, in every order of the chain, from joint-failure counts.

Documents are read once.  For every subset S of the filters the number J(S) of
documents that fail all of S is a sum of products of flags, 32 sums for five
filters, taken for each part of the corpus.  All else is inclusion and
exclusion over these counts: survivors of a chain, what a step removes, what
only one filter catches, and, because the signed J(S) are the Harsanyi
dividends of "documents removed", each filter's Shapley value.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_digest

#: The contract's limits of the five filters.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, MARKUP = 50, 65, 5, "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
#: Filters that an audit takes at most: 2 ** n sums, n! orders.
MOST_FILTERS = 6


def text_flags(text: Column) -> dict[str, Column]:
    """Failures that a text alone decides: too few words (A), repetitive (B), capitals (C), markup characters (D).  ``text`` must not be null."""
    words = F.array_remove(F.split(text, SPACES), "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    n_capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n_words < LEAST_WORDS,
        "B": n_distinct.cast("long") * 100 < n_words.cast("long") * LEAST_DISTINCT_PERCENT,
        "C": n_capitals.cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITALS_PERCENT,
        "D": text.rlike(MARKUP),
    }


def flagged(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, A..E, good, toxic, n``: equal documents of a part as one row with their number.

    Texts are read once and leave the scan as a digest and four flags.  E is
    identical text under a smaller id: of a digest's rows those with its least
    id hold it, found by a join on digest *and* id, so that a text with a third
    of all rows is spread by id.  Rows without an id are nobody's copy and
    nobody's original; rows that share text and id are not each other's copies.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    facts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_digest(F.col(text_col)).alias("digest"), *[f.alias(k) for k, f in text_flags(text).items()])
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id is not null and (good or toxic)")
    marks = marks.groupBy("id").agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
    facts = scratch.write(facts.groupBy(*facts.columns).agg(F.count("*").alias("n")), "facts")
    first = facts.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").withColumn("holds", F.lit(True))
    known = facts.join(first, ["digest", "id"], "left").join(marks, "id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return known.select("part", "A", "B", "C", "D", (F.col("id").isNotNull() & ~no("holds")).alias("E"), no("good").alias("good"), no("toxic").alias("toxic"), "n")


def joint_failures(rows: DataFrame, filters: list[str], part: str, weights: dict[str, str]) -> DataFrame:
    """``part`` and, for each weight, an array of 2 ** n sums: of the rows that fail every filter in the bits of the place.

    ``filters`` name boolean columns without nulls, by one letter each, and
    ``weights`` are SQL. The sums are products of
    flags, combined before they are shuffled; nothing but one row a part moves.
    """
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters")
    places = range(1 << len(filters))
    product = lambda s: " * ".join(["1L", *[f"cast({name} as long)" for i, name in enumerate(filters) if s >> i & 1]])
    sums = [F.expr(f"sum({weight} * {product(s)}) as {name}_{s}") for name, weight in weights.items() for s in places]
    of = rows.groupBy(part).agg(*sums)
    return of.select(part, *[F.array(*[f"{name}_{s}" for s in places]).alias(name) for name in weights])


def _survivors(joint: str, n: int) -> Column:
    """At each place P the rows that fail nothing in P: the signed sum of J over the subsets of P."""
    every = f"sequence(0, {(1 << n) - 1})"
    return F.expr(f"transform({every}, p -> aggregate({every}, 0L, (a, s) -> a + if((s & ~p) = 0, if(bit_count(s) % 2 = 0, {joint}[s], -{joint}[s]), 0L)))")


def _dividends(joint: str, n: int, scale: str) -> Column:
    """For each filter the sum, over the sets S that hold it, of its share ``scale`` of the dividend: J(S), negative for an even S."""
    return F.expr(f"transform(sequence(0, {n - 1}), f -> aggregate(sequence(1, {(1 << n) - 1}), 0L, (a, s) -> a + if((shiftright(s, f) & 1) = 1, if(bit_count(s) % 2 = 1, {joint}[s], -{joint}[s]) * {scale}, 0L)))")


def interactions(joint: DataFrame, filters: list[str], part: str, lost: dict[str, str], scratch: Scratch) -> DataFrame:
    """Every step of every order of the filters, from the counts ``n`` of :func:`joint_failures`.

    Returns ``part, filter_order, step, kept, removed, redundant, unique_fails,
    <lost...>, shapley``; ``lost`` maps a result column to the weight whose
    removed rows it counts.  ``shapley`` is the value times n!, a whole number.
    A part is one row until its n! orders of n steps are spelled out.
    """
    n = len(filters)
    tables = joint.select(
        F.col(part).alias("part"), *[_survivors(c, n).alias(f"kept_{c}") for c in ("n", *lost.values())],
        F.expr(f"transform(sequence(0, {n - 1}), f -> n[shiftleft(1, f)])").alias("failing"),
        _dividends("n", n, "1L").alias("single"), _dividends("n", n, f"({math.factorial(n)}L div bit_count(s))").alias("worth"),
    )
    tables = scratch.write(tables, "tables", keep=True)
    orders = F.split(F.lit(",".join("".join(map(str, p)) for p in permutations(range(n)))), ",")
    rows = tables.withColumn("o", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    rows = rows.withColumn("f", F.expr("int(substr(o, step, 1))")).withColumn("p", F.expr("aggregate(sequence(1, step), 0, (a, i) -> a + if(i < step, shiftleft(1, int(substr(o, i, 1))), 0))"))
    gone = lambda c: f"kept_{c}[p] - kept_{c}[p + shiftleft(1, f)]"
    return rows.select(
        F.col("part").alias(part), F.translate("o", "".join(map(str, range(n))), "".join(filters)).alias("filter_order"), "step",
        F.expr("kept_n[p + shiftleft(1, f)]").alias("kept"), F.expr(gone("n")).alias("removed"),
        F.expr(f"failing[f] - ({gone('n')})").alias("redundant"), F.expr("single[f]").alias("unique_fails"),
        *[F.expr(gone(c)).alias(k) for k, c in lost.items()], F.expr("worth[f]").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The five text filters in all 120 orders, for each part of the corpus.

    Null texts are empty, null parts the empty string, other columns are not
    read.  Labels may repeat or lack an id; any label counts.  An empty table
    has no parts and so an empty result.
    """
    with Scratch(docs.sparkSession, "filters") as scratch:
        rows = flagged(docs, labels, scratch, id_col, text_col, part_col)
        joint = joint_failures(rows, ["A", "B", "C", "D", "E"], "part", {"n": "n", "good": "n * cast(good as long)", "toxic": "n * cast(toxic as long)"})
        return interactions(joint, ["A", "B", "C", "D", "E"], "part", {"good_lost": "good", "toxic_lost": "toxic"}, scratch)
