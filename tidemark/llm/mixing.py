"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and ``CAP`` copies.  Among all rates whose
expected words meet every source's target, the ones of least relative entropy
to rate one (half the cap) are an exponential tilt with the document's size,

    rate = CAP / (1 + exp(-tilt_source * size / scale_source)),

and the tilts minimise a convex dual whose gradient is the miss of the token
constraints.  Newton's method needs two sums for each source in an iteration;
they are taken by the cluster over a histogram of (source, size).  Rates are
then rounded to whole copies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Scratch, fresh

#: Copies of one document at most.
CAP = 2
#: Weights of the sources by code point, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all words that the mix takes.
SHARE = 1.5
#: Documents that are rounded together, as expected; a source of more is dealt into several such cells by hash.
CELL = 2048
#: Times that one task repeats a row at most.
SPREAD = 10_000
#: The largest miss of a target, as a share of it, at which Newton's method ends.
TOLERANCE = 1e-6


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space, as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def _per_source(sized: DataFrame, weights: Sequence[float], cap: float, scratch: Scratch) -> DataFrame:
    """``source, words, n, scale, limit, weight``, a row for each source, numbered by code point (null last).

    Sources are ranked by a range partitioning, part by part, so their number
    is not bounded by a task or by the driver, which sees one count a part.
    """
    of = sized.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size").cast("double") * F.col("size")).alias("squares"))
    order = [F.col("source").isNull(), F.col("source")]
    parts = scratch.write(scratch.write(of, "totals").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "parts")
    before, at = [], 0
    for r in parts.groupBy("part").agg(F.count("*").alias("k")).orderBy("part").collect():
        before += [F.lit(r["part"]), F.lit(at)]
        at += r["k"]
    offset = F.create_map(*before)[F.col("part")] if before else F.lit(0)
    number = offset + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    # a size-weighted mean size is the scale: tilts then are of order one
    scale = F.when(F.col("words") > 0, F.col("squares") / F.col("words")).otherwise(1.0)
    out = parts.withColumn("number", number).select("source", "words", "n", scale.alias("scale"), (F.col("words") * float(cap)).alias("limit"), weight.alias("weight"))
    return scratch.write(out, "sources")


def _with_targets(sources: DataFrame, share: float) -> DataFrame:
    """``sources`` with ``target``: ``share`` of all words by weight, none above its limit.

    What a limit cuts off is shared among the sources below theirs by weight
    until none is above: a source gets ``level * weight``, and the level rises
    while limits are met.  If all are met the rest is not taken.
    """
    level, met = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") >= F.col("limit")
        r = sources.agg(F.sum("words").alias("words"), F.count_if(full).alias("met"), F.sum(F.when(full, F.col("limit")).otherwise(0.0)).alias("given"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if r["met"] == met or not r["open"]:
            break
        met, level = r["met"], (share * r["words"] - r["given"]) / r["open"]
    return sources.withColumn("target", F.when(full, F.col("limit")).otherwise(F.lit(level) * F.col("weight")))


def _solve(sources: DataFrame, histogram: DataFrame, cap: float, scratch: Scratch) -> DataFrame:
    """``sources`` with the ``tilt`` of each for which its expected words meet the target; null at a bound.

    ``histogram(source, size, n)``.  Newton steps on all duals at once, one
    aggregation an iteration, each kept inside a bracket of its root so that it
    converges from anywhere.  The state is a table: the driver sees how many
    sources are open.
    """
    inner = (F.col("target") > 0) & (F.col("target") < F.col("limit"))
    state = sources.select("*", F.when(inner, 0.0).alias("tilt"), F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), inner.alias("open"))
    state, open_ = scratch.counted(state, "state", F.col("open"))
    while open_:
        now = state.where("open").select("source", "tilt", "scale")
        z = F.col("size") / F.col("scale")
        rate = F.lit(float(cap)) / (1.0 + F.exp(-F.col("tilt") * z))
        words = F.col("n") * F.col("size") * rate
        curve = words * z * (1.0 - rate / float(cap))
        sums = histogram.join(now, histogram["source"].eqNullSafe(now["source"])).groupBy(now["source"].alias("of")).agg(F.sum(words).alias("taken"), F.sum(curve).alias("curve"))
        row = state.join(sums, state["source"].eqNullSafe(sums["of"]), "left")
        miss = F.col("taken") - F.col("target")
        low, high = F.when(miss > 0, F.col("low")).otherwise(F.col("tilt")), F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(miss, F.col("curve"))
        wide = F.col("tilt") - F.signum(miss) * 4.0
        bisect = F.when((low == -math.inf) | (high == math.inf), wide).otherwise((low + high) / 2)
        step = F.when((newton > low) & (newton < high) & (F.abs(newton - F.col("tilt")) <= 8.0), newton).otherwise(bisect)
        near = F.abs(miss) <= TOLERANCE * F.col("target")
        stuck = (step == F.col("tilt")) | (high - low < 1e-12)
        is_open = F.col("open") & ~near & ~stuck
        tilt = F.when(F.col("open") & ~near, step).otherwise(F.col("tilt"))
        row = row.select(*sources.columns, tilt.alias("tilt"), F.when(F.col("open"), low).alias("low"), F.when(F.col("open"), high).alias("high"), is_open.alias("open"))
        state, open_ = scratch.counted(row, "state", F.col("open"))
    # sums of floats differ in the last bits from run to run; rates must not
    return state.select(*sources.columns, F.round("tilt", 9).alias("tilt"))


def round_copies(sizes: np.ndarray, rates: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole copies of each group of ``counts`` equal documents, whose words stay near the expected words.

    A document's copies are its rate rounded down or up.  Largest documents
    first; each group is rounded so that the words missed so far come closest
    to none, so the smallest documents settle the balance.
    """
    base = np.floor(rates)
    missing, out = 0.0, (base * counts).astype(np.int64)
    for i, (size, part, n) in enumerate(zip(sizes.tolist(), (rates - base).tolist(), counts.tolist())):
        if part > 0:
            missing += part * size * n
            up = min(n, max(0, math.ceil(missing / size - 0.5)))
            out[i] += up
            missing -= up * size
    return out


def _text_key(text: Column) -> Column:
    """Two hashes of the text as written: with id, source and size they tell rows apart."""
    return F.struct(F.xxhash64(text).alias("x"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("y"))


def _decided(docs: DataFrame, weights: Sequence[float], share: float, cap: int, id_col: str, text_col: str, source_col: str, scratch: Scratch) -> DataFrame:
    """A row for each group of equal documents: ``doc_id, source, size, key``, how many (``n``), rate and ``copies`` in all.

    Kept in ``scratch``.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), _text_key(text).alias("key"))
    sized = scratch.write(rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n")), "sized")
    sources = _with_targets(_per_source(sized, weights, cap, scratch), share)
    histogram = scratch.write(sized.where("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n")), "histogram")
    state, n_sources = scratch.counted(_solve(sources, histogram, cap, scratch).withColumnRenamed("source", "name"), "solved")
    few = F.broadcast(state) if n_sources <= BROADCAST_KEYS else state
    tilted = F.lit(float(cap)) / (1.0 + F.exp(-F.col("tilt") * F.col("size") / F.col("scale")))
    bound = F.when(F.col("target") > 0, float(cap)).otherwise(0.0)
    rate = F.when(F.col("size") == 0, 0.0).otherwise(F.coalesce(tilted, bound))
    cells = F.ceil(F.col("of") / CELL).cast("long")
    rated = sized.join(few.withColumnRenamed("n", "of"), sized["source"].eqNullSafe(few["name"]))
    rated = rated.select("doc_id", "source", "size", "key", "n", F.col("words").alias("source_size"), "target", rate.alias("rate"), F.pmod(F.xxhash64("doc_id", "key", "size"), cells).alias("cell"))
    columns = ["source", "size", "n", "source_size", "target", "rate"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "x", "y"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        return pdf.assign(copies=round_copies(pdf["size"].to_numpy(np.float64), pdf["rate"].to_numpy(), pdf["n"].to_numpy()))[["doc_id", "x", "y", *columns, "copies"]]

    # the id travels as text: pandas would turn longs with nulls into doubles
    typed = rated.select(F.col("doc_id").cast("string"), "key.x", "key.y", *columns, "cell")
    out = typed.groupBy("source", "cell").applyInPandas(run, "doc_id string, x long, y long, source string, size long, n long, source_size long, target double, rate double, copies long")
    return scratch.write(out.withColumn("doc_id", F.col("doc_id").cast("long")), "decided", keep=True)


def entropy_mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Copies that a mix takes of every document so that each source meets its target in words.

    Null texts have size zero; documents of size zero are never taken.  A null
    source is a source of its own, ordered last.  Rows that repeat id, source
    and text are documents of equal rate, counted before anything is shuffled;
    their copies differ by one at most.  An empty table gives an empty result.
    Columns besides the three named are neither read nor kept.

    The state of Newton's method is a table with a row for each source.  Reruns
    agree: rates depend on sums only and rounding on (size, id, text) order
    within cells dealt by a hash of them.

    Returns ``doc_id long, size long, source string, source_size long, target
    double, rate double, copies long, taken long``.
    """
    with Scratch(docs.sparkSession, "mix") as scratch:
        of = _decided(docs, weights, share, cap, id_col, text_col, source_col, scratch)
    each = _spread(of, "n", "no").withColumn("each", F.floor(F.col("copies") / F.col("n")) + (F.col("no") < F.pmod("copies", "n")).cast("long"))
    return each.select("doc_id", "size", "source", "source_size", "target", "rate", F.col("each").alias("copies"), (F.col("size") * F.col("each")).alias("taken"))


def _spread(df: DataFrame, times: str, no: str) -> DataFrame:
    """Every row as many times as its column ``times`` says, numbered in ``no``; what is repeated often is dealt to many tasks."""
    (part,) = fresh(df, "part")
    parts = df.where(F.col(times) > 0).withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / SPREAD))))
    often = F.col(times) > SPREAD
    parts = parts.where(~often).unionByName(parts.where(often).repartition(part))
    first = F.col(part) * SPREAD
    return parts.withColumn(no, F.explode(F.sequence(first, F.least(first + SPREAD, F.col(times)) - 1))).drop(part)


def mix_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
) -> DataFrame:
    """``docs`` with every row as many times as :func:`entropy_mix` takes it; its columns only.

    Rows are found by id, source and text, whatever else they hold.  Of rows
    that repeat all three, one is taken as many times as they are together.
    Texts move once, to meet their copies.
    """
    with Scratch(docs.sparkSession, "mix-rows") as scratch:
        of = _decided(docs, weights, share, cap, id_col, text_col, source_col, scratch)
    x, y, no, times, id_, source, of_x, of_y = fresh(docs, "x", "y", "no", "times", "id", "of_source", "of_x", "of_y")
    key = _text_key(F.col(text_col).cast("string"))
    rows = docs.withColumns({x: key["x"], y: key["y"]})
    side = of.where("copies > 0").select("n", F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("x").alias(of_x), F.col("y").alias(of_y), F.col("copies").alias(times))
    single, repeated = side.where("n = 1").drop("n"), side.where("n > 1").drop("n")
    same = lambda s: rows[id_col].cast("long").eqNullSafe(s[id_]) & rows[source_col].cast("string").eqNullSafe(s[source]) & (rows[x] == s[of_x]) & (rows[y] == s[of_y])
    taken = rows.join(single, same(single)).withColumn(no, F.explode(F.array_repeat(F.lit(True), F.col(times).cast("int")))).select(*docs.columns)
    if repeated.isEmpty():
        return taken
    once = rows.join(repeated, same(repeated)).dropDuplicates([id_col, source_col, x, y]).select(*docs.columns, times)
    return taken.unionByName(_spread(once, times, no).select(*docs.columns))
