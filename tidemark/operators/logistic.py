"""Logistic regression of many (candidate, ticker, fold) at once, by Newton steps over sums.

Loss, gradient and curvature of every model are sums over rows, taken for all
models in one pass; a model's step is the solution of a system of as many
equations as it has coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import medians
from ..functions.shared import Scratch
from .blocks import arrays, rows_of, summed
from .folds import small

#: Newton steps at most, and the largest slope at which a model is at its minimum.
STEPS, FLAT = 100, 1e-9
_LISTS = ("fill", "mean", "scale", "weight", "beta", "base", "step", "sums")
STATE = "part string, model string, train_end long, c double, fill array<double>, mean array<double>, scale array<double>, weight array<double>, beta array<double>, base array<double>, step array<double>, size double, loss double, done boolean"


def prepared(rows: DataFrame, parts: DataFrame, names: list[str], scratch: Scratch) -> DataFrame:
    """Of each train part ``(ticker, fold, train_end)``: rows, rises, and arrays of the features' medians, means and deviations.

    Means and population deviations are those of the values with missing ones
    replaced by the median, from moments of the present ones; a constant
    feature has the deviation 1.  Medians are exact, and selected only for
    features that miss a value in that train part (0 if they miss all).
    """
    train = rows.join(small(parts.select("ticker", "fold", "train_end")), "ticker").where(F.col("row_idx") < F.col("train_end"))
    moments = [F.struct(F.count(n).alias("c"), F.avg(n).alias("m"), F.stddev_pop(n).alias("s")) for n in names]
    found = scratch.write(train.groupBy("ticker", "fold", "train_end").agg(F.count("*").alias("n"), F.sum("target").cast("double").alias("up"), F.array(*moments).alias("of")), "moments")
    missing = found.select("ticker", "fold", F.posexplode(F.transform("of", lambda x: x["c"] < F.col("n"))).alias("j", "gap")).where("gap").select("ticker", "fold", "j")
    gaps = scratch.write(missing, "gaps")
    if gaps.isEmpty():
        fill = found.select("ticker", "fold", F.transform("of", lambda x: F.lit(0.0)).alias("fill"))
    else:
        values = train.select("ticker", "fold", "row_idx", F.posexplode(F.array(*[F.col(n).cast("double") for n in names])).alias("j", "value"))
        middle = medians(values.join(small(gaps), ["ticker", "fold", "j"]), ["ticker", "fold", "j"], "value", "row_idx", scratch)
        of = middle.groupBy("ticker", "fold").agg(F.map_from_entries(F.collect_list(F.struct("j", "median"))).alias("by"))
        known = F.coalesce(F.try_element_at(F.col("by"), F.col("j")), F.lit(0.0))
        each = found.select("ticker", "fold", F.posexplode("of").alias("j", "x")).join(of, ["ticker", "fold"], "left").select("ticker", "fold", "j", known.alias("v"))
        fill = each.groupBy("ticker", "fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("fill"))
    both = found.join(fill, ["ticker", "fold"])
    mean = F.zip_with("of", "fill", lambda x, f: (x["c"] * F.coalesce(x["m"], F.lit(0.0)) + (F.col("n") - x["c"]) * f) / F.col("n"))
    both = both.withColumn("mean", mean).withColumn("_both", F.arrays_zip("of", "fill", "mean"))
    square = lambda v: v * v
    spread = F.transform("_both", lambda x: F.sqrt((x["of"]["c"] * (square(F.coalesce(x["of"]["s"], F.lit(0.0))) + square(F.coalesce(x["of"]["m"], F.lit(0.0)) - x["mean"])) + (F.col("n") - x["of"]["c"]) * square(x["fill"] - x["mean"])) / F.col("n")))
    scale = F.zip_with(spread, "mean", lambda s, m: F.when(s > 1e-14 * F.abs(m), s).otherwise(F.lit(1.0)))
    return scratch.write(both.select("ticker", "fold", "train_end", "n", "up", "fill", "mean", scale.alias("scale")), "prepared")


def class_weights(balanced: Column) -> Column:
    """Weights of falls and rises: n / (2 * rows of the class) if balanced and both occur, else 1."""
    n, up = F.col("n"), F.col("up")
    return F.when(balanced & (up > 0) & (up < n), F.array(n / (2.0 * (n - up)), n / (2.0 * up))).otherwise(F.array(F.lit(1.0), F.lit(1.0)))


def _unfolded(flat: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, slope and curvature of the data, as :func:`_contribution` lays them out."""
    curve = np.zeros((k, k))
    curve[np.triu_indices(k)] = flat[1 + k :]
    return float(flat[0]), flat[1 : 1 + k], curve + np.triu(curve, 1).T


def _contribution(block: dict, models: list[dict]) -> Iterator[tuple[str, np.ndarray]]:
    """A block's part of each unfinished model's loss, slope and (upper) curvature at its coefficients."""
    pos, y, x = arrays(block)
    scaled: dict[int, np.ndarray] = {}  # folds share their scaled rows
    for m in models:
        if m["done"] or not len(pos) or pos[0] >= m["train_end"]:
            continue
        n = int(np.searchsorted(pos, m["train_end"]))
        if m["train_end"] not in scaled:
            z = (np.where(np.isnan(x[:n]), m["fill"], x[:n]) - m["mean"]) / m["scale"]
            scaled[m["train_end"]] = np.column_stack((z, np.ones(n)))
        z, up = scaled[m["train_end"]], y[:n]
        margin = z @ np.array(m["beta"])
        p = 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))
        weight = m["c"] * np.where(up == 1, m["weight"][1], m["weight"][0])
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z
        yield m["model"], np.concatenate(([weight @ (np.logaddexp(0, margin) - up * margin)], z.T @ (weight * (p - up)), curve[np.triu_indices(z.shape[1])]))


def _stepped(m: dict) -> dict:
    """A model's next coefficients from the sums at its present ones; half a step back if the loss rose."""
    if m["done"]:
        return m
    beta = np.array(m["beta"])
    k = len(beta)
    ridge = np.append(np.ones(k - 1), 0.0)
    loss, slope, curve = _unfolded(np.array(m["sums"]), k)
    loss, slope = loss + 0.5 * float(ridge @ beta**2), slope + ridge * beta
    if m["loss"] is not None and loss > m["loss"] and m["size"] > 1e-8:
        size = m["size"] / 2
        return m | {"size": size, "beta": (np.array(m["base"]) - size * np.array(m["step"])).tolist()}
    settled = m["loss"] is not None and m["loss"] - loss <= 1e-14 * abs(loss)
    step = np.linalg.solve(curve + np.diag(ridge + 1e-12), slope)
    if np.abs(slope).max() < FLAT or settled:  # the last step is beyond what the loss can tell
        return m | {"loss": loss, "beta": (beta - step).tolist(), "done": True}
    return m | {"loss": loss, "base": beta.tolist(), "step": step.tolist(), "size": 1.0, "beta": (beta - step).tolist()}


def fitted(blocks: DataFrame, parts: DataFrame, settings: list[tuple[str, float, bool]], scratch: Scratch) -> DataFrame:
    """Coefficients of every setting ``(name, C, balanced)`` on every train part of :func:`prepared`.

    The minimum of C * weighted log loss + half the squared coefficients of the
    scaled features (the intercept is free).  A pass over the blocks for each
    Newton step; finished models are passed over.  Returns ``part, model
    (name|fold), fill, mean, scale, beta`` (the last coefficient is the
    intercept); a part without rows has no model.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(c)).alias("c"), F.lit(b).alias("balanced")) for n, c, b in settings]))
    state = parts.withColumn("_k", kinds).select(
        F.col("ticker").alias("part"), F.concat_ws("|", "_k.name", "fold").alias("model"), "train_end", "_k.c", "fill", "mean", "scale", class_weights(F.col("_k.balanced")).alias("weight"),
        F.transform(F.concat("mean", F.array(F.lit(0.0))), lambda x: F.lit(0.0)).alias("beta"), *[F.lit(None).cast("array<double>").alias(c) for c in ("base", "step")], F.lit(1.0).alias("size"), F.lit(None).cast("double").alias("loss"), F.lit(False).alias("done"),
    )
    state, open_ = scratch.counted(state, "state", ~F.col("done"))
    columns = state.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{c: v for c, v in _stepped(m).items() if c in columns} for m in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, pa.schema([batch.schema.field(c) for c in columns]))

    for _ in range(STEPS):
        if not open_:
            break
        sums = summed(blocks, state.where(~F.col("done")), ["train_end", "c", "fill", "mean", "scale", "weight", "beta", "done"], _contribution)
        state, open_ = scratch.counted(state.join(sums, ["part", "model"], "left").mapInArrow(step, STATE), "state", ~F.col("done"))
    return state.select("part", "model", "fill", "mean", "scale", "beta")


def margin(names: list[str], fill: str = "fill", mean: str = "mean", scale: str = "scale", beta: str = "beta") -> Column:
    """The linear score of a row beside its model's arrays, missing features replaced."""
    x = F.zip_with(F.array(*[F.col(n).cast("double") for n in names]), fill, lambda v, f: F.coalesce(v, f))
    z = F.zip_with(F.zip_with(x, mean, lambda v, m: v - m), scale, lambda v, s: v / s)
    terms = F.zip_with(F.concat(z, F.array(F.lit(1.0))), beta, lambda v, b: v * b)
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def slopes(rows: DataFrame, parts: DataFrame, models: DataFrame, c: float, balanced: bool, names: list[str]) -> DataFrame:
    """``ticker, fold, n, slope``: rows of each train part, and the largest slope of one setting's loss at its fitted coefficients.

    The check of a fit by another way: plain expressions and sums over the rows.
    """
    known = parts.select("ticker", "fold", "train_end", "n", class_weights(F.lit(balanced)).alias("w"))
    of = known.join(models.select(F.col("part").alias("ticker"), F.substring_index("model", "|", -1).cast("long").alias("fold"), "fill", "mean", "scale", "beta"), ["ticker", "fold"])
    train = rows.join(small(of), "ticker").where(F.col("row_idx") < F.col("train_end"))
    pull = c * F.col("w")[F.col("target").cast("int")] * (probability(margin(names)) - F.col("target"))
    x = F.zip_with(F.array(*[F.col(n).cast("double") for n in names]), "fill", lambda v, f: F.coalesce(v, f))
    z = F.zip_with(F.zip_with(x, "mean", lambda v, m: v - m), "scale", lambda v, s: v / s)
    each = train.select("ticker", "fold", "n", "beta", pull.alias("pull"), F.concat(z, F.array(F.lit(1.0))).alias("z"))
    each = each.select("ticker", "fold", "n", "pull", F.posexplode("z").alias("j", "v"), F.when(F.size("beta") > 0, F.col("beta")).alias("beta"))
    sums = each.groupBy("ticker", "fold", "n", "j").agg(F.sum(F.col("pull") * F.col("v")).alias("s"), F.first("beta").alias("beta"))
    ridge = F.when(F.col("j") < len(names), F.expr("beta[j]")).otherwise(F.lit(0.0))
    return sums.groupBy("ticker", "fold", "n").agg(F.max(F.abs(F.col("s") + ridge)).alias("slope"))


def probability(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(score, F.lit(35.0)), F.lit(-35.0))))
