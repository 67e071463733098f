"""Model candidates on walk-forward folds.

All (candidate, ticker, fold) are fitted together, in passes over blocks of
rows: logistic regressions by sums of gradients and curvatures
(:mod:`logistic`), trees by sums of histograms (:mod:`trees`).  There is one
way for tables of every size.  Medians, scaling and bins come from each train
part only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.shared import Scratch
from . import logistic, trees
from .blocks import END, arrays, hashed_positions, packed, rows_of
from .folds import small
from .ranking import Standing

#: Order of the families by complexity, the tie-break of the ranking.
COMPLEXITY = {"logistic": 1, "random_forest": 2, "gradient_boosting": 3, "lstm": 4}
#: Parameter grids by family.
GRIDS: dict[str, list[dict[str, Any]]] = {
    "logistic": [{"C": 1.0, "balanced": True}, {"C": 0.1, "balanced": True}, {"C": 0.01, "balanced": True}, {"C": 0.01, "balanced": False}, {"C": 0.001, "balanced": False}],
    "gradient_boosting": [{"rate": 0.03, "leaves": 7}, {"rate": 0.03, "leaves": 15}, {"rate": 0.1, "leaves": 7}],
    "random_forest": [{"trees": 400, "depth": 6, "least": 30}, {"trees": 400, "depth": 4, "least": 50}],
    "lstm": [{"lookback": 20, "units": (32, 16)}],
}


@dataclass(frozen=True)
class Candidate:
    """A family with one setting of its parameters."""

    family: str
    params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.family not in COMPLEXITY:
            raise ValueError(f"unknown model family {self.family!r}")

    @property
    def name(self) -> str:
        shown = ",".join(f"{k}={'x'.join(map(str, v)) if isinstance(v, (list, tuple)) else v}" for k, v in sorted(self.params.items()))
        return f"{self.family}[{shown}]"

    @property
    def simplicity(self) -> tuple[float, ...]:
        """Smaller is simpler: stronger penalty, fewer or shallower trees."""
        p = self.params
        if self.family == "logistic":
            return (float(p.get("C", 1.0)),)
        if self.family == "gradient_boosting":
            return (float(p.get("leaves", 15)), float(p.get("rate", 0.05)))
        if self.family == "random_forest":
            return (float(p.get("depth", 6)), float(p.get("trees", 400)), -float(p.get("least", 30)))
        return (float(sum(p.get("units", ()))), float(p.get("lookback", 0)))


    @property
    def standing(self) -> Standing:
        return Standing(COMPLEXITY[self.family], self.simplicity)

    @property
    def balanced(self) -> bool:
        return bool(self.params.get("balanced", self.family == "random_forest"))


def lstm_available() -> bool:
    """Whether the recurrent family can be fitted; it has no learner here."""
    return False


def candidates(families: tuple[str, ...] = ("logistic", "gradient_boosting")) -> list[Candidate]:
    """All settings of the families; the recurrent one is left out, as it has no learner."""
    out = [Candidate(f, p) for f in families for p in (GRIDS[f] if f in GRIDS else [{}]) if f != "lstm" or lstm_available()]
    if not out:
        raise ValueError("no candidates")
    return out


def probabilities(model: dict[str, Any], x: np.ndarray) -> np.ndarray:
    """Probability of a rise of each row of features (NaN where missing)."""
    if model["kind"] != "logistic":
        return trees.probabilities(model, x)
    z = (np.where(np.isnan(x), model["fill"], x) - np.array(model["mean"])) / np.array(model["scale"])
    beta = np.array(model["beta"])
    return 1.0 / (1.0 + np.exp(-np.clip(z @ beta[:-1] + beta[-1], -35, 35)))


def importances(model: dict[str, Any], d: int) -> list[float]:
    """Coefficients, or each feature's share of the gains of all splits."""
    return list(model["beta"][:-1]) if model["kind"] == "logistic" else trees.shares_of_gain(model, d)


@dataclass
class Fitted:
    """One fitted model: a plain dictionary, which travels as JSON."""

    candidate: Candidate
    names: list[str]
    local: dict[str, Any]

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows with ``proba_up``."""
        local = self.local

        @F.pandas_udf("double")
        def proba(*columns: pd.Series) -> pd.Series:
            return pd.Series(probabilities(local, np.column_stack([c.to_numpy(np.float64) for c in columns])))

        return rows.withColumn("proba_up", proba(*self.names))

    def importance(self) -> dict[str, float]:
        """Coefficients or shares of the splits' gains by feature."""
        return dict(zip(self.names, importances(self.local, len(self.names))))


def _models(rows: DataFrame, parts: DataFrame, chosen: list[Candidate], names: list[str], seed: int, scratch: Scratch) -> Iterator[tuple[str, int, str, dict[str, Any]]]:
    """``(ticker, fold, candidate, model)`` of every candidate on every train part ``(ticker, fold, train_end)``."""
    for c in chosen:
        if c.family == "lstm":
            raise ValueError("lstm has no learner here")
    last = parts.groupBy("ticker").agg(F.max("train_end").alias("_last"))
    train = rows.join(small(last), "ticker").where(F.col("row_idx") < F.col("_last")).drop("_last")
    blocks = scratch.write(packed(train, names), "blocks")
    known = logistic.prepared(train, parts, names, scratch)
    linear = [(c.name, float(c.params.get("C", 1.0)), c.balanced) for c in chosen if c.family == "logistic"]
    if linear:
        for r in logistic.fitted(blocks, known, linear, scratch).toLocalIterator():
            name, fold = r["model"].rsplit("|", 1)
            yield r["part"], int(fold), name, {"kind": "logistic"} | {k: list(r[k]) for k in ("fill", "mean", "scale", "beta")}
    grown = [(c.name, c.family, c.params) for c in chosen if c.family != "logistic"]
    if grown:
        for m in trees.fitted(blocks, train, known, grown, names, seed, scratch):
            yield m["part"], m["fold"], m["name"].rsplit("|", 1)[0], trees.model_of(m)


def _in_order(train: DataFrame, names: list[str]) -> DataFrame:
    """``train`` as the rows of one part: positions are hashes of a row's ticker and session, or of its values."""
    keys = [c for c in ("ticker", "session") if c in train.columns] or [*names, "target"]
    kept = train.select(*names, F.col("target").cast("double").alias("target"), F.xxhash64(*keys).alias("_key"))
    return hashed_positions(kept, ["_key"], train.count()).drop("_key")


def fit(candidate: Candidate, train: DataFrame, names: list[str], seed: int = 42) -> Fitted:
    """Fit a candidate on all of ``train`` (features of ``names``, which may be null, and ``target``)."""
    with Scratch(train.sparkSession, "fit") as scratch:
        rows = scratch.write(_in_order(train, names), "train")
        parts = rows.select("ticker").distinct().select("ticker", F.lit(1).cast("long").alias("fold"), F.lit(END).cast("long").alias("train_end"))
        found = list(_models(rows, parts, [candidate], names, seed, scratch))
    if not found:
        raise ValueError("there are no rows to fit a model on")
    return Fitted(candidate, names, found[0][3])


#: Rows whose features travel to Python at once.
SCORED_ROWS = 4_096


def _scored(blocks: DataFrame, models: dict[str, list[tuple[str, int, int, int, dict]]]) -> DataFrame:
    """``ticker, row_idx, candidate, fold, proba_up`` of the models' eval ranges, ``models[ticker] = [(name, fold, from, to, model)]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("ticker", pa.string()), ("row_idx", pa.int64()), ("candidate", pa.string()), ("fold", pa.int64()), ("proba_up", pa.float64())])
        for row in rows_of(batches):
            pos, _, x = arrays(row)
            for name, fold, start, end, model in models.get(row["part"], []):
                a, b = np.searchsorted(pos, [start, end])
                if a < b:
                    n = int(b - a)
                    yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n), pa.array(pos[a:b]), pa.array([name] * n), pa.array([fold] * n, pa.int64()), pa.array(probabilities(model, x[a:b]))], schema=kind)

    return blocks.mapInArrow(run, "ticker string, row_idx long, candidate string, fold long, proba_up double")


def model_oof(rows: DataFrame, folds: DataFrame, chosen: list[Candidate], names: list[str], seed: int = 42) -> DataFrame:
    """Out-of-fold predictions of every candidate, ticker and fold, shaped like the baselines'.

    A row is read once for all candidates and folds of its ticker.  Models are
    few numbers each and scored ``trees.MODELS`` at a time.
    """
    columns = ["candidate", "ticker", "fold", "session", "row_idx", "proba_up", "prediction", "target", "future_return"]
    with Scratch(rows.sparkSession, "oof") as scratch:
        parts = scratch.write(folds.select("ticker", "fold", "train_end", "eval_start", "eval_end"), "folds")
        blocks = scratch.write(packed(rows, names), "all")
        spans = {(r["ticker"], r["fold"]): (r["eval_start"], r["eval_end"]) for r in parts.collect()} if parts.count() <= trees.MODELS * 100 else None
        if spans is None:
            raise ValueError("too many folds for one call: fit tickers in groups")
        out: DataFrame | None = None
        group: dict[str, list] = {}
        n = 0

        def flushed(out: DataFrame | None) -> DataFrame:
            some = scratch.write(_scored(blocks, group), "scores", keep=True)
            return some if out is None else out.unionByName(some)

        for ticker, fold, name, model in _models(rows, parts, chosen, names, seed, scratch):
            group.setdefault(ticker, []).append((name, fold, *spans[ticker, fold], model))
            n += 1
            if n % trees.MODELS == 0:
                out, group = flushed(out), {}
        if group or out is None:
            out = flushed(out)
    scored = out.join(rows.select("ticker", "row_idx", "session", "target", "future_return"), ["ticker", "row_idx"])
    return scored.withColumn("prediction", (F.col("proba_up") >= 0.5).cast("int")).select(*columns)


# ---- importance ----


def permuted_rows(rows: DataFrame, keys: list[str], names: list[str], repeats: int, seed: int, scratch: Scratch) -> DataFrame:
    """``keys, row_idx, target, j, repeat, x``: the features of every row with feature j dealt anew, once for each feature and repeat.

    A permutation is a join of two orders of a group's rows: row of place k by
    ``row_idx`` takes the value of the row of place k by a hash of (seed, j,
    repeat, row_idx).  ``x`` is the whole array of features with that value in it.
    """
    plain = ranked(rows.select(*keys, "row_idx", "target", F.array(*[F.col(n).cast("double") for n in names]).alias("x")), keys, ["row_idx"], scratch, "place").drop("place_n")
    plain = scratch.write(plain, "plain")
    draws = plain.select(*keys, "row_idx", "x").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1)))).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "j", "repeat", F.col("row_idx").cast("string")))
    draws = draws.select(*keys, "row_idx", "j", "repeat", F.expr("x[j]").alias("value"), draw.alias("draw"))
    dealt = ranked(draws, [*keys, "j", "repeat"], ["draw", "row_idx"], scratch, "place").select(*keys, "place", "j", "repeat", "value")
    both = plain.join(dealt, [*keys, "place"])
    return both.select(*keys, "row_idx", "target", "j", "repeat", F.expr("transform(x, (v, i) -> if(i = j, value, v))").alias("x"))


def _balanced(found: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over the classes that occur of the share predicted right."""
    right = found.groupBy(*keys, "target").agg(F.avg((F.col("prediction") == F.col("target")).cast("double")).alias("right"))
    return right.groupBy(*keys).agg(F.avg("right").alias("balanced"))


def permutation_losses(rows: DataFrame, keys: list[str], names: list[str], models: dict[Any, dict[str, Any]], repeats: int = 5, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """``keys, name, value``: mean loss of balanced accuracy when a feature's values are dealt anew, of the model of each key."""
    if scratch is None:
        with Scratch(rows.sparkSession, "permuted") as own:
            return own.write(permutation_losses(rows, keys, names, models, repeats, seed, own), "losses", keep=True)
    key = F.concat_ws("|", *keys) if keys else F.lit("")

    @F.pandas_udf("int")
    def predicted(which: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(which), np.int32)
        for k in which.unique():
            at = np.flatnonzero(which == k)
            out[at] = probabilities(models[k], np.array([np.array(v, np.float64) for v in x.iloc[at]])) >= 0.5
        return pd.Series(out)

    grouped = [*keys] or ["_all"]
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    base = rows.select(*grouped, "target", predicted(key, F.array(*[F.col(n).cast("double") for n in names])).alias("prediction"))
    base = _balanced(base, grouped).withColumnRenamed("balanced", "base")
    dealt = permuted_rows(rows, grouped, names, repeats, seed, scratch)
    after = _balanced(dealt.select(*grouped, "j", "repeat", "target", predicted(key, "x").alias("prediction")), [*grouped, "j", "repeat"])
    lost = after.join(base, grouped).groupBy(*grouped, "j").agg(F.avg(F.col("base") - F.col("balanced")).alias("value"))
    return lost.select(*keys, F.array(*[F.lit(n) for n in names])[F.col("j")].alias("name"), "value")


def permuted(fitted: Fitted, rows: DataFrame, seed: int = 42, repeats: int = 5) -> dict[str, float]:
    """:func:`permutation_losses` of one model over ``rows``."""
    found = permutation_losses(rows, [], fitted.names, {"": fitted.local}, repeats, seed)
    return {r["name"]: r["value"] for r in found.collect()}


def importance(candidate: Candidate, train: DataFrame, names: list[str], seed: int = 42, repeats: int = 0) -> DataFrame:
    """``ticker, name, value``: importances of a candidate fitted on each ticker's rows.

    Coefficients or gain shares, or with ``repeats`` the mean loss of balanced
    accuracy when a feature's values are dealt anew so many times.
    """
    spark = train.sparkSession
    with Scratch(spark, "importance") as scratch:
        rows = scratch.write(train.select("ticker", "row_idx", *names, F.col("target").cast("double").alias("target")), "rows")
        parts = rows.select("ticker").distinct().select("ticker", F.lit(1).cast("long").alias("fold"), F.lit(END).cast("long").alias("train_end"))
        models = {ticker: model for ticker, _, _, model in _models(rows, parts, [candidate], names, seed, scratch)}
        if repeats:
            out = permutation_losses(rows, ["ticker"], names, models, repeats, seed, scratch)
        else:
            found = [(t, n, float(v)) for t, m in models.items() for n, v in zip(names, importances(m, len(names)))]
            out = spark.createDataFrame(found, "ticker string, name string, value double")
        return scratch.write(out, "importance", keep=True)


def sequences(rows: DataFrame, names: list[str], lookback: int) -> DataFrame:
    """``ticker, session, sequence``: for each row the features of the last ``lookback`` rows, oldest first; full ones only."""
    if lookback < 1:
        raise ValueError("lookback must be positive")
    w = Window.partitionBy("ticker").orderBy("session").rowsBetween(-(lookback - 1), 0)
    s = rows.select("ticker", "session", F.collect_list(F.array(*names)).over(w).alias("sequence"))
    return s.where(F.size("sequence") == lookback)
