"""Boosted trees and forests, grown level by level from histograms that are added up over blocks.

All trees that can grow at once grow in one pass: a forest's trees, and the
present tree of every (candidate, ticker, fold) of a boosting.  A task bins nothing and
sorts nothing: it finds each row's node, adds first and second derivatives up by
(node, feature, bin) in whole numbers, which no order of addition changes, and
hands the filled bins on.  Splits are sought where the sums of a tree meet.

Trees are small and live on the driver, ``MODELS`` models at a time; rows never do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.shared import Scratch
from .blocks import arrays, rows_of
from .folds import small
from .logistic import class_weights

#: Bins of a feature; one more holds missing values.
BINS = 255
#: Sums are whole multiples of this, and the least sum of second derivatives on either side of a split.
GRAIN, LEAST_CURVE = 2.0**-26, 1e-3
#: Models that grow together, trees of a model after which scores of the rows are written anew, bytes of sums for which one more task seeks splits.
MODELS, REFRESHED, GROUP_BYTES = 5_000, 20, 4_000_000
#: Share of a Poisson variable of mean 1 up to each count.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
WIDTH = BINS + 1


# ---- bins ----


def edges(rows: DataFrame, parts: DataFrame, names: list[str], scratch: Scratch) -> DataFrame:
    """``ticker, fold, edges``: of every feature in every train part the upper edges of its bins.

    Edges are values at equally spaced exact ranks, all distinct values where
    they are few; the largest is left out.  Missing values have no rank.
    """
    train = rows.join(small(parts.select("ticker", "fold", "train_end")), "ticker").where(F.col("row_idx") < F.col("train_end"))
    values = train.select("ticker", "fold", "row_idx", F.posexplode(F.array(*[F.col(n).cast("double") for n in names])).alias("j", "value"))
    places = ranked(values.where(F.col("value").isNotNull() & ~F.isnan("value")), ["ticker", "fold", "j"], ["value", "row_idx"], scratch)
    last = F.expr(f"(rank * {BINS}) div rank_n <> ((rank + 1) * {BINS}) div rank_n")
    cuts = places.where(last).groupBy("ticker", "fold", "j").agg(F.array_sort(F.collect_set("value")).alias("cuts"))
    cuts = cuts.withColumn("cuts", F.slice("cuts", F.lit(1), F.size("cuts") - 1))
    of = cuts.groupBy("ticker", "fold").agg(F.map_from_entries(F.collect_list(F.struct("j", "cuts"))).alias("by"))
    none = F.array().cast("array<double>")
    every = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda j: F.coalesce(F.try_element_at(F.col("by"), j), none))
    found = parts.select("ticker", "fold").join(of, ["ticker", "fold"], "left")
    return scratch.write(found.select("ticker", "fold", F.when(F.col("by").isNull(), F.array_repeat(none, len(names))).otherwise(every).alias("edges")), "edges")


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers as bytes; BINS stands for a missing value."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), BINS, np.searchsorted(e, x[:, j], "left"))
    return out


# ---- rows in trees ----


def _column(tree: dict[str, list], name: str, kind: type) -> np.ndarray:
    return np.array(tree[name], kind)


def leaves_of(tree: dict[str, list], of: np.ndarray) -> np.ndarray:
    """The node in which each binned row ends."""
    feature, at, missing, left, right = (_column(tree, k, t) for k, t in (("feature", np.int64), ("bin", np.int64), ("missing", bool), ("left", np.int64), ("right", np.int64)))
    node = np.zeros(len(of), np.int64)
    inner = np.flatnonzero(feature[node] >= 0)
    while len(inner):
        n = node[inner]
        value = of[inner, feature[n]]
        node[inner] = np.where(np.where(value == BINS, missing[n], value <= at[n]), left[n], right[n])
        inner = inner[feature[node[inner]] >= 0]
    return node


def _hashed(x: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """53 bits of a hash of seed, tree and each of ``x``, as numbers in [0, 1)."""
    z = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + (tree + 1) * 0x8CB92BA72F3D8DD7) % (1 << 64))
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(odd)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def times_drawn(pos: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree's bootstrap takes each row: Poisson of mean 1, by a hash of seed, tree and position."""
    return np.searchsorted(_POISSON, _hashed(pos, seed, tree), "right")


def features_at(model: dict, tree: int, nodes: list[int], d: int) -> np.ndarray:
    """Features on which each node may split: all, or a root of them drawn for the node."""
    if model["kind"] == "boosting":
        return np.tile(np.arange(d), (len(nodes), 1))
    draws = _hashed((np.array(nodes)[:, None] * d + np.arange(d)).ravel(), ~model["seed"] & 0xFFFFFFFF, tree).reshape(-1, d)
    return np.sort(np.argsort(draws, axis=1, kind="stable")[:, : max(1, int(math.sqrt(d)))], axis=1)


def histogram(model: dict, no: int, tree: dict[str, list], of: np.ndarray, pos: np.ndarray, up: np.ndarray, raw: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (node of the frontier, feature, bin) that a block fills in one tree, and there the sums of g, h and rows."""
    node = leaves_of(tree, of)
    slot_of = np.full(len(tree["feature"]), -1)
    slot_of[tree["frontier"]] = np.arange(len(tree["frontier"]))
    rows = np.flatnonzero(slot_of[node] >= 0)
    weight = np.where(up == 1, model["weight"][1], model["weight"][0])
    if model["kind"] == "boosting":
        p = 1.0 / (1.0 + np.exp(-np.clip(raw, -35, 35)))
        g, h, count = weight * (p - up), weight * p * (1 - p), np.ones(len(up))
    else:
        count = times_drawn(pos, model["seed"], no).astype(float)
        rows = rows[count[rows] > 0]
        g, h = weight * up * count, weight * count  # the gain of g^2 / h is the fall of weighted Gini impurity
    if not len(rows):
        return np.zeros(0, np.uint32), np.zeros((3, 0), np.int64)
    chosen = features_at(model, no, tree["frontier"], of.shape[1])
    slot, k = slot_of[node[rows]], chosen.shape[1]
    flat = ((slot * k)[:, None] + np.arange(k)) * WIDTH + of[rows[:, None], chosen[slot]]
    flat, size = flat.ravel(), len(tree["frontier"]) * k * WIDTH
    if size <= 4 * len(flat):  # most bins are filled: no sorting
        places, inverse = np.flatnonzero(np.bincount(flat, minlength=size)), flat
    else:
        places, inverse = np.unique(flat, return_inverse=True)
        size = len(places)
    at = places if inverse is flat else slice(None)
    whole = lambda v: np.bincount(inverse, np.repeat(v, k), size)[at].astype(np.int64)
    return places.astype(np.uint32), np.array([whole(np.rint(g[rows] / GRAIN)), whole(np.rint(h[rows] / GRAIN)), whole(count[rows])])


def best_split(hist: np.ndarray, least: int, ridge: float) -> tuple[float, int, int, bool] | None:
    """Of (g, h, rows) by (feature, bin): gain, feature, last bin that goes left, whether missing values go left."""
    total = hist[:, 0].sum(axis=1)
    score = lambda g, h: g**2 / (h + ridge)
    best = None
    below = np.cumsum(hist[:, :, :BINS], axis=2)
    for missing_left in (False, True) if hist[2, :, BINS].any() else (False,):
        left = below + hist[:, :, BINS:] if missing_left else below
        right = total[:, None, None] - left
        fine = (left[2] >= max(1, least)) & (right[2] >= max(1, least)) & (left[1] >= LEAST_CURVE) & (right[1] >= LEAST_CURVE)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fine, score(left[0], left[1]) + score(right[0], right[1]) - score(total[0], total[1]), -np.inf)
        at = int(gain.argmax())
        if gain.flat[at] > 1e-12 and (best is None or gain.flat[at] > best[0]):
            best = (float(gain.flat[at]), at // BINS, at % BINS, missing_left)
    return best


# ---- growing ----


def new_tree() -> dict[str, list]:
    return {"feature": [-1], "bin": [0], "missing": [False], "left": [0], "right": [0], "gain": [0.0], "value": [0.0], "frontier": [0]}


def grow(model: dict, tree: dict[str, list], found: list[tuple], level: int) -> None:
    """Split the frontier where it gains most, as far as depth and leaves allow; the rest become leaves.

    ``found`` has for each frontier node its sums and its best split or None.
    """
    n_leaves = sum(f < 0 for f in tree["feature"])
    allowed = min(model["leaves"] - n_leaves, len(found)) if level < model["depth"] else 0
    by_gain = sorted((i for i, (_, split) in enumerate(found) if split is not None), key=lambda i: (-found[i][1][0], i))
    after = []
    for i, (node, ((g, h), split)) in enumerate(zip(tree["frontier"], found)):
        tree["value"][node] = -model["rate"] * g / (h + model["ridge"]) if model["kind"] == "boosting" else (g / h if h > 0 else 0.0)
        if i not in by_gain[: max(0, allowed)]:
            continue
        gain, feature, at, missing, sides = split
        for side in sides:
            for name, empty in (("feature", -1), ("bin", 0), ("missing", False), ("left", 0), ("right", 0), ("gain", 0.0), ("value", 0.0)):
                tree[name].append(empty)
            child = len(tree["feature"]) - 1
            g, h, count = side
            tree["value"][child] = -model["rate"] * g / (h + model["ridge"]) if model["kind"] == "boosting" else (g / h if h > 0 else 0.0)
            if count >= 2 * max(1, model["least"]):  # else no split leaves both sides enough rows
                after.append(child)
        for name, v in (("feature", feature), ("bin", at), ("missing", missing), ("left", child - 1), ("right", child), ("gain", gain)):
            tree[name][node] = v
    last = level + 1 >= model["depth"] or sum(f < 0 for f in tree["feature"]) >= model["leaves"]
    tree["frontier"] = [] if last else after


BINNED = "part string, block long, pos binary, y binary, folds array<struct<fold:long,of:binary>>, raws array<struct<model:string,raw:binary>>, models array<string>"
DEALT = f"{BINNED}, share_n long, share long"


def _binned_blocks(blocks: DataFrame, cuts: DataFrame, ends: DataFrame) -> DataFrame:
    """Blocks with the bins of their rows in every fold that trains on them."""
    of = ends.select("ticker", "fold", "train_end").join(cuts, ["ticker", "fold"]).groupBy(F.col("ticker").alias("part")).agg(F.collect_list(F.struct("fold", "train_end", "edges")).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("fold", pa.int64()), ("of", pa.binary())]))
        raws = pa.list_(pa.struct([("model", pa.string()), ("raw", pa.binary())]))
        kind = pa.schema([("part", pa.string()), ("block", pa.int64()), ("pos", pa.binary()), ("y", pa.binary()), ("folds", pair), ("raws", raws), ("models", pa.list_(pa.string()))])
        for row in rows_of(batches):
            pos, _, x = arrays(row)
            folds = [{"fold": f["fold"], "of": binned(x[:n], [np.array(e) for e in f["edges"]]).tobytes()} for f in row["of"] if (n := int(np.searchsorted(pos, f["train_end"])))]
            if folds:
                yield pa.RecordBatch.from_pylist([{"part": row["part"], "block": row["block"], "pos": row["pos"], "y": row["y"], "folds": folds, "raws": [], "models": []}], kind)

    return blocks.join(of, "part").mapInArrow(run, BINNED)


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    pos, y = np.frombuffer(row["pos"], np.int64), np.frombuffer(row["y"], np.float64)
    out = {}
    for f in row["folds"]:
        flat = np.frombuffer(f["of"], np.uint8)
        out[f["fold"]] = flat
    return pos, y, out


def _scores(model: dict, of: np.ndarray, known: bytes | None) -> np.ndarray:
    """Scores of rows: those written last, plus the trees since, in their order."""
    raw = np.full(len(of), model["start"]) if known is None else np.frombuffer(known, np.float64).copy()
    for tree in model["trees"][model["written"] :]:
        raw += np.array(tree["value"])[leaves_of(tree, of)]
    return raw


def _dealt(base: DataFrame, tasks: int, scratch: Scratch) -> DataFrame:
    """Blocks once for each of ``share_n`` shares of the trees: more than one where blocks are fewer than tasks."""
    n = max(1, base.count())
    share_n = -(-tasks // n)
    shares = base.withColumn("share_n", F.lit(share_n).cast("long")).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("share_n") - 1)))
    return scratch.write(shares.repartition(n * share_n) if share_n > 1 else shares, "dealt")


def _shared(row: Any, m: int, t: int) -> bool:
    """Whether a tree of a model is in a dealt block's share."""
    return (m + t) % row["share_n"] == row["share"]


def _pass(blocks: RDD, models: list[dict], growing: list[tuple[int, int]], d: int, tasks: int) -> dict[tuple[int, int], list[tuple]]:
    """Sums and best splits of every frontier node of the ``growing`` (model, tree) pairs.

    A pass is a job of two stages over an RDD that is planned once: what a
    block adds to a tree meets in order of the trees, so that a task holds the
    sums of one tree.  Only trees that no written score covers travel.
    """
    by_part: dict[str, list[int]] = {}
    for i, (m, _) in enumerate(growing):
        by_part.setdefault(models[m]["part"], []).append(i)
    used = {m for m, _ in growing}
    plain = {m: {k: models[m][k] for k in ("kind", "fold", "name", "seed", "weight", "start", "least", "ridge", "open")} for m in used}
    scored = {m: plain[m] | {"trees": models[m]["trees"][models[m]["written"] :], "written": 0} for m in used}

    def fill(rows: Iterator[Any]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        for row in rows:
            pos, y, folds = _block(row)
            raws = {r["model"]: r["raw"] for r in row["raws"]}
            scores: dict[int, np.ndarray] = {}
            for i in by_part.get(row["part"], []):
                m, t = growing[i]
                model = scored[m]
                if not _shared(row, m, t) or model["fold"] not in folds:
                    continue
                of = folds[model["fold"]].reshape(-1, d)
                n = len(of)
                if model["kind"] == "boosting" and m not in scores:
                    scores[m] = _scores(model, of, raws.get(model["name"]))
                yield i, histogram(model, t, model["open"][t], of, pos[:n], y[:n], scores.get(m))

    def split(rows: Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[int, list[tuple]]]:
        for i, parts in groupby(rows, lambda r: r[0]):
            m, t = growing[i]
            model, frontier = plain[m], plain[m]["open"][t]["frontier"]
            chosen = features_at(model, t, frontier, d)
            k = chosen.shape[1]
            dense = np.zeros((3, len(frontier) * k * WIDTH), np.int64)
            for _, (places, sums) in parts:
                dense[:, places] += sums
            hist = dense.reshape(3, -1, k, WIDTH) * np.array([GRAIN, GRAIN, 1.0])[:, None, None, None]
            out = []
            for s in range(len(chosen)):
                own = hist[:, s]
                g, h, count = own[:, 0].sum(axis=1).tolist()
                best = best_split(own, model["least"], model["ridge"])
                found = None
                if best is not None:
                    gain, j, at, missing = best
                    lg, lh, lc = (own[:, j, : at + 1].sum(axis=1) + (own[:, j, BINS] if missing else 0)).tolist()
                    found = (gain, int(chosen[s, j]), at, missing, ((lg, lh, lc), (g - lg, h - lh, count - lc)))
                out.append(((g, h), found))
            yield i, out

    slots = sum(len(models[m]["open"][t]["frontier"]) for m, t in growing)
    size = slots * (d if models[growing[0][0]]["kind"] == "boosting" else max(1, int(math.sqrt(d)))) * WIDTH * 24
    filled = blocks.mapPartitions(fill).repartitionAndSortWithinPartitions(max(1, min(tasks, len(growing), -(-size // GROUP_BYTES))))
    return {growing[i]: found for i, found in filled.mapPartitions(split).collect()}  # a row a tree


def _rewritten(blocks: DataFrame, models: list[dict], d: int, scratch: Scratch) -> DataFrame:
    """Dealt blocks with the present score of each of their rows in every model of their share."""
    by_part: dict[str, list[tuple[int, dict]]] = {}
    for no, m in enumerate(models):
        sent = {k: m[k] for k in ("fold", "name", "start")} | {"trees": m["trees"][m["written"] :], "written": 0}
        by_part.setdefault(m["part"], []).append((no, sent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                _, _, folds = _block(row)
                known = {r["model"]: r["raw"] for r in row["raws"]}
                row["raws"] = [{"model": m["name"], "raw": _scores(m, folds[m["fold"]].reshape(-1, d), known.get(m["name"])).tobytes()} for no, m in by_part.get(row["part"], []) if m["fold"] in folds and _shared(row, no, 0)]
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    return scratch.write(blocks.mapInArrow(run, DEALT), "scored")


def _grown(base: DataFrame, models: list[dict], d: int, scratch: Scratch) -> None:
    """Grow all trees of models of one kind level by level into ``trees``.

    A boosting starts its next tree as soon as one is grown, whatever the
    others do, so passes are as many as the levels of the deepest model, not
    of the deepest tree of every round.
    """
    tasks = base.sparkSession.sparkContext.defaultParallelism
    held = _dealt(base, tasks, scratch)
    blocks = held.rdd
    while True:
        for model in models:
            if model["open"] and not any(tree["frontier"] for tree in model["open"]):
                model["trees"] += model["open"]
                model["open"] = []
            if not model["open"] and len(model["trees"]) < model["rounds"] * model["n_trees"]:
                model["open"], model["level"] = [new_tree() for _ in range(model["n_trees"])], 0
        growing = [(m, t) for m, model in enumerate(models) for t, tree in enumerate(model["open"]) if tree["frontier"]]
        if not growing:
            return
        if models[0]["kind"] == "boosting" and max(len(m["trees"]) - m["written"] for m in models if m["open"]) >= REFRESHED:
            held = _rewritten(held, models, d, scratch)
            blocks = held.rdd
            for m in models:
                m["written"] = len(m["trees"])
        found = _pass(blocks, models, growing, d, tasks)
        for m, t in growing:
            tree = models[m]["open"][t]
            if (m, t) in found:
                grow(models[m], tree, found[m, t], models[m]["level"])
            else:  # a bootstrap without a row
                tree["frontier"] = []
        for m in {m for m, _ in growing}:
            models[m]["level"] += 1


def fitted(blocks: DataFrame, rows: DataFrame, parts: DataFrame, settings: list[tuple[str, str, dict[str, Any]]], names: list[str], seed: int, scratch: Scratch) -> Iterator[dict]:
    """Models of every setting ``(name, family, parameters)`` on every train part of ``parts`` (see :func:`logistic.prepared`).

    Yields plain dictionaries with ``part, fold, name, kind, start, edges,
    trees``.  Boosting of log loss: a tree a round, L2 on leaf values; forests:
    Poisson bootstraps, a root of the features at each node, splits by weighted
    Gini impurity.  Missing values go to the better side.  A tree splits its
    last level's nodes of greatest gain until it has its leaves or depth.
    """
    d = len(names)
    cuts = edges(rows, parts, names, scratch)
    base = scratch.write(_binned_blocks(blocks, cuts, parts), "binned")
    order = parts.join(cuts, ["ticker", "fold"]).select("ticker", "fold", "n", "up", "edges", class_weights(F.lit(True)).alias("balanced")).orderBy("ticker", "fold")
    plain = [1.0, 1.0]
    group: list[dict] = []

    def done(models: list[dict]) -> Iterator[dict]:
        for kind in ("boosting", "forest"):
            some = [m for m in models if m["kind"] == kind]
            if not some:
                continue
            _grown(base, some, d, scratch)
            yield from some

    for p in order.toLocalIterator():
        for name, family, params in settings:
            boosting = family == "gradient_boosting"
            weight = p["balanced"] if params.get("balanced", not boosting) else plain
            share = min(max(weight[1] * p["up"] / max(weight[0] * (p["n"] - p["up"]) + weight[1] * p["up"], 1e-12), 1e-6), 1 - 1e-6)
            group.append({
                "part": p["ticker"], "fold": p["fold"], "name": f"{name}|{p['fold']}", "kind": "boosting" if boosting else "forest", "seed": seed, "weight": list(weight), "edges": p["edges"],
                "start": math.log(share / (1 - share)), "rate": float(params.get("rate", 0.05)), "ridge": float(params.get("l2", 1.0)) if boosting else 0.0, "least": int(params.get("least", 40 if boosting else 30)),
                "leaves": int(params.get("leaves", 15)) if boosting else 1 << 30, "depth": 1 << 30 if boosting else int(params.get("depth", 6)),
                "rounds": int(params.get("rounds", 200)) if boosting else 1, "n_trees": 1 if boosting else int(params.get("trees", 400)), "trees": [], "open": [], "written": 0, "level": 0,
            })
        if len(group) >= MODELS:
            yield from done(group)
            group = []
    yield from done(group)


# ---- fitted trees ----


def model_of(grown: dict) -> dict[str, Any]:
    """A grown model as a plain dictionary that travels as JSON: thresholds instead of bins."""
    trees = []
    for t in grown["trees"]:
        cut = [grown["edges"][f][b] if f >= 0 and b < len(grown["edges"][f]) else (math.inf if f >= 0 else 0.0) for f, b in zip(t["feature"], t["bin"])]
        trees.append({k: t[k] for k in ("feature", "missing", "left", "right", "gain", "value")} | {"at": [str(c) if math.isinf(c) else c for c in cut]})
    return {"kind": grown["kind"], "start": grown["start"], "trees": trees}


def probabilities(model: dict[str, Any], x: np.ndarray) -> np.ndarray:
    """Probability of a rise of each row of features (NaN where missing)."""
    total = np.full(len(x), model["start"] if model["kind"] == "boosting" else 0.0)
    for t in model["trees"]:
        feature, at, missing, left, right = (np.array(t[k], kind) for k, kind in (("feature", np.int64), ("at", np.float64), ("missing", bool), ("left", np.int64), ("right", np.int64)))
        node = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(feature[node] >= 0)
        while len(inner):
            n = node[inner]
            value = x[inner, feature[n]]
            node[inner] = np.where(np.where(np.isnan(value), missing[n], value <= at[n]), left[n], right[n])
            inner = inner[feature[node[inner]] >= 0]
        total += np.array(t["value"])[node]
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))) if model["kind"] == "boosting" else total / max(1, len(model["trees"]))


def shares_of_gain(model: dict[str, Any], d: int) -> list[float]:
    """Each feature's share of the gains of all splits."""
    total = np.zeros(d)
    for t in model["trees"]:
        inner = np.array(t["feature"]) >= 0
        np.add.at(total, np.array(t["feature"])[inner], np.array(t["gain"])[inner])
    return (total / total.sum() if total.sum() > 0 else total).tolist()
