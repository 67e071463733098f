"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut into halves with a codebook each; the product of the two
codebooks is a grid of cells, and every vector lies in one.  A vector visits
cells in the order of its distance to them (multi-sequence traversal) until
the cells that hold its neighbours at the linking cosine are passed with the
target probability, and what the cells hold is verified in double precision.
Of the cells on its way it visits its own and those of a higher number, so a
pair meets once and half the visits are spared.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

#: Cosine from which vectors link.
COSINE = 0.9
#: Vectors that codebooks and stopping rule are fitted on: SAMPLE, or for large codebooks A_WORD for each word.
SAMPLE, A_WORD = 8_192, 16
#: Chance that a neighbour at exactly the linking cosine, in a random direction, lies in a visited cell.
TARGET = 0.98
#: Codewords of each half: about sqrt(vectors) / SPREAD, a power of two, within the bounds.  A cell holds some
#: SPREAD ** 2 vectors up to (MOST_WORDS * SPREAD) ** 2 = 9.7e9 vectors, and grows in proportion beyond.
SPREAD, LEAST_WORDS, MOST_WORDS = 24.0, 4, 4_096
#: Vectors of one length up to this many are a single cell, where every pair is compared.
ONE_CELL = 2_048
#: Vectors of a cell, and visitors of a cell, that are compared at once; fuller cells are cut into such blocks.
CELL_BLOCK, VISITOR_BLOCK = 2_048, 2_048
ITERATIONS = 15


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one, none of them zero; scaled first, so that no square overflows or vanishes."""
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _squared(half: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances of aligned or broadcast rows, in an order of sums that depends on the row alone."""
    return ((half - words) ** 2).sum(axis=-1)


def _codebook(half: np.ndarray, count: int, seed: int) -> np.ndarray:
    """k-means with farthest-first seeding; deterministic for a given sample."""
    count = min(count, len(half))
    start = np.random.default_rng(seed).integers(len(half))
    words = [half[start]]
    far = _squared(half, words[0])
    for _ in range(count - 1):
        words.append(half[int(far.argmax())])
        far = np.minimum(far, _squared(half, words[-1]))
    book = np.array(words)
    for _ in range(ITERATIONS):
        near = (-2 * half @ book.T + (book**2).sum(axis=1)).argmin(axis=1)
        size = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, half)
        book = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], book)
    return book


@dataclass
class MultiIndex:
    """Two codebooks and ``reach``: how much farther than its nearest cell a vector's last visited cell may be."""

    first: np.ndarray
    second: np.ndarray
    reach: float = 0.0

    @classmethod
    def fit(cls, sample: np.ndarray, words: int, cosine: float, target: float) -> MultiIndex:
        unit = unit_rows(sample)
        cut = (unit.shape[1] + 1) // 2
        index = cls(_codebook(unit[:, :cut], words, 1), _codebook(unit[:, cut:], words, 2))
        noise = np.random.default_rng(3).normal(size=unit.shape)
        noise -= (noise * unit).sum(axis=1, keepdims=True) * unit
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
        moved = cosine * unit + math.sqrt(max(0.0, 1 - cosine**2)) * noise
        cell = index.cells(moved)
        index.reach = float(np.quantile(index.cost(unit, cell) - index.nearest(unit), target)) if unit.shape[1] > 1 else math.inf
        return index

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each vector's halves to all words."""
        cut = self.first.shape[1]
        return _squared(unit[:, None, :cut], self.first[None]), _squared(unit[:, None, cut:], self.second[None])

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each vector: word of the first half times the number of second words, plus word of the second."""
        a, b = self.halves(unit)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.halves(unit)
        return a.min(axis=1) + b.min(axis=1)

    def cost(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Distance of each vector to the cell beside it."""
        cut = self.first.shape[1]
        return _squared(unit[:, :cut], self.first[cells // len(self.second)]) + _squared(unit[:, cut:], self.second[cells % len(self.second)])

    def visited(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Cells that one vector visits, nearest first, from its halves' distances (multi-sequence algorithm)."""
        rows, columns = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        x, y = a[rows].tolist(), b[columns].tolist()
        limit = (x[0] + y[0]) + self.reach
        heap, out, pushed = [(x[0] + y[0], 0, 0)], [], {(0, 0)}
        while heap:
            cost, i, j = heapq.heappop(heap)
            if cost > limit:
                break
            out.append(int(rows[i]) * len(self.second) + int(columns[j]))
            for n, m in ((i + 1, j), (i, j + 1)):
                if n < len(x) and m < len(y) and (n, m) not in pushed:
                    pushed.add((n, m))
                    heapq.heappush(heap, (x[n] + y[m], n, m))
        return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _forest(linked: np.ndarray, visitors: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what ``linked`` joins, at most one for each vector: each to the least of its group."""
    best = np.minimum(visitors, np.where(linked, members[None, :], np.iinfo(np.int64).max).min(axis=1))
    while True:
        below = np.minimum(members, np.where(linked, best[:, None], np.iinfo(np.int64).max).min(axis=0))
        again = np.minimum(best, np.where(linked, below[None, :], np.iinfo(np.int64).max).min(axis=1))
        if np.array_equal(again, best):
            return np.concatenate((visitors, members)), np.concatenate((best, below))
        best = again


def _fitted(classes: DataFrame, cosine: float, target: float) -> dict[int, MultiIndex]:
    """An index for each length that more than ``ONE_CELL`` distinct vectors have; the others are one cell."""
    out = {}
    for r in classes.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("vectors")).where(F.col("vectors") > ONE_CELL).collect():
        words = min(MOST_WORDS, max(LEAST_WORDS, 1 << max(0, round(math.log2(math.sqrt(r["vectors"]) / SPREAD)))))
        rows = classes.where(F.size("v") == r["n"]).orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, A_WORD * words)).select("v").collect()
        out[r["n"]] = MultiIndex.fit(np.array([x["v"] for x in rows], np.float64), words, cosine, target)
    return out


def _placed(classes: DataFrame, indexes: dict[int, MultiIndex]) -> DataFrame:
    """``classes`` with ``cell`` and, besides its own, the cells ``visits`` of higher numbers that a vector visits.

    A cell is numbered by its words and by the length of its vectors.
    """

    @F.arrow_udf("struct<cell:long,visits:array<long>>")
    def place(column: pa.Array) -> pa.Array:
        sizes = np.diff(column.offsets.to_numpy())
        cells, visits = np.zeros(len(column), np.int64), [[] for _ in range(len(column))]
        for length, index in indexes.items():
            at = np.flatnonzero(sizes == length)
            for part in (at[lo : lo + 256] for lo in range(0, len(at), 256)):
                a, b = index.halves(unit_rows(_matrix(column.take(pa.array(part)))))
                own = a.argmin(axis=1) * len(index.second) + b.argmin(axis=1)
                cells[part] = own
                for i, x, y, cell in zip(part.tolist(), a, b, own.tolist()):
                    visits[i] = [c | length << 32 for c in index.visited(x, y) if c > cell]
        return pa.StructArray.from_arrays([pa.array(cells | sizes.astype(np.int64) << 32), pa.array(visits, pa.list_(pa.int64()))], ["cell", "visits"])

    return classes.withColumn("p", place("v")).select("id", "n", "v", "p.*")


def embedding_groups(vectors: DataFrame, cosine: float = COSINE, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links and groups of vectors whose cosine is at least ``cosine``.

    Equal vectors are one node with a count, so copies are never paired with
    each other.  Every vector is indexed and visits the index; a pair meets
    where the vector of the lower cell visits the other one's.  Of a cell's
    links only sums and a spanning forest leave the task.

    Vectors link with those of their own length only.  Null vectors, zero
    vectors and ones with null or non-finite components link with nothing.  A
    null id never links.  Repeated rows (equal id and vector) count as copies.
    An empty table gives an empty result.  Columns besides the two named are
    neither read nor kept.

    Returns ``vec_id long, n_links long, component_id long, kept boolean``.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    with Scratch(vectors.sparkSession, "embeddings") as scratch:
        rows = scratch.write(rows.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), F.col("v")).alias("v")), "vectors", keep=True)
        classes = scratch.write(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "classes")
        placed = scratch.write(_placed(classes, _fitted(classes, cosine, target)), "placed")
        met = scratch.write(_met(placed, cosine, scratch), "met")
        links = met.where("not edge").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
        groups = connected_components(met.where("edge").select("a", "b"), scratch)
        named = classes.join(links, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
        named = scratch.write(named.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component")), "named", keep=True)
    found = rows.where("v is not null").join(named, "v").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return found.union(alone)


def _met(placed: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """``edge boolean, a long, b long``: links to count for a vector (``a`` has ``b`` more), and edges of a spanning forest.

    Members of a cell are dealt into ``cuts`` blocks, its visitors into
    ``waves``.  A cell of one block is its members' own visitor.
    """
    visits = placed.select(F.explode("visits").alias("to")).groupBy("to").agg(F.count("*").alias("visitors"))
    held = placed.groupBy(F.col("cell").alias("to")).agg(F.count("*").alias("members"))
    cuts = F.ceil(F.col("members") / CELL_BLOCK).cast("int")
    visitors = F.coalesce("visitors", F.lit(0)) + F.when(cuts > 1, F.col("members")).otherwise(0)
    # one row for each occupied cell: at most MOST_WORDS squared, joined as its size allows
    blocks = scratch.write(held.join(visits, "to", "left").select("to", cuts.alias("cuts"), F.greatest(F.lit(1), F.ceil(visitors / VISITOR_BLOCK)).cast("int").alias("waves")), "blocks")
    # vectors travel as floats where that loses nothing
    lossless = placed.where(F.exists("v", lambda x: x.cast("float").cast("double") != x)).isEmpty()
    packed = F.col("v").cast("array<float>" if lossless else "array<double>").alias("v")
    grain = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    members = placed.join(blocks, placed["cell"] == blocks["to"]).withColumn("wave", F.explode(F.sequence(F.lit(0), F.col("waves") - 1)))
    members = members.select("to", (grain % F.col("cuts")).cast("int").alias("cut"), "wave", F.lit(True).alias("member"), ((F.col("cuts") == 1) & (F.col("wave") == 0)).alias("visitor"), "id", "n", packed)
    guests = placed.withColumn("of", F.explode(F.concat("visits", F.array("cell")))).join(blocks, F.col("of") == blocks["to"]).where("of <> cell or cuts > 1")
    guests = guests.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    guests = guests.select("to", "cut", (grain % F.col("waves")).cast("int").alias("wave"), (F.lit(False)).alias("member"), F.lit(True).alias("visitor"), "id", "n", packed, (F.col("of") == F.col("cell")).alias("own"))
    # a vector that visits its own cell, of several blocks, meets each other member twice: the smaller id counts
    members = members.withColumn("own", F.col("visitor"))

    def compare(table: pa.Table) -> pa.Table:
        is_member, is_visitor, own = (table[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("member", "visitor", "own"))
        ids, counts = table["id"].to_numpy(), table["n"].to_numpy()
        unit = unit_rows(_matrix(table["v"]))
        q, d = np.flatnonzero(is_visitor), np.flatnonzero(is_member)
        out_a, out_b, out_kind = [], [], []
        if len(q) and len(d):
            linked = unit[q] @ unit[d].T >= cosine
            linked &= np.where(own[q][:, None], ids[q][:, None] < ids[d][None, :], True)
            q, linked = q[linked.any(axis=1)], linked[linked.any(axis=1)]
            d, linked = d[linked.any(axis=0)], linked[:, linked.any(axis=0)]
            if len(q):
                nodes, roots = _forest(linked, ids[q], ids[d])
                out_a = [ids[q], ids[d], nodes]
                out_b = [linked @ counts[d], linked.T @ counts[q], roots]
                out_kind = [np.zeros(len(q) + len(d), bool), np.ones(len(nodes), bool)]
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({"edge": join(out_kind, pa.bool_()), "a": join(out_a, pa.int64()), "b": join(out_b, pa.int64())})

    return members.unionByName(guests).groupBy("to", "cut", "wave").applyInArrow(compare, "edge boolean, a long, b long")
