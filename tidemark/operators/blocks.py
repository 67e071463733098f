"""Rows of a panel packed into blocks, over which models are fitted by sums.

A block is some thousand rows of one ticker as one binary matrix.  A fit is a
series of passes: blocks meet the state of their ticker's models, each task
adds up what its blocks contribute to every model, and the sums of all tasks
are added by key.  No ticker's rows come together in a task, however many it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block (some 1 MB of features), and models whose sums a task holds before it hands them on.
BLOCK_ROWS, HELD = 4_096, 2_000
BLOCK = "part string, block long, pos binary, y binary, x binary"
#: A position behind every row.
END = (1 << 63) - 1


def packed(rows: DataFrame, names: list[str], part: str = "ticker", pos: str = "row_idx") -> DataFrame:
    """Blocks of ``rows``: positions (int64), targets and features (float64, NaN where missing), in order of position."""
    d = len(names)
    flat = rows.select(F.col(part).alias("part"), F.floor(F.col(pos) / BLOCK_ROWS).cast("long").alias("block"), F.col(pos).cast("long").alias("pos"), F.col("target").cast("double").alias("y"), *[F.col(n).cast("double").alias(f"f{i}") for i, n in enumerate(names)])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pos", "ascending"), *[(f"f{i}", "ascending") for i in range(d)]])
        x = np.column_stack([table[f"f{i}"].to_numpy().astype(np.float64) for i in range(d)])
        row = {"part": table["part"][0].as_py(), "block": table["block"][0].as_py(), "pos": table["pos"].to_numpy().tobytes(), "y": table["y"].to_numpy().astype(np.float64).tobytes(), "x": x.tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("part", pa.string()), ("block", pa.int64()), ("pos", pa.binary()), ("y", pa.binary()), ("x", pa.binary())]))

    return flat.groupBy("part", "block").applyInArrow(pack, BLOCK)


def hashed_positions(rows: DataFrame, columns: list[str], count: int) -> DataFrame:
    """``rows`` with ``part`` and ``row_idx`` for tables without an order: rows are dealt to blocks by a hash of their values."""
    slots = max(1, -(-count // (BLOCK_ROWS // 2))) * BLOCK_ROWS
    return rows.withColumn("ticker", F.lit("all")).withColumn("row_idx", F.pmod(F.xxhash64(*columns), F.lit(slots)))


def arrays(row: dict[str, Any]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, targets and features of a block."""
    pos, y = np.frombuffer(row["pos"], np.int64), np.frombuffer(row["y"], np.float64)
    return pos, y, np.frombuffer(row["x"], np.float64).reshape(len(pos), -1)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def summed(blocks: DataFrame, state: DataFrame, fields: list[str], contribution: Callable[[dict, list[dict]], Iterator[tuple[str, np.ndarray]]]) -> DataFrame:
    """``part, model, sums array<double>``: for every model the sum of what each block contributes.

    ``state`` has a row for each model (``part, model`` and ``fields``); a
    block meets all models of its part, which are one row then.
    ``contribution(block, models)`` gives a vector for each of them.  Tasks add
    up their own blocks' vectors, so what meets for a model is a vector a task.
    """
    models = state.groupBy("part").agg(F.collect_list(F.struct("model", *fields)).alias("models"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("part", pa.string()), ("model", pa.string()), ("sums", pa.list_(pa.float64()))])
        held: dict[tuple[str, str], np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], schema=kind)

        for row in rows_of(batches):
            for model, vector in contribution(row, row["models"]):
                key = (row["part"], model)
                held[key] = held[key] + vector if key in held else vector
            if len(held) >= HELD:
                yield out()
                held = {}
        if held:
            yield out()

    def total(table: pa.Table) -> pa.Table:
        vectors = sorted(table["sums"].to_pylist())  # any order of arrival gives the same sum
        kind = pa.schema([("part", pa.string()), ("model", pa.string()), ("sums", pa.list_(pa.float64()))])
        return pa.table({"part": table["part"][:1], "model": table["model"][:1], "sums": [np.sum(vectors, axis=0).tolist()]}, kind)

    partial = blocks.join(models, "part").mapInArrow(add, "part string, model string, sums array<double>")
    return partial.groupBy("part", "model").applyInArrow(total, "part string, model string, sums array<double>")
