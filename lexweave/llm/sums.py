"""Sums of long vectors over all tasks, in a tree: no task and not the driver ever holds more than a bounded number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vector travels in pieces of so many numbers; so many pieces are added up at once.
PIECE = 1 << 15
FAN_IN = 64
#: A pass has at most so many tasks, so that two levels of FAN_IN are enough.
MOST_TASKS = FAN_IN * FAN_IN


def parts(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's partial sums as pieces; pieces of zeros stay away, and 32 bits are enough for one task."""
    flat = np.ascontiguousarray(total).reshape(-1)
    for i in range(0, len(flat), PIECE):
        piece = flat[i : i + PIECE]
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([i // PIECE], pa.int32()), pa.array([piece.astype(np.float32).tobytes()], pa.binary())], names=["piece", "sums"])


def _add(kind: type) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["sums"].iloc[0], dtype=kind).astype(np.float64)
        for v in pdf["sums"].iloc[1:]:
            total += np.frombuffer(v, dtype=kind)
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "sums": [total.tobytes()]})

    return add


def add_up(df: DataFrame, run: Callable, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of what run yields by parts(); the driver gets one vector of the given shape."""
    one = df.coalesce(MOST_TASKS).mapInArrow(run, "piece int, sums binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    some = one.groupBy("piece", "salt").applyInPandas(_add(np.float32), "piece int, sums binary")
    rows = some.groupBy("piece").applyInPandas(_add(np.float64), "piece int, sums binary").collect()
    out = np.zeros(int(np.prod(shape)))
    for r in rows:
        v = np.frombuffer(r["sums"], dtype=np.float64)
        out[r["piece"] * PIECE : r["piece"] * PIECE + len(v)] = v
    return out.reshape(shape)
