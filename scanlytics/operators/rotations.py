"""Groups of rooms that were captured in one orientation, found in the order of capture."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN = (0, 1, 2, 4, 5, 6, 8, 9, 10)  # the rotation in a column-major 4 x 4 transform


def _grouper(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rooms come floor by floor, in order; only the first rooms of the floor's groups are held."""
        floor, firsts = None, np.zeros((0, 9))
        for batch in batches:
            t = batch.column("t")
            turns = t.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 16)[:, TURN]
            keys, out = list(zip(*(batch.column(c).to_pylist() for c in ("uuid", "floor")), strict=True)), np.zeros(len(turns), np.int64)
            for i, key in enumerate(keys):
                if key != floor:
                    floor, firsts = key, np.zeros((0, 9))
                angle = np.degrees(np.arccos(np.clip((firsts @ turns[i] - 1) / 2, -1, 1)))
                near = np.flatnonzero(angle < threshold)
                if len(near):
                    out[i] = near[0]
                else:
                    out[i] = len(firsts)
                    firsts = np.vstack([firsts, turns[i]])
            kept = [batch.column(c) for c in ("uuid", "floor", "seq")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out)], names=["uuid", "floor", "seq", "rotation_group"])

    return group


def floor_rotation_groups(rooms: DataFrame, threshold: float = 1.0) -> DataFrame:
    """``uuid, floor, seq, rotation_group``: rooms (``uuid, floor, seq, created, t``) by the first group, in order of capture, whose first room is turned by less than ``threshold`` degrees against them.

    Rooms are taken by ``created`` (null or 0 first), then ``seq``; rooms without 16 numbers take no part. The order decides, so a floor is one stream
    through one task, which holds one rotation for each of the floor's groups and no rooms: there is no limit of size.
    """
    rows = rooms.where("size(t) = 16").select("uuid", "floor", "seq", F.coalesce("created", F.lit(0.0)).alias("created"), F.transform("t", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("t"))
    rows = rows.repartition("uuid", "floor").sortWithinPartitions("uuid", "floor", "created", "seq")
    kinds = {c: rooms.schema[c].dataType.simpleString() for c in ("uuid", "floor", "seq")}
    return rows.select("uuid", "floor", "seq", "t").mapInArrow(_grouper(threshold), ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", rotation_group long")


def rotation_summary(rooms: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (``n_rooms, avg_yaw, time_start, time_end``; times of 0 do not count) and floors (``n_rooms, n_analyzed, n_groups, restart``)."""
    both = groups.join(rooms.select("uuid", "floor", "seq", "yaw", "created"), ["uuid", "floor", "seq"])
    when = F.when(F.col("created") != 0, F.col("created"))
    by_group = both.groupBy("uuid", "floor", "rotation_group").agg(F.count("*").alias("n_rooms"), F.avg("yaw").alias("avg_yaw"), F.min(when).alias("time_start"), F.max(when).alias("time_end"))
    found = groups.groupBy("uuid", "floor").agg(F.count("*").alias("n_analyzed"), (F.max("rotation_group") + 1).alias("n_groups"))
    by_floor = rooms.groupBy("uuid", "floor").agg(F.count("*").alias("n_rooms")).join(found, ["uuid", "floor"], "left").fillna(0, ["n_analyzed", "n_groups"])
    return by_group, by_floor.withColumn("restart", F.col("n_groups") > 1)
