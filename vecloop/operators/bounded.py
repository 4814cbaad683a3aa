"""Cluster sums that skip points which cannot have changed their cluster.

With the cached points are kept, as of some earlier centres, each point's cluster, its distance, and a lower bound on its distance to
all others. By the triangle inequality a point is still nearest to the same centre while that distance, plus how far its centre
has moved, is below the bound, less how far any other has. Such a point costs one distance instead of K. The
bounds are not changed from one iteration to the next, only taken anew when they have become too weak.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecloop.operators.kmeans import nearest_in_block
from vecloop.operators.logistic import merge_partials
from vecloop.operators.model import MAX_MODEL_NUMBERS, check_size

#: Far more than distances are rounded by; what is closer than that is compared as the plain trainer does.
MARGIN = 1e-9


def with_bounds(points: DataFrame, centers: Sequence[Sequence[float]], max_model_numbers: int = MAX_MODEL_NUMBERS) -> DataFrame:
    """``(x, cid, upper, lower)``: the nearest centre, its distance, and at most the distance to any other."""
    model = np.asarray([list(c) for c in centers], dtype=np.float64)
    k, width = model.shape
    check_size(k * width, max_model_numbers)
    block = min(k, 1024)
    rows_per_slice = max(1, 1_000_000 // max(width, block))
    nearest, ids = nearest_in_block(), np.arange(k, dtype=np.int32)

    def lowest_other(x, cid):
        with np.errstate(over="ignore", invalid="ignore"):
            xx = np.einsum("ij,ij->i", x, x)
            lowest = np.full(len(x), np.inf)
            for first in range(0, k, block):
                some = model[first : first + block]
                cc = np.einsum("ij,ij->i", some, some)
                estimate = (-2 * some) @ x.T + cc[:, None]
                own = np.flatnonzero((cid >= first) & (cid < first + len(some)))
                estimate[cid[own] - first, own] = np.inf
                reach = (16 * width + 128) * 2.0**-53 * (xx + cc.max()) + 1e-300
                lowest = np.minimum(lowest, estimate.min(0) + xx - reach)
            # An unknown distance bounds nothing.
            return np.sqrt(np.maximum(np.where(np.isnan(lowest), 0, lowest), 0))

    def bound(batches):
        for batch in batches:
            rows = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for begin in range(0, len(rows), rows_per_slice):
                x = rows[begin : begin + rows_per_slice]
                best, cid = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int32)
                for first in range(0, k, block):
                    nearest(x, model[first : first + block], ids[first : first + block], best, cid)
                vectors = batch.column("x").slice(begin, len(x))
                columns = [vectors, pa.array(cid), pa.array(np.sqrt(best)), pa.array(lowest_other(x, cid))]
                yield pa.RecordBatch.from_arrays(columns, names=["x", "cid", "upper", "lower"])

    return points.select("x").mapInArrow(bound, "x array<double>, cid int, upper double, lower double")


def bounded_sums(
    bounded: DataFrame, of: Sequence[Sequence[float]], centers: Sequence[Sequence[float]], fan_in: int = 0
) -> DataFrame:
    """As ``kmeans.cluster_sums`` for ``centers``, from points with their bounds as of the centres ``of``; and ``skipped``, the points
    of a cluster that cost one distance."""
    old, model = (np.asarray([list(c) for c in m], dtype=np.float64) for m in (of, centers))
    k, width = model.shape
    moved = np.sqrt(((model - old) ** 2).sum(1))
    farthest = int(moved.argmax())
    others = np.full(k, moved[farthest])
    others[farthest] = np.delete(moved, farthest).max(initial=0)
    nearest, ids = nearest_in_block(), np.arange(k, dtype=np.int32)
    block = min(k, 1024)
    rows_per_slice = max(1, 1_000_000 // max(width, block))

    def partial_sums(batches):
        count, skipped, cost, total = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(k), np.zeros((k, width))
        for batch in batches:
            rows = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            kept, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "upper", "lower"))
            for begin in range(0, len(rows), rows_per_slice):
                some = slice(begin, begin + rows_per_slice)
                x, cid = rows[some], kept[some].copy()
                still = (upper[some] + moved[cid]) * (1 + MARGIN) < (lower[some] - others[cid]) * (1 - MARGIN)
                gap = x - model[cid]
                best = np.einsum("ij,ij->i", gap, gap)
                skipped += np.bincount(cid[still], minlength=k)
                at = np.flatnonzero(~still)
                if len(at):
                    d, c = np.full(len(at), np.inf), np.zeros(len(at), dtype=np.int32)
                    for first in range(0, k, block):
                        nearest(x[at], model[first : first + block], ids[first : first + block], d, c)
                    best[at], cid[at] = d, c
                count += np.bincount(cid, minlength=k)
                cost += np.bincount(cid, weights=best, minlength=k)
                order = np.argsort(cid, kind="stable")
                present, first = np.unique(cid[order], return_index=True)
                total[present] += np.add.reduceat(x[order], first, axis=0)
        used = np.flatnonzero(count + skipped)
        if len(used):
            yield pa.RecordBatch.from_pydict(
                {
                    "cid": pa.array(used.astype(np.int32)),
                    "n": pa.array(count[used]),
                    "cost": pa.array(cost[used]),
                    "skipped": pa.array(skipped[used]),
                    "g": pa.array(total[used].tolist(), pa.list_(pa.float64())),
                }
            )

    schema = "cid int, n bigint, cost double, skipped bigint, g array<double>"
    partials = bounded.mapInArrow(partial_sums, schema).withColumn("pid", F.spark_partition_id())
    return merge_partials(partials, width, fan_in, "cid")


class BoundedPoints:
    """Points with bounds, kept in memory over the iterations and taken anew once about all of them have cost K distances since."""

    def __init__(self, points: DataFrame, max_model_numbers: int = MAX_MODEL_NUMBERS):
        self.points, self.max_model_numbers = points, max_model_numbers
        self.bounded: DataFrame | None = None
        self.of: Sequence[Sequence[float]] = []
        self.spent = 0.0

    def sums(self, centers: Sequence[Sequence[float]], fan_in: int = 0) -> list:
        """Rows of ``bounded_sums``."""
        before = self.bounded
        if before is None or self.spent >= 1 or len(self.of) != len(centers):
            self.bounded = with_bounds(before or self.points, centers, self.max_model_numbers).persist()
            self.of, self.spent = centers, 0.0
        rows = bounded_sums(self.bounded, self.of, centers, fan_in).collect()
        if before is not None and before is not self.bounded:
            before.unpersist()
        self.spent += 1 - sum(r["skipped"] for r in rows) / max(1, sum(r["n"] for r in rows))
        return rows

    def release(self) -> None:
        if self.bounded is not None:
            self.bounded.unpersist()
