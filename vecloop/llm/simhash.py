"""SimHash near-duplicates through tables of Hamming distances to reference fingerprints (pivots).

A pivot table holds a fingerprint's distances to many reference fingerprints. By the triangle inequality
two fingerprints within d bits differ by at most d in each coordinate, so pairs with a larger difference
are discarded unseen, and survivors are verified bit by bit.

So as not to look at all pairs, the table also deals the fingerprints out. Sixteen references differ from
the first one in one group of four bits each; ``distance to it - distance to the first`` counts the
bits that differ from the first in that group. Two bits flipped change these counts by at most 2 in all, so
two fingerprints that link have a point of the count lattice within one step of each. Each fingerprint is
sent to its own point and to the points one step away (at most 33), and only those that meet are compared.

A point where very many meet is passed on unread to a second deal by 64 references that differ from the
first in a single bit: there no more than 65 distinct fingerprints meet in a point, and all of them link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from vecloop.llm.common import hex64, pick, tidy
from vecloop.llm.components import connected_components
from vecloop.session import write_and_reread

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
#: Fingerprints that may meet in a point before it is dealt again.
MOST_IN_POINT = 2048
#: Counts per point: groups of four bits.
_GROUPS = 16

_FIRST = 0x0F1E2D3C4B5A6978  # the first reference; any fixed value does


def references(more: int = 16) -> np.ndarray:
    """The first reference, one per group of four bits, and ``more`` pseudo-random ones."""
    groups = [_FIRST ^ (0xF << (4 * g)) for g in range(_GROUPS)]
    spread = [xxhash.xxh64_intdigest(bytes([i]), seed=7) for i in range(more)]
    return np.array([_FIRST, *groups, *spread], np.uint64)


def pivot_table(fingerprints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances, a row per fingerprint and a column per reference."""
    return np.bitwise_count(fingerprints[:, None] ^ refs[None, :]).astype(np.int8)


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the hashes of a text's shingles, repeats included; 0 without a word."""
    words = text.lower().split()  # of bytes: A-Z and the six blanks only
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle_words)]))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
    totals = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.sum(0, dtype=np.int32)
    return sum(1 << i for i in np.flatnonzero(2 * totals > len(hashes)).tolist())


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (a signed long) of every row's whole text; null and wordless texts have 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [fingerprint(t or b"", shingle_words) for t in part.column(1).to_pylist()]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed)], schema=schema)

    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, fp bigint")


_POINTS = pa.schema([("point", pa.int64()), ("fp", pa.int64())])
_MET = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def points(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and lattice points (packed counts): each row's own and those one step away."""
    table = pivot_table(fps, references(0)).astype(np.int64)
    counts = (table[:, :1] - table[:, 1:] + 4) >> 1
    place = np.int64(8) ** np.arange(_GROUPS, dtype=np.int64)
    own = counts @ place
    row, moved = [np.arange(len(fps))], [own]
    for g in range(_GROUPS):
        for step, can in ((1, counts[:, g] < 4), (-1, counts[:, g] > 0)):
            row.append(np.flatnonzero(can))
            moved.append(own[can] + step * place[g])
    return np.concatenate(row), np.concatenate(moved)


def _deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        fps = part.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 4096):
            some = fps[i : i + 4096]
            row, point = points(some.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(some[row])], schema=_POINTS)


def linked(fps: np.ndarray, point: np.ndarray, max_distance: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``max_distance`` that meet in a point; both arrays sorted by point."""
    table = pivot_table(fps, refs)
    left, right = [], []
    ahead = 1
    at = np.arange(len(fps))
    while True:
        at = at[at + ahead < len(fps)]
        at = at[point[at] == point[at + ahead]]
        if not len(at):
            break
        for i in range(0, len(at), 1 << 15):
            a = at[i : i + (1 << 15)]
            b = a + ahead
            near = np.abs(table[a] - table[b]).max(1) <= max_distance  # else discarded
            a, b = a[near], b[near]
            same = np.bitwise_count(fps[a] ^ fps[b]) <= max_distance
            left.append(fps[a[same]])
            right.append(fps[b[same]])
        ahead += 1
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _meet(max_distance: int, most: int):
    """Rows sorted by point to links ``(a, b)``; members of overfull points come out as ``(a, null)``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = references()
        point, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        overfull = None

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            pairs = np.unique(np.stack([a.view(np.int64), b.view(np.int64)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=_MET)

        def alone(a: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64())], schema=_MET)

        def settle(point: np.ndarray, fps: np.ndarray):
            starts = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(point)]]))
            of_row = np.repeat(sizes, sizes)
            if (full := of_row > most).any():
                yield alone(fps[full])
            some = (of_row > 1) & ~full
            if some.any():
                a, b = linked(fps[some].view(np.uint64), point[some], max_distance, refs)
                if len(a):
                    yield out(a, b)

        for part in parts:
            point = np.concatenate([point, part.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, part.column(1).to_numpy(zero_copy_only=False)])
            if overfull is not None:
                still = point == overfull
                if still.any():
                    yield alone(fps[still])
                    point, fps = point[~still], fps[~still]
            if not len(point):
                continue
            # The last point may go on in the next batch.
            last = np.searchsorted(point, point[-1], "left")
            if last:
                yield from settle(point[:last], fps[:last])
                point, fps = point[last:], fps[last:]
            if len(point) > most:
                overfull = point[0]
                yield alone(fps)
                point, fps = point[:0], fps[:0]
        if len(point):
            yield from settle(point, fps)

    return run


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE, most_in_point: int = MOST_IN_POINT) -> DataFrame:
    """Links ``(a, b)`` that connect all of ``distinct (fp)`` within ``max_distance`` bits, at most 2.

    Every such pair is connected by the links, most of them directly; members of an overfull point
    through the least fingerprint of a finer point, in which all are within 2 bits of each other.
    """
    if max_distance not in (0, 1, 2):
        raise ValueError("max_distance must be 0, 1 or 2")
    if max_distance == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    dealt = distinct.select("fp").mapInArrow(tidy(_deal), "point bigint, fp bigint")
    sorted_ = dealt.repartition("point").sortWithinPartitions("point")
    met = write_and_reread(sorted_.mapInArrow(tidy(_meet(max_distance, most_in_point)), "a bigint, b bigint"), "met")

    again = met.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if max_distance == 1:  # a bit apart: the finer point is one of the two
        fine = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(_bit(i)))
        pairs = again.select("fp", F.explode(fine).alias("other")).join(again.select(F.col("fp").alias("other")), "other")
        finer = pairs.select(F.col("fp").alias("a"), F.col("other").alias("b")).where("a < b")
    else:
        fine = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(_bit(i))))
        meet = again.select("fp", F.explode(fine).alias("point"))
        least = F.min("fp").over(Window.partitionBy("point"))
        finer = meet.select(least.alias("a"), F.col("fp").alias("b")).where("a <> b")
    return met.where("b IS NOT NULL").union(finer)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(i, F.lit(0)))


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_in_point: int = MOST_IN_POINT,
) -> DataFrame:
    """Fingerprint and component of every row: ``doc_id, fp, component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``max_distance`` bits, a row's own
    id included. Texts with equal fingerprints are linked, however many. Null and wordless texts have
    fingerprint 0 and link like others. A null id is never the smallest; a component of null ids has
    null. Repeated rows get equal results. An empty table gives no rows.

    Copies are collapsed to distinct fingerprints first; the rest works on those.
    """
    rows = write_and_reread(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    distinct = write_and_reread(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(distinct, max_distance, most_in_point))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def component_digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
