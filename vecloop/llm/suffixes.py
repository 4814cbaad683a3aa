"""Removal of repeated 50-byte strings by bucket-pointer refinement over the corpus.

Suffixes are sorted only as deep as it takes. A window (a string of ``LENGTH`` bytes) is put into a bucket
by the q-gram at its anchor, the least q-gram hash inside it; equal windows have equal anchors, and
neighbouring windows mostly share theirs, so a bucket holds some 6 % as many entries as there are bytes.
A bucket of one document is done. The others are refined by the bucket identifiers of later offsets:
the identifier of 40 bytes is made of those of two q-grams, and those of 50 bytes, and of a whole run of
windows with one anchor, of two of 40 bytes, each computed once and used again.

Round 1 sorts (q-gram, run identifier, document). A run that a smaller document has as well is removed; one
that no other run of its bucket can overlap is kept; only the rest is refined to single windows, which round 2
sorts by (window identifier, document). Documents are grouped into homes in a bucketed table, so that
verdicts are brought to the texts, and the texts never shuffled. Within a home, equal entries are merged
before they are sent: of a text copied everywhere one entry a home goes out.

Identifiers are hashes, not ranks, so no round needs a numbering of all buckets. An entry is at least 80
bits, compared within one bucket of the shuffle; q-gram collisions only make a bucket larger.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vecloop.llm.common import pick
from vecloop.llm.shingles import mix
from vecloop.session import fresh_path, remove, write_and_reread

LENGTH = 50
#: Length of a q-gram; twice that is below, four times that at least 2 * LENGTH - Q.
Q = 20
#: Bytes of text in a home, homes in a bucket of their table, and bytes per bucket of a round's shuffle.
HOME_BYTES = 8 << 20
HOMES = 2
BUCKET_BYTES = 16 << 20
_SEGMENT = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
# Fixed odd numbers for hashing: a base with its inverse modulo 2^64, and two factors.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_F1, _F2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)



def _powers(base: int) -> np.ndarray:
    factors = np.full(_SEGMENT + 2 * LENGTH, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_forward, _backward = _powers(_BASE), _powers(_INVERSE)


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier made of two: of an offset, and of a later one."""
    return mix(a * _F1 + mix(b) * _F2)


class Home:
    """Runs of windows with one anchor, in some documents; positions count from the first document's first byte."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids, self.texts = np.array(ids, np.int64), texts
        self.begin = np.cumsum([0] + [len(t) for t in texts])
        found = [self._segment(*s) for s in self._segments()]
        names = ("first", "last", "gram", "run", "doc")
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
        for name, column in zip(names, columns):
            setattr(self, name, column)

    def _segments(self) -> Iterator[tuple[int, list[int], list[bytes], list[int]]]:
        """Documents, or parts of a long one that share all but a byte of a window, in pieces of a bounded size."""
        numbers, pieces, at, size = [], [], [], 0
        for d, text in enumerate(self.texts):
            if len(text) < LENGTH:
                continue
            for start in range(0, len(text) - LENGTH + 1, _SEGMENT):
                piece = text[start : start + _SEGMENT + LENGTH - 1]
                if size + len(piece) > _SEGMENT and pieces:
                    yield numbers, pieces, at
                    numbers, pieces, at, size = [], [], [], 0
                numbers.append(d)
                pieces.append(piece)
                at.append(int(self.begin[d]) + start)
                size += len(piece)
        if pieces:
            yield numbers, pieces, at

    @staticmethod
    def _identifiers(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of all q-grams, and of all strings of twice their length."""
        data = np.frombuffer(raw, np.uint8)
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * _forward[:n], out=sums[1:])
        gram = mix((sums[Q:] - sums[:-Q]) * _backward[: n - Q + 1])
        return gram, _two(gram[:-Q], gram[Q:])

    def _segment(self, numbers: list[int], pieces: list[bytes], at: list[int]):
        raw = b"".join(pieces)
        gram, double = self._identifiers(raw)
        least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
        have, wide = 1, LENGTH - Q + 1
        while have < wide:
            step = min(have, wide - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        anchor = (least & _PLACE).astype(np.int64)
        lengths = np.array([len(p) for p in pieces])
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(pieces)), lengths)
        window = np.arange(len(anchor))
        window = window[window + LENGTH <= ends[owner[: len(anchor)]]]
        anchor, owner = anchor[window], owner[window]
        heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
        first, last = window[heads], window[np.append(heads[1:], len(window)) - 1]
        anchor, owner = anchor[heads], owner[heads]
        shape = ((anchor - first) * 64 + (last - first)).astype(np.uint64)
        run = mix(_two(double[first], double[last + LENGTH - 2 * Q]) + shape)
        shift = (np.array(at) - (ends - lengths))[owner]
        return first + shift, last + shift, gram[anchor], run, np.array(numbers)[owner]

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows of some runs: place, identifier of 64 and more bits as two columns, run's number."""
        counts = self.last[runs] - self.first[runs] + 1
        which = np.repeat(runs, counts)
        step = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = self.first[which] + step
        one, two = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint16)
        # Only the windows' own bytes are hashed again, text by text.
        doc = self.doc[which]
        heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, int)
        for a, b in zip(heads, np.append(heads[1:], len(doc))):
            text, base = self.texts[doc[a]], self.begin[doc[a]]
            local = place[a:b] - base
            for start in range(0, len(text) - LENGTH + 1, _SEGMENT):
                here = np.flatnonzero((local >= start) & (local < start + _SEGMENT))
                if len(here):
                    _, double = self._identifiers(text[start : start + _SEGMENT + LENGTH - 1])
                    p = local[here] - start
                    early, late = double[p], double[p + LENGTH - 2 * Q]
                    one[a + here] = _two(early, late)
                    two[a + here] = (_two(late, early) >> np.uint64(48)).astype(np.uint16)
        return place, np.stack([one, two.astype(np.uint64)]), which


def _classes(ids: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries merged by key (rows of columns): the class of each, and each class's key order and least id."""
    order = np.lexsort((ids, *key))
    sorted_ = key[:, order]
    new = np.concatenate([[True], (sorted_[:, 1:] != sorted_[:, :-1]).any(0)]) if len(order) else np.zeros(0, bool)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return of, order[new], ids[order[new]]


def _bytes_of(column: np.ndarray, n: int) -> bytes:
    """The low n bytes of each number."""
    return np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _numbers(blob: bytes, n: int) -> np.ndarray:
    wide = np.zeros((len(blob) // n, 8), np.uint8)
    wide[:, :n] = np.frombuffer(blob, np.uint8).reshape(-1, n)
    return wide.view("<u8").ravel()


_SENT = pa.schema([("bucket", pa.int32()), ("home", pa.int64()), ("one", pa.binary()), ("two", pa.binary()), ("docs", pa.binary()), ("which", pa.binary())])
_SENT_KINDS = "bucket int, home bigint, one binary, two binary, docs binary, which binary"
_SAID = pa.schema([("home", pa.int64()), ("round", pa.int32()), ("bucket", pa.int32()), ("place", pa.binary()), ("verdict", pa.binary())])
_SAID_KINDS = "home bigint, round int, bucket int, place binary, verdict binary"
COVERED, OPEN = 1, 2


class Entries:
    """A home's merged entries of a round, dealt to buckets by the first column of their key."""

    def __init__(self, ids: np.ndarray, key: np.ndarray, buckets: int):
        self.of, head, self.least = _classes(ids, key)
        self.key = key[:, head]
        bucket = (self.key[0] >> np.uint64(8)) % np.uint64(buckets)
        self.order = np.argsort(bucket, kind="stable")
        self.edges = np.searchsorted(bucket[self.order], np.arange(buckets + 1))

    def rows(self, home: int, sizes: tuple[int, int]) -> Iterator[tuple]:
        for bucket in np.flatnonzero(self.edges[1:] > self.edges[:-1]).tolist():
            some = self.order[self.edges[bucket] : self.edges[bucket + 1]]
            docs, which = np.unique(self.least[some], return_inverse=True)
            one, two = (_bytes_of(k[some], n) for k, n in zip(self.key, sizes))
            yield bucket, home, one, two, docs.astype("<i8").tobytes(), which.astype("<u2").tobytes()

    def verdicts(self, said: list[dict]) -> np.ndarray:
        """The verdict of each class, from the answers of all buckets."""
        result = np.zeros(len(self.least), np.uint8)
        for r in said:
            some = self.order[self.edges[r["bucket"]] : self.edges[r["bucket"] + 1]]
            result[some[np.frombuffer(r["place"], "<u4")]] = np.frombuffer(r["verdict"], np.uint8)
        return result


# Bytes sent of each key column, by round.
_SIZES = {1: (6, 6), 2: (8, 2)}


def _judge(round_: int):
    """Rows of one bucket after the other: which entries a smaller document has too, and (round 1) which stay open."""

    def decide(rows: list[dict]) -> Iterator[dict]:
        one = np.concatenate([_numbers(r["one"], _SIZES[round_][0]) for r in rows])
        two = np.concatenate([_numbers(r["two"], _SIZES[round_][1]) for r in rows])
        ids = np.concatenate([np.frombuffer(r["docs"], "<i8")[np.frombuffer(r["which"], "<u2")] for r in rows])
        order = np.lexsort((ids, two, one))
        one, two, least = one[order], two[order], ids[order]
        bucket = np.concatenate([[True], one[1:] != one[:-1]])
        group = bucket | np.concatenate([[True], two[1:] != two[:-1]])
        heads = np.flatnonzero(group)
        first = least[heads][np.cumsum(group) - 1]
        verdict = np.empty(len(order), np.uint8)
        judged = np.where(least > first, COVERED, 0)
        if round_ == 1:
            # A bucket whose runs all come first in the same document has nothing more to remove.
            starts = np.flatnonzero(bucket)
            of = np.cumsum(bucket) - 1
            differ = (np.minimum.reduceat(first, starts) != np.maximum.reduceat(first, starts))[of]
            judged = np.where((judged == 0) & differ, OPEN, judged)
        verdict[order] = judged
        at = 0
        for r in rows:
            n = len(r["which"]) // 2
            place = np.flatnonzero(verdict[at : at + n])
            if len(place):
                said = verdict[at : at + n][place]
                yield {"home": r["home"], "round": round_, "bucket": r["bucket"], "place": place.astype("<u4").tobytes(), "verdict": said.tobytes()}
            at += n

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for part in parts:
            for row in part.to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    yield from (pa.RecordBatch.from_pylist([x], schema=_SAID) for x in decide(held))
                    held = []
                held.append(row)
        if held:
            yield from (pa.RecordBatch.from_pylist([x], schema=_SAID) for x in decide(held))

    return run


def _home_of(table: pa.Table) -> tuple[int, Home, pa.Table]:
    table = table.sort_by("place")
    known = [i for i, x in enumerate(table["doc_id"].to_pylist()) if x is not None]
    known_rows = table.take(pa.array(known, pa.int64()))
    home = Home(known_rows["doc_id"].to_pylist(), [t or b"" for t in known_rows["text"].to_pylist()])
    return table["home"][0].as_py(), home, table


def _first_round(home: Home, buckets: int) -> Entries:
    low = np.uint64((1 << 48) - 1)
    return Entries(home.ids[home.doc], np.stack([home.gram & low, home.run & low]), buckets)


def _second_round(home: Home, first: Entries, verdict: np.ndarray, buckets: int):
    """Windows of the open runs of each class's least document; the same document may have several."""
    open_ = np.flatnonzero((verdict[first.of] == OPEN) & (home.ids[home.doc] == first.least[first.of]))
    place, key, which = home.windows(open_)
    return place, home.ids[home.doc[which]], Entries(home.ids[home.doc[which]], key, buckets)


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
)
_RESULT_KINDS = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _covered(home: Home, said: list[dict], buckets: int) -> np.ndarray:
    """Starts of the windows to remove, as (first, last) rows."""
    first = _first_round(home, buckets)
    verdict = first.verdicts([r for r in said if r["round"] == 1])
    ids = home.ids[home.doc]
    runs = (verdict[first.of] == COVERED) | (ids > first.least[first.of])
    place, owners, second = _second_round(home, first, verdict, buckets)
    judged = second.verdicts([r for r in said if r["round"] == 2])
    single = place[(judged[second.of] == COVERED) | (owners > second.least[second.of])]
    return np.concatenate([np.stack([home.first[runs], home.last[runs]], 1), np.stack([single, single], 1)])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, home_bytes: int = HOME_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row without the bytes of 50-byte strings that also start in a document with a smaller id.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and with ``texts`` the remaining bytes
    as ``kept``. Texts are judged as UTF-8 bytes on the input; a null text is empty, shorter ones lose
    nothing. Equal ids are not smaller than each other, so repeated rows lose the same bytes; rows
    without an id lose nothing and take nothing. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))

    def settle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = TaskContext.get().partitionId() << 33
        size = n = 0
        for part in parts:
            homes, places = [], []
            for length in (len(t) for t in part.column(1).to_pylist()):
                if n and (size + length > home_bytes or n >= 60_000):
                    home, size, n = home + 1, 0, 0
                homes.append(home)
                places.append(n)
                size, n = size + length, n + 1
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(homes, pa.int64()), pa.array(places, pa.int32())], names=["doc_id", "text", "home", "place"])

    # A bucket of the table is read by one task, so their number goes with the bytes. The table lies in the shared folder.
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (HOMES * home_bytes))
    table, path = f"vecloop_homes_{uuid.uuid4().hex}", fresh_path(spark, "homes")
    settled = rows.mapInArrow(settle, "doc_id bigint, text binary, home bigint, place int")
    settled.write.bucketBy(tasks, "home").option("path", path).saveAsTable(table, format="parquet")
    try:
        return _refine(spark.table(table), total, bucket_bytes, texts)
    finally:
        spark.sql(f"DROP TABLE {table}")
        remove(spark, path)


def _refine(settled: DataFrame, total: int, bucket_bytes: int, texts: bool) -> DataFrame:
    buckets = max(16, -(-total // bucket_bytes))
    by_home = settled.groupBy("home")

    def send_runs(table: pa.Table) -> pa.Table:
        number, home, _ = _home_of(table)
        return pa.Table.from_pylist([dict(zip(_SENT.names, r)) for r in _first_round(home, buckets).rows(number, _SIZES[1])], _SENT)

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _SENT.empty_table()
        number, home, _ = _home_of(left)
        first = _first_round(home, buckets)
        _, _, second = _second_round(home, first, first.verdicts(right.to_pylist()), buckets)
        return pa.Table.from_pylist([dict(zip(_SENT.names, r)) for r in second.rows(number, _SIZES[2])], _SENT)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _RESULT.empty_table()
        _, home, table = _home_of(left)
        starts = _covered(home, right.to_pylist(), buckets)
        change = np.zeros(home.begin[-1] + 1, np.int32)
        np.add.at(change, starts[:, 0], 1)
        np.add.at(change, starts[:, 1] + LENGTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        out, d = [], 0
        for doc_id, text in zip(table["doc_id"].to_pylist(), table["text"].to_pylist()):
            n_removed = n_spans = 0
            kept = text
            if doc_id is not None:
                part = gone[home.begin[d] : home.begin[d + 1]]
                n_removed = int(part.sum())
                if n_removed:
                    n_spans = int(part[0]) + int((part[1:] & ~part[:-1]).sum())
                    kept = np.frombuffer(text, np.uint8)[~part].tobytes()
                d += 1
            out.append((doc_id, len(text), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT)], schema=_RESULT)

    def judged(sent: DataFrame, round_: int) -> DataFrame:
        dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
        return write_and_reread(dealt.mapInArrow(_judge(round_), _SAID_KINDS), f"round{round_}")

    said = judged(by_home.applyInArrow(send_runs, _SENT_KINDS), 1)
    windows = by_home.cogroup(said.groupBy("home")).applyInArrow(send_windows, _SENT_KINDS)
    said = said.union(judged(windows, 2))
    result = by_home.cogroup(said.groupBy("home")).applyInArrow(finish, _RESULT_KINDS)
    return write_and_reread(result if texts else result.drop("kept"), "kept")
