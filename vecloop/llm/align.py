"""Alignment of two tokenizers' tokens by byte offsets, all documents of a batch in lockstep.

Both tokenizers cut the same bytes. A lane is a document, or a part of a long one, with a pointer into its A and one
into its B tokens. In each step every lane links the two tokens it points at; the one that ends first is
passed, both where they end together, which is a cut between groups. Lanes that reach their end are taken out, so a step costs
what is still open. Long documents are dealt to several lanes that begin at cuts, or a
batch would wait for its longest document.

How often an id pair is linked in the whole corpus is counted from blocks: a block holds some million links as
places in its own list of different pairs, so a pair is sent once per block, for counting and for the answer.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from vecloop.llm.common import pick, tidy
from vecloop.llm.fim import bounded
from vecloop.session import write_and_reread

#: How GPT-2 cuts texts before merging: the rule that files of this kind name as ByteLevel with use_regex.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Settings:
    """``held_bytes``: texts aligned at once; ``lane``: A tokens of a lane, about; ``window``: tokens searched for a cut that a lane
    can begin at (without one the lane goes on); ``block_links``: links of a block, more only for a single longer document; ``task_blocks``: blocks
    that get their counts in one task, about."""

    held_bytes: int = 1 << 20
    lane: int = 1024
    window: int = 64
    block_links: int = 400_000
    task_blocks: int = 16


def byte_level_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable ones of Latin-1 for themselves, the rest from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """A byte-level BPE of a ``tokenizers`` file.

    If its ids are in the order of its merges, ids serve as ranks and ``tiktoken`` encodes, with the same result four times
    as fast; any other file goes through ``tokenizers``.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        names = {i: entry for entry, i in content["model"]["vocab"].items()} | {t["id"]: t["content"] for t in content["added_tokens"]}
        letters = byte_level_letters()
        self.bytes = [self._bytes(names.get(i, ""), letters) for i in range(max(names, default=-1) + 1)]
        self.fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=self._ranks(content), special_tokens={}) if self._ordered(content) else None

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The library's own, loaded where it is needed."""
        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    @staticmethod
    def _bytes(entry: str, letters: dict[str, int]) -> bytes:
        return bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()

    def _ranks(self, content: dict) -> dict[bytes, int]:
        return {self.bytes[i]: i for i in content["model"]["vocab"].values()}

    @staticmethod
    def _ordered(content: dict) -> bool:
        model, before = content["model"], content["pre_tokenizer"]
        if content["normalizer"] or before != before | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            return False
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return False
        vocab, letters = model["vocab"], byte_level_letters()
        merged = [vocab.get(a + b, -1) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        single = [vocab.get(c, -1) for c in letters]
        rising = all(x < y for x, y in zip(merged, merged[1:]))
        return rising and len(vocab) == len(merged) + 256 and min(single) >= 0 and max(single) < min(merged, default=1 << 31)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast:
            return [self.fast.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens:
    """A SentencePiece model; its pieces' bytes."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.model.id_to_piece(i)) for i in range(self.model.vocab_size()))
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@dataclass
class Side:
    """Tokens of all documents of a batch, end to end: ids, where they end among the bytes of all, and each document's first."""

    ids: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)


@dataclass
class Alignment:
    """Of a batch: both sides; for each cut the tokens of either side up to it, and cuts of each document; links as
    (a, b) in one number and links of each document, in the documents' order."""

    a: Side
    b: Side
    cut_a: np.ndarray
    cut_b: np.ndarray
    cut_firsts: np.ndarray
    links: np.ndarray
    link_firsts: np.ndarray


class Aligner:
    """Two tokenizers by their files, the same on every executor."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        self.b_ids = len(self.b.bytes)
        # Ids as text with what follows them, for the digest of groups.
        self.texts = [[b"%d%s" % (i, after) for after in (b",", b"|", b";") for i in range(max(len(self.a.bytes), self.b_ids))]]

    def encode(self, texts: list[str | None]) -> tuple[Side, Side]:
        """Tokens of every text; none where a side's bytes are not the text's."""
        known = [t or "" for t in texts]
        spaced = [" " + t for t in known]
        a, b = self.a.encode(spaced), self.b.encode(known)
        for i, text in enumerate(spaced):
            whole = text.encode()
            if len(whole) == 1 or any(b"".join(map(side.bytes.__getitem__, ids[i])) != whole for side, ids in ((self.a, a), (self.b, b))):
                a[i] = b[i] = []
        return self._side(a, self.sizes[0]), self._side(b, self.sizes[1])

    @staticmethod
    def _side(lists: list[list[int]], sizes: np.ndarray) -> Side:
        firsts = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
        ids = np.fromiter((i for x in lists for i in x), np.int32, firsts[-1])
        return Side(ids, np.cumsum(sizes[ids]), firsts)

    def align(self, texts: list[str | None], settings: Settings = Settings()) -> Alignment:
        a, b = self.encode(texts)
        return lockstep(a, b, self.b_ids, settings)

    def group_digests(self, found: Alignment) -> list[bytes]:
        """Groups of each document as ``a1,a2|b1;a3|b2,b3``."""
        a, b = found.a, found.b
        size = len(self.texts[0]) // 3
        laid = np.empty(len(a.ids) + len(b.ids), np.int64)
        # A group's A tokens stand after all B tokens of earlier groups, its B tokens after its own A tokens.
        before_a, before_b = np.diff(found.cut_a, prepend=0), np.diff(found.cut_b, prepend=0)
        group_a = np.repeat(found.cut_b - before_b, before_a)
        group_b = np.repeat(found.cut_a, before_b)
        laid[np.arange(len(a.ids)) + group_a] = a.ids
        laid[np.arange(len(b.ids)) + group_b] = b.ids
        laid[found.cut_b - before_b + found.cut_a - 1] += size
        laid[found.cut_a + found.cut_b - 1] += 2 * size
        parts = b"".join(map(self.texts[0].__getitem__, laid.tolist()))
        # Where each document's text ends: lengths of decimals, and one more for what follows.
        decimals = np.array([len(x) for x in self.texts[0]], np.int64)[laid]
        ends = np.concatenate([[0], np.cumsum(decimals)])[a.firsts + b.firsts]
        return [parts[x : max(x, y - 1)] for x, y in zip(ends.tolist(), ends[1:].tolist())]


def lanes(a: Side, b: Side, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First A and B token of each lane, and the end of its A tokens; in the documents' order."""
    some = a.counts > 0
    # Candidates: a window of A tokens around every so many; the first whose end is a B token's end begins a lane behind it.
    each = np.maximum(a.counts // settings.lane - 1, 0)
    owner = np.repeat(np.arange(len(a.counts)), each)
    nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + 1
    around = (a.firsts[owner] + nth * settings.lane)[:, None] + np.arange(min(settings.window, settings.lane))
    ends = a.ends[around]
    at = np.searchsorted(b.ends, ends)
    hit = b.ends[np.minimum(at, len(b.ends) - 1)] == ends if len(b.ends) else np.zeros(ends.shape, bool)
    row = np.flatnonzero(hit.any(1))
    column = hit[row].argmax(1)
    from_a = np.concatenate([a.firsts[:-1][some], around[row, column] + 1])
    from_b = np.concatenate([b.firsts[:-1][some], at[row, column] + 1])
    order = np.argsort(from_a, kind="stable")
    from_a, from_b = from_a[order], from_b[order]
    return from_a, from_b, np.append(from_a[1:], len(a.ids))


def lockstep(a: Side, b: Side, b_ids: int, settings: Settings) -> Alignment:
    """All lanes at once, a link of each at a step."""
    i, j, stop = lanes(a, b, settings)
    lane = np.arange(len(i))
    most = len(a.ids) + len(b.ids)
    links, owners = np.empty(most, np.int64), np.empty(most, np.int32)
    cuts: list[tuple[np.ndarray, np.ndarray]] = []
    made = 0
    while len(lane):
        links[made : made + len(lane)] = a.ids[i] * np.int64(b_ids) + b.ids[j]
        owners[made : made + len(lane)] = lane
        made += len(lane)
        a_end, b_end = a.ends[i], b.ends[j]
        i = i + (a_end <= b_end)
        j = j + (b_end <= a_end)
        both = a_end == b_end
        cuts.append((i[both], j[both]))
        open_ = i < stop
        if not open_.all():
            i, j, stop, lane = i[open_], j[open_], stop[open_], lane[open_]
    cut_a = np.concatenate([x for x, _ in cuts] or [np.zeros(0, np.int64)])
    cut_b = np.concatenate([x for _, x in cuts] or [np.zeros(0, np.int64)])
    order = np.argsort(cut_a, kind="stable")
    cut_a, cut_b = cut_a[order], cut_b[order]
    cut_firsts = np.searchsorted(cut_a, a.firsts, side="right")
    # Each overlap is a link: tokens of both sides, less one for every common end.
    counts = a.counts + b.counts - np.diff(cut_firsts)
    links = links[:made][np.argsort(owners[:made], kind="stable")]
    return Alignment(a, b, cut_a, cut_b, cut_firsts, links, np.concatenate([[0], np.cumsum(counts)]))


def align_documents(docs: DataFrame, a_path: str, b_path: str, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignments themselves: ``doc_id, a_ids, b_ids, a_cuts, b_cuts``; group k has the A tokens from ``a_cuts[k-1]``
    (0 at first) up to ``a_cuts[k]``, and B tokens likewise.

    Null and empty texts have empty lists, as have texts that a tokenizer changes. Each row is aligned alone, so ties,
    repeated rows and null ids change nothing. Any length of text is aligned as a whole. An empty table gives no rows.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Aligner(a_path, b_path)  # for this task: a worker that waits holds none
        for part in parts:
            for some in bounded(part, "text", settings.held_bytes):
                found = tokenizers.align(some.column("text").to_pylist(), settings)
                cuts = np.diff(found.cut_firsts)
                lists = [
                    (found.a.ids, found.a.firsts),
                    (found.b.ids, found.b.firsts),
                    (found.cut_a - np.repeat(found.a.firsts[:-1], cuts), found.cut_firsts),
                    (found.cut_b - np.repeat(found.b.firsts[:-1], cuts), found.cut_firsts),
                ]
                columns = [pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(x, pa.int32())) for x, firsts in lists]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *columns], names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


_DOCUMENT = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_BLOCK = "block bigint, docs array<struct<doc_id:{id},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>, places binary, pairs array<bigint>, times array<bigint>"


def blocks(docs: DataFrame, a_path: str, b_path: str, settings: Settings) -> DataFrame:
    """Documents aligned, a row per block: their figures, ``places`` of their links (32 bits each) among the block's
    different ``pairs``, and how often each of those is linked in it."""
    from hashlib import sha256

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Aligner(a_path, b_path)  # for this task: a worker that waits holds none
        number = TaskContext.get().partitionId() << 40
        figures: list[pa.StructArray] = []
        links: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            pairs, places, times = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
            held = pa.concat_arrays(figures)
            columns = [
                pa.array([number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held),
                pa.array([places.astype(np.int32).tobytes()], pa.binary()),
                *[pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(x, pa.int64())) for x in (pairs, times)],
            ]
            figures.clear()
            links.clear()
            number += 1
            return pa.RecordBatch.from_arrays(columns, names=["block", "docs", "places", "pairs", "times"])

        held = 0
        for part in parts:
            for some in bounded(part, "text", settings.held_bytes):
                found = tokenizers.align(some.column("text").to_pylist(), settings)
                n_links = np.diff(found.link_firsts)
                digests = [sha256(x).hexdigest() if x else "" for x in tokenizers.group_digests(found)]
                counts = [found.a.counts, found.b.counts, np.diff(found.cut_firsts), n_links]
                columns = [some.column("doc_id"), *[pa.array(x, pa.int64()) for x in counts], pa.array(digests, pa.string())]
                if held and held + len(found.links) > settings.block_links:
                    yield block()
                    held = 0
                figures.append(pa.StructArray.from_arrays(columns, names=["doc_id", *[name for name, _ in _DOCUMENT]]))
                links.append(found.links)
                held += len(found.links)
        if figures:
            yield block()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), _BLOCK.format(id=kind))


def pair_counts(held: DataFrame, b_ids: int) -> DataFrame:
    """``pair, count, best`` over the corpus; ``best``: no id is linked more often to the pair's B id.

    Each block adds one row a pair. The highest counts are a row per B id, of which there are no more than the
    tokenizer has: that bounds what the join broadcasts.
    """
    sums = held.select(F.arrays_zip("pairs", "times").alias("z")).select(F.inline("z")).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    counts = write_and_reread(sums, "pairs").withColumn("b", F.pmod("pair", F.lit(b_ids)))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def count_links(docs: DataFrame, a_path: str, b_path: str, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``n_best``: links whose id pair has the highest count of its B id in the corpus, ties included; ``count_sum``: the counts of all links' id
    pairs together. Repeated rows count each. Null and empty texts and those that a tokenizer changes have zeros and an empty
    digest. Null ids are kept. Any length of text is aligned as a whole; other columns of ``docs`` are not read. An empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    held = write_and_reread(blocks(rows, a_path, b_path, settings), "blocks")
    b_ids = sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    counts = pair_counts(held, b_ids)
    asked = held.select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    # The pairs grow with the documents: merged at every size, never a broadcast.
    answers = asked.join(counts.hint("merge"), "pair").select("of", "place", "count", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.combine_chunks().to_batches()[0]
        figures = block.column("docs").flatten()
        size = right.num_rows
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = right.column("place").to_numpy()
        count[at] = right.column("count").to_numpy()
        best[at] = right.column("best").to_numpy()
        places = np.frombuffer(block.column("places")[0].as_buffer(), np.int32)
        firsts = np.concatenate([[0], np.cumsum(figures.field("n_links").to_numpy())])
        sums = [np.diff(np.concatenate([[0], np.cumsum(x[places])])[firsts]) for x in (best, count)]
        columns = {name: figures.field(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        columns |= {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups_sha256": figures.field("groups_sha256")}
        return pa.table(columns)

    # Some blocks a task, however many there are: a group can't be split later.
    tasks = max(1, held.count() // settings.task_blocks)
    result = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    left, right = held.select("block", "docs", "places").repartition(tasks, "block"), answers.repartition(tasks, "of")
    sides = left.groupBy("block"), right.groupBy("of")
    return sides[0].cogroup(sides[1]).applyInArrow(run, result)
