"""A log-bilinear language model trained by noise-contrastive estimation, and text scores from it.

The score of unit w after units a, b is ``(A[a] + B[b]) . R[w] + bias[w]``: two context tables, one table of
targets. A unit is a word that occurs often enough, or a group of the other words, by their last letters. The
vocabulary grows with the corpus, as does the number of groups. Within a group a word has the add-0.1
unigram probability, so that all words, unseen ones too, share one normalised distribution.

Units lie in bands of neighbours by frequency, and bands are targets as well: a unit's probability is its
band's, times its own within the band. Both are normalised exactly, over some square root of the vocabulary each.

Counts cover all training tokens. Training runs over all training documents in rounds: each task
improves the model on its documents in numpy, and sends what it changed, by blocks of rows, which are
averaged on the executors. What goes through the driver is the model.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from vecloop.llm.common import pick
from vecloop.session import write_and_reread

#: The token that ends a text; a blank, so no word.
END = b"\n"
#: Added to every count.
SMOOTH = 0.1


@dataclass(frozen=True)
class Settings:
    """``vocabulary``: words of the model at least, the most frequent; ``lookup``: words at least whose counts
    go to all tasks (the rest are joined); ``width`` of the vectors; ``noise`` samples, ``band_noise`` of bands, and tokens per ``batch``;
    ``rounds`` of averaging, each over its share of the training documents; ``rate`` of AdaGrad."""

    vocabulary: int = 2047
    lookup: int = 200_000
    width: int = 32
    noise: int = 64
    band_noise: int = 16
    batch: int = 1024
    rounds: int = 4
    rate: float = 0.08
    seed: int = 1


@dataclass
class Counts:
    """Corpus counts: the whole table, its sums, and the words frequent enough to be sent to tasks; the words of
    the model, and tokens and distinct words in each group of the others."""

    table: DataFrame
    total: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray
    own: list[bytes]
    group_tokens: np.ndarray
    group_words: np.ndarray


class Units(dict):
    """Unit of each word: its place among the model's words, or after them that of its group."""

    def __init__(self, words: list[bytes], groups: int):
        super().__init__(zip(words, range(len(words))))
        self.groups = groups

    def __missing__(self, word: bytes) -> int:
        return len(self) + zlib.crc32(word[-3:]) % self.groups


def least_count(total: int) -> int:
    """Words that occur so often have a unit of their own. It grows slower than the corpus, so the vocabulary grows."""
    return max(5, isqrt(total) // 100)


def band_edges(units: int) -> np.ndarray:
    """Firsts of the bands, and the end. Bands of frequent units are small: their width grows as the root of the rank."""
    bands = ceil(0.6 * units**0.5)
    return np.unique(np.ceil(units * (np.arange(bands + 1) / bands) ** 2).astype(np.int64))


@dataclass
class Model:
    """``words[i]`` is unit i; the groups come next, and after all units the bands, if any. ``log_p`` is the units'
    unigram, then the bands'."""

    words: list[bytes]
    log_p: np.ndarray
    left: np.ndarray
    right: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    groups: int = 1

    PARTS = ("left", "right", "target", "bias")


def training(doc_id: Column) -> Column:
    """Whether a document is learned from: crc32 of its id as text, modulo 10, is not 0. A null id counts as empty text."""
    return _remainder(doc_id, 10) != 0


def _remainder(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a whole text, A-Z lower-cased, then the end."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """``tokens`` of texts (binary), laid end to end: how many each text has, for each token the place of its word, and the
    words, each once (one may be empty and without tokens), the end last."""
    lowered = pc.ascii_lower(pc.cast(pc.fill_null(texts, b""), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True)))
    split = pc.ascii_split_whitespace(lowered)
    found = split.flatten()
    real = pc.binary_length(found).to_numpy() > 0
    before = np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy()]
    lengths = np.diff(before) + 1
    encoded = found.dictionary_encode()
    words = encoded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    at = np.full(lengths.sum(), len(words), np.int64)
    inside = np.ones(len(at), bool)
    inside[np.cumsum(lengths) - 1] = False
    at[inside] = encoded.indices.to_numpy()[real]
    return lengths, at, [*words, END]


def pieces(parts: Iterator[pa.RecordBatch], column: int = 0, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows in smaller batches, of about ``size`` bytes of text or one row."""
    for part in parts:
        bytes_before = np.cumsum(pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy().astype(np.int64))
        edges = np.flatnonzero(np.diff(bytes_before // size)) + 1
        for first, last in zip([0, *edges.tolist()], [*edges.tolist(), part.num_rows]):
            if last > first:
                yield part.slice(first, last - first)


def count_tokens(texts: DataFrame, settings: Settings = Settings(), most_held: int = 300_000) -> Counts:
    """Counts of all tokens of ``texts (text)`` (binary), summed in each task before the shuffle."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            for i in range(0, len(items := list(held.items())), 50_000):
                some = items[i : i + 50_000]
                words, n = zip(*some)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], schema=schema)
            held.clear()

        for part in pieces(parts):
            _, at, words = coded(part.column(0))
            for word, n in zip(words, np.bincount(at, minlength=len(words)).tolist()):
                if n:
                    held[word] += n
            if len(held) > most_held:
                yield from flush()
        yield from flush()

    partial = texts.select("text").mapInArrow(run, "word binary, n bigint")
    table = write_and_reread(partial.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    # The least count with which at most `lookup` words are sent: from a histogram of some hundred steps.
    step = F.floor(F.log2("c") * 32).cast("int")
    steps = table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("c"), F.min("c").alias("least")).collect()
    room, least = settings.lookup, None
    for s in sorted(steps, key=lambda s: -s["step"]):
        room -= s["words"]
        if room < 0:
            break
        least = s["least"]
    total = sum(s["c"] for s in steps)
    if steps:
        least = min(least_count(total), least or total)
    sent = table.where(F.col("c") >= F.lit(least)).toArrow() if least is not None else None
    pairs = sorted(zip(sent["word"].to_pylist(), sent["c"].to_pylist()), key=lambda x: (-x[1], x[0])) if sent else []
    words, c = [w for w, _ in pairs], np.array([c for _, c in pairs], np.int64)
    own = words[: max(settings.vocabulary, int((c >= least_count(total)).sum()))]
    if END in words and END not in own:
        own[-1] = END
    return Counts(table, total, sum(s["words"] for s in steps), words, c, own, *group_sums(table, own))


def group_sums(table: DataFrame, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each group, from the whole table of counts."""
    groups = 1 + len(own) // 8
    sent = table.sparkSession.sparkContext.broadcast(own)
    schema = pa.schema([("group", pa.int32()), ("tokens", pa.int64()), ("words", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Units(sent.value, groups)
        sums = np.zeros((2, groups), np.int64)
        for part in parts:
            at = np.fromiter(map(of.__getitem__, part.column(0).to_pylist()), np.int64, part.num_rows) - len(of)
            some = at >= 0
            np.add.at(sums[0], at[some], part.column(1).to_numpy()[some])
            sums[1] += np.bincount(at[some], minlength=groups)
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[0][at]), pa.array(sums[1][at])], schema=schema)

    found = table.select("word", "c").mapInArrow(run, "group int, tokens bigint, words bigint")
    rows = found.groupBy("group").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).toArrow()
    sums = np.zeros((2, groups), np.int64)
    for line, name in zip(sums, ("tokens", "words")):
        line[rows["group"].to_numpy()] = rows[name].to_numpy()
    sent.unpersist()
    return sums[0], sums[1]


def start(counts: Counts, settings: Settings = Settings()) -> Model:
    """The unigram model of units and bands: contexts say nothing yet."""
    of = dict(zip(counts.words, counts.counts.tolist()))
    n = np.concatenate([[of[w] for w in counts.own], counts.group_tokens]) + SMOOTH
    p = n / n.sum()
    p = np.concatenate([p, np.add.reduceat(p, band_edges(len(p))[:-1])])
    rng = np.random.default_rng(settings.seed)
    shape = (len(p), settings.width)
    target = rng.normal(0, 0.3 / np.sqrt(settings.width), shape).astype(np.float32)
    zero = np.zeros(shape, np.float32)
    log_p = np.log(p).astype(np.float32)
    return Model(counts.own, log_p, zero, zero.copy(), target, log_p, len(counts.group_tokens))


class Trainer:
    """AdaGrad on the noise-contrastive objective, over batches of (before last, last, unit). The unit is told from
    noise units, and its band from noise bands. ``hits``: how often each row was learned from, as ``a``, as ``b`` and as target."""

    def __init__(self, model: Model, settings: Settings, seed: int):
        self.s = settings
        self.rng = np.random.default_rng([settings.seed, seed])
        self.units = len(model.words) + model.groups
        edges = band_edges(self.units)
        self.band = self.units + np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        p = np.exp(model.log_p.astype(np.float64))
        k = settings.noise, settings.band_noise
        self.drawn = [(k[0], 0, np.cumsum(p[: self.units])), (k[1], self.units, np.cumsum(p[self.units :]))]
        self.log_kq = model.log_p + np.log(np.repeat(k, [self.units, len(p) - self.units])).astype(np.float32)
        # The model that came in is shared by the worker's tasks; this one changes its own copy. A row's numbers lie beside its
        # sums of squares, so that a step finds them in one place.
        whole = np.concatenate([model.target, model.bias[:, None]], axis=1)
        self.tables = [np.concatenate([t, np.full_like(t, 1e-3)], axis=1) for t in (model.left, model.right, whole)]
        width = settings.width
        left, right, target = self.tables
        self.model = replace(model, left=left[:, :width], right=right[:, :width], target=target[:, :width], bias=target[:, width])
        # The same rows as one item each, which are written back faster.
        self.items = [t.view(f"V{t.shape[1] * t.itemsize}").ravel() for t in self.tables]
        self.room = [np.empty((settings.batch, n), np.float32) for n in k]
        self.hits = np.zeros((len(p), 3), np.int32)

    def _found(self, k: int, rows: np.ndarray) -> tuple:
        """Rows of a table, each once, and which of them every place needs; the places by row, and where a row's begin and end."""
        order = np.argsort(rows, kind="stable")
        ordered = rows.take(order)
        new = np.empty(len(rows) + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:-1])
        edges = np.flatnonzero(new)
        counts = edges[1:] - edges[:-1]
        inverse = np.empty(len(rows), np.int64)
        inverse[order] = np.repeat(np.arange(len(counts)), counts)
        once = ordered.take(edges[:-1])
        return once, self.tables[k].take(once, 0), inverse, order, edges[:-1], counts

    def _step(self, k: int, found: tuple, grad: np.ndarray) -> None:
        once, table, _, order, starts, counts = found
        summed = grad.take(order.take(starts), 0)
        # Few places are added as they are, since a call for each row and column takes longer; in the order in which reduceat adds.
        for n in (2, 3, 4):
            at = np.flatnonzero(counts == n)
            if len(at):
                first = starts.take(at)
                rest = grad.take(order.take(first + 1), 0)
                for j in range(2, n):
                    rest += grad.take(order.take(first + j), 0)
                summed[at] += rest
        several = counts > 4
        if several.any():
            among = counts[several]
            summed[several] = np.add.reduceat(grad.take(order[np.repeat(several, counts)], 0), np.cumsum(among) - among, axis=0)
        width = grad.shape[1]
        squares = table[:, width:]
        squares += summed * summed
        summed *= np.float32(self.s.rate)
        summed /= np.sqrt(squares)
        table[:, :width] += summed
        self.items[k].put(once, table.view(self.items[k].dtype).ravel())

    def learn(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        n, width = len(w), self.s.width
        drawn = []
        for noises, first, cumulative in self.drawn:
            some = np.searchsorted(cumulative, self.rng.random(noises) * cumulative[-1])
            drawn.append(first + np.minimum(some, len(cumulative) - 1))
        rows = np.concatenate([w, drawn[0], self.band.take(w), drawn[1]])
        found = [self._found(k, x) for k, x in enumerate((a, b, rows))]
        context = found[0][1][:, :width].take(found[0][2], 0)
        context += found[1][1][:, :width].take(found[1][2], 0)
        targets = found[2][1][:, : width + 1].take(found[2][2], 0)
        log_kq = self.log_kq.take(rows)
        to_context = np.zeros_like(context)
        to_target = np.empty((len(rows), width + 1), np.float32)
        at = 0
        for (noises, *_), room in zip(self.drawn, self.room):
            own, noise = slice(at, at + n), slice(at + n, at + n + noises)
            at += n + noises
            target, others = np.ascontiguousarray(targets[own, :width]), np.ascontiguousarray(targets[noise, :width])
            real = (context * target).sum(1) + targets[own, width] - log_kq[own]
            false = room[:n]
            np.matmul(context, others.T, out=false)
            false += targets[noise, width]
            false -= log_kq[noise]
            # d log-likelihood / d score: 1 - P(data) for real words, -P(data) for noise.
            up = 1 / (1 + np.exp(np.clip(real, -30, 30)))
            np.clip(false, -30, 30, out=false)
            np.negative(false, out=false)
            np.exp(false, out=false)
            false += 1
            down = np.divide(-1, false, out=false)
            target *= up[:, None]
            target += down @ others
            to_context += target
            np.multiply(up[:, None], context, out=to_target[own, :width])
            to_target[noise, :width] = down.T @ context
            to_target[own, width], to_target[noise, width] = up, down.sum(0)
            np.add.at(self.hits[:, 2], rows[noise], 1)
        self._step(0, found[0], to_context)
        self._step(1, found[1], to_context)
        self._step(2, found[2], to_target)

    def feed(self, ids: np.ndarray, firsts: np.ndarray, end: int) -> None:
        """Learn from texts laid end to end; ``firsts`` are the places of their first tokens."""
        a, b = contexts(ids, firsts, end)
        order = self.rng.permutation(len(ids))
        for k, x in enumerate((a, b, ids)):
            self.hits[:, k] += np.bincount(x, minlength=len(self.hits))
        self.hits[:, 2] += np.bincount(self.band[ids], minlength=len(self.hits))
        for i in range(0, len(ids), self.s.batch):
            some = order[i : i + self.s.batch]
            self.learn(a.take(some), b.take(some), ids.take(some))


def contexts(ids: np.ndarray, firsts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each; before a text's first token stand ends."""
    b = np.concatenate([[end], ids[:-1]])
    a = np.concatenate([[end, end], ids[:-2]])[: len(ids)]
    a[firsts] = b[firsts] = end
    second = firsts + 1
    a[second[second < len(ids)]] = end
    return a, b


def _units(model: Model) -> tuple[Units, int]:
    of = Units(model.words, model.groups)
    return of, of[END]


def train_round(texts: DataFrame, model: Model, settings: Settings, number: int) -> Model:
    """One round: every task learns from its texts; each row becomes the average of its tasks', by how often they learned from it."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    size = 256  # rows of a block
    columns = [settings.width, settings.width, settings.width + 1]
    schema = pa.schema([("block", pa.int32()), ("at", pa.binary()), ("hits", pa.binary()), ("change", pa.binary())])

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        of, end = _units(model)
        trainer = Trainer(model, settings, number * 1_000_003 + TaskContext.get().partitionId())

        def feed(ids: np.ndarray, lengths: np.ndarray):
            trainer.feed(ids, np.cumsum(lengths) - lengths, end)

        ids, lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        for part in pieces(parts):
            some, at, words = coded(part.column(0))
            units = np.fromiter(map(of.__getitem__, words), np.int64, len(words))
            ids, lengths = np.concatenate([ids, units[at]]), np.concatenate([lengths, some])
            # Whole texts are learned from together, until they have so many tokens.
            while len(ids) >= 200_000:
                until = 1 + int(np.searchsorted(np.cumsum(lengths), 200_000))
                n = int(lengths[:until].sum())
                feed(ids[:n], lengths[:until])
                ids, lengths = ids[n:], lengths[until:]
        if len(ids):
            feed(ids, lengths)
        changed = np.flatnonzero(trainer.hits.any(1))
        parts = zip(*[np.split(x, np.flatnonzero(np.diff(changed // size)) + 1) for x in (changed, trainer.hits[changed])])
        for at, hits in parts if len(changed) else ():
            change = np.concatenate([getattr(trainer.model, p)[at].reshape(len(at), -1) - getattr(model, p)[at].reshape(len(at), -1) for p in Model.PARTS], axis=1)
            row = {"block": at[0] // size, "at": (at % size).astype(np.int16).tobytes(), "hits": hits.tobytes(), "change": change.astype(np.float16).tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    def average(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part in parts:
            for r in part.to_pylist():
                if r["block"] not in sums:
                    sums[r["block"]] = np.zeros((size, 3)), np.zeros((size, sum(columns)))
                n, change = sums[r["block"]]
                at, hits = np.frombuffer(r["at"], np.int16), np.frombuffer(r["hits"], np.int32).reshape(-1, 3)
                n[at] += hits
                change[at] += np.repeat(hits, columns, axis=1) * np.frombuffer(r["change"], np.float16).reshape(len(at), -1).astype(np.float64)
        for block, (n, change) in sums.items():
            change /= np.repeat(np.maximum(n, 1), columns, axis=1)
            yield pa.RecordBatch.from_pylist([{"block": block, "at": b"", "hits": b"", "change": change.astype(np.float16).tobytes()}], schema=schema)

    kinds = "block int, at binary, hits binary, change binary"
    # A task reads what all have learned of some blocks only; there are more of them the larger the vocabulary.
    found = texts.select("text").mapInArrow(learn, kinds).repartition("block").mapInArrow(average, kinds).collect()
    sent.unpersist()
    # The driver's garbage holds on to the round's shuffle files.
    texts.sparkSession.sparkContext._jvm.System.gc()
    model = replace(model, **{p: getattr(model, p).copy() for p in Model.PARTS})
    while found:
        r = found.pop()
        rows = slice(r["block"] * size, (r["block"] + 1) * size)
        change = np.frombuffer(r["change"], np.float16).reshape(size, -1)
        for p, some in zip(Model.PARTS, np.split(change, np.cumsum([settings.width] * 3), axis=1)):
            own = getattr(model, p)[rows]
            own += some[: len(own)].reshape(own.shape)
    return model


def train(docs: DataFrame, counts: Counts, settings: Settings = Settings()) -> Model:
    """Train on ``docs (doc_id, text)``, all of them: each round takes the documents of one remainder of their text's hash."""
    model = start(counts, settings)
    for number in range(settings.rounds):
        share = F.pmod(F.xxhash64("text"), F.lit(settings.rounds)) == number
        model = train_round(docs.where(share), model, settings, number)
    return model


@dataclass
class Scorer:
    """Tables of a small model without bands: a token's log10 probability is ``left[a, w] + right[b, w] - norm[a, b]``."""

    left: np.ndarray
    right: np.ndarray
    norm: np.ndarray


def scorer(model: Model) -> Scorer:
    left = model.left @ model.target.T + model.bias
    right = model.right @ model.target.T
    top_left, top_right = left.max(1, keepdims=True), right.max(1, keepdims=True)
    norm = np.log(np.exp(left - top_left) @ np.exp(right - top_right).T) + top_left + top_right.T
    scale = np.float32(1 / np.log(10))
    return Scorer(left * scale, right * scale, norm * scale)


class Probabilities:
    """log10 probabilities of units after two others: of the band among the bands, and of the unit within its band."""

    def __init__(self, model: Model):
        units = len(model.words) + model.groups
        self.left, self.right = model.left, model.right
        rows = np.concatenate([model.target, model.bias[:, None]], axis=1)
        self.units, self.bands = rows[:units], rows[units:]
        self.edges = band_edges(units)
        self.band = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))

    @staticmethod
    def _shares(context: np.ndarray, rows: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Natural logarithms of the softmax over ``rows`` of the contexts ``at``, at ``own``."""
        norms = np.empty(len(context), np.float32)
        step = max(64, 100_000 // len(rows))
        room = np.empty((min(step, len(context)), len(rows)), np.float32)
        # No score is larger than the product of the lengths.
        small = np.sqrt(np.einsum("ij,ij->i", context, context).max(initial=0) * np.einsum("ij,ij->i", rows, rows).max(initial=0)) < 60
        for i in range(0, len(context), step):
            scores = np.matmul(context[i : i + step], rows.T, out=room[: len(context) - i])
            top = 0.0
            if not small and np.abs(scores).max() > 60:
                top = scores.max(1)
                scores -= top[:, None]
            np.exp(scores, out=scores)
            norms[i : i + step] = np.log(scores.sum(1)) + top
        shares = np.empty(len(at), np.float32)
        for i in range(0, len(at), 8192):
            some = at[i : i + 8192]
            shares[i : i + 8192] = np.einsum("ij,ij->i", context.take(some, 0), rows.take(own[i : i + 8192], 0)) - norms.take(some)
        return shares

    def of(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        band = self.band[w]
        # A context that stands in several places has one row; bands are scored once for it.
        pair, at = np.unique(a * len(self.left) + b, return_inverse=True)
        context = np.ones((len(pair), self.left.shape[1] + 1), np.float32)
        for i in range(0, len(pair), 4096):
            some = pair[i : i + 4096]
            np.add(self.left.take(some // len(self.left), 0), self.right.take(some % len(self.left), 0), out=context[i : i + 4096, :-1])
        logs = self._shares(context, self.bands, at, band)
        # Within a band, equal contexts lie together.
        order = np.argsort(band * len(pair) + at)
        band, at, own = band[order], at[order], w[order]
        firsts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        for i, j in zip(firsts.tolist(), [*firsts[1:].tolist(), len(band)]):
            first, last = self.edges[band[i]], self.edges[band[i] + 1]
            if last - first > 1:
                new = np.concatenate([[True], at[i + 1 : j] != at[i : j - 1]])
                logs[order[i:j]] += self._shares(context.take(at[i:j][new], 0), self.units[first:last], np.cumsum(new) - 1, own[i:j] - first)
        return logs / np.log(10)


_PARTS = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
     ("base", pa.float64()), ("score", pa.float64()), ("others", pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())])))]
)


def score(docs: DataFrame, counts: Counts, model: Model) -> DataFrame:
    """Scores of ``docs (doc_id, held_out, text)``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Words outside the lookup are counted by text and joined to the counts' table; a hot word is in the
    lookup, so the join has no hot key.
    """
    total, distinct = counts.total, counts.distinct
    base_norm = float(np.log10(total + SMOOTH * (distinct + 1)))
    group_norm = np.log10(counts.group_tokens + SMOOTH * (counts.group_words + 1))
    sent = docs.sparkSession.sparkContext.broadcast((model, counts.words, counts.counts, group_norm))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, c, group_norm = sent.value
        of, end = _units(model)
        odds = Probabilities(model)
        place = {w: i for i, w in enumerate(words)}
        unknown, own = len(words), len(model.words)
        logs = np.append(np.log10(c + SMOOTH), 0.0)
        # Unit of each word in the lookup, and what a word of a group adds; without its count if it is not in the lookup.
        kind = np.fromiter((of[w] for w in [*words, END]), np.int64, unknown + 1)
        norms = np.append(np.zeros(own), group_norm)
        within = np.where(kind >= own, logs, 0.0)
        based = logs - base_norm
        based[unknown] = 0.0
        row = TaskContext.get().partitionId() << 33

        for part in pieces(parts, 2, 1 << 22):
            n = part.num_rows
            lengths, at, found = coded(part.column(2))
            firsts = np.cumsum(lengths) - lengths
            places = np.fromiter(map(place.get, found, repeat(unknown)), np.int64, len(found))
            units = kind[places]
            for i in np.flatnonzero(places == unknown).tolist():
                units[i] = of[found[i]]
            ids, at, word = units[at], places[at], at
            # Words that are not in the lookup, by text.
            missing = np.flatnonzero(at == unknown)
            owner = np.searchsorted(firsts, missing, side="right") - 1
            pairs, tf = np.unique(owner * len(found) + word[missing], return_counts=True)
            edges = np.searchsorted(pairs, np.arange(n + 1) * len(found))
            others = pa.StructArray.from_arrays([pa.array(found, pa.binary()).take(pa.array(pairs % len(found))), pa.array(tf, pa.int32())], ["word", "tf"])
            a, b = contexts(ids, firsts, end)
            logs = within[at] - norms[ids]
            for i in range(0, len(ids), 1_000_000):
                some = slice(i, i + 1_000_000)
                logs[some] += odds.of(a[some], b[some], ids[some])
            columns = [
                pa.array(np.arange(row, row + n)),
                part.column(0),
                part.column(1),
                pa.array(lengths),
                pa.array(lengths - np.bincount(owner, minlength=n)),
                pa.array(np.add.reduceat(based[at], firsts)),
                pa.array(np.add.reduceat(logs, firsts)),
                pa.ListArray.from_arrays(pa.array(edges, pa.int32()), others),
            ]
            row += n
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, _PARTS)], schema=_PARTS)

    kinds = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, others array<struct<word:binary,tf:int>>"
    rows = docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, kinds)
    rows = write_and_reread(rows, "scores")
    words = rows.select("row", F.inline("others")).join(counts.table, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = F.log10(F.col("c") + F.lit(SMOOTH))
    known = F.when(F.col("c") > 0, F.col("tf")).otherwise(F.lit(0))
    sums = words.groupBy("row").agg(
        F.sum(known).alias("also_known"), F.sum(F.col("tf") * (log - base_norm)).alias("also_base"), F.sum(F.col("tf") * log).alias("also_score")
    )
    also = lambda c: F.coalesce(c, F.lit(0))
    return rows.drop("others").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + also("also_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + also("also_base")).alias("base_score"),
        (F.col("score") + also("also_score")).alias("score"),
    )


def score_documents(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the documents that are not held out, score all.

    Null and empty texts are the end token alone. Without training documents every token has
    probability 1 of being unseen, and scores are 0. Repeated rows are learned from and scored each.
    An empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(
        "doc_id", (~training(F.col("doc_id"))).alias("held_out"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")
    )
    learned = rows.where(~F.col("held_out"))
    counts = count_tokens(learned, settings)
    return score(rows, counts, train(learned, counts, settings))
