"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Statistics come from the bytes of many texts laid end to end: byte classes are summed between the texts' edges,
words and lines are told apart by hashes from running sums. Trees are grown from histograms of binned
statistics, on a bounded sample of labelled rows, and flattened into arrays of nodes; scoring walks all
trees for all texts of a batch, one level at a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vecloop.llm.common import BLANKS, pick, tidy
from vecloop.llm.fim import bounded, laid_out


@dataclass(frozen=True)
class Settings:
    """``most_rows``: labelled rows that are learned from, at most, those with the least hash of their id. ``trees`` of ``depth``, grown
    at ``rate``; ``bins`` of each statistic; ``ridge`` on leaves, and ``least_weight`` of a leaf; ``held_bytes``: texts measured at once."""

    most_rows: int = 20_000
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 64
    ridge: float = 1.0
    least_weight: float = 0.5
    held_bytes: int = 1 << 21


#: Byte classes whose share of the text is a statistic; bytes from 0x80 on belong to letters outside ASCII.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": BLANKS.encode(),
    "stop": b".,;:?'\"()-",
    "shout": b"!",
    "symbol": b"#*$%&|<>@^~_=+{}[]\\/`",
    "other": bytes(range(0x80, 0x100)),
}
STATISTICS = (
    "log_bytes", *CLASSES, "upper_of_letters", "words_log", "word_mean", "word_spread", "word_longest_log", "symbol_words", "different_words",
    "same_as_before", "same_pairs", "lines_log", "line_words", "repeated_lines", "open_lines", "entropy",
)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _i, _bytes in enumerate(CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _i
_NAMES = list(CLASSES)
_SYMBOLS = np.isin(_CLASS_OF, [_NAMES.index("symbol"), _NAMES.index("shout")])
_ENDS_LINE = np.zeros(256, bool)
_ENDS_LINE[list(b".!?:;")] = True


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    some = np.full(n, factor, np.uint64)
    if n:
        some[0] = 1
    return np.cumprod(some)


def _hashes(sums: np.ndarray, inverse: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each stretch of bytes, the same wherever it stands: sums of byte times power, shifted to the power 0."""
    found = (sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)
    found *= _MIX
    return found ^ (found >> np.uint64(29))


def _different(owner: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each of ``n`` owners has; ``owner`` is sorted."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[new], minlength=n)


def statistics(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` per text; an empty text has zeros."""
    n, sizes = len(edges) - 1, np.diff(edges)
    text_of = np.repeat(np.arange(n), sizes)
    per = lambda x, by: x / np.maximum(by, 1)
    found = {"log_bytes": np.log1p(sizes)}
    counts = np.bincount(text_of * 256 + data, minlength=256 * n).reshape(n, 256)
    for name, members in CLASSES.items():
        found[name] = per(counts[:, list(members)].sum(1), sizes)
    found["upper_of_letters"] = found["upper"] / np.maximum(found["upper"] + found["lower"], 1e-9)
    shares = per(counts, sizes[:, None])
    found["entropy"] = -(shares * np.log2(np.where(shares > 0, shares, 1))).sum(1)

    word = _CLASS_OF[data] != _NAMES.index("blank")
    begins, ends = word.copy(), word.copy()
    inner = np.zeros(len(data), bool)  # bytes whose neighbour before is of the same text
    inner[1:] = text_of[1:] == text_of[:-1]
    begins[1:] &= ~(word[:-1] & inner[1:])
    ends[:-1] &= ~(word[1:] & inner[1:])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = text_of[first]
    words = np.bincount(owner, minlength=n)
    lengths = (last - first).astype(float)
    found["words_log"] = np.log1p(words)
    found["word_mean"] = per(np.bincount(owner, lengths, minlength=n), words)
    spread = per(np.bincount(owner, lengths**2, minlength=n), words) - found["word_mean"] ** 2
    found["word_spread"] = np.sqrt(np.maximum(spread, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, lengths)
    found["word_longest_log"] = np.log1p(longest)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data], dtype=np.int64)])
    found["symbol_words"] = per(np.bincount(owner, symbols[last] > symbols[first], minlength=n), words)

    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_FACTOR, len(data)), dtype=np.uint64)])
    inverse = _powers(_INVERSE, len(data) + 1)
    keys = _hashes(sums, inverse, first, last)
    found["different_words"] = per(_different(owner, keys, n), words)
    follows = owner[1:] == owner[:-1]
    found["same_as_before"] = per(np.bincount(owner[1:][follows & (keys[1:] == keys[:-1])], minlength=n), words)
    pairs, of = (keys[:-1] * _FACTOR + keys[1:])[follows], owner[1:][follows]
    found["same_pairs"] = 1 - per(_different(of, pairs, n) + (words < 2), np.maximum(words - 1, 1))

    # Lines that hold a word: from the first byte after a line feed, or a text's first, to the next line feed.
    feed = data == ord("\n")
    starts = np.flatnonzero(~feed & ~np.concatenate([[False], (~feed[:-1]) & inner[1:]])) if len(data) else first
    stops = np.flatnonzero(~feed & ~np.concatenate([(~feed[1:]) & inner[1:], [False]])) + 1 if len(data) else last
    held = np.searchsorted(first, stops) - np.searchsorted(first, starts)
    starts, stops, held = starts[held > 0], stops[held > 0], held[held > 0]
    of = text_of[starts]
    lines = np.bincount(of, minlength=n)
    found["lines_log"] = np.log1p(lines)
    found["line_words"] = np.log1p(per(words, lines))
    found["repeated_lines"] = 1 - per(_different(of, _hashes(sums, inverse, starts, stops), n) + (lines == 0), lines)
    final = last[np.searchsorted(first, stops) - 1] - 1  # a line's last word's last byte
    found["open_lines"] = per(np.bincount(of, ~_ENDS_LINE[data[final]], minlength=n), lines)
    return np.stack([found[name] for name in STATISTICS], axis=1) * (sizes > 0)[:, None]


@dataclass
class Trees:
    """All nodes of all trees in a row: a node sends a text left if its ``statistic`` is at most ``limit``. A leaf leads to
    itself. ``roots`` are the trees' first nodes, ``base`` the log-odds to begin with."""

    base: float
    roots: np.ndarray
    statistic: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margins(self, rows: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None], len(rows), axis=0)
        at = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            node = np.where(rows[at, self.statistic[node]] <= self.limit[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -500, 500)))


def bin_limits(column: np.ndarray, bins: int) -> np.ndarray:
    """Values that part a statistic into at most ``bins`` bins; each bin holds its upper limit, the last has none."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))
        return values[values < column.max()]
    return values[:-1]


def best_splits(sums: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the gain, statistic and bin of its best split, from ``sums[gradient or weight, node, statistic, bin]``.
    Equal gains go to the first statistic, then the lowest bin."""
    below = np.cumsum(sums, axis=3)
    total = below[..., -1:]
    above = total - below
    part = lambda s: s[0] ** 2 / (s[1] + settings.ridge)
    gains = part(below) + part(above) - part(total)
    gains[(below[1] < settings.least_weight) | (above[1] < settings.least_weight)] = 0
    flat = gains.reshape(len(gains), -1)
    best = flat.argmax(1)
    return flat[np.arange(len(flat)), best], best // sums.shape[3], best % sums.shape[3]


def fit(rows: np.ndarray, labels: np.ndarray, settings: Settings = Settings()) -> Trees:
    """Boosting on the logistic loss. Without rows, or with one label only, there are no trees and every score is the smoothed share of label 1."""
    n, width = len(rows), len(STATISTICS)
    share = (labels.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    nodes: dict[str, list] = {k: [] for k in ("statistic", "limit", "left", "right", "value")}
    roots: list[int] = []

    def node() -> int:
        at = len(nodes["value"])
        for k, v in (("statistic", 0), ("limit", np.inf), ("left", at), ("right", at), ("value", 0.0)):
            nodes[k].append(v)
        return at

    limits = [bin_limits(rows[:, k], settings.bins) for k in range(width)] if n else []
    bins = max((len(x) + 1 for x in limits), default=1)
    binned = np.stack([np.searchsorted(x, rows[:, k]) for k, x in enumerate(limits)], axis=1) if n else np.zeros((0, width), int)
    columns = np.arange(width) * bins + binned
    margin = np.full(n, base)
    for _ in range(settings.trees if 0 < labels.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        kinds = labels - p, p * (1 - p)
        roots.append(node())
        place = np.full(n, roots[-1])
        open_ = [roots[-1]]
        for _ in range(settings.depth):
            if not open_:
                break
            slot = np.full(len(nodes["value"]), -1)
            slot[open_] = np.arange(len(open_))
            some = np.flatnonzero(slot[place] >= 0)
            at = (slot[place[some]][:, None] * (width * bins) + columns[some]).ravel()
            size = len(open_) * width * bins
            sums = np.stack([np.bincount(at, np.repeat(k[some], width), size) for k in kinds]).reshape(2, len(open_), width, bins)
            after = []
            for parent, gain, k, b in zip(open_, *(x.tolist() for x in best_splits(sums, settings))):
                if gain > 1e-9:
                    children = node(), node()
                    nodes["statistic"][parent], nodes["limit"][parent] = k, limits[k][b]
                    nodes["left"][parent], nodes["right"][parent] = children
                    own = some[place[some] == parent]
                    place[own] = np.where(binned[own, k] <= b, *children)
                    after += children
            open_ = after
        for leaf in np.unique(place).tolist():
            own = place == leaf
            nodes["value"][leaf] = settings.rate * kinds[0][own].sum() / (kinds[1][own].sum() + settings.ridge)
        margin += np.array(nodes["value"])[place]
    arrays = {k: np.array(v, np.float64 if k in ("limit", "value") else np.int64) for k, v in nodes.items()}
    return Trees(base, np.array(roots, np.int64), **arrays, depth=settings.depth)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def measured(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``rows`` with ``statistics array<double>`` in place of their ``text``."""
    kept = [c for c in rows.columns if c != "text"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in bounded(part, "text", settings.held_bytes):
                found = statistics(*laid_out(some.column("text")))
                edges = pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(STATISTICS))
                lists = pa.ListArray.from_arrays(edges, pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], lists], names=[*kept, "statistics"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.mapInArrow(tidy(run), ", ".join([*kinds, "statistics array<double>"]))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Trees:
    """Learn from ``docs (doc_id, text)`` that ``labels (doc_id, label)`` name and that are not held out.

    At most ``most_rows`` ids are learned from, which bounds what is sent to the tasks and what returns. An id labelled several times has the
    label of most of its rows, 1 if even; of several rows with one id the one with the least statistics is taken.
    """
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.most_rows).toArrow()
    if not sample.num_rows:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0), settings)
    chosen = docs.sparkSession.createDataFrame(sample, known.schema)
    found = measured(docs.join(F.broadcast(chosen), "doc_id"), settings)
    found = found.groupBy("doc_id").agg(F.min("statistics").alias("statistics"), F.first("label").alias("label")).toArrow().sort_by("doc_id")
    rows = found["statistics"].combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    return fit(rows, found["label"].to_numpy().astype(float), settings)


def score(docs: DataFrame, trees: Trees, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``score`` in place of their ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    kept = [c for c in docs.columns if c != "text"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in bounded(part, "text", settings.held_bytes):
                scores = sent.value.scores(statistics(*laid_out(some.column("text"))))
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], pa.array(scores)], names=[*kept, "score"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.mapInArrow(tidy(run), ", ".join([*kinds, "score double"]))


def classify(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """Learn from the labelled rows that are not held out, and score every row from its text alone: ``doc_id, held_out, score, predicted``.

    Null texts are scored as empty ones. Repeated rows get equal scores, equal texts too. Ids may be null: such rows are scored, not learned
    from. Texts of any length are measured as a whole. Without labels every score is 0.5. Other columns are not read. An empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    trees = train(rows, pick(labels, doc_id=id_col, label=label_col), settings)
    scored = score(rows.withColumn("held_out", held_out(F.col("doc_id"))), trees, settings)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
