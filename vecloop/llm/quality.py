"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Each rule's cost and share of rejected texts are measured on a sample; rules then run by rejections per
second, and a text's later rules are skipped once one rejects it. The order changes the work and the
name of the first rule that rejects, never the verdict.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecloop.llm.common import BLANKS, pick

#: Symbols counted by ``n_symbols``.
SYMBOLS = "#*$%&|<>"
#: Expected number of rows on which costs and rejections are measured.
SAMPLE_ROWS = 2000


class Features:
    """Measures of one whole text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of three words found twice or more."""
        words = self.words
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) == len(windows):
            return 0
        total = free = 0  # free: the first word not counted yet
        for i, window in enumerate(windows):
            if counts[window] > 1:
                total += i + 3 - max(i, free)
                free = i + 3
        return total


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


def _few_words(f: Features) -> bool:
    return f.n_words < 50


def _repeated_words(f: Features) -> bool:
    return 100 * f.n_repeat_words > 50 * f.n_words


def _symbols(f: Features) -> bool:
    return 100 * f.n_symbols > 10 * f.n_words


def _repeated_lines(f: Features) -> bool:
    return 100 * f.n_dup_lines > 40 * len(f.lines)


def _word_length(f: Features) -> bool:
    return not 3 * f.n_words <= f.word_chars <= 10 * f.n_words


BASE = ("few_words", "repeated_words")
RULES = (
    Rule("few_words", _few_words),
    Rule("repeated_words", _repeated_words),
    Rule("symbols", _symbols),
    Rule("repeated_lines", _repeated_lines),
    Rule("word_length", _word_length),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Seconds and rejections of each rule, each from a fresh text, over a Bernoulli sample of about ``sample_rows``."""
    texts = pick(docs, text=text_col)
    total = texts.count()
    share = min(1.0, sample_rows / total) if total else 1.0

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, n = [0.0] * len(rules), [0] * len(rules), 0
        for part in parts:
            for text in part.column(0).to_pylist():
                n += 1
                for i, rule in enumerate(rules):
                    begin = time.perf_counter()
                    rejected[i] += rule.rejects(Features(text))
                    seconds[i] += time.perf_counter() - begin
        yield pa.RecordBatch.from_pydict(
            {"rule": [r.name for r in rules], "seconds": seconds, "rejected": rejected, "n": [n] * len(rules)}
        )

    sums = [F.sum(c).alias(c) for c in ("seconds", "rejected", "n")]
    sampled = texts.sample(False, share, 42).mapInArrow(run, "rule string, seconds double, rejected bigint, n bigint")
    return [r.asDict() for r in sampled.groupBy("rule").agg(*sums).collect()]


def order_rules(rules: tuple[Rule, ...], measured: list[dict]) -> tuple[Rule, ...]:
    """By rejections per second, the most first; ties and rules without a measure by name."""
    rate = {m["rule"]: m["rejected"] / max(m["seconds"], 1e-9) for m in measured}
    return tuple(sorted(rules, key=lambda r: (-rate.get(r.name, 0.0), r.name)))


def verdict(features: Features, ordered: tuple[Rule, ...]) -> str | None:
    """The first rule that rejects the text; the rules after it are not evaluated."""
    for rule in ordered:
        if rule.rejects(features):
            return rule.name
    return None


_SCORES = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())]
)


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measures and verdict of every row: the cascade's order comes from a sample, its verdict covers all rows.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    rejected_by`` (the first rule in this run's order; null if kept). A null text has no words and fails
    the base rules; rows are judged alone, so ties and repeats don't matter; no rows give no rows.
    """
    ordered = order_rules(rules, measure(docs, rules, text_col, sample_rows))
    base = {r.name: r for r in RULES}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text in part.column(1).to_pylist():
                f = Features(text)
                by = verdict(f, ordered)
                failed = any(base[b].rejects(f) for b in BASE)
                rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, by is None and not failed, by))
            columns = list(zip(*rows)) or [[]] * 8
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(_SCORES)[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *arrays], schema=_SCORES)

    rows = pick(docs, doc_id=id_col, text=text_col)
    kinds = ", ".join(f"{c} bigint" for c in _SCORES.names[:6])
    return rows.mapInArrow(run, f"{kinds}, base_failed boolean, kept boolean, rejected_by string")
