"""Scores of the language model, recomputed token by token from its trained parameters."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vecloop.llm import lm


def plain_scores(texts, counts, model, tally):
    """log10 probabilities of texts: of the band, of the unit in its band, and of the word in its group."""
    of = lm.Units(model.words, model.groups)
    units, end = len(model.words) + model.groups, of[lm.END]
    edges = lm.band_edges(units)
    rows = np.concatenate([model.target, model.bias[:, None]], axis=1).astype(np.float64)

    def log_share(context, among, own):
        scores = among @ context
        return scores[own] - scores.max() - math.log(np.exp(scores - scores.max()).sum())

    for text in texts:
        total, a, b = 0.0, end, end
        for word in lm.tokens(text):
            unit = of[word]
            context = np.append(model.left[a].astype(np.float64) + model.right[b], 1.0)
            band = int(np.searchsorted(edges, unit, side="right")) - 1
            first, last = edges[band], edges[band + 1]
            total += (log_share(context, rows[units:], band) + log_share(context, rows[first:last], unit - first)) / math.log(10)
            if unit >= len(model.words):
                group = unit - len(model.words)
                total += math.log10((tally[word] + 0.1) / (counts.group_tokens[group] + 0.1 * (counts.group_words[group] + 1)))
            a, b = b, unit
        yield total


@pytest.mark.parametrize("lookup, vocabulary", [(10, 8), (200_000, 40)])
def test_scores_from_the_parameters(spark, lookup, vocabulary):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in (rng.pareto(1, rng.integers(1, 60)) * 5).astype(int)) for _ in range(80)] + ["", "never seen words", "W1 w1"]
    rows = spark.createDataFrame([(i, i % 5 == 0, t.encode()) for i, t in enumerate(texts)], "doc_id bigint, held_out boolean, text binary").repartition(3)
    learned = rows.where("NOT held_out")
    settings = lm.Settings(lookup=lookup, vocabulary=vocabulary, width=8, noise=6, band_noise=3, batch=64, rounds=2)
    counts = lm.count_tokens(learned, settings)
    model = lm.train(learned, counts, settings)
    assert np.abs(model.left).max() > 0  # it has learned something
    tally = Counter(w for i, t in enumerate(texts) if i % 5 for w in lm.tokens(t.encode()))
    found = {r["doc_id"]: r["score"] for r in lm.score(rows, counts, model).collect()}
    expected = list(plain_scores([t.encode() for t in texts], counts, model, tally))
    for i, value in enumerate(expected):
        assert found[i] == pytest.approx(value, rel=1e-4, abs=1e-4)


def test_coded_texts_have_the_same_tokens():
    texts = ["", " ", "a", "  B a\x0b\x0cA\r\n", "\x1fx\x85 \xa0É É", None, "<\x00> \x1c", "b\n" * 500]
    encoded = [None if t is None else t.encode() for t in texts]
    lengths, at, words = lm.coded(pa.array(["left out".encode(), *encoded], pa.binary()).slice(1))
    expected = [lm.tokens(t) for t in encoded]
    assert lengths.tolist() == [len(t) for t in expected]
    assert [words[i] for i in at] == [w for t in expected for w in t]
    assert len(set(words)) == len(words)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_pieces_hold_every_row_once(size):
    texts = [b"x" * n for n in (0, 3, 20, 0, 5, 0)] + [None, b"yy"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts, pa.binary())], names=["id", "text"])
    found = list(lm.pieces(iter([batch, batch.slice(0, 0), batch.slice(3)]), 1, size))
    assert [i for p in found for i in p.column(0).to_pylist()] == [*range(8), *range(3, 8)]
    assert all(p.num_rows for p in found)


def test_a_context_is_normalised_once(monkeypatch):
    units = 40
    rng = np.random.default_rng(2)
    bands = len(lm.band_edges(units)) - 1
    make = lambda: rng.normal(0, 1, (units + bands, 4)).astype(np.float32)
    model = lm.Model([b"%d" % i for i in range(units - 1)], np.zeros(units + bands, np.float32), make(), make(), make(), np.zeros(units + bands, np.float32), 1)
    shares, sizes = lm.Probabilities._shares, []
    monkeypatch.setattr(lm.Probabilities, "_shares", staticmethod(lambda context, *x: sizes.append(len(context)) or shares(context, *x)))
    a, b, w = np.array([3, 3, 5] * 50), np.array([1, 1, 2] * 50), rng.integers(0, units, 150)
    together = lm.Probabilities(model).of(a, b, w)
    assert sizes and max(sizes) == 2
    alone = [lm.Probabilities(model).of(*(x[i : i + 1] for x in (a, b, w)))[0] for i in range(150)]
    assert together == pytest.approx(alone, abs=1e-5)


def test_a_row_moves_once_a_batch_by_the_sum_of_its_gradients():
    settings = lm.Settings(width=5, batch=64)
    counts = lm.Counts(None, 60, 30, [], np.zeros(0), [b"%d" % i for i in range(29)] + [lm.END], np.array([3, 3, 3, 3]), np.array([1, 1, 1, 1]))
    counts.words, counts.counts = counts.own, np.arange(30, 0, -1)
    trainer = lm.Trainer(lm.start(counts, settings), settings, 1)
    rng = np.random.default_rng(3)
    rows, grad = np.repeat(np.arange(8), [1, 2, 3, 4, 5, 9, 1, 7])[rng.permutation(32)], rng.normal(size=(32, 5)).astype(np.float32)
    summed = np.array([grad[rows == i].sum(0) for i in range(8)])
    trainer._step(0, trainer._found(0, rows), grad)
    moved = settings.rate * summed / np.sqrt(1e-3 + summed**2)
    assert trainer.model.left[:8] == pytest.approx(moved, rel=1e-4, abs=1e-5)
    assert not trainer.model.left[8:].any()
