"""Language identification with string kernels.

The blended spectrum presence kernel of two texts is the mean, over n = 1, 2, 3, of the cosine of their
sets of character n-grams. Texts are mapped by their kernel with a set of landmarks (Nyström), and a
one-versus-rest kernel ridge regression on that map gives a margin per language. Scoring is one batched
product with the landmarks and one with the weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vecloop.llm.common import pick, tidy

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds of what is learned.

    ``per_lang``: training texts of a language. The rest is shared out evenly, with so many a language at least that features grow with languages and
    scripts: ``landmarks`` in all or ``least_landmarks`` a language; of each length the ``grams`` most frequent n-grams in all, or ``least_grams`` a
    language. ``letters``: most frequent letters of a language that are told apart. ``ridge``: weight of the regression's penalty.
    """

    per_lang: int = 400
    landmarks: int = 128
    least_landmarks: int = 4
    letters: int = 4000
    grams: int = 6000
    least_grams: int = 300
    ridge: float = 1e-3


class Spectrum:
    """Presence of the counted n-grams in whole texts. A sign stands for a letter; 0 for what is no letter, 1 for a letter that is not counted."""

    def __init__(self, letters: dict[str, int], size: int, columns: dict[int, list[int]]):
        self.size = size
        self.signs = np.zeros(0x110000, np.int32)  # 0: no letter
        for letter, sign in letters.items():
            self.signs[ord(letter)] = sign
        self.columns = {n: np.sort(np.asarray(codes, np.int64)) for n, codes in columns.items()}
        self.spans, at = [], 0
        for codes in self.columns.values():
            self.spans.append((at, at + len(codes)))
            at += len(codes)
        self.width = at

    @staticmethod
    def codes(signs: np.ndarray, size: int, n: int) -> np.ndarray:
        """Codes of all n-grams; runs of signs that are no letters count as one, as does the text's edge."""
        code = signs[: len(signs) - n + 1].astype(np.int64)
        for j in range(1, n):
            code = code * size + signs[j : len(signs) - n + 1 + j]
        return code

    def signs_of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        signs = np.zeros(len(points) + 2, np.int32)
        signs[1:-1] = self.signs[points]
        repeated = (signs[1:] == 0) & (signs[:-1] == 0)
        return signs[1:][~repeated] if repeated.any() else signs[1:]

    def presence(self, texts: list[str]) -> np.ndarray:
        """A row per text; each n's block has length 1, or is empty."""
        found = np.zeros((len(texts), self.width), np.float32)
        for row, text in zip(found, texts):
            signs = self.signs_of(text)
            for (first, _), (n, known) in zip(self.spans, self.columns.items()):
                if len(signs) >= n and len(known):
                    codes = self.codes(signs, self.size, n)
                    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                    row[first + at[known[at] == codes]] = 1
        for a, b in self.spans:
            block = found[:, a:b]
            block /= np.sqrt(np.maximum(block.sum(1, keepdims=True), 1))
        return found / np.float32(np.sqrt(len(self.spans)))


@dataclass
class LanguageModel:
    spectrum: Spectrum | None
    landmarks: np.ndarray
    weights: np.ndarray
    langs: list[str]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: half the lead of the best margin over the next, within 0 to 1. ``und``
        and 0 for a null text, one without a letter, or a model that has learned nothing."""
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            kernel = self.spectrum.presence([texts[i] for i in known]) @ self.landmarks.T
            margins = kernel @ self.weights
            best = margins.argmax(1)
            lead = (margins.max(1) + 1) / 2
            if len(self.langs) > 1:
                lead = (margins.max(1) - np.partition(margins, -2, axis=1)[:, -2]) / 2
            for i, b, s in zip(known, best.tolist(), np.clip(lead, 0, 1).tolist()):
                langs[i], scores[i] = self.langs[b], s
        return langs, scores


def training_sample(labelled: DataFrame, per_lang: int) -> list[tuple[str, str]]:
    """``per_lang`` different texts of each language, those with the least hash of the text, or all if there are fewer; in a fixed order.

    Texts are counted once however often they occur, since all copies of a text pass the threshold or none. It
    lets through about 1.5 times the bound, so at most some hundred texts a language reach the driver; should
    a language fall short of the bound, it is raised.
    """
    place = F.xxhash64("text")
    different = labelled.select("lang", place.alias("place")).distinct()
    counts = {r["lang"]: r["n"] for r in different.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    rank = F.pmod(place, F.lit(1 << 20)) / F.lit(float(1 << 20))
    wanted = 1.5 * per_lang + 20
    while True:
        share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, wanted / n))])
        few = labelled.where(rank < share[F.col("lang")]).select("lang", rank.alias("rank"), place.alias("place"), "text").distinct()
        rows = sorted((r["lang"], r["rank"], r["place"], r["text"]) for r in few.collect())
        found = Counter(r[0] for r in rows)
        if all(found[lang] >= min(per_lang, n) for lang, n in counts.items()):
            break
        wanted *= 4
    taken: Counter = Counter()
    sample = []
    for lang, _, _, text in rows:
        taken[lang] += 1
        if taken[lang] <= per_lang:
            sample.append((lang, text))
    return sample


def fit(sample: list[tuple[str, str]], settings: Settings = Settings()) -> LanguageModel:
    """Kernel ridge regression on a sample of ``(lang, text)``; an empty sample gives a model that knows no language."""
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return LanguageModel(None, np.zeros((0, 0)), np.zeros((0, 0)), [])
    by_lang = {lang: [text for known, text in sample if known == lang] for lang in langs}
    common: set[str] = set()
    for texts in by_lang.values():
        letters = Counter(c.lower() for text in texts for c in text if c.isalpha() and len(c.lower()) == 1)
        common.update(sorted(letters, key=lambda c: (-letters[c], c))[: settings.letters])
    signs = {c: i + 2 for i, c in enumerate(sorted(common))}
    size = len(signs) + 2
    table = {c: signs.get(c.lower(), 1) for c in map(chr, range(0x110000)) if c.isalpha()}
    plain = Spectrum(table, size, {})
    columns: dict[int, set[int]] = {1: set(), 2: set(), 3: set()}
    each = max(settings.grams // len(langs), settings.least_grams)
    for texts in by_lang.values():
        rows = [plain.signs_of(text) for text in texts]
        for n, chosen in columns.items():
            counts = Counter()
            for row in rows:
                if len(row) >= n:
                    counts.update(np.unique(Spectrum.codes(row, size, n)).tolist())
            chosen.update(sorted(counts, key=lambda c: (-counts[c], c))[:each])
    columns = {n: sorted(chosen) for n, chosen in columns.items()}
    spectrum = Spectrum(table, size, columns)

    features = np.concatenate([spectrum.presence([t for _, t in sample[i : i + 256]]) for i in range(0, len(sample), 256)])
    labels = np.array([langs.index(lang) for lang, _ in sample])
    each = max(settings.landmarks // len(langs), settings.least_landmarks)
    chosen = np.concatenate([np.flatnonzero(labels == k)[:each] for k in range(len(langs))])
    marks = features[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    solid = values > 1e-6 * values.max()
    root = vectors[:, solid] / np.sqrt(values[solid])
    mapped = (features @ marks.T) @ root
    targets = np.where(labels[:, None] == np.arange(len(langs)), 1.0, -1.0)
    # Languages weigh the same, however many texts each has.
    weight = (1.0 / np.bincount(labels, minlength=len(langs)))[labels][:, None]
    left = mapped.T @ (mapped * weight) + settings.ridge * np.eye(mapped.shape[1])
    solved = np.linalg.solve(left, mapped.T @ (targets * weight))
    return LanguageModel(spectrum, marks, (root @ solved).astype(np.float32), langs)


def train(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the labelled rows of ``docs`` that have a text."""
    labelled = pick(docs, text=text_col, lang=lang_col).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return fit(training_sample(labelled, settings.per_lang), settings)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def predictor(docs: DataFrame, model: LanguageModel):
    """A column function: text to ``struct<lang_pred, score>``; the model goes to the tasks once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [None if t is None or t is pd.NA else t for t in part.tolist()]
            langs, scores = [], []
            for i in range(0, len(texts), 128):
                some = sent.value.predict(texts[i : i + 128])
                langs += some[0]
                scores += some[1]
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(score)(parts)

    return predict


def identify(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, and predict every row from its text alone.

    Returns ``doc_id, held_out, lang_pred, score``. Rows are judged alone, texts of any length as a whole: repeats get equal results. Of
    equal margins the language that comes first by name wins, with score 0. Null labels are not learned from; other columns are not read. An
    empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = train(rows.where(~held_out(F.col("doc_id"))), settings)
    said = predictor(docs, model)(F.col("text"))
    judged = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), said.alias("said"))
    return judged.select("doc_id", "held_out", "said.lang_pred", "said.score")
