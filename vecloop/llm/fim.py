"""Fill-in-the-middle by displacement: every byte of a batch gets the distance to its place in the output.

Texts of a batch lie end to end. Their prefix, middle and suffix move as wholes, so the distance is constant
within a part: differences are noted where parts begin, their running sum is the distance of every byte, and
numpy scatters the bytes. Restoring goes the other way: the marks in an output say where its parts are, and
a running sum of differences says for every byte of the text where to fetch it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from vecloop.llm.common import BLANKS, tidy

#: Marks of prefix, suffix and middle; a text that holds one is left as it is.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
PLAIN, PSM, SPM = 0, 1, 2
FORMS = pa.array(["plain", "psm", "spm"])

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[ord(c) for c in BLANKS]] = True


@dataclass(frozen=True)
class Settings:
    """``seed`` of the draws; of 100 texts ``moved`` are cut, and of 100 of these ``suffix_first`` begin with their suffix.
    ``held_bytes``: texts that lie end to end at once, one text at least; ``block``: bytes moved at once."""

    seed: int = 42
    moved: int = 50
    suffix_first: int = 80
    held_bytes: int = 1 << 22
    block: int = 1 << 20


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and where each begins (and the last ends)."""
    texts = pc.fill_null(texts, "")
    edges = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def column(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data))


def unit_ends(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all units, and for each text (and the end) the place of its first among them.

    A unit is a word with the blanks before it; blanks at a text's end are one more.
    """
    blank = _IS_BLANK[data]
    end = np.zeros(len(data), bool)
    end[:-1] = ~blank[:-1] & blank[1:]
    end[edges[1:][np.diff(edges) > 0] - 1] = True
    ends = np.flatnonzero(end) + 1
    return ends, np.searchsorted(ends, edges, side="right")


def marks_at(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of marks that lie within one text, and the text of each."""
    found = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2])) if len(data) >= MARK else np.zeros(0, np.int64)
    found = found[np.isin(data[found + 1], [PREFIX[1], SUFFIX[1], MIDDLE[1]])]
    owner = np.searchsorted(edges, found, side="right") - 1
    whole = found + MARK <= edges[owner + 1]
    return found[whole], owner[whole]


def displacements(starts: np.ndarray, shifts: np.ndarray, size: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all ``size`` bytes and where each goes, a block at a time: parts begin at ``starts``, in order, and
    move by ``shifts``. Of parts that begin at one place all but the last are empty."""
    steps = np.diff(shifts, prepend=0)
    carried = 0
    for first in range(0, size, block):
        last = min(first + block, size)
        some = slice(*np.searchsorted(starts, [first, last]))
        difference = np.zeros(last - first, np.int64)
        np.add.at(difference, starts[some] - first, steps[some])
        difference[0] += carried
        shift = np.cumsum(difference)
        carried = shift[-1]
        places = np.arange(first, last)
        yield places, places + shift


@dataclass
class Cuts:
    """Units of each text, its form, and where its middle begins and ends, as places in the bytes of all."""

    units: np.ndarray
    form: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def cut(data: np.ndarray, edges: np.ndarray, draws: np.ndarray, settings: Settings) -> Cuts:
    """``draws``: four numbers for each text."""
    ends, firsts = unit_ends(data, edges)
    units = np.diff(firsts)
    chosen = np.sort(draws[:, :2] % (units + 1)[:, None], axis=1)
    places = np.where(chosen > 0, np.append(ends, 0)[firsts[:-1, None] + np.maximum(chosen, 1) - 1], edges[:-1, None])
    plain = (units == 0) | (draws[:, 2] % 100 >= settings.moved)
    plain[marks_at(data, edges)[1]] = True
    form = np.where(plain, PLAIN, np.where(draws[:, 3] % 100 < settings.suffix_first, SPM, PSM))
    return Cuts(units, form, places[:, 0], places[:, 1])


def scatter(data: np.ndarray, edges: np.ndarray, cuts: Cuts, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The outputs' bytes and edges."""
    moved = cuts.form != PLAIN
    out_edges = edges + np.concatenate([[0], np.cumsum(3 * MARK * moved)])
    to = out_edges[:-1]
    prefix, middle, suffix = cuts.begin - edges[:-1], cuts.end - cuts.begin, edges[1:] - cuts.end
    suffix_first = cuts.form == SPM
    # Marks and parts alternate; the middle is last in both forms.
    one, two = np.where(suffix_first, suffix, prefix), np.where(suffix_first, prefix, suffix)
    marks = np.stack([to, to + MARK + one, to + 2 * MARK + one + two], axis=1)
    to_prefix = np.where(moved, np.where(suffix_first, marks[:, 1], marks[:, 0]) + MARK, to)
    to_middle = np.where(moved, marks[:, 2] + MARK, to + prefix)
    to_suffix = np.where(moved, np.where(suffix_first, marks[:, 0], marks[:, 1]) + MARK, to + prefix + middle)
    starts = np.stack([edges[:-1], cuts.begin, cuts.end], axis=1)
    shifts = np.stack([to_prefix, to_middle, to_suffix], axis=1) - starts
    out = np.empty(out_edges[-1], np.uint8)
    for places, goes in displacements(starts.ravel(), shifts.ravel(), len(data), block):
        out[goes] = data[places]
    for form, order in ((PSM, (PREFIX, SUFFIX, MIDDLE)), (SPM, (SUFFIX, PREFIX, MIDDLE))):
        for at, mark in zip(marks[cuts.form == form].T, order):
            out[at[:, None] + np.arange(MARK)] = np.frombuffer(mark, np.uint8)
    return out, out_edges


def gather(out: np.ndarray, edges: np.ndarray, form: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and edges, from outputs and forms alone."""
    moved = form != PLAIN
    found, owner = marks_at(out, edges)
    found, owner = found[moved[owner]], owner[moved[owner]]
    if not np.array_equal(owner, np.repeat(np.flatnonzero(moved), 3)):
        raise ValueError("an output has not the marks of its form")
    marks = np.repeat(edges[:-1, None], 3, axis=1)
    marks[moved] = found.reshape(-1, 3)
    text_edges = edges - np.concatenate([[0], np.cumsum(3 * MARK * moved)])
    one, two = marks[:, 1] - marks[:, 0] - MARK, marks[:, 2] - marks[:, 1] - MARK
    suffix_first = form == SPM
    prefix = np.where(moved, np.where(suffix_first, two, one), 0)
    suffix = np.where(moved, np.where(suffix_first, one, two), 0)
    starts = np.stack([text_edges[:-1], text_edges[:-1] + prefix, text_edges[1:] - suffix], axis=1)
    # A plain output is all middle, and begins where it begins.
    sources = np.stack(
        [np.where(suffix_first, marks[:, 1], marks[:, 0]) + MARK, np.where(moved, marks[:, 2] + MARK, edges[:-1]), np.where(suffix_first, marks[:, 0], marks[:, 1]) + MARK],
        axis=1,
    )
    # The suffix of a plain output is empty and moves like its middle, or the last text's distance would go on.
    sources[~moved, 2] = edges[1:][~moved]
    text = np.empty(text_edges[-1], np.uint8)
    for places, come in displacements(starts.ravel(), (sources - starts).ravel(), len(text), block):
        text[places] = out[come]
    return text, text_edges


def bounded(part: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have ``most`` bytes together, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < part.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield part.slice(first, last - first)
        first = last


def _draws(doc_id: Column, seed: int) -> Column:
    """The first 16 bytes of the SHA-256 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.unhex(F.substring(F.sha2(key.cast("binary"), 256), 1, 32))


def fill_in_middle(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row's whole text.

    Each row is drawn for by its id alone, so repeated rows get equal results and the order of rows does not matter. A
    null id is drawn for as an empty one. Null and empty texts are plain, with no units and an empty output, as
    is a text that holds a mark. Prefix, middle or suffix may be empty (equal draws). Any length of text
    is cut as a whole. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), _draws(docs[id_col], settings.seed).alias("draws"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in bounded(part, "text", settings.held_bytes):
                data, edges = laid_out(some.column("text"))
                draws = np.frombuffer(b"".join(some.column("draws").to_pylist()), ">u4").reshape(-1, 4).astype(np.int64)
                cuts = cut(data, edges, draws, settings)
                letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
                plain = cuts.form == PLAIN
                columns = {
                    "doc_id": some.column("doc_id"),
                    "n": pa.array(cuts.units.astype(np.int64)),
                    "form": FORMS.take(pa.array(cuts.form)),
                    "prefix_chars": pa.array((letters[cuts.begin] - letters[edges[:-1]]).astype(np.int64), mask=plain),
                    "middle_chars": pa.array((letters[cuts.end] - letters[cuts.begin]).astype(np.int64), mask=plain),
                    "output": column(*scatter(data, edges, cuts, settings.block)),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kinds = f"doc_id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return rows.mapInArrow(tidy(run), kinds)


def restore(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``rows`` and a last column ``restored``: each text rebuilt from ``output`` and ``form`` alone.

    A null output is restored as empty. An output without the marks of its form, or of an unknown form, ends the job with an error.
    Other columns are passed on, a former ``restored`` replaced.
    """
    rows = rows.drop("restored")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", restored string"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in bounded(part, "output", settings.held_bytes):
                out, edges = laid_out(some.column("output"))
                form = pc.index_in(some.column("form"), FORMS)
                if form.null_count:
                    raise ValueError("an output of no known form")
                text = column(*gather(out, edges, form.to_numpy(), settings.block))
                yield pa.RecordBatch.from_arrays([*some.columns, text], names=[*some.schema.names, "restored"])

    return rows.mapInArrow(tidy(run), kinds)
