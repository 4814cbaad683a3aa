"""Exact merge-type (BPE) SentencePiece encoding by backtracking, and its decoding.

The library's merge loop gives the one segmentation in which every piece merges to itself and every
two neighbours, merged anew from their characters, stay those two pieces. It is found left to right:
take the longest piece here (from one Aho-Corasick pass), keep it if it goes with the piece before, else
try the next shorter one, else step back. A bit per position remembers where no continuation exists, so
no position is tried twice.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from vecloop.llm.common import pick, tidy
from vecloop.llm.fim import bounded

SPACE = "▁"


class PieceModel:
    """The pieces of a SentencePiece model file of merge type with byte fallback and no text normalisation."""

    def __init__(self, path: str, cached_units: int = 400_000):
        """``path``: the model file, the same on every executor. A task remembers the ids of the last ``cached_units`` to twice as
        many units."""
        file = sentencepiece.SentencePieceProcessor(model_file=path)
        if not all(file.is_byte(i) for i in file.encode_as_ids("͸")[-2:]):
            raise ValueError(f"{path}: not a model with byte fallback")
        if file.encode_as_pieces("a  b")[0] != SPACE + "a" or file.decode(file.encode(" ﬁ① ")) != " ﬁ① ":
            raise ValueError(f"{path}: a model that changes its text is not supported")
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: list[int] = [0] * 256
        self.pieces: list[str] = []
        self.byte_of: dict[int, int] = {}
        for i in range(file.vocab_size()):
            piece = file.id_to_piece(i)
            self.pieces.append(piece)
            if file.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.byte_of[i] = value
            elif not (file.is_control(i) or file.is_unknown(i) or file.is_unused(i)):
                self.ids[piece] = i
                self.scores[piece] = file.get_score(i)
        # A piece with equal scores elsewhere merges leftmost first, which pairs of pieces don't show.
        seen: dict[float, int] = {}
        for piece in self.ids:
            if len(piece) > 1:
                seen[self.scores[piece]] = seen.get(self.scores[piece], 0) + 1
        self.ties = frozenset(p for p in self.ids if len(p) > 1 and seen[self.scores[p]] > 1)
        self.tied = re.compile("|".join(map(re.escape, sorted(self.ties, key=len)))) if self.ties else None
        self.units = self._unit_pattern()
        # Only pieces that merge to themselves can stand in a segmentation. What is no piece has the id -1 and the size 1.
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, tuple[int, ...]] = {}
        self.sizes = [len(p) for p in self.pieces] + [1]
        self.usable: dict[str, int] = {}
        for piece, i in self.ids.items():
            if self.merge(piece) == [piece]:
                self.usable[piece] = i
                self.automaton.add_word(piece, (len(piece), i))
                if piece not in self.ties:
                    self.whole[piece] = (i,)
        self.most = max(map(len, self.usable), default=1)
        self.automaton.make_automaton()
        self.texts = [str(i) for i in range(len(self.pieces))]
        #: What an id decodes to alone; bytes and special ids depend on others.
        self.decoded = [p.replace(SPACE, " ") if p in self.ids else None for p in self.pieces]
        self.pairs: dict[int, bool] = {}
        self.cached_units = cached_units
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def forget(self) -> None:
        """Drop what is remembered of texts. Pairs of pieces stay, there is a bound on them."""
        self.cache, self.older = {}, {}

    def _unit_pattern(self) -> re.Pattern:
        """Cuts that no piece of this vocabulary spans, so that units can be encoded alone."""
        word = re.compile(r"\w")
        loose: set[str] = set()  # word characters that some piece joins to others
        for piece in self.ids:
            body = piece.lstrip(SPACE)
            if SPACE in body:
                return re.compile(r".+", re.DOTALL)
            for x, y in zip(body, body[1:]):
                if bool(word.match(x)) != bool(word.match(y)):
                    loose.add(x if word.match(x) else y)
        ahead = f"(?![{re.escape(''.join(sorted(loose)))}])" if loose else ""
        plain = rf"[^\W{re.escape(''.join(sorted(loose)))}]"
        return re.compile(rf"{SPACE}*(?:{plain}++{ahead}|[^\w{SPACE}]++{ahead}|[^{SPACE}]+)|{SPACE}+")

    def merge(self, text: str) -> list[str]:
        """The library's merge loop: always the best-scored neighbours, the leftmost of equals."""
        parts: list[str] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        scores = self.scores
        heap = []
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None:
                heap.append((-score, i, parts[i], parts[i + 1]))
        heapq.heapify(heap)
        n = len(parts)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (score := scores.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (-score, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (score := scores.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (-score, h, parts[h], parts[i]))
        return [p for p in parts if p]

    def _goes(self, a: int, b: int) -> bool:
        """Whether two neighbouring pieces stay as they are when merged anew."""
        if len(self.pairs) > 200_000:
            self.pairs.clear()
        x, y = self.pieces[a], self.pieces[b]
        known = self.pairs[a * len(self.pieces) + b] = self.merge(x + y) == [x, y]
        return known

    def _ids(self, parts: list[str]) -> list[int]:
        """Ids of pieces; a character that is no piece becomes its bytes."""
        found: list[int] = []
        for part in parts:
            known = self.ids.get(part)
            found.extend([known] if known is not None else [self.bytes[b] for b in part.encode("utf-8")])
        return found

    def _longest(self, unit: str, at: int, most: int) -> tuple[int, int]:
        """Size and id of the longest piece here that has no more than ``most`` letters; a letter that is no piece has size 1 and the id -1."""
        usable = self.usable
        for size in range(most, 0, -1):
            i = usable.get(unit[at : at + size])
            if i is not None:
                return size, i
        return (1, -1) if most > 0 else (0, -1)

    def segment(self, unit: str) -> list[int]:
        """Ids of a unit."""
        if self.tied and self.tied.search(unit):
            return self._ids(self.merge(unit))
        n, pairs, many, sizes = len(unit), self.pairs, len(self.pieces), self.sizes
        # One pass finds the longest matches where each begins at the end of the one before. They stand if all neighbours go together.
        longest = {end - size + 1: (size, i) for end, (size, i) in self.automaton.iter_long(unit)}
        failed = 0  # a bit per position from which no segmentation went on
        chosen: list[int] = []
        at, found = 0, longest.get(0)
        while at < n:
            before = chosen[-1] if chosen else -1
            size, i = found or self._longest(unit, at, min(self.most, n - at))
            while size:
                if not failed >> (at + size) & 1:
                    if before < 0 or i < 0:
                        break
                    goes = pairs.get(before * many + i)
                    if self._goes(before, i) if goes is None else goes:
                        break
                size, i = self._longest(unit, at, size - 1)
            if size:
                chosen.append(i)
                at += size
                found = longest.get(at)
                continue
            if not chosen:
                return self._ids(self.merge(unit))
            failed |= 1 << at
            size = sizes[chosen.pop()]
            at -= size
            found = self._longest(unit, at, size - 1)
        if -1 not in chosen:
            return chosen
        parts, at = [], 0
        for piece in chosen:
            parts.append(unit[at : at + sizes[piece]])
            at += sizes[piece]
        return self._ids(parts)

    def encode_unit(self, unit: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the text they decode to. Bytes of a letter never stand in two units."""
        ids = self.whole.get(unit) or self.segment(unit)
        return len(ids), ",".join(map(self.texts.__getitem__, ids)), self._joined(ids)

    def _known_units(self, text: str) -> list[tuple[int, str, str]]:
        if not text:
            return []
        units = self.units.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(self.cache.get, units))
        if None in found:
            for k, known in enumerate(found):
                if known is None:
                    found[k] = self.cache.get(units[k]) or self._remembered(units[k])
        return found

    def _remembered(self, unit: str) -> tuple[int, str, str]:
        known = self.older.get(unit) or self.encode_unit(unit)
        if len(unit) <= 64:
            if len(self.cache) >= self.cached_units:
                self.cache, self.older = {}, self.cache
            self.cache[unit] = known
        return known

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self._known_units(text) for i in ids.split(",")]

    def decode(self, ids: Sequence[int]) -> str:
        """Pieces joined, spaces back, the added first space off; bytes that are no UTF-8 become U+FFFD each."""
        text = self._joined(ids)
        first = next((i for i in ids if self.pieces[i] in self.ids or i in self.byte_of or _special(self.pieces[i])), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text

    def digest_parts(self, text: str) -> tuple[int, str, str]:
        """Ids of a whole text: how many, joined by commas, and what they decode to; units that occur again are decoded once."""
        known = self._known_units(text)
        decoded = "".join([d for _, _, d in known])
        return sum([n for n, _, _ in known]), ",".join([i for _, i, _ in known]), decoded.removeprefix(" ")

    def _joined(self, ids: Sequence[int]) -> str:
        try:
            return "".join(map(self.decoded.__getitem__, ids))
        except TypeError:  # some are bytes or special
            pass
        parts: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                parts.append(_text(bytes(run)))
                run.clear()
            piece = self.pieces[i]
            parts.append(piece.replace(SPACE, " ") if piece in self.ids else _special(piece))
        if run:
            parts.append(_text(bytes(run)))
        return "".join(parts)


def _special(piece: str) -> str:
    return " ⁇ " if piece == "<unk>" else ""


def _text(run: bytes) -> str:
    """UTF-8, each byte that belongs to no character as one U+FFFD."""
    out = []
    at = 0
    while at < len(run):
        first = run[at]
        size = 1 if first < 0x80 else 2 if first >> 5 == 6 else 3 if first >> 4 == 14 else 4 if first >> 3 == 30 else 1
        try:
            out.append(run[at : at + size].decode("utf-8"))
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


_MODELS: dict[str, PieceModel] = {}


@contextmanager
def model(path: str) -> Iterator[PieceModel]:
    """The model, loaded once per worker process; what it remembers of texts goes when the task ends."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    try:
        yield _MODELS[path]
    finally:
        _MODELS[path].forget()


_TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` of every row's whole text; null and empty texts have no ids. Order and repeats don't matter."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with model(path) as m:
            for part in small(parts):
                known = [m.digest_parts(t or "") for t in part.column(1).to_pylist()]
                ids = [[int(i) for i in k[1].split(",")] if k[0] else [] for k in known]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([k[2] for k in known], pa.string())], schema=_TOKENS
                )

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(tidy(run), "doc_id bigint, ids array<int>, decoded string")


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``tokenize``, with counts and SHA-256 in place of the lists: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    from hashlib import sha256

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with model(path) as m:
            for part in small(parts):
                known = [m.digest_parts(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([k[0] for k in known], pa.int64()),
                        pa.array([sha256(k[1].encode()).hexdigest() for k in known]),
                        pa.array([sha256(k[2].encode()).hexdigest() for k in known]),
                    ],
                    schema=_DIGESTS,
                )

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(tidy(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def small(parts: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices whose texts, the second column, have ``most`` bytes together, or one row."""
    for part in parts:
        yield from bounded(part, part.schema.names[1], most)
