"""Benchmark decontamination by size-partitioned MinHash containment search.

A document holds an item if it holds at least ``threshold`` of the item's distinct shingles. Items are
put into size classes (powers of two). An item of n shingles is sketched by the k least hashes of its
shingles, k = n - ceil(threshold * n) + 1: a document that holds enough of the item must hold one of any
k of its shingles, so the search misses nothing, however long the document. Each class is searched apart:
a document's sketch for a class is its hashes up to the class's largest sketch value, and meets the class's
items only. Candidates are verified by the exact shingles, as text.

Documents meet the sketches first in a bitmap of fixed size, sent to all tasks; more items make it less
selective, never wrong, since the join after it is exact. Then everything is joins on what is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vecloop.llm.common import batches, pick, tidy
from vecloop.llm.shingles import Words, blocks
from vecloop.session import write_and_reread

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: log2 of the bits in each of the two bitmaps (4 MB each).
BITMAP_BITS = 25

_GRAMS = pa.schema([("item", pa.string()), ("words", pa.int32()), ("hash", pa.int64()), ("gram", pa.string())])
_HITS = pa.schema(
    [("row", pa.string()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("sketch", pa.list_(pa.struct([("class", pa.int32()), ("hash", pa.int64())]))), ("grams", pa.list_(pa.string()))]
)


def index_items(items: DataFrame, threshold: float = THRESHOLD, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``item, words, hash, gram, size, class, place`` for the distinct shingles of ``items (item, text)``.

    ``place`` ranks an item's shingles by unsigned hash; ``sketched`` marks the k least. Items with fewer words than a
    shingle are one shingle of all their words (``words`` long); items without a word have none.
    """

    def shingle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for item, text in zip(*[c.to_pylist() for c in part.columns]):
                    words = Words([(text or "").encode()])
                    size = min(len(words.hash), shingle_words)
                    if size:
                        place, hashes = words.shingles(size)
                        for h, p in dict(zip(hashes.tolist(), place.tolist())).items():
                            yield item, size, h - (1 << 64) if h >= 1 << 63 else h, words.text(p, size)

        yield from batches(rows(), _GRAMS)

    grams = items.select("item", "text").mapInArrow(shingle, "item string, words int, hash bigint, gram string")
    by_item = Window.partitionBy("item")
    unsigned = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))
    sized = grams.withColumn("size", F.count(F.lit(1)).over(by_item)).withColumn(
        "place", F.row_number().over(by_item.orderBy(unsigned))
    )
    return sized.withColumns(
        {
            "class": F.floor(F.log2("size")).cast("int"),
            "sketched": F.col("place") <= F.col("size") - needed(F.col("size"), threshold) + 1,
        }
    )


def needed(size: Column, threshold: float) -> Column:
    """The least number of shared shingles that makes the threshold."""
    return F.ceil(size * F.lit(threshold) - F.lit(1e-9))


def _bitmap(hashes: DataFrame, bits: int, salted: bool) -> np.ndarray:
    """Bits at the hashes' low bits (of a class each its own, if salted), put together on the cluster; at most
    2^bits / 64 rows reach the driver."""
    at = F.col("hash")
    if salted:
        at = at.bitwiseXOR(F.xxhash64("class"))
    at = at.bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    slots = hashes.select(F.shiftright(at, 6).alias("slot"), one.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    found = slots.toArrow()
    result = np.zeros(max(1 << bits >> 6, 1), np.int64)
    result[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return result.view(np.uint64)


def _in(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes & np.uint64((1 << bits) - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def find(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    shingle_words: int = SHINGLE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    bits: int = BITMAP_BITS,
) -> DataFrame:
    """Every (document, item) with at least ``threshold`` of the item's shingles in the document.

    Returns ``doc_id, text_hash, item_id, n_shared, n_shingles, containment``; ``text_hash`` is
    ``xxhash64`` of the document's text. Words are split at blanks, A-Z lower-cased. Null and empty texts
    are in no pair. Repeated document rows are found each; items equal in text share the work and are
    reported under each id, an item repeated under one id once. An empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    named = pick(items, item_id=item_id_col, text=item_text_col).where(F.col("text").isNotNull())
    named = named.withColumn("item", F.sha2("text", 256)).distinct()
    index = write_and_reread(index_items(named.groupBy("item").agg(F.first("text").alias("text")), threshold, shingle_words), "items")
    sketches = index.where("sketched")
    top = F.max(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))))
    tops = sketches.groupBy("class", "words").agg(top.alias("top")).withColumn("salt", F.xxhash64("class")).collect()
    # One row a class and shingle length: at most 64 classes.
    bounds: dict[int, list[tuple]] = {}
    for t in tops:
        bounds.setdefault(t["words"], []).append((t["class"], np.uint64(t["top"] + (1 << 63)), np.uint64(t["salt"] % (1 << 64))))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((_bitmap(sketches, bits, True), _bitmap(index, bits, False)))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch_bits, all_bits = sent.value
        run = uuid.uuid4().hex

        def hits():
            n = 0
            for part in parts:
                ids, hashes = part.column(0).to_pylist(), part.column(2).to_pylist()
                for first, block in blocks([t or b"" for t in part.column(1).to_pylist()]):
                    words = Words(block)
                    found: dict[int, tuple[set, set]] = {}
                    for size, classes in bounds.items():
                        place, grams = words.shingles(size)
                        for kind, top, salt in classes:
                            least = np.flatnonzero(grams <= top)
                            for i in least[_in(sketch_bits, grams[least] ^ salt, bits)].tolist():
                                sketch = found.setdefault(int(words.doc[place[i]]), (set(), set()))[0]
                                sketch.add((kind, int(grams[i].view(np.int64))))
                        if not found:
                            continue
                        of_found = np.isin(words.doc[place], list(found))
                        for i in np.flatnonzero(of_found)[_in(all_bits, grams[of_found], bits)].tolist():
                            found[int(words.doc[place[i]])][1].add(words.text(place[i], size))
                    for d, (sketch, exact) in found.items():
                        n += 1
                        yield f"{run}-{n}", ids[first + d], hashes[first + d], [{"class": c, "hash": h} for c, h in sorted(sketch)], sorted(exact)

        yield from batches(hits(), _HITS, 256)

    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text"), F.xxhash64("text").alias("text_hash"))
    schema = "row string, doc_id bigint, text_hash bigint, sketch array<struct<class:int,hash:bigint>>, grams array<string>"
    hits = write_and_reread(rows.mapInArrow(tidy(search), schema), "hits")

    met = hits.select("row", F.inline("sketch"))
    candidates = met.join(sketches.select("class", "hash", "item"), ["class", "hash"])
    candidates = candidates.select("row", "item").distinct()
    exact = index.groupBy("item").agg(F.collect_list("gram").alias("wanted"), F.first("size").alias("n_shingles"))
    shared = (
        candidates.join(hits.select("row", "doc_id", "text_hash", "grams"), "row")
        .join(exact, "item")
        .withColumn("n_shared", F.size(F.array_intersect("grams", "wanted")).cast("long"))
        .where(F.col("n_shared") >= needed(F.col("n_shingles"), threshold))
    )
    return shared.join(named.select("item", "item_id"), "item").select(
        "doc_id", "text_hash", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    )
