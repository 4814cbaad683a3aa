"""The operators as stages over ``documents``: rows in, rows with the same columns out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecloop.llm import decontaminate, langid, pieces, secrets, simhash
from vecloop.llm.common import pick, tidy
from vecloop.session import write_and_reread

#: Put in place of a secret.
REDACTED = "[REDACTED]"


def keep_languages(docs: DataFrame, settings: langid.Settings = langid.Settings()) -> DataFrame:
    """Rows in a language: those predicted ``und`` (no text, no letter, nothing learned for want of labels) go.

    Without a single labelled text nothing can be told apart, and rows with a letter stay.
    """
    model = langid.train(pick(docs, doc_id="doc_id", text="text", lang="lang").where(~langid.held_out(F.col("doc_id"))), settings)
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return docs.where(langid.predictor(docs, model)(F.col("text"))["lang_pred"] != langid.UNKNOWN)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id; of rows repeating that id, one.

    Rows without an id can't name their group's smallest and are passed on.
    """
    found = simhash.near_duplicates(docs).where("doc_id = component_id")
    first = write_and_reread(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "first")
    # The ids grow with the documents, so the plan is the same at every size: never a broadcast.
    kept = docs.join(first.where("n = 1").hint("merge"), "doc_id", "left_semi")
    repeated = first.where("n > 1")
    if not repeated.isEmpty():
        kept = kept.union(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*kept.columns))
    return kept.select(*docs.columns).union(docs.where("doc_id IS NULL"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows that hold no benchmark item. Null texts hold none; repeated rows stay or go together; with an empty table of items all stay."""
    found = decontaminate.find(docs, items).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["bad_id"]) & (F.xxhash64(docs["text"]) == found["bad_text"])
    return docs.join(found.hint("merge"), same, "left_anti")


def redact_secrets(docs: DataFrame, ledger_path: str) -> DataFrame:
    """All rows, their secrets replaced; ``n_chars``, if there, counts the new text.

    Overlapping spans are replaced as one. Texts come through the ledger's blobs, so a copy is scanned once. Null texts stay null, other
    columns of any name stay as they are, repeated rows are kept, and an empty table gives no rows.
    """
    ledger = secrets.update_ledger(docs, ledger_path)
    found = secrets.spans_by_blob(ledger).where(F.size("spans") > 0)
    blobs = write_and_reread(found.select("blob", "spans"), "spans").hint("merge")
    # The caller's columns travel as one, so that they clash with none of these.
    text = F.col("row")["text"]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.withColumn("blob", F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))
    joined = rows.join(blobs, "blob", "left")  # merged at every size
    spans = F.transform(F.coalesce("spans", F.array().cast(blobs.schema["spans"].dataType)), lambda s: F.struct(s["start"], s["stop"]))

    def step(state, span):
        # Text so far, and the place up to which the old text is used up.
        new = F.concat(
            state["text"],
            F.substring(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0))),
            F.when(span["start"] >= state["at"], F.lit(REDACTED)).otherwise(F.lit("")),
        )
        return F.struct(new.alias("text"), F.greatest(span["stop"], state["at"]).alias("at"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    end = lambda s: F.concat(s["text"], F.substring(text, s["at"] + 1, F.length(text)))
    redacted = joined.withColumn("new", F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text))
    changed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("spans").isNotNull(), F.length("new")).otherwise(F.col("row")["n_chars"])
        changed["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
    return redacted.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


_ENCODED = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())]
)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip``: the ids of every whole text, and whether they decode to it again.

    They do unless the text holds the sign that stands for a space, which decodes to a space.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with pieces.model(model_path) as m:
            for some in pieces.small(parts):
                texts = [t or "" for t in some.column(1).to_pylist()]
                known = [m.digest_parts(t) for t in texts]
                ends = np.cumsum([0] + [k[0] for k in known]).astype(np.int32)
                ids = np.fromstring(",".join(k[1] for k in known if k[0]), np.int32, sep=",")
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).cast(pa.int64()),
                        pa.array(np.diff(ends).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())),
                        pa.array([k[2] == t for k, t in zip(known, texts)]),
                    ],
                    schema=_ENCODED,
                )

    rows = pick(docs, doc_id="doc_id", text="text")
    return rows.mapInArrow(tidy(run), "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean")
