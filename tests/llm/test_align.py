"""Alignment against the definition: all overlapping pairs, common ends, counts over the corpus."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

import public_tokenizers
from vecloop.llm import align

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    return align.Aligner(*PATHS)


def texts():
    prose = [" ".join(f"unfathomable{i * j % 7} Wörter-{j} 中文" for j in range(40)) for i in range(6)]
    odd = [None, "", " ", "a▁b", "\x00\x01", " \n\t  x", "😀é́�", "<s></s><unk><|endoftext|>", "x" * 3000, " " * 3000, "ab " * 4000, "1234567890" * 50]
    return odd + prose + prose[:2]


def spans(ids, side):
    ends = np.cumsum([len(side.bytes[i]) for i in ids]).tolist()
    return list(zip([0, *ends], ends))


def expected(text, tokenizers):
    """Ids, links and groups of a text, from the definition."""
    whole = (" " + (text or "")).encode()
    a = tokenizers.a.tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids
    b = tokenizers.b.model.encode(text or "")
    if not text or any(b"".join(s.bytes[i] for i in ids) != whole for s, ids in ((tokenizers.a, a), (tokenizers.b, b))):
        return [], [], [], ""
    sa, sb = spans(a, tokenizers.a), spans(b, tokenizers.b)
    links, k = [], 0
    for i, (x, y) in zip(a, sa):
        while sb[k][1] <= x:
            k += 1
        m = k
        while m < len(b) and sb[m][0] < y:
            links.append((i, b[m]))
            m += 1
    common = sorted({y for _, y in sa} & {y for _, y in sb})
    group = lambda ids, s, x, y: ",".join(str(i) for i, (u, v) in zip(ids, s) if x < v <= y)
    groups = [f"{group(a, sa, x, y)}|{group(b, sb, x, y)}" for x, y in zip([0, *common], common)]
    return a, b, links, ";".join(groups)


def test_the_file_is_encoded_by_ranks_with_the_same_ids(tokenizers):
    assert tokenizers.a.fast
    some = [" " + (t or "") for t in texts()]
    assert tokenizers.a.encode(some) == [e.ids for e in tokenizers.a.tokenizer.encode_batch(some, add_special_tokens=False)]


def test_another_order_of_ids_goes_through_the_library(tokenizers, tmp_path):
    import json

    content = json.load(open(PATHS[0], encoding="utf-8"))
    vocab = content["model"]["vocab"]
    x, y = [v for v in vocab if len(v) > 3][:2]
    vocab[x], vocab[y] = vocab[y], vocab[x]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(content))
    other = align.ByteTokens(str(path))
    assert other.fast is None
    swap = {vocab[x]: vocab[y], vocab[y]: vocab[x]}
    some = [" " + (t or "") for t in texts()]
    assert other.encode(some) == [[swap.get(i, i) for i in ids] for ids in tokenizers.a.encode(some)]


@pytest.mark.parametrize("settings", [align.Settings(), align.Settings(lane=4, window=2), align.Settings(lane=3, window=100)])
def test_batches(tokenizers, settings):
    found = tokenizers.align(texts(), settings)
    digests = tokenizers.group_digests(found)
    for k, text in enumerate(texts()):
        a, b, links, groups = expected(text, tokenizers)
        assert found.a.ids[found.a.firsts[k] : found.a.firsts[k + 1]].tolist() == a
        assert found.b.ids[found.b.firsts[k] : found.b.firsts[k + 1]].tolist() == b
        own = found.links[found.link_firsts[k] : found.link_firsts[k + 1]]
        assert Counter(divmod(x, tokenizers.b_ids) for x in own.tolist()) == Counter(links)
        assert digests[k].decode() == groups


@pytest.mark.parametrize("settings", [align.Settings(), align.Settings(held_bytes=500, block_links=300, lane=16)])
def test_counts_over_the_corpus(spark, tokenizers, settings):
    rows = [*enumerate(texts()), (None, "no id"), (12, texts()[12])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS block", "2 AS pair", "3 AS count").repartition(4)
    known = [expected(t, tokenizers) for _, t in rows]
    counts = Counter(link for _, _, links, _ in known for link in links)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    wanted = []
    for (doc_id, _), (a, b, links, groups) in zip(rows, known):
        best = sum(counts[x] == highest[x[1]] for x in links)
        digest = sha256(groups.encode()).hexdigest() if groups else ""
        wanted.append((doc_id, len(a), len(b), groups.count("|"), len(links), best, sum(counts[x] for x in links), digest))
    found = align.count_links(docs, *PATHS, settings)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))


def test_the_alignments_themselves(spark, tokenizers):
    docs = spark.createDataFrame([*enumerate(texts())], "doc_id int, text string").repartition(3)
    for r in align.align_documents(docs, *PATHS).collect():
        a, b, _, groups = expected(texts()[r["doc_id"]], tokenizers)
        assert (r["a_ids"], r["b_ids"]) == (a, b)
        parts = zip([0, *r["a_cuts"]], r["a_cuts"], [0, *r["b_cuts"]], r["b_cuts"])
        assert groups == ";".join(f"{','.join(map(str, a[p:q]))}|{','.join(map(str, b[x:y]))}" for p, q, x, y in parts)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert align.count_links(none, *PATHS).count() == 0
    assert align.align_documents(none, *PATHS).count() == 0
