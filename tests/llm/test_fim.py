"""Fill-in-the-middle against plain string cutting, and its round trip."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from vecloop.llm import fim

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def draws(doc_id):
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), draws(doc_id)
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def awkward(n):
    rng = random.Random(3)
    letters = ["a", " ", "é", "\n", "\x0b", "\x85", "😀", "<", "P", ">", "S", "<P", "S>", "<M>"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(n)]
    return texts + [None, "", " ", "\t\n", "<", "<P>", "a<S>b", "word " * 60_000, "x" * 300_000, "same", "same"]


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_scatter_and_gather(block):
    texts = pa.array(awkward(600), pa.string())
    for some in (texts, texts.slice(7, 300), texts.slice(0, 0)):
        data, edges = fim.laid_out(some)
        drawn = np.array([draws(i) for i in range(len(some))], np.int64).reshape(-1, 4)
        cuts = fim.cut(data, edges, drawn, fim.Settings())
        out, out_edges = fim.scatter(data, edges, cuts, block)
        found = zip(cuts.units.tolist(), fim.FORMS.take(pa.array(cuts.form)).to_pylist(), fim.column(out, out_edges).to_pylist())
        wanted = [expected(i, t) for i, t in enumerate(some.to_pylist())]
        assert list(found) == [(n, form, text) for n, form, _, _, text in wanted]
        text, text_edges = fim.gather(out, out_edges, cuts.form, block)
        assert np.array_equal(text, data) and np.array_equal(text_edges, edges)


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(awkward(300))] + [(None, "no id here at all"), (5, "id 5 again"), (5, "id 5 again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n", "'x' AS form", "2 AS output", "3 AS draws").repartition(3)
    small = fim.Settings(held_bytes=1000)
    made = fim.fill_in_middle(docs, small)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = fim.restore(made, small).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in found))) == sorted(map(repr, ((i, *expected(i, t)) for i, t in rows)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["restored"]) for r in found) == sorted((-1 if i is None else i, t or "") for i, t in rows)
    assert fim.restore(fim.fill_in_middle(docs.where("false"))).count() == 0


def test_an_output_without_its_marks_is_an_error(spark):
    broken = spark.createDataFrame([(1, "spm", "<S>a<P>b")], "doc_id int, form string, output string")
    with pytest.raises(Exception, match="has not the marks"):
        fim.restore(broken).collect()
