"""The quality classifier: statistics against plain Python, splits and walks against brute force, held-out accuracy."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from vecloop.llm import classifier as c
from vecloop.llm.fim import laid_out
from vecloop.plans.views import table


def texts():
    odd = [None, "", " ", "\n\n", "a", "A a a A.\nA a a A.\n\nend", "中文 😀 word", "x|y|z # 1 2 3!!", "\t lead and trail \n", "one\n\ntwo. \nthree\n", "w " * 20_000]
    return odd + [" ".join(f"w{(i * 7 + j * j) % 23}{'!' * (j % 3)}" for j in range(30 + i)) + ("\nline" * i) for i in range(20)]


def plain(text):
    data = (text or "").encode()
    if not data:
        return [0.0] * len(c.STATISTICS)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.split()]
    found = {"log_bytes": math.log1p(len(data)), "words_log": math.log1p(len(words)), "lines_log": math.log1p(len(lines))}
    for name, members in c.CLASSES.items():
        found[name] = sum(b in members for b in data) / len(data)
    found["upper_of_letters"] = found["upper"] / max(found["upper"] + found["lower"], 1e-9)
    found["entropy"] = -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values())
    sizes = [len(w) for w in words] or [0]
    found["word_mean"], found["word_spread"], found["word_longest_log"] = np.mean(sizes), np.std(sizes), math.log1p(max(sizes))
    n = max(len(words), 1)
    found["symbol_words"] = sum(any(b in c.CLASSES["symbol"] + c.CLASSES["shout"] for b in w) for w in words) / n
    found["different_words"] = len(set(words)) / n
    pairs = list(zip(words, words[1:]))
    found["same_as_before"] = sum(x == y for x, y in pairs) / n
    found["same_pairs"] = 1 - len(set(pairs)) / len(pairs) if pairs else 0
    found["line_words"] = math.log1p(len(words) / max(len(lines), 1))
    found["repeated_lines"] = 1 - len(set(lines)) / len(lines) if lines else 0
    found["open_lines"] = sum(x.split()[-1][-1] not in b".!?:;" for x in lines) / max(len(lines), 1)
    return [found[name] for name in c.STATISTICS]


def test_statistics():
    found = c.statistics(*laid_out(pa.array(texts(), pa.string())))
    for text, row in zip(texts(), found):
        np.testing.assert_allclose(row, plain(text), atol=1e-9, err_msg=repr((text or "")[:40]))
    assert c.statistics(*laid_out(pa.array([], pa.string()))).shape == (0, len(c.STATISTICS))
    assert not c.statistics(*laid_out(pa.array([None, ""], pa.string()))).any()


def sample(n=400):
    rng = np.random.default_rng(5)
    rows = np.round(rng.random((n, len(c.STATISTICS))), 2)
    labels = ((rows[:, 3] > 0.6) ^ (rows[:, 7] < 0.3)).astype(float)
    return rows, labels


def test_first_split_is_the_best_of_all():
    rows, labels = sample()
    settings = c.Settings(trees=1, depth=1, bins=200)
    trees = c.fit(rows, labels, settings)
    p = (labels.sum() + 1) / (len(labels) + 2)
    gradient, weight = labels - p, np.full(len(labels), p * (1 - p))
    part = lambda some: gradient[some].sum() ** 2 / (weight[some].sum() + settings.ridge)
    gains = {(k, v): part(rows[:, k] <= v) + part(rows[:, k] > v) for k in range(rows.shape[1]) for v in np.unique(rows[:, k])[:-1]}
    chosen = trees.statistic[trees.roots[0]], trees.limit[trees.roots[0]]
    assert np.isclose(gains[chosen], max(gains.values()))


def test_flat_walk_equals_a_recursive_one():
    rows, labels = sample()
    trees = c.fit(rows, labels, c.Settings(trees=12, depth=3))

    def walk(node, row):
        if trees.left[node] == node:
            return trees.value[node]
        return walk(trees.left[node] if row[trees.statistic[node]] <= trees.limit[node] else trees.right[node], row)

    wanted = [trees.base + sum(walk(r, row) for r in trees.roots) for row in rows[:60]]
    np.testing.assert_allclose(trees.margins(rows[:60]), wanted)
    assert ((trees.scores(rows) > 0.5) == labels).mean() > 0.95


def test_little_to_learn_from():
    none = c.fit(np.zeros((0, len(c.STATISTICS))), np.zeros(0))
    assert none.scores(np.ones((2, len(c.STATISTICS)))).tolist() == [0.5, 0.5]
    one = c.fit(np.ones((3, len(c.STATISTICS))), np.ones(3))
    assert np.allclose(one.scores(np.zeros((1, len(c.STATISTICS)))), 0.8)
    same = c.fit(np.ones((4, len(c.STATISTICS))), np.array([1.0, 0, 1, 1]))
    assert np.isfinite(same.scores(np.ones((1, len(c.STATISTICS))))).all()


def test_rows(spark):
    rows = [*enumerate(texts()), (None, "no id"), (12, texts()[12]), (12, "another text of id 12"), (12, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS score", "2 AS label", "'x' AS statistics").repartition(3)
    marks = [(i, i % 2) for i in range(25)] + [(3, 1), (3, 0), (None, 1), (5, None), (900, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int").selectExpr("*", "'x' AS text")
    found = c.classify(docs, labels).collect()
    assert len(found) == len(rows)
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in rows)
    for r in found:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    empties = {r["score"] for r in found if r["doc_id"] in (0, 1)}
    assert len(empties) == 1
    assert {r["score"] for r in c.classify(docs, labels.where("false")).collect()} == {0.5}
    assert c.classify(docs.where("false"), labels).count() == 0


def test_held_out_rows_do_not_teach(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id bigint, text string")
    marks = [(i, int(i % 3 > 0)) for i in range(31)]
    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in marks]
    results = [sorted(c.classify(docs, spark.createDataFrame(m, "doc_id bigint, quality int")).collect()) for m in (marks, other)]
    assert results[0] == results[1]


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = c.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    judged = found.where("held_out").join(table(spark, sf_dir, "labels"), "doc_id").select("predicted", "quality").collect()
    assert len(judged) > 50
    assert sum(r["predicted"] == r["quality"] for r in judged) / len(judged) > 0.95
