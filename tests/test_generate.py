import hashlib

from vecloop.sources import generate


def expected(seed, i, pos):
    return int(hashlib.md5(f"{seed}:{i}:{pos}".encode()).hexdigest()[:13], 16) / 2**52


def test_same_for_any_partitioning(spark):
    ids = generate.ids(spark, 50)
    one = sorted(generate.labeled_points(ids.repartition(1), 4).collect())
    many = sorted(generate.labeled_points(ids.repartition(13), 4).collect())
    assert one == many and len(one) == 50
    assert sorted(generate.labeled_points(ids, 4, seed=1).collect()) != one


def test_values(spark):
    rows = generate.labeled_points(generate.ids(spark, 400), 3, seed=5).collect()
    assert {r["y"] for r in rows} == {1.0, -1.0}
    assert 120 < sum(r["y"] > 0 for r in rows) < 280
    for r in rows:
        assert r["x"] == [expected(5, r["id"], pos) for pos in (1, 2, 3)]
        assert all(0 <= v < 1 for v in r["x"])
    vectors = generate.vectors(generate.ids(spark, 10), 3, seed=5).collect()
    assert all(r["x"] == [expected(5, r["id"], pos) for pos in (0, 1, 2)] for r in vectors)
