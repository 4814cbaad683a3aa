import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecloop.session import fresh_path
from vecloop.sources import text

TOO_FEW, WIDTH, NUMBER, FINITE = "too few values", "wrong number of dimensions", "not a number", "not finite"


@pytest.fixture
def parse(spark):
    """value -> (reason, y, x) for each line."""

    def run(parser, lines, *args):
        df = parser(spark.createDataFrame([(v,) for v in lines], "value string"), *args)
        return {r["value"]: (r["reason"], r["y"] if "y" in df.columns else None, r["x"]) for r in df.collect()}

    return run


def reasons(parsed):
    return {line: row[0] for line, row in parsed.items()}


def test_labeled_lenient(parse):
    found = parse(text.parse_labeled, ["1 2 3", "  -1   2.5  3e1 ", "1 2 3 4", "1 2 3 x", "1 2", "", "   ", "1 x 3", "1 NaN 3", "Infinity 2 3", "1\t2 3 4"], 2)
    assert found["1 2 3"] == (None, 1.0, [2.0, 3.0])
    assert found["  -1   2.5  3e1 "] == (None, -1.0, [2.5, 30.0])
    assert found["1 2 3 4"] == found["1 2 3 x"] == (None, 1.0, [2.0, 3.0])
    bad = {k: v for k, v in reasons(found).items() if v}
    assert bad == {"1 2": TOO_FEW, "": TOO_FEW, "   ": TOO_FEW, "1 x 3": NUMBER, "1 NaN 3": FINITE, "Infinity 2 3": FINITE, "1\t2 3 4": NUMBER}


def test_labeled_strict(parse):
    found = parse(text.parse_labeled_strict, ["1 2 3", "1 2 3   ", " 1 2 3", "1  2 3", "1  3", "1 2 3 4", "1 2", "", "1 2 -Infinity"], 2)
    assert found["1 2 3"] == found["1 2 3   "] == (None, 1.0, [2.0, 3.0])
    bad = {k: v for k, v in reasons(found).items() if v}
    assert bad == {" 1 2 3": WIDTH, "1  2 3": WIDTH, "1  3": NUMBER, "1 2 3 4": WIDTH, "1 2": WIDTH, "": WIDTH, "1 2 -Infinity": FINITE}


def test_label_last(parse):
    lines = ["2 3 1", "2 3 -1.9", "1", "2  3 1", "2 3 4e10", "x 1", "2 3 1 "]
    found = parse(text.parse_label_last, lines)
    assert found["2 3 1"] == found["2 3 1 "] == (None, 1, [2.0, 3.0])
    assert found["2 3 -1.9"] == (None, -1, [2.0, 3.0])
    assert found["1"] == (None, 1, [])
    bad = {k: v for k, v in reasons(found).items() if v}
    assert bad == {"2  3 1": NUMBER, "2 3 4e10": "label out of range", "x 1": NUMBER}
    assert reasons(parse(text.parse_label_last, ["2 3 1", "2 1"], 2)) == {"2 3 1": None, "2 1": WIDTH}


def test_vectors(parse):
    found = parse(text.parse_vectors, ["1 2 3", "1", "1  2", "", " 1", "1 2 "])
    assert {k: v[2] for k, v in found.items() if v[0] is None} == {"1 2 3": [1, 2, 3], "1": [1], "1 2 ": [1, 2]}
    assert {v[0] for v in found.values() if v[0]} == {NUMBER}
    assert reasons(parse(text.parse_vectors, ["1 2 3", "1 2"], 2)) == {"1 2 3": WIDTH, "1 2": None}


def test_vectors_fixed(parse):
    found = parse(text.parse_vectors_fixed, ["1 2 3", "  1   2", "1", "1 x"], 2)
    assert found["1 2 3"][2] == found["  1   2"][2] == [1, 2]
    assert (found["1"][0], found["1 x"][0]) == (TOO_FEW, NUMBER)


def test_wide_lines_parse_like_narrow_ones(parse):
    width = text.UNROLL_WIDTH + 3
    good = " ".join(str(i) for i in range(width + 1))
    found = parse(text.parse_labeled, [good, good.replace("7", "x", 1), good.replace("5", "NaN", 1), "1 2"], width)
    assert found[good] == (None, 0.0, [float(i) for i in range(1, width + 1)])
    assert sorted(v[0] for v in found.values() if v[0]) == sorted([NUMBER, FINITE, TOO_FEW])


def test_points_and_rejects_split_the_lines(spark):
    lines = spark.createDataFrame([("1 2",), ("1 x",), ("1",)], "value string")
    parsed = text.parse_labeled(lines, 1)
    assert [tuple(r) for r in text.points(parsed).collect()] == [(1.0, [2.0])]
    assert {tuple(r) for r in text.rejects(parsed).collect()} == {("1 x", NUMBER), ("1", TOO_FEW)}


def test_fail_mode(spark):
    lines = spark.createDataFrame([("1 2",), ("1 x",)], "value string")
    parsed = text.parse_labeled(lines, 1)
    with pytest.raises(PySparkException, match="not a number: 1 x"):
        text.points(parsed, "fail").collect()
    good = text.parse_labeled(lines.where("value = '1 2'"), 1)
    assert [tuple(r) for r in text.points(good, "fail").collect()] == [(1.0, [2.0])]
    with pytest.raises(ValueError):
        text.points(parsed, "skip")


def test_further_columns_pass_through(spark):
    lines = spark.createDataFrame([("1 2", "a")], "value string, source string")
    assert text.parse_vectors(lines, 2).columns == ["value", "source", "reason", "x"]


def test_reject_counts(spark):
    lines = spark.createDataFrame([("1 2",), ("1",), ("1 x",), ("1 y",)], "value string")
    counts = text.reject_counts(
        lines, {"a": lambda df: text.parse_labeled(df, 1), "b": lambda df: text.parse_vectors(df, 1)}
    )
    assert {tuple(r) for r in counts.collect()} == {("a", TOO_FEW, 1), ("a", NUMBER, 2), ("b", WIDTH, 3)}


def test_write_and_load(spark, make_points):
    x, y = [[0.1, 2 / 3], [1e-12, 1e300]], [1.0, -1.0]
    points = make_points(x, y, 2)
    path = fresh_path(spark, "test")
    text.write_points(points.drop("id"), path)
    text.write_points(points.drop("id"), path)  # replaces the first copy
    loaded = text.points(text.parse_labeled(text.scan_lines(spark, path), 2))
    assert sorted((r["y"], r["x"]) for r in loaded.collect()) == sorted(zip(y, x))
    assert "1.0 0.1 0.6666666666666666" in {r["value"] for r in text.scan_lines(spark, path).collect()}

    path = fresh_path(spark, "test")
    text.write_result(points.select("x"), path)
    lines = [r["value"] for r in text.scan_lines(spark, path).collect()]
    assert "0.1 0.6666666666666666 " in lines and all(v.endswith(" ") for v in lines)
    loaded = text.points(text.parse_vectors(text.scan_lines(spark, path), 2))
    assert sorted(r["x"] for r in loaded.collect()) == sorted(x)

    path = fresh_path(spark, "test")
    text.write_points(points.select("x"), path)
    assert text.scan_lines(spark, path).where(F.col("value").endswith(" ")).count() == 0


@pytest.fixture
def folder(tmp_path):
    """A folder of text files by name."""

    def make(**files):
        for name, content in files.items():
            (tmp_path / name).write_text(content)
        return str(tmp_path)

    return make


def test_first_width_is_that_of_the_first_record(spark, folder):
    path = folder(b="1 2 3 4\n", a="x\n1  2\nNaN 1\n\n5 6 7 \n1 2\n")
    assert text.first_width(spark, path) == 3
    assert reasons({r["value"]: (r["reason"],) for r in text.load_vectors(spark, path).collect()}) == {
        "1 2 3 4": WIDTH, "x": WIDTH, "1  2": NUMBER, "NaN 1": WIDTH, "": WIDTH, "5 6 7 ": None, "1 2": WIDTH,
    }


def test_first_width_without_a_record(spark, folder):
    assert text.first_width(spark, folder(a="", b="x y\n\n")) is None
    assert {r["reason"] for r in text.load_vectors(spark, folder()).collect()} == {NUMBER}


def test_first_width_is_found_behind_many_bad_files(spark, folder):
    path = folder(**{f"f{i:03}": "no number\n" for i in range(40)}, **{"f[x] {1}*": "1 2\n", "g": "1\n"})
    assert text.first_width(spark, path) == 2


@pytest.mark.parametrize("size", ["7b", "64b", "1g"])
def test_first_width_is_the_same_for_any_splits(spark, folder, size):
    lines = ["bad line"] * 30 + ["1 2 3 4 5"] + ["1 2"] * 50 + ["1 2 3 4 5"] * 3
    path = folder(part="\n".join(lines) + "\n", rest="1 2 3\n" * 20)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert text.first_width(spark, path) == 5
        assert text.points(text.load_vectors(spark, path)).count() == 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_label_last_has_the_first_records_width(spark, folder):
    path = folder(a="1 2 -1\n1 2 3 1\n4 5 1\n1 1\n")
    assert [tuple(r) for r in text.points(text.load_label_last(spark, path)).collect()] == [(-1, [1, 2]), (1, [4, 5])]
    assert text.points(text.load_label_last(spark, path, 3)).count() == 1
