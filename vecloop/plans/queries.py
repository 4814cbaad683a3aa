"""One query per operator, over the whole of the tables it reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecloop.functions import vectors as vec
from vecloop.operators import centers as ctr
from vecloop.operators import kmeans, logistic, timings
from vecloop.operators.blocked import train_kmeans_blocked
from vecloop.operators.runs import iteration_durations
from vecloop.operators.sampling import sample_k
from vecloop.plans import views
from vecloop.plans.matrix import KEPT, KEPT_ALSO, run_matrix
from vecloop.session import fresh_path
from vecloop.sources import generate, metrics, models, text

SEED = 42


def _long(df: DataFrame, array: str | Column, *keys: str) -> DataFrame:
    """A vector as rows ``(keys, pos, v)``, rounded for comparison."""
    column = F.col(array) if isinstance(array, str) else array
    exploded = df.select(*keys, F.posexplode(column).alias("pos", "v"))
    return exploded.select(*keys, "pos", _round("v"))


def _round(name: str) -> Column:
    # Adding 0 turns -0.0 into 0.0.
    return (F.round(F.col(name), 6) + F.lit(0.0)).alias(name)


def _wide(width: int, *keys: str) -> list:
    """A vector as columns ``x0, x1, ...``."""
    return [*keys, *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(width)]]


# Sources and sinks


def scan_text_lines(spark, sf_dir):
    path = fresh_path(spark, "lines")
    text.write_lines(views.lines(spark, sf_dir, views.CLEAN_LINE), path)
    return text.scan_lines(spark, path).agg(
        F.count(F.lit(1)).alias("line_count"), F.sum(F.length("value")).alias("total_length")
    )


def load_points_lenient(spark, sf_dir):
    parsed = text.parse_labeled(views.lines(spark, sf_dir, views.MESSY_LINE), views.LINE_WIDTH)
    return text.points(parsed).select(*_wide(3, "y"))


def load_points_strict(spark, sf_dir):
    parsed = text.parse_labeled_strict(views.lines(spark, sf_dir, views.MESSY_LINE), views.LINE_WIDTH)
    return text.points(parsed).select(*_wide(3, "y"))


def load_points_label_last(spark, sf_dir):
    parsed = text.parse_label_last(views.lines(spark, sf_dir, views.LABEL_LAST_LINE), views.LINE_WIDTH)
    return text.points(parsed).select(*_wide(3, "y"))


def load_vectors(spark, sf_dir):
    parsed = text.parse_vectors(views.lines(spark, sf_dir, views.MESSY_LINE), 1 + views.LINE_WIDTH)
    return text.points(parsed).select(*_wide(4))


def _sorted_lines(spark, sf_dir, ascending=True):
    """The messy lines in the order of their text, as files: which record is the first doesn't depend on the writing tasks."""
    path = fresh_path(spark, "lines")
    text.write_lines(views.lines(spark, sf_dir, views.MESSY_LINE).orderBy("value", ascending=ascending), path)
    return path


def load_vectors_inferred(spark, sf_dir):
    """Vectors as wide as the first record; the rejects are there as well, with their reason."""
    parsed = text.load_vectors(spark, _sorted_lines(spark, sf_dir))
    return parsed.groupBy("value", "reason", F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("lines"))


def load_label_last_inferred(spark, sf_dir):
    """Points with the label last, all as wide as the first record, which stands at the other end of the same lines."""
    parsed = text.load_label_last(spark, _sorted_lines(spark, sf_dir, ascending=False))
    return text.points(parsed).select(F.concat_ws(" ", F.col("x").cast("array<int>")).alias("x"), "y")


def load_vectors_fixed(spark, sf_dir):
    parsed = text.parse_vectors_fixed(views.lines(spark, sf_dir, views.MESSY_LINE), views.LINE_WIDTH)
    return text.points(parsed).select(*_wide(3))


def reject_summary(spark, sf_dir):
    """Rejected lines by loader and reason: five loaders, one scan."""
    lines = views.lines(spark, sf_dir, views.MESSY_LINE)
    parsers = {
        "lenient": lambda df: text.parse_labeled(df, 3),
        "strict": lambda df: text.parse_labeled_strict(df, 3),
        "label_last": lambda df: text.parse_label_last(df, 3),
        "vectors": lambda df: text.parse_vectors(df, 4),
        "vectors_fixed": lambda df: text.parse_vectors_fixed(df, 3),
    }
    return text.reject_counts(lines, parsers)


def _event_ids(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))


def gen_labeled_points(spark, sf_dir):
    """One generated point per event."""
    points = generate.labeled_points(_event_ids(spark, sf_dir), 10, SEED)
    wide = points.select(*_wide(10, "id", "y"))
    return wide.select("id", "y", *[_round(f"x{i}") for i in range(10)])


def gen_vectors(spark, sf_dir):
    """One generated vector per event."""
    wide = generate.vectors(_event_ids(spark, sf_dir), 10, SEED).select(*_wide(10, "id"))
    return wide.select("id", *[_round(f"x{i}") for i in range(10)])


def write_points_text(spark, sf_dir):
    """Line items' points, written as text and loaded again."""
    path = fresh_path(spark, "points")
    text.write_points(views.points_lr(spark, sf_dir), path)
    return text.points(text.parse_labeled(text.scan_lines(spark, path), 4)).select(*_wide(4, "y"))


def write_result_text(spark, sf_dir):
    """The gradient term of every line item, written as result vectors and read again."""
    path = fresh_path(spark, "result")
    terms = logistic.gradient_terms(views.points_lr(spark, sf_dir), views.LR_START)
    text.write_result(terms.select(F.col("term").alias("x")), path)
    lines = text.scan_lines(spark, path)
    loaded = text.parse_vectors(lines, 4).withColumn("ends_with_space", F.col("value").endswith(" "))
    good = loaded.where(F.col("reason").isNull()).select(*_wide(4, "ends_with_space"))
    return good.select("ends_with_space", *[_round(f"x{i}") for i in range(4)])


def model_history(spark, sf_dir):
    """Train, save the weights of every iteration, read the table back."""
    path = fresh_path(spark, "weights")
    trained = logistic.train_logistic(views.points_lr(spark, sf_dir), views.ITERATIONS, views.LR_START)
    models.save_history(trained.history(), path)
    return _long(models.weights_history(spark, path), "w", "iter")


def resume_from_iteration(spark, sf_dir):
    """Five iterations, saved; then five more from the saved model."""
    path = fresh_path(spark, "resume")
    points = views.points_lr(spark, sf_dir)
    models.save_history(logistic.train_logistic(points, 5, views.LR_START).history(), path)
    again = logistic.train_logistic(points, 5, models.load_weights(spark, path, 5), first_iter=5)
    return _long(again.history(), "w", "iter")


def write_metrics(spark, sf_dir):
    """Append the events' metrics to the metrics table, later iterations twice as after a restart, and read it back."""
    path = fresh_path(spark, "metrics")
    rows = views.event_metrics(spark, sf_dir)
    metrics.append_metrics(rows, path)
    metrics.append_metrics(rows.where("iter > 3"), path)
    return metrics.read_metrics_table(spark, path)


def read_metrics(spark, sf_dir):
    """The events' metrics as text, one number per line, read back in line order."""
    path = fresh_path(spark, "timings")
    metrics.write_metrics_text(views.event_metrics(spark, sf_dir), path)
    return metrics.read_metrics_text(spark, path)


def read_metrics_any(spark, sf_dir):
    """Runs of three algorithms, written here and known by their table, and one run in part files as Hadoop names them."""
    path = fresh_path(spark, "timings")
    algo = F.get(F.array(F.lit("lr"), F.lit("kmeans"), F.lit("pagerank")), F.col("nodes") % 3)
    metrics.write_metrics_text(views.event_metrics(spark, sf_dir).withColumn("algo", algo), path)
    ours = metrics.read_metrics_text(spark, path)

    root = fresh_path(spark, "hadoop")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    orders = views.table(spark, sf_dir, "orders").orderBy("o_orderkey").select(cents.alias("value"))
    # Only the older writer names its files part-00000.
    orders.rdd.map(lambda row: row["value"]).saveAsTextFile(f"{root}/25/hadooppagerank.txt")
    runs = metrics.runs_frame(spark, [("25/hadooppagerank.txt", "hadoop", "pagerank", 25)])
    return timings.union_runs([ours, metrics.read_metrics_text(spark, root, runs=runs)])


# Vector functions


def vec_dot(spark, sf_dir):
    df = views.points_emb(spark, sf_dir)
    return df.select("id", vec.dot(F.col("x"), F.reverse("x")).alias("v")).select("id", _round("v"))


def vec_scale(spark, sf_dir):
    return _long(views.points_emb(spark, sf_dir), vec.scale(F.col("x"), F.col("label")), "id")


def vec_add(spark, sf_dir):
    return _long(views.points_emb(spark, sf_dir), vec.add(F.col("x"), F.reverse("x")), "id")


def vec_subtract(spark, sf_dir):
    return _long(views.points_emb(spark, sf_dir), vec.subtract(F.col("x"), F.reverse("x")), "id")


def vec_sqdist(spark, sf_dir):
    df = views.points_emb(spark, sf_dir)
    return df.select("id", vec.squared_distance(F.col("x"), F.reverse("x")).alias("v")).select("id", _round("v"))


# Logistic regression


def _terms(spark, sf_dir, rule):
    terms = logistic.gradient_terms(views.points_lr(spark, sf_dir), views.LR_START, rule)
    wide = terms.select(*[F.get("term", F.lit(i)).alias(f"g{i}") for i in range(4)])
    return wide.select(*[_round(f"g{i}") for i in range(4)])


def lr_gradient_terms(spark, sf_dir):
    return _terms(spark, sf_dir, "logistic")


def lr_gradient_terms_alt(spark, sf_dir):
    return _terms(spark, sf_dir, "alt")


def lr_gradient_sum(spark, sf_dir):
    sums = logistic.gradient_sum(views.points_lr(spark, sf_dir), views.LR_START)
    wide = sums.select("n", *[F.get("g", F.lit(i)).alias(f"g{i}") for i in range(4)])
    return wide.select("n", *[_round(f"g{i}") for i in range(4)])


def lr_train(spark, sf_dir):
    trained = logistic.train_logistic(views.points_lr(spark, sf_dir), views.ITERATIONS, views.LR_START)
    return _long(trained.history(), "w", "iter")


def _random_start(spark, sf_dir, init):
    """From the trainer's own start; the points' coordinates are below 1."""
    trained = logistic.train_logistic(views.points_lr(spark, sf_dir), views.ITERATIONS, init=init, width=4)
    return _long(trained.history(), "w", "iter")


def lr_train_uniform(spark, sf_dir):
    return _random_start(spark, sf_dir, "uniform")


def lr_train_int(spark, sf_dir):
    return _random_start(spark, sf_dir, "int")


def lr_train_text(spark, sf_dir):
    """Every line item's point as a line of text: scan, parse, keep in memory, iterate."""
    path = fresh_path(spark, "points")
    text.write_points(views.points_lr(spark, sf_dir), path)
    points = text.points(text.parse_labeled(text.scan_lines(spark, path), 4), "fail")
    return _long(logistic.train_logistic(points, views.ITERATIONS, views.LR_START).history(), "w", "iter")


def lr_train_table(spark, sf_dir):
    """The same lines, parsed once into a table that every iteration reads."""
    path = fresh_path(spark, "points")
    text.write_points(views.points_lr(spark, sf_dir), path)
    points = text.points(text.parse_labeled(text.scan_lines(spark, path), 4), "fail")
    return _long(logistic.train_logistic(points, views.ITERATIONS, views.LR_START, cache="table").history(), "w", "iter")


def rejects_in_training(spark, sf_dir):
    """Bad lines by reason: counted while a trainer first reads its points, and kept by the one pass that stores points and bad lines."""
    path = fresh_path(spark, "lines")
    text.write_lines(views.lines(spark, sf_dir, views.MESSY_LINE), path)
    parsed, seen = text.counted(text.parse_labeled(text.scan_lines(spark, path), 3))
    logistic.train_logistic(text.points(parsed), 2, [0.0] * 3)
    stored, _ = text.store(text.parse_labeled(text.scan_lines(spark, path), 3), fresh_path(spark, "parsed"))
    counted = spark.createDataFrame([(r, n) for r, n in seen.get.items() if n], "reason string, lines bigint")
    saved = text.rejects(stored).groupBy("reason").agg(F.count("value").alias("saved"))
    return counted.join(saved, "reason", "full")


def lr_train_uncached(spark, sf_dir):
    trained = logistic.train_logistic(views.points_lr(spark, sf_dir), views.ITERATIONS, views.LR_START, cache=False)
    return _long(trained.history(), "w", "iter")


def lr_train_alt(spark, sf_dir):
    trained = logistic.train_logistic(views.points_lr(spark, sf_dir), views.ITERATIONS, views.LR_START, rule="alt")
    return _long(trained.history(), "w", "iter")


def lr_train_wide(spark, sf_dir):
    """The trainer on 64-wide vectors, beyond the width that generated code handles well."""
    points = views.points_emb(spark, sf_dir)
    return _long(logistic.train_logistic(points, views.ITERATIONS, [0.0] * 64).history(), "w", "iter")


# K-means


def kmeans_assign(spark, sf_dir):
    assigned = kmeans.assign(views.points_emb(spark, sf_dir), views.first_centers(spark, sf_dir))
    return assigned.select("id", "cid")


def model_cross_join(spark, sf_dir):
    """Distance of every point to every centre; the centres ride along as one value, nothing is joined."""
    pairs = kmeans.distances(views.points_emb(spark, sf_dir).select("id", "x"), views.first_centers(spark, sf_dir))
    return pairs.select("id", "cid", _round("distance"))


def cluster_sum_count(spark, sf_dir):
    sums = kmeans.cluster_sums(views.points_emb(spark, sf_dir), views.first_centers(spark, sf_dir))
    return _long(sums, "g", "cid", "n")


def cluster_means(spark, sf_dir):
    means = kmeans.cluster_means(views.points_emb(spark, sf_dir), views.first_centers(spark, sf_dir))
    return _long(means, "c", "cid", "n")


def _old_and_new(spark, sf_dir):
    """Diagonal centres and the means of their clusters, most of which are empty."""
    centers = kmeans.diagonal_centers(views.K, 64)
    old = spark.createDataFrame(list(enumerate(centers)), "cid int, c array<double>")
    return old, kmeans.cluster_means(views.points_emb(spark, sf_dir), centers)


def centers_join(spark, sf_dir):
    joined = ctr.join_centers(*_old_and_new(spark, sf_dir))
    both = F.arrays_zip("old_c", F.coalesce("new_c", F.array_repeat(F.lit(None).cast("double"), 64)).alias("new_c"))
    exploded = joined.select("cid", F.posexplode(both).alias("pos", "pair"))
    return exploded.select("cid", "pos", F.col("pair.old_c").alias("old_v"), F.col("pair.new_c").alias("new_v")).select(
        "cid", "pos", _round("old_v"), _round("new_v")
    )


def centers_upsert(spark, sf_dir):
    return _long(ctr.upsert_centers(*_old_and_new(spark, sf_dir)), "c", "cid")


def center_shift(spark, sf_dir):
    return ctr.center_shift(*_old_and_new(spark, sf_dir)).select(_round("shift"))


def sample_centers(spark, sf_dir):
    drawn = sample_k(views.points_emb(spark, sf_dir), views.K, "id", SEED)
    return drawn.select("id", F.posexplode("x").alias("pos", "v"))


def _train_kmeans(spark, sf_dir, **options):
    return kmeans.train_kmeans(views.points_emb(spark, sf_dir), views.K, views.ITERATIONS, **options)


def kmeans_train(spark, sf_dir):
    trained = _train_kmeans(spark, sf_dir, centers=views.first_centers(spark, sf_dir))
    return _long(trained.history(), "c", "iter", "cid")


def kmeans_shift_history(spark, sf_dir):
    trained = _train_kmeans(spark, sf_dir, centers=views.first_centers(spark, sf_dir))
    return trained.shift_history().select("iter", _round("shift"))


def kmeans_train_diagonal(spark, sf_dir):
    trained = _train_kmeans(spark, sf_dir, init="diagonal", empty="drop")
    return _long(trained.history(), "c", "iter", "cid")


def _whole_points(spark, sf_dir):
    return views.points_lr(spark, sf_dir).select(F.transform("x", lambda v: F.round(v * views.WHOLE)).alias("x"))


def _whole_centers():
    return [[v * views.WHOLE for v in c] for c in views.spread_centers()]


def _whole(trained):
    exploded = trained.history().select("iter", "cid", F.posexplode("c").alias("pos", "v"))
    return exploded.select("iter", "cid", "pos", F.floor("v").alias("v"))


def kmeans_train_lineitem(spark, sf_dir):
    """K-means over every line item. Coordinates are whole numbers (ten millions for 1), so their sums are exact in any order."""
    points, centers = _whole_points(spark, sf_dir), _whole_centers()
    # One row group holds them all, and one task would read it.
    slots = spark.sparkContext.defaultParallelism
    trained = kmeans.train_kmeans(points, iterations=views.ITERATIONS, centers=centers, partitions=slots)
    return _whole(trained)


def kmeans_train_bounded(spark, sf_dir):
    """The same with bounds kept with the points."""
    return _whole(kmeans.train_kmeans(_whole_points(spark, sf_dir), iterations=views.ITERATIONS, centers=_whole_centers(), bounds=True))


def kmeans_train_text(spark, sf_dir):
    """The same from lines of text: scan, parse, keep in memory, iterate."""
    path = fresh_path(spark, "vectors")
    text.write_points(_whole_points(spark, sf_dir), path)
    points = text.points(text.parse_vectors_fixed(text.scan_lines(spark, path), 4), "fail")
    return _whole(kmeans.train_kmeans(points, iterations=views.ITERATIONS, centers=_whole_centers()))


def kmeans_train_table(spark, sf_dir):
    """The same lines, parsed once into a table that every iteration reads."""
    path = fresh_path(spark, "vectors")
    text.write_points(_whole_points(spark, sf_dir), path)
    points = text.points(text.parse_vectors_fixed(text.scan_lines(spark, path), 4), "fail")
    return _whole(kmeans.train_kmeans(points, iterations=views.ITERATIONS, centers=_whole_centers(), cache="table"))


def kmeans_train_sampled(spark, sf_dir):
    """From the trainer's own start, K embeddings drawn by their ids."""
    return _long(_train_kmeans(spark, sf_dir).history(), "c", "iter", "cid")


def kmeans_train_blocked(spark, sf_dir):
    """The centres as a table, three to a block and a few hundred points held at a time, so that several blocks pass by each point."""
    points = views.points_emb(spark, sf_dir)
    start = spark.createDataFrame(list(enumerate(views.first_centers(spark, sf_dir))), "cid int, c array<double>")
    trained = train_kmeans_blocked(points, start, views.ITERATIONS, block_numbers=3 * 64, held_numbers=400 * 64)
    return _long(trained.history(), "c", "iter", "cid")


def kmeans_resume(spark, sf_dir):
    """Five iterations, saved; then five more from the saved centres."""
    path = fresh_path(spark, "resume")
    points = views.points_emb(spark, sf_dir)
    start = views.first_centers(spark, sf_dir)
    models.save_history(kmeans.train_kmeans(points, iterations=5, centers=start).history(), path)
    again = kmeans.train_kmeans(points, iterations=5, centers=models.load_centers(spark, path, 5), first_iter=5)
    return _long(again.history(), "c", "iter", "cid")


# Metrics


def durations(spark, sf_dir):
    ends = views.user_ends(spark, sf_dir)
    rows = iteration_durations(ends, ["user_id"], ["end_ns", "event_id"], "end_ns", "start_ns")
    return rows.select("user_id", "event_id", "iter", "duration_ns")


def metrics_first_vs_rest(spark, sf_dir):
    runs = timings.first_vs_rest(views.event_metrics(spark, sf_dir))
    return runs.select("engine", "algo", "nodes", _round("first_s"), _round("later_s"))


def metrics_pivot(spark, sf_dir):
    table = timings.later_by_engine(views.event_metrics(spark, sf_dir), views.ENGINES)
    return table.select("algo", "nodes", *[_round(e) for e in views.ENGINES])


def metrics_one_engine(spark, sf_dir):
    return timings.one_engine(views.event_metrics(spark, sf_dir), "purchase").select("algo", "nodes", _round("later_s"))


def metrics_largest_cluster(spark, sf_dir):
    runs = timings.largest_cluster(views.event_metrics(spark, sf_dir))
    return runs.select("engine", "algo", "nodes", _round("first_s"), _round("later_s"))


def metrics_first_later_long(spark, sf_dir):
    rows = timings.first_later_long(views.event_metrics(spark, sf_dir))
    return rows.select("engine", "algo", "nodes", "series", _round("seconds"))


def metrics_union(spark, sf_dir):
    return timings.union_runs([views.event_metrics(spark, sf_dir), views.order_metrics(spark, sf_dir)])


def bench_matrix(spark, sf_dir):
    """The models of the four runs and whether each iteration was timed; the times are in the metrics table."""
    centers = views.first_centers(spark, sf_dir)
    models_, times = run_matrix(views.points_lr(spark, sf_dir), views.points_emb(spark, sf_dir), views.LR_START, centers)
    path = fresh_path(spark, "metrics")
    metrics.append_metrics(times, path)
    timed = metrics.read_metrics_table(spark, path).select("engine", "algo", "iter", (F.col("duration_ns") > 0).alias("timed"))
    return _long(models_.join(timed, ["engine", "algo", "iter"]), "c", "engine", "algo", "iter", "cid", "timed")


def bench_matrix_text(spark, sf_dir):
    """The matrix from lines of text: parsed in every iteration, kept in memory, or kept as a table."""
    paths = [fresh_path(spark, name) for name in ("labeled", "vectors")]
    text.write_points(views.points_lr(spark, sf_dir), paths[0])
    text.write_points(views.points_emb(spark, sf_dir).select("x"), paths[1])
    labeled = text.points(text.parse_labeled(text.scan_lines(spark, paths[0]), 4), "fail")
    vectors = text.points(text.load_vectors(spark, paths[1]), "fail")
    centers = views.first_centers(spark, sf_dir)
    models_, times = run_matrix(labeled, vectors, views.LR_START, centers, engines=KEPT | KEPT_ALSO)
    path = fresh_path(spark, "metrics")
    metrics.append_metrics(times, path)
    timed = metrics.read_metrics_table(spark, path).select("engine", "algo", "iter", (F.col("duration_ns") > 0).alias("timed"))
    return _long(models_.join(timed, ["engine", "algo", "iter"]), "c", "engine", "algo", "iter", "cid", "timed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        scan_text_lines, load_points_lenient, load_points_strict, load_points_label_last, load_vectors,
        load_vectors_fixed, reject_summary, gen_labeled_points, gen_vectors, write_points_text, write_result_text,
        model_history, resume_from_iteration, write_metrics, read_metrics, vec_dot, vec_scale, vec_add, vec_subtract,
        vec_sqdist, lr_gradient_terms, lr_gradient_terms_alt, lr_gradient_sum, lr_train, lr_train_uncached,
        lr_train_alt, lr_train_wide, kmeans_assign, model_cross_join, cluster_sum_count, cluster_means, centers_join,
        centers_upsert, center_shift, kmeans_train, kmeans_shift_history, kmeans_train_diagonal, kmeans_train_lineitem,
        metrics_first_vs_rest, metrics_pivot, metrics_one_engine, metrics_largest_cluster, metrics_first_later_long,
        metrics_union, bench_matrix, lr_train_uniform, lr_train_int, lr_train_text, kmeans_train_text,
        kmeans_train_sampled, kmeans_resume, load_vectors_inferred, load_label_last_inferred,
        read_metrics_any, kmeans_train_blocked, lr_train_table, kmeans_train_table, rejects_in_training,
        kmeans_train_bounded, bench_matrix_text,
    ]
    registered = {q.__name__: q for q in plain}
    # These two share their name with the operator they call.
    registered.update({"sample_k": sample_centers, "iteration_durations": durations})
    return registered
