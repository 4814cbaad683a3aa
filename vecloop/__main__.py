"""The jobs from the command line, for ``spark-submit`` or ``python -m vecloop``.

    generate labeled|vectors PATH FEATURES RECORDS
    lr PATH ITERATIONS
    kmeans PATH K ITERATIONS
    summary METRICS [first-rest|by-engine|largest]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecloop.functions.vectors import constant
from vecloop.operators import timings
from vecloop.operators.blocked import train_kmeans_blocked
from vecloop.operators.kmeans import train_kmeans
from vecloop.operators.logistic import initial_weights, train_logistic
from vecloop.operators.runs import number_in_order
from vecloop.operators.sampling import sample_vectors
from vecloop.session import fresh_path, remove_intermediates, write_and_reread
from vecloop.sources import generate, metrics, models, text

LABELED = {"lenient": text.parse_labeled, "strict": text.parse_labeled_strict, "label-last": text.parse_label_last}
VECTORS = {"fixed": text.parse_vectors_fixed, "whole": text.parse_vectors}


def _iteration(value: str) -> int | str:
    return value if value == "latest" else int(value)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="vecloop", description="Iterative jobs over points stored as text.")
    jobs = parser.add_subparsers(dest="job", required=True)

    gen = jobs.add_parser("generate", help="write random points as text")
    gen.add_argument("kind", choices=["labeled", "vectors"])
    gen.add_argument("path")
    gen.add_argument("features", type=int)
    gen.add_argument("records", type=int)
    gen.add_argument("--seed", type=int, default=42)

    lr = jobs.add_parser("lr", help="logistic regression; the label comes first on a line")
    lr.add_argument("path")
    lr.add_argument("iterations", type=int)
    lr.add_argument("--rule", choices=["logistic", "alt"], default="logistic")
    lr.add_argument("--init", choices=["uniform", "int"], default="uniform")
    lr.add_argument("--step", type=float, default=1.0)
    lr.add_argument("--format", choices=sorted(LABELED), default="lenient", help="how a line holds its point")

    kmeans = jobs.add_parser("kmeans", help="K-means")
    kmeans.add_argument("path")
    kmeans.add_argument("k", type=int)
    kmeans.add_argument("iterations", type=int)
    kmeans.add_argument("--init", choices=["sample", "diagonal"], default="sample")
    kmeans.add_argument("--empty", choices=["keep", "error", "drop"], default="keep")
    kmeans.add_argument("--format", choices=sorted(VECTORS), default="fixed", help="the first words of a line, or all of them")
    kmeans.add_argument("--blocked", action="store_true", help="centres in a table, for more than a process can hold")

    for job in (lr, kmeans):
        job.add_argument(
            "--resume", type=_iteration, metavar="ITERATION",
            help="start from this iteration of --model and run so many more; latest: from the last complete one, if any, up to so many in all",
        )
        job.add_argument("--width", type=int, help="features per line: 10, or for label-last and whole lines those of the first record")
        job.add_argument("--seed", type=int, default=42)
        job.add_argument("--bad-lines", choices=["fail", "reject"], default="fail", help="reject counts them by reason")
        job.add_argument("--rejects", metavar="PATH", help="with --bad-lines reject, save the bad lines here")
        job.add_argument("--partitions", type=int, help="lay the points out anew while loading")
        keep = job.add_mutually_exclusive_group()
        keep.add_argument("--no-cache", action="store_true", help="read the input again in every iteration")
        keep.add_argument("--table", action="store_true", help="parse the input once into a table, and read that in every iteration")
        job.add_argument("--model", help="save the model here after every iteration")
        job.add_argument("--metrics", help="append the time to this table after every iteration")
        job.add_argument("--engine", default="spark", help="name of this run in the metrics")
        job.add_argument("--nodes", type=int, default=1, help="cluster size of this run in the metrics")

    summary = jobs.add_parser("summary", help="first iteration against the mean of the rest")
    summary.add_argument("metrics")
    summary.add_argument("table", nargs="?", choices=["first-rest", "by-engine", "largest"], default="first-rest")
    return parser


def _generate(spark: SparkSession, args) -> None:
    make = generate.labeled_points if args.kind == "labeled" else generate.vectors
    points = make(generate.ids(spark, args.records, args.features), args.features, args.seed)
    text.write_points(points.drop("id"), args.path)


class _Input:
    """The points of a job, from one pass over its text. Bad lines end the job, or are counted, shown and, if asked for, saved."""

    def __init__(self, spark: SparkSession, args, parsers: dict, whole: str):
        self.cache: bool | str = "table" if args.table else not args.no_cache
        self.width = args.width
        if self.width is None and args.format == whole:
            values = text.first_width(spark, args.path)
            if values is None:
                raise ValueError(f"no record in {args.path}")
            self.width = values - (args.job == "lr")
        self.width = self.width or 10
        parsed = parsers[args.format](text.scan_lines(spark, args.path), self.width)
        self._counts = None
        if args.bad_lines == "reject" and args.rejects:
            parsed, found = text.store(parsed, fresh_path(spark, "parsed"))
            text.rejects(parsed).write.mode("overwrite").partitionBy("reason").text(args.rejects)
            self._show(found)
            self.cache = self.cache is True  # already a table
        elif args.bad_lines == "reject":
            parsed, self._counts = text.counted(parsed)
        self.points = text.points(parsed, args.bad_lines)

    def _show(self, counts: dict[str, int]) -> None:
        for reason, n in sorted(counts.items()):
            if n:
                print(f"rejected {n} lines: {reason}")

    def read(self) -> None:
        """To be called when the first iteration has read the points: what it has rejected is shown, once."""
        if self._counts is not None:
            self._show(self._counts.get)
            self._counts = None


def _save(spark: SparkSession, args, i: int, model: DataFrame | None, duration_ns: int | None) -> None:
    """The model, then the time, then the mark: an iteration without its mark is run, and timed, again."""
    if args.model and model is not None:
        models.save_history(model, args.model)
    if args.metrics and duration_ns is not None:
        row = metrics.metrics_frame(spark, args.engine, args.job, args.nodes, [duration_ns], i)
        metrics.append_metrics(row, args.metrics)
    if args.model:
        models.commit(spark, args.model, i)


def _first(spark: SparkSession, args) -> tuple[int | None, int]:
    """The saved iteration to start from, if any, and how many to run."""
    if args.resume != "latest":
        return args.resume, args.iterations
    done = models.latest_iteration(spark, args.model)
    print("nothing to resume" if done is None else f"resumed from iteration {done}")
    return done, max(0, args.iterations - (done or 0))


def _lr(spark: SparkSession, args) -> None:
    def done(i: int, weights: list[float], ns: int) -> None:
        print(f"iteration {i} took {ns} ns")
        data.read()
        _save(spark, args, i, models.weights_frame(spark, i, weights), ns)

    data = _Input(spark, args, LABELED, "label-last")
    saved, iterations = _first(spark, args)
    if saved is None:
        start, first_iter = initial_weights(spark, data.width, args.init, args.seed), 0
        _save(spark, args, 0, models.weights_frame(spark, 0, start), None)
    else:
        start, first_iter = models.load_weights(spark, args.model, saved), saved
    model = train_logistic(
        data.points, iterations, start, step=args.step, rule=args.rule,
        cache=data.cache, first_iter=first_iter, partitions=args.partitions, on_iteration=done,
    )
    print("weights:", *model.final)


def _kmeans(spark: SparkSession, args) -> None:
    def begin(centers: list[list[float]]) -> None:
        if saved is None:
            _save(spark, args, 0, models.centers_frame(spark, 0, centers), None)

    def done(i: int, centers: list[list[float]], shift: float | None, ns: int) -> None:
        print(f"iteration {i} took {ns} ns, shift {shift}")
        data.read()
        _save(spark, args, i, models.centers_frame(spark, i, centers), ns)

    data = _Input(spark, args, VECTORS, "whole")
    saved, iterations = _first(spark, args)
    if args.blocked:
        return _kmeans_blocked(spark, args, data, saved, iterations)
    start, first_iter = None, 0
    if saved is not None:
        start, first_iter = models.load_centers(spark, args.model, saved), saved
        if len(start) > args.k or len(start) < args.k and args.empty != "drop":
            raise ValueError(f"iteration {saved} has {len(start)} centres, not {args.k}")
    model = train_kmeans(
        data.points, args.k, iterations, start, init=args.init, width=data.width, id_col=None,
        empty=args.empty, cache=data.cache, seed=args.seed, first_iter=first_iter, partitions=args.partitions,
        on_start=begin, on_iteration=done,
    )
    for center in model.final:
        print("center:", *center)


def _kmeans_blocked(spark: SparkSession, args, data: _Input, saved: int | None, iterations: int) -> None:
    """Centres stay in a table; each iteration's folder is the saved model."""

    def done(i: int, centers: DataFrame, shift: float | None, ns: int) -> None:
        print(f"iteration {i} took {ns} ns, shift {shift}")
        data.read()
        _save(spark, args, i, None, ns)

    if saved is not None:
        # Copied, since the trainer writes its start to the folder this is read from.
        start = write_and_reread(models.centers_history(spark, args.model).where(f"iter = {saved}").select("cid", "c"), "start")
        if (n := start.count()) > args.k or n < args.k and args.empty != "drop":
            raise ValueError(f"iteration {saved} has {n} centres, not {args.k}")
    elif args.init == "diagonal":
        start = spark.range(args.k).select(F.col("id").alias("cid"), constant(F.col("id"), data.width).alias("c"))
    else:
        drawn = sample_vectors(data.points, args.k, args.seed)
        start = number_in_order(drawn, [], ["digest"], "digest").selectExpr("iter - 1 AS cid", "x AS c")
        if start.count() < args.k:
            raise ValueError(f"{args.k} centres wanted, but there are fewer points")
    model = train_kmeans_blocked(
        data.points, start, iterations, path=args.model, empty=args.empty, cache=data.cache, first_iter=saved or 0,
        partitions=args.partitions, on_start=lambda _: _save(spark, args, saved or 0, None, None), on_iteration=done,
    )
    print(f"centres: {model.path}")


def _summary(spark: SparkSession, args) -> None:
    runs = metrics.read_metrics_table(spark, args.metrics)
    if args.table == "by-engine":
        table = timings.later_by_engine(runs, timings.engines_of(runs)).orderBy("algo", "nodes")
    elif args.table == "largest":
        table = timings.first_later_long(runs).orderBy("algo", "nodes", "engine", "series")
    else:
        table = timings.first_vs_rest(runs).orderBy("algo", "nodes", "engine")
    table.show(truncate=False)


def main(argv: list[str] | None = None) -> None:
    parser = _parser()
    args = parser.parse_args(argv)
    if getattr(args, "resume", None) is not None and not args.model:
        parser.error("--resume needs --model")
    if getattr(args, "blocked", False) and not args.model:
        parser.error("--blocked needs --model, where the centres are kept")
    spark = SparkSession.builder.appName(f"vecloop {args.job}").getOrCreate()
    {"generate": _generate, "lr": _lr, "kmeans": _kmeans, "summary": _summary}[args.job](spark, args)


if __name__ == "__main__":
    main()
    remove_intermediates(SparkSession.active())
