"""The same queries as DuckDB SQL. Iterations are unrolled into one materialised step each."""

from __future__ import annotations

from vecloop.plans.views import (
    CLEAN_LINE,
    ENGINES,
    ITERATIONS,
    WHOLE,
    K,
    LABEL_LAST_LINE,
    LR_START,
    MESSY_LINE,
    spread_centers,
)

SEED = 42

POINTS_LR = """
SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y,
       l_quantity / 50 AS x0, l_extendedprice / 100000 AS x1, l_discount * 10 AS x2, l_tax * 10 AS x3
FROM lineitem
"""

POINTS_EMB = """
SELECT vec_id AS id, label::DOUBLE AS label,
       CASE WHEN label % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y, embedding::DOUBLE[] AS x
FROM embeddings
"""


def _lines(line: str) -> str:
    return f"""
SELECT {line} AS value
FROM (SELECT l_linenumber, l_returnflag,
             CASE WHEN l_returnflag = 'R' THEN '1' ELSE '-1' END AS y,
             l_linenumber::VARCHAR AS n, l_quantity::INT::VARCHAR AS q, l_suppkey::VARCHAR AS s
      FROM lineitem)
"""


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


# Loaders. The tokens and the numbers a loader uses; ``bad`` is why it rejects the line.

RUNS = "list_filter(string_split(value, ' '), lambda t: t <> '')"
SINGLE = "string_split(rtrim(value, ' '), ' ')"


def _parsed(line: str, tokens: str, shape: str, used: str) -> str:
    return f"""
SELECT *, CASE WHEN shape IS NOT NULL THEN shape
               WHEN len(list_filter(num, lambda v: v IS NULL)) > 0 THEN 'not a number'
               WHEN len(list_filter(num, lambda v: isnan(v) OR isinf(v))) > 0 THEN 'not finite' END AS bad
FROM (SELECT *, list_transform({used}, lambda t: TRY_CAST(t AS DOUBLE)) AS num
      FROM (SELECT *, {shape} AS shape FROM (SELECT value, {tokens} AS tok FROM ({_lines(line)}))))
"""


def _few(n: int) -> str:
    return f"CASE WHEN len(tok) < {n} THEN 'too few values' END"


def _wrong(n: int) -> str:
    return f"CASE WHEN len(tok) <> {n} THEN 'wrong number of dimensions' END"


LENIENT = _parsed(MESSY_LINE, RUNS, _few(4), "tok[1:4]")
STRICT = _parsed(MESSY_LINE, SINGLE, _wrong(4), "tok")
VECTORS = _parsed(MESSY_LINE, SINGLE, _wrong(4), "tok")
FIXED = _parsed(MESSY_LINE, RUNS, _few(3), "tok[1:3]")
LABEL_LAST = _parsed(LABEL_LAST_LINE, SINGLE, _wrong(4), "tok")




def _inferred(order: str) -> str:
    """Every line, its numbers, and why it is rejected if all must be as wide as the first that holds only numbers."""
    loose = _parsed(MESSY_LINE, SINGLE, "NULL", "tok")
    return f"""
WITH r AS MATERIALIZED ({loose}),
w AS (SELECT len(num) AS width FROM r WHERE bad IS NULL ORDER BY value {order} LIMIT 1)
SELECT value, num, CASE WHEN len(tok) <> width THEN 'wrong number of dimensions' ELSE bad END AS bad FROM r, w
"""


def _loaded(parsed: str, columns: str) -> str:
    return f"SELECT {columns} FROM ({parsed}) WHERE bad IS NULL"


def _uniform(pos: str | int, seed: int = SEED) -> str:
    return f"(('0x' || substr(md5('{seed}:' || event_id || ':' || {pos}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


# Logistic regression


def _dot4(w: str) -> str:
    return " + ".join(f"x{i} * {w}{i}" for i in range(4))


def _factor(rule: str, d: str) -> str:
    if rule == "logistic":
        return f"(1 / (1 + exp(-y * ({d}))) - 1) * y"
    den = f"(1 - y * exp({d}))"
    return f"(1 - CASE WHEN {den} = 0 THEN 'Infinity'::DOUBLE ELSE 1 / {den} END) * -y"


START = "SELECT 0 AS iter, " + ", ".join(f"{w}::DOUBLE AS w{i}" for i, w in enumerate(LR_START))


def _lr_terms(rule: str) -> str:
    terms = ", ".join(_r(f"c * x{i}", f"g{i}") for i in range(4))
    return f"SELECT {terms} FROM (SELECT *, {_factor(rule, _dot4('w'))} AS c FROM ({POINTS_LR}), ({START}))"


def _drawn_start(value: str) -> str:
    """Weights from the digest of (seed, position): ``value`` of a uniform ``u``."""
    u = "(('0x' || substr(md5('{seed}:' || {i}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    return "SELECT 0 AS iter, " + ", ".join(
        f"({value.format(u=u.format(seed=SEED, i=i))})::DOUBLE AS w{i}" for i in range(4)
    )


def _lr_train(rule: str = "logistic", start: str = START) -> str:
    sign = {"logistic": "-", "alt": "+"}[rule]
    steps = [f"p AS MATERIALIZED ({POINTS_LR})", f"m0 AS MATERIALIZED ({start})"]
    for i in range(1, ITERATIONS + 1):
        new = ", ".join(f"any_value(w{j}) {sign} sum(c * x{j}) AS w{j}" for j in range(4))
        steps.append(
            f"m{i} AS MATERIALIZED (SELECT {i} AS iter, {new} "
            f"FROM (SELECT *, {_factor(rule, _dot4('w'))} AS c FROM p, m{i - 1}))"
        )
    every = " UNION ALL ".join(
        f"SELECT iter, {j} AS pos, {_r(f'w{j}', 'v')} FROM m{i}" for i in range(ITERATIONS + 1) for j in range(4)
    )
    return f"WITH {', '.join(steps)} {every}"


def _lr_train_wide() -> str:
    steps = [
        f"p AS MATERIALIZED ({POINTS_EMB})",
        "e AS MATERIALIZED (SELECT id, y, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS pos FROM p)",
        "m0 AS MATERIALIZED (SELECT 0 AS iter, pos, 0.0::DOUBLE AS w FROM (SELECT DISTINCT pos FROM e))",
    ]
    for i in range(1, ITERATIONS + 1):
        steps.append(
            f"""m{i} AS MATERIALIZED (
SELECT {i} AS iter, pos, any_value(w) - sum(c * v) AS w
FROM e JOIN m{i - 1} USING (pos)
JOIN (SELECT id, {_factor('logistic', 'd')} AS c
      FROM (SELECT id, any_value(y) AS y, sum(v * w) AS d FROM e JOIN m{i - 1} USING (pos) GROUP BY id)) USING (id)
GROUP BY pos)"""
        )
    every = " UNION ALL ".join(f"SELECT iter, pos, {_r('w', 'v')} FROM m{i}" for i in range(ITERATIONS + 1))
    return f"WITH {', '.join(steps)} {every}"


# K-means

DISTANCE = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
DRAWN = f"SELECT row_number() OVER (ORDER BY md5('{SEED}:' || id), id) - 1 AS cid, x AS c FROM ({POINTS_EMB}) ORDER BY cid LIMIT {K}"
FIRST = f"SELECT row_number() OVER (ORDER BY id) - 1 AS cid, x AS c FROM ({POINTS_EMB}) ORDER BY id LIMIT {K}"
DIAGONAL = f"SELECT range AS cid, list_transform(range(64), lambda i: cid::DOUBLE) AS c FROM range({K})"


def _assigned(points: str, centers: str) -> str:
    return (
        f"SELECT id, any_value(x) AS x, min_by(cid, (d, cid)) AS cid "
        f"FROM (SELECT id, x, cid, {DISTANCE} AS d FROM {points}, {centers}) GROUP BY id"
    )


def _cluster_stats(centers: str) -> str:
    """Rows (cid, pos, n, s): count and sum per cluster and position."""
    return f"""
SELECT cid, pos, count(*) AS n, sum(v) AS s
FROM (SELECT cid, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS pos
      FROM ({_assigned(f'({POINTS_EMB})', f'({centers})')}))
GROUP BY cid, pos
"""


def _centers_long(centers: str) -> str:
    return f"SELECT cid, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS v FROM ({centers})"


def _old_new() -> str:
    return f"""
SELECT cid, pos, o.v AS old_v, m.s / m.n AS new_v
FROM ({_centers_long(DIAGONAL)}) o LEFT JOIN ({_cluster_stats(DIAGONAL)}) m USING (cid, pos)
"""


def _kmeans_steps(start: str, empty: str) -> list[str]:
    steps = [f"p AS MATERIALIZED ({POINTS_EMB})", f"m0 AS MATERIALIZED ({start})"]
    for i in range(1, ITERATIONS + 1):
        means = f"""
SELECT cid, list(v ORDER BY pos) AS c
FROM (SELECT cid, pos, avg(v) AS v
      FROM (SELECT cid, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS pos FROM ({_assigned('p', f'm{i - 1}')}))
      GROUP BY cid, pos)
GROUP BY cid
"""
        if empty == "keep":
            body = f"SELECT o.cid, coalesce(n.c, o.c) AS c FROM m{i - 1} o LEFT JOIN ({means}) n USING (cid)"
        else:
            body = f"SELECT row_number() OVER (ORDER BY cid) - 1 AS cid, c FROM ({means})"
        steps.append(f"m{i} AS MATERIALIZED ({body})")
    return steps


def _kmeans_train(start: str, empty: str) -> str:
    every = " UNION ALL ".join(
        f"SELECT {i} AS iter, cid, pos, {_r('v', 'v')} FROM ({_centers_long(f'SELECT * FROM m{i}')})"
        for i in range(ITERATIONS + 1)
    )
    return f"WITH {', '.join(_kmeans_steps(start, empty))} {every}"


def _kmeans_lineitem() -> str:
    """Four named coordinates instead of lists."""
    whole = ", ".join(f"round(x{j} * {WHOLE}) AS x{j}" for j in range(4))
    start = ", ".join(f"({i}, {', '.join(f'{v * WHOLE!r}::DOUBLE' for v in c)})" for i, c in enumerate(spread_centers()))
    distance = " + ".join(f"(x{j} - c{j}) * (x{j} - c{j})" for j in range(4))
    steps = [
        f"p AS MATERIALIZED (SELECT row_number() OVER () AS id, {whole} FROM ({POINTS_LR}))",
        f"m0 AS MATERIALIZED (SELECT * FROM (VALUES {start}) t(cid, c0, c1, c2, c3))",
    ]
    means = ", ".join(f"avg(x{j}) AS c{j}" for j in range(4))
    for i in range(1, ITERATIONS + 1):
        steps.append(
            f"""m{i} AS MATERIALIZED (
SELECT cid, {', '.join(f'coalesce(n.c{j}, o.c{j}) AS c{j}' for j in range(4))}
FROM m{i - 1} o LEFT JOIN (
  SELECT cid, {means}
  FROM p JOIN (SELECT id, min_by(cid, (d, cid)) AS cid FROM (SELECT id, cid, {distance} AS d FROM p, m{i - 1}) GROUP BY id)
       USING (id)
  GROUP BY cid) n USING (cid))"""
        )
    every = " UNION ALL ".join(
        f"SELECT {i} AS iter, cid, {j} AS pos, floor(c{j})::BIGINT AS v FROM m{i}"
        for i in range(ITERATIONS + 1)
        for j in range(4)
    )
    return f"WITH {', '.join(steps)} {every}"


def _kmeans_shift() -> str:
    moved = DISTANCE.replace("(x, c)", "(o.c, n.c)")
    every = " UNION ALL ".join(
        f"SELECT {i} AS iter, {_r(f'sum({moved})', 'shift')} FROM m{i - 1} o JOIN m{i} n USING (cid)"
        for i in range(1, ITERATIONS + 1)
    )
    return f"WITH {', '.join(_kmeans_steps(FIRST, 'keep'))} {every}"


# Metrics


def _durations(source: str, run: str, end: str, tie: str, start: str, keep: str) -> str:
    over = f"OVER (PARTITION BY {run} ORDER BY {end}, {tie})"
    return f"""
SELECT {keep}, row_number() {over} AS iter,
       (epoch_us({end}) - coalesce(lag(epoch_us({end})) {over}, epoch_us({start}))) * 1000 AS duration_ns
FROM {source}
"""


EVENT_METRICS = _durations(
    "(SELECT *, event_type AS engine, 'lr' AS algo, day(ts) AS nodes FROM events)",
    "engine, nodes", "ts", "event_id", "date_trunc('day', ts)::TIMESTAMP", "engine, algo, nodes",
)
ORDER_METRICS = _durations(
    "(SELECT *, o_orderstatus AS engine, 'kmeans' AS algo, month(o_orderdate) AS nodes FROM orders)",
    "engine, nodes", "o_orderdate", "o_orderkey", "TIMESTAMP '1990-01-01'", "engine, algo, nodes",
)

FIRST_REST = f"""
SELECT engine, algo, nodes, max(duration_ns / 1e9) FILTER (WHERE iter = 1) AS first_s,
       avg(duration_ns / 1e9) FILTER (WHERE iter > 1) AS later_s
FROM ({EVENT_METRICS}) GROUP BY engine, algo, nodes
"""
LARGEST = f"SELECT * FROM ({FIRST_REST}) WHERE nodes = (SELECT max(day(ts)) FROM events)"


def _matrix(*engines: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{engine}' AS engine, '{algo}' AS algo, iter::INT AS iter, {cid} AS cid, pos, v, true AS timed "
        f"FROM ({sql}) WHERE iter > 0"
        for engine in engines
        for algo, cid, sql in (("lr", "0", _lr_train()), ("kmeans", "cid", _kmeans_train(FIRST, "keep")))
    )


POSITIONS = (
    "model_history", "resume_from_iteration", "vec_scale", "vec_add", "vec_subtract", "lr_train", "lr_train_uncached",
    "lr_train_alt", "lr_train_wide", "cluster_sum_count", "cluster_means", "centers_join", "centers_upsert",
    "sample_k", "kmeans_train", "kmeans_train_blocked", "kmeans_train_diagonal", "kmeans_train_sampled", "kmeans_resume", "lr_train_text", "lr_train_table",
    "lr_train_uniform", "lr_train_int", "bench_matrix", "bench_matrix_text",
)
CLUSTER_IDS = (
    "kmeans_assign", "model_cross_join", "cluster_sum_count", "cluster_means", "centers_join", "centers_upsert",
    "kmeans_train", "kmeans_train_blocked", "kmeans_train_diagonal", "kmeans_train_sampled", "kmeans_resume", "bench_matrix", "bench_matrix_text",
)
NODES = (
    "write_metrics", "read_metrics", "read_metrics_any", "metrics_first_vs_rest", "metrics_pivot", "metrics_one_engine",
    "metrics_largest_cluster", "metrics_first_later_long", "metrics_union",
)


def oracle_sql() -> dict[str, str]:
    num3 = "num[2] AS x0, num[3] AS x1, num[4] AS x2"
    sorted_pivot = ", ".join(_r(f"max(later_s) FILTER (WHERE engine = '{e}')", e) for e in ENGINES)
    reject = " UNION ALL ".join(
        f"SELECT '{name}' AS loader, bad AS reason FROM ({sql}) WHERE bad IS NOT NULL"
        for name, sql in {
            "lenient": LENIENT,
            "strict": STRICT,
            "label_last": _parsed(MESSY_LINE, SINGLE, _wrong(4), "tok"),
            "vectors": VECTORS,
            "vectors_fixed": FIXED,
        }.items()
    )
    emb_long = f"SELECT id, generate_subscripts(x, 1) - 1 AS pos, unnest({{}}) AS v FROM ({POINTS_EMB})"

    def emb(expr: str) -> str:
        return f"SELECT id, pos, {_r('v', 'v')} FROM ({emb_long.format(expr)})"

    both = "list_zip(x, list_reverse(x))"
    sums = ", ".join(_r(f"sum(c * x{i})", f"g{i}") for i in range(4))
    sql = {
        "scan_text_lines": f"SELECT count(*) AS line_count, sum(length(value))::BIGINT AS total_length FROM ({_lines(CLEAN_LINE)})",
        "load_points_lenient": _loaded(LENIENT, f"num[1] AS y, {num3}"),
        "load_points_strict": _loaded(STRICT, f"num[1] AS y, {num3}"),
        "load_points_label_last": _loaded(
            LABEL_LAST, "trunc(num[4])::INT AS y, num[1] AS x0, num[2] AS x1, num[3] AS x2"
        ),
        "load_vectors": _loaded(VECTORS, "num[1] AS x0, num[2] AS x1, num[3] AS x2, num[4] AS x3"),
        "load_vectors_inferred": f"""SELECT value, bad AS reason, width::INT AS width, count(*) AS lines
FROM (SELECT value, bad, (SELECT len(num) FROM ({_inferred('ASC')}) WHERE bad IS NULL LIMIT 1) AS width FROM ({_inferred('ASC')})) GROUP BY ALL""",
        "load_label_last_inferred": f"""SELECT array_to_string(list_transform(num[:len(num) - 1], lambda v: v::INT::VARCHAR), ' ') AS x, trunc(num[len(num)])::INT AS y
FROM ({_inferred('DESC')}) WHERE bad IS NULL""",
        "load_vectors_fixed": _loaded(FIXED, "num[1] AS x0, num[2] AS x1, num[3] AS x2"),
        "reject_summary": f"SELECT loader, reason, count(*) AS lines FROM ({reject}) GROUP BY loader, reason",
        "gen_labeled_points": f"SELECT event_id AS id, CASE WHEN {_uniform(0)} < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS y, "
        + ", ".join(_r(_uniform(i + 1), f"x{i}") for i in range(10))
        + " FROM events",
        "gen_vectors": "SELECT event_id AS id, " + ", ".join(_r(_uniform(i), f"x{i}") for i in range(10)) + " FROM events",
        "write_points_text": POINTS_LR,
        "write_result_text": "SELECT true AS ends_with_space, "
        + ", ".join(_r(f"g{i}", f"x{i}") for i in range(4))
        + f" FROM ({_lr_terms('logistic').replace('round(', '(').replace(', 6)', ')')})",
        "model_history": _lr_train(),
        "resume_from_iteration": f"SELECT * FROM ({_lr_train()}) WHERE iter >= 5",
        "write_metrics": EVENT_METRICS,
        "read_metrics": EVENT_METRICS,
        "read_metrics_any": f"""
SELECT engine, ['lr', 'kmeans', 'pagerank'][1 + nodes % 3] AS algo, nodes, iter, duration_ns FROM ({EVENT_METRICS})
UNION ALL SELECT 'hadoop', 'pagerank', 25, row_number() OVER (ORDER BY o_orderkey), round(o_totalprice * 100)::BIGINT FROM orders""",
        "vec_dot": f"SELECT id, {_r(f'list_sum(list_transform({both}, lambda z: z[1] * z[2]))', 'v')} FROM ({POINTS_EMB})",
        "vec_scale": emb("list_transform(x, lambda v: v * label)"),
        "vec_add": emb(f"list_transform({both}, lambda z: z[1] + z[2])"),
        "vec_subtract": emb(f"list_transform({both}, lambda z: z[1] - z[2])"),
        "vec_sqdist": f"SELECT id, {_r(f'list_sum(list_transform({both}, lambda z: pow(abs(z[1] - z[2]), 2)))', 'v')} FROM ({POINTS_EMB})",
        "lr_gradient_terms": _lr_terms("logistic"),
        "lr_gradient_terms_alt": _lr_terms("alt"),
        "lr_gradient_sum": f"SELECT count(*) AS n, {sums} FROM (SELECT *, {_factor('logistic', _dot4('w'))} AS c FROM ({POINTS_LR}), ({START}))",
        "lr_train": _lr_train(),
        "lr_train_uncached": _lr_train(),
        "lr_train_alt": _lr_train("alt"),
        "lr_train_wide": _lr_train_wide(),
        "kmeans_assign": f"SELECT id, cid FROM ({_assigned(f'({POINTS_EMB})', f'({FIRST})')})",
        "model_cross_join": f"SELECT id, cid, {_r(DISTANCE, 'distance')} FROM ({POINTS_EMB}), ({FIRST})",
        "cluster_sum_count": f"SELECT cid, n, pos, {_r('s', 'v')} FROM ({_cluster_stats(FIRST)})",
        "cluster_means": f"SELECT cid, n, pos, {_r('s / n', 'v')} FROM ({_cluster_stats(FIRST)})",
        "centers_join": f"SELECT cid, pos, {_r('old_v', 'old_v')}, {_r('new_v', 'new_v')} FROM ({_old_new()})",
        "centers_upsert": f"SELECT cid, pos, {_r('coalesce(new_v, old_v)', 'v')} FROM ({_old_new()})",
        "center_shift": f"SELECT {_r('sum(pow(old_v - coalesce(new_v, old_v), 2))', 'shift')} FROM ({_old_new()})",
        "sample_k": f"""SELECT id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS v
FROM (SELECT * FROM ({POINTS_EMB}) ORDER BY md5('{SEED}:' || id), id LIMIT {K})""",
        "kmeans_train": _kmeans_train(FIRST, "keep"),
        "kmeans_train_blocked": _kmeans_train(FIRST, "keep"),
        "kmeans_shift_history": _kmeans_shift(),
        "kmeans_train_diagonal": _kmeans_train(DIAGONAL, "drop"),
        "kmeans_train_lineitem": _kmeans_lineitem(),
        "kmeans_train_text": _kmeans_lineitem(),
        "kmeans_train_table": _kmeans_lineitem(),
        "kmeans_train_bounded": _kmeans_lineitem(),
        "lr_train_table": _lr_train(),
        "rejects_in_training": f"SELECT bad AS reason, count(*) AS lines, count(*) AS saved FROM ({LENIENT}) WHERE bad IS NOT NULL GROUP BY bad",
        "kmeans_train_sampled": _kmeans_train(DRAWN, "keep"),
        "kmeans_resume": f"SELECT * FROM ({_kmeans_train(FIRST, 'keep')}) WHERE iter >= 5",
        "lr_train_text": _lr_train(),
        "lr_train_uniform": _lr_train(start=_drawn_start("2 * {u} - 1")),
        "lr_train_int": _lr_train(start=_drawn_start("floor(100 * {u})")),
        "bench_matrix": _matrix("cached", "uncached"),
        "bench_matrix_text": _matrix("cached", "uncached", "table"),
        "iteration_durations": _durations(
            "events", "user_id", "ts", "event_id", "date_trunc('day', ts)::TIMESTAMP", "user_id, event_id"
        ),
        "metrics_first_vs_rest": f"SELECT engine, algo, nodes, {_r('first_s', 'first_s')}, {_r('later_s', 'later_s')} FROM ({FIRST_REST})",
        "metrics_pivot": f"SELECT algo, nodes, {sorted_pivot} FROM ({FIRST_REST}) GROUP BY algo, nodes",
        "metrics_one_engine": f"SELECT algo, nodes, {_r('later_s', 'later_s')} FROM ({FIRST_REST}) WHERE engine = 'purchase'",
        "metrics_largest_cluster": f"SELECT engine, algo, nodes, {_r('first_s', 'first_s')}, {_r('later_s', 'later_s')} FROM ({LARGEST})",
        "metrics_first_later_long": f"""
SELECT engine, algo, nodes, 'first' AS series, {_r('first_s', 'seconds')} FROM ({LARGEST})
UNION ALL SELECT engine, algo, nodes, 'later' AS series, {_r('later_s', 'seconds')} FROM ({LARGEST})""",
        "metrics_union": f"({EVENT_METRICS}) UNION ALL ({ORDER_METRICS})",
    }
    # Positions, cluster ids and sizes are 32-bit here and there.
    narrow = {"pos": POSITIONS, "cid": CLUSTER_IDS, "nodes": NODES}
    for column, keys in narrow.items():
        for key in keys:
            sql[key] = f"SELECT * REPLACE ({column}::INT AS {column}) FROM ({sql[key]})"
    return sql
