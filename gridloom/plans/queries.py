"""Registered queries of the core engine, each beside the SQL that states its result.

The SQL sides are brute force: all pairs, whole groups. Doubles are rounded only
where sums or transcendental functions may differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elementwise as E
from ..operators.points import PointSet
from ..operators.tensor import Tensor, cat, stack

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

RADII = [0.1, 0.02, 0.06, 0.04, 0.08, 0.06]
SHELLS = [0.0, 0.01, 0.02, 0.03, 0.04, 0.05]
BOX = (1.1, 1.2)
KERNEL = [[0.5, -1.0, 0.25], [1.0, 2.0, -0.5], [0.0, 0.75, 1.5]]


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# --- points --------------------------------------------------------------------------------------

PART = "part AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / CAST(50 AS DOUBLE) AS x, (p_retailprice - CAST(900 AS DOUBLE)) / CAST(100 AS DOUBLE) AS y, p_retailprice AS w FROM main.part)"
CUST = "cust AS (SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) / CAST(25 AS DOUBLE) AS x, c_acctbal / CAST(10000 AS DOUBLE) AS y, c_acctbal AS w FROM customer)"
SUPP = "supp AS (SELECT s_suppkey AS id, CAST(s_nationkey AS DOUBLE) / CAST(25 AS DOUBLE) AS x, s_acctbal / CAST(10000 AS DOUBLE) AS y, s_acctbal AS w FROM supplier)"
D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def _wrapped(axis: str, side: float) -> str:
    d, s = f"abs(a.{axis} - b.{axis})", f"CAST('{side!r}' AS DOUBLE)"
    return f"(CASE WHEN {d} > {s} / 2 THEN {s} - {d} ELSE {d} END)"


D2_BOX = f"({_wrapped('x', BOX[0])} * {_wrapped('x', BOX[0])} + {_wrapped('y', BOX[1])} * {_wrapped('y', BOX[1])})"


def _num(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def part_points(spark, sf, periodic=None) -> PointSet:
    t = _read(spark, sf, "part").select("p_partkey", (F.col("p_size").cast("double") / 50.0).alias("x"), ((F.col("p_retailprice") - 900.0) / 100.0).alias("y"), "p_retailprice")
    return PointSet(t, "p_partkey", ["x", "y"], "p_retailprice", periodic)


def _account_points(spark, sf, table, p) -> PointSet:
    t = _read(spark, sf, table).select(F.col(f"{p}key").alias("id"), (F.col(f"{p[0]}_nationkey").cast("double") / 25.0).alias("x"), (F.col(f"{p[0]}_acctbal") / 10000.0).alias("y"), F.col(f"{p[0]}_acctbal").alias("w"))
    return PointSet(t, "id", ["x", "y"], "w")


def customers(spark, sf) -> PointSet:
    return _account_points(spark, sf, "customer", "c_cust")


def suppliers(spark, sf) -> PointSet:
    return _account_points(spark, sf, "supplier", "s_supp")


def _knn_sql(points: str, queries: str, d2: str, k: int) -> str:
    return f"SELECT query_id, CAST(rank AS INTEGER) AS rank, id, distance FROM (SELECT b.id AS query_id, a.id AS id, sqrt({d2}) AS distance, row_number() OVER (PARTITION BY b.id ORDER BY {d2}, a.id) AS rank FROM {points} a, {queries} b) WHERE rank <= {k}"


@query(f"WITH {PART} {_knn_sql('part', 'part', D2, 8)}")
def knn_part(spark, sf):
    p = part_points(spark, sf)
    return p.nearest(p, 8)


@query(f"WITH {CUST}, {SUPP} {_knn_sql('cust', 'supp', D2, 40)}")
def knn_cross_k40(spark, sf):
    return customers(spark, sf).nearest(suppliers(spark, sf), 40)


@query(f"WITH {PART} {_knn_sql('part', 'part', D2_BOX, 4)}")
def knn_periodic(spark, sf):
    p = part_points(spark, sf, BOX)
    return p.nearest(p, 4)


_ED2 = " + ".join(f"(a.v[{i}] - b.v[{i}]) * (a.v[{i}] - b.v[{i}])" for i in range(1, 65))


@query(f"WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT b.id AS query_id, a.id AS id, {_ED2} AS d2 FROM e a, e b) SELECT query_id, CAST(rank AS INTEGER) AS rank, id, sqrt(d2) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, id) AS rank FROM d) WHERE rank <= 8")
def knn_embeddings(spark, sf):
    p = PointSet(_read(spark, sf, "embeddings"), "vec_id", "embedding", dim=64)
    return p.nearest(p, 8)


@query(f"WITH {PART} SELECT b.id AS query_id, a.id AS id, sqrt({D2}) AS distance FROM part a, part b WHERE {D2} <= {_num(0.05 * 0.05)}")
def radius_part(spark, sf):
    p = part_points(spark, sf)
    return p.radius(p, 0.05)


@query(f"WITH {CUST}, {SUPP}, n AS (SELECT b.id AS query_id, count(*) AS n, string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY sqrt({D2}), a.id) AS ids FROM cust a, supp b WHERE {D2} <= {_num(0.01 * 0.01)} GROUP BY b.id) SELECT s.id AS query_id, CAST(coalesce(n.n, 0) AS INTEGER) AS n, coalesce(n.ids, '') AS ids FROM supp s LEFT JOIN n ON n.query_id = s.id")
def radius_csr(spark, sf):
    lists = customers(spark, sf).radius_lists(suppliers(spark, sf), 0.01)
    return lists.select("query_id", F.size("neighbours").alias("n"), F.array_join(F.transform("neighbours", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query(f"WITH {PART} SELECT b.id AS query_id, a.id AS id, sqrt({D2}) AS distance FROM part a, part b WHERE {D2} <= 0")
def radius_zero(spark, sf):
    p = part_points(spark, sf)
    return p.radius(p, 0.0)


@query(f"WITH {CUST}, {SUPP} SELECT b.id FROM supp b WHERE EXISTS (SELECT 1 FROM cust a WHERE {D2} <= {_num(0.005 * 0.005)})")
def radius_exists(spark, sf):
    return customers(spark, sf).has_neighbour(suppliers(spark, sf), 0.005)


@query(f"WITH {PART} SELECT a.id AS i, b.id AS j FROM part a, part b WHERE a.id < b.id AND {D2} <= {_num(0.05 * 0.05)}")
def pairs_self(spark, sf):
    return part_points(spark, sf).pairs(0.05)


@query(f"WITH {CUST}, {SUPP} SELECT a.id AS i, b.id AS j FROM cust a, supp b WHERE {D2} <= {_num(0.05 * 0.05)}")
def pairs_cross(spark, sf):
    return customers(spark, sf).pairs(0.05, suppliers(spark, sf))


@query(f"WITH {PART} SELECT a.id AS i, b.id AS j FROM part a, part b WHERE a.id < b.id AND {D2_BOX} <= {_num(0.1 * 0.1)}")
def pairs_periodic(spark, sf):
    return part_points(spark, sf, BOX).pairs(0.1)


def _counts_sql(tables: str, pair: str, d2: str, radii: list[float], cumulative: bool, value: str | None = None) -> str:
    rows = ", ".join(f"({k}, {_num(r)}, {_num(r * r)})" for k, r in enumerate(radii))
    inner = f"SELECT {d2} AS d2, {value or '1'} AS w FROM {pair}"
    below = "" if cumulative else " AND p.d2 > coalesce((SELECT max(q.s) FROM r q WHERE q.s < r.s OR (q.s = r.s AND q.k < r.k)), CAST(-1 AS DOUBLE))"
    total = "count(p.d2)" if value is None else "round(coalesce(sum(p.w), 0), 2)"
    # of equal radii the first has the shell; the others are empty
    return f"WITH {tables}, r(k, radius, s) AS (VALUES {rows}), p AS ({inner}) SELECT CAST(r.k AS INTEGER) AS k, r.radius, {total} AS \"count\" FROM r LEFT JOIN p ON p.d2 <= r.s{below} GROUP BY r.k, r.radius"


_SELF, _CROSS = "part a, part b WHERE a.id < b.id", "cust a, supp b"


@query(_counts_sql(PART, _SELF, D2, RADII, True))
def counts_cumulative(spark, sf):
    return part_points(spark, sf).counts(RADII)


@query(_counts_sql(PART, _SELF, D2, SHELLS, False))
def counts_shell(spark, sf):
    return part_points(spark, sf).counts(SHELLS, cumulative=False)


@query(_counts_sql(PART, _SELF, D2_BOX, RADII, True))
def counts_periodic(spark, sf):
    return part_points(spark, sf, BOX).counts(RADII)


@query(_counts_sql(f"{CUST}, {SUPP}", _CROSS, D2, RADII, True))
def cross_counts_cumulative(spark, sf):
    return customers(spark, sf).counts(RADII, suppliers(spark, sf))


@query(_counts_sql(f"{CUST}, {SUPP}", _CROSS, D2, SHELLS, False))
def cross_counts_shell(spark, sf):
    return customers(spark, sf).counts(SHELLS, suppliers(spark, sf), cumulative=False)


def _rounded(df: DataFrame, column: str = "count", digits: int = 2) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


@query(_counts_sql(PART, _SELF, D2, RADII, True, "a.w * b.w"))
def counts_weighted(spark, sf):
    return _rounded(part_points(spark, sf).counts_weighted(RADII))


@query(_counts_sql(PART, _SELF, D2, SHELLS, False, "a.w * b.w"))
def counts_weighted_shell(spark, sf):
    return _rounded(part_points(spark, sf).counts_weighted(SHELLS, cumulative=False))


@query(_counts_sql(f"{CUST}, {SUPP}", _CROSS, D2, RADII, True, "a.w * b.w"))
def cross_counts_weighted(spark, sf):
    return _rounded(customers(spark, sf).counts_weighted(RADII, suppliers(spark, sf)))


@query(f"WITH c AS ({_counts_sql(PART, _SELF, D2_BOX, SHELLS, False)}), n AS (SELECT count(*) AS n FROM main.part) SELECT c.k, c.radius, round(c.\"count\" / (n.n * (n.n - 1) / CAST(2 AS DOUBLE) * pi() * (c.radius * c.radius - p.radius * p.radius) / {_num(BOX[0] * BOX[1])}), 6) AS g FROM c JOIN c p ON p.k = c.k - 1, n")
def rdf(spark, sf):
    """Pair density in shells over that of evenly spread points."""
    p = part_points(spark, sf, BOX)
    n = p.bounds[0]
    c = p.counts(SHELLS, cumulative=False)
    inner = F.element_at(F.array(*map(F.lit, SHELLS)), F.col("k"))
    ideal = F.lit(n * (n - 1) / 2.0) * F.pi() * (F.col("radius") * F.col("radius") - inner * inner) / (BOX[0] * BOX[1])
    return c.where("k > 0").select("k", "radius", F.round(F.col("count") / ideal, 6).alias("g"))


@query(f"WITH {PART} SELECT CAST(floor(x / {_num(0.25 * (1 + 1e-9))}) AS BIGINT) AS c0, CAST(floor(y / {_num(0.25 * (1 + 1e-9))}) AS BIGINT) AS c1, count(*) AS num, min(x) AS min_0, max(x) AS max_0, min(y) AS min_1, max(y) AS max_1 FROM part GROUP BY 1, 2")
def bbox_stats(spark, sf):
    return part_points(spark, sf).stats(0.25)


@query(f"WITH {PART}, p AS (SELECT 0 AS axis, x AS v FROM part UNION ALL SELECT 1, y FROM part) SELECT CAST(axis AS INTEGER) AS axis, min(v) AS min, max(v) AS max, max(v) - min(v) AS spread FROM p GROUP BY axis")
def bbox(spark, sf):
    return part_points(spark, sf).bbox()


@query()
def kd_dump(spark, sf):
    return part_points(spark, sf).kd_nodes(leaf_size=64)


# --- columns -------------------------------------------------------------------------------------

_Z = "(l_discount - CAST('0.05' AS DOUBLE))"


@query(
    f"""SELECT l_orderkey, l_linenumber, -{_Z} AS neg, abs({_Z}) AS absolute, CASE WHEN {_Z} > 0 THEN 1.0::DOUBLE WHEN {_Z} < 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS sign, {_Z} * {_Z} AS square,
    sqrt(l_quantity) AS sqrt, 1 / sqrt(l_quantity) AS rsqrt, round(exp({_Z}), 9) AS exp, round(ln(l_quantity), 9) AS log, CASE WHEN {_Z} > 0 THEN {_Z} ELSE 0 END AS relu, round(1 / (1 + exp(-{_Z})), 9) AS sigmoid, round(tanh({_Z}), 9) AS tanh FROM lineitem"""
)
def elementwise_unary(spark, sf):
    t = _read(spark, sf, "lineitem").withColumn("z", F.col("l_discount") - F.lit(0.05))
    exact = {"neg": "z", "absolute": "z", "sign": "z", "square": "z", "sqrt": "l_quantity", "rsqrt": "l_quantity", "relu": "z"}
    close = {"exp": "z", "log": "l_quantity", "sigmoid": "z", "tanh": "z"}
    return t.select("l_orderkey", "l_linenumber", *[E.UNARY[f](c).alias(f) for f, c in exact.items()], *[F.round(E.UNARY[f](c), 9).alias(f) for f, c in close.items()])


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS add, l_quantity - l_tax AS sub, l_quantity * l_tax AS mul, CASE WHEN l_tax = 0 THEN CAST('inf' AS DOUBLE) ELSE l_quantity / l_tax END AS div, round(pow(l_quantity, l_tax), 9) AS pow FROM lineitem")
def elementwise_binary(spark, sf):
    q, t = "l_quantity", "l_tax"
    div = F.when(F.col(t) == 0, F.lit(E.INF)).otherwise(E.div(q, t))  # whatever is divided by 0
    return _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", E.add(q, t).alias("add"), E.sub(q, t).alias("sub"), E.mul(q, t).alias("mul"), div.alias("div"), E.rounded(E.power_libm(q, t), 9).alias("pow"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE CAST(0 AS DOUBLE) END AS picked, greatest(CAST(50000 AS DOUBLE), least(CAST(150000 AS DOUBLE), o_totalprice)) AS clamped FROM orders")
def where_clamp(spark, sf):
    return _read(spark, sf, "orders").select("o_orderkey", E.where(F.col("o_orderstatus") == "O", "o_totalprice", 0.0).alias("picked"), E.clamp("o_totalprice", 50000.0, 150000.0).alias("clamped"))


# --- arrays: the embeddings as [n, 64], row numbers from the ids --------------------------------

EMB = "e AS (SELECT vec_id AS i0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT max(i0) + 1 AS n FROM e)"
LAB = "y AS (SELECT vec_id AS i0, CAST(label AS BIGINT) AS y FROM embeddings)"


def matrix(spark, sf) -> Tensor:
    t = _read(spark, sf, "embeddings")
    return Tensor.rows(t, "vec_id", "embedding", (t.agg(F.max("vec_id")).first()[0] + 1, 64))


def labels(spark, sf, n: int) -> Tensor:
    return Tensor.wrap(_read(spark, sf, "embeddings"), (n,), ["vec_id"], "label")


def _r(t: Tensor, digits: int = 6) -> DataFrame:
    # + 0.0 folds a negative zero
    return t.df.withColumn("v", F.round("v", digits) + F.lit(0.0))


_PARTS = {"min": "min(v)", "max": "max(v)", "sum": "sum(v)", "mean": "avg(v)", "var": "var_pop(v)", "std": "stddev_pop(v)", "norm": "sqrt(sum(v * v))"}


def _reductions(sql_axis: str, axis: int | None, name: str) -> None:
    by = f", {sql_axis}" if sql_axis else ""
    sql = " UNION ALL ".join(f"SELECT '{k}' AS f{by}, round({x}, 6) + 0 AS v FROM e" + (f" GROUP BY {sql_axis}" if sql_axis else "") for k, x in _PARTS.items())

    @query(f"WITH {EMB} SELECT f{', ' + sql_axis + ' AS i0' if sql_axis else ''}, v FROM ({sql})", name)
    def reduced(spark, sf):
        m, out = matrix(spark, sf), None
        for k in _PARTS:
            rows = _r(getattr(m, k)(axis)).withColumn("f", F.lit(k))
            rows = rows.select("f", *(["i0"] if axis is not None else []), "v")
            out = rows if out is None else out.union(rows)
        return out


_reductions("i1", 0, "reduce_axis0")
_reductions("i0", 1, "reduce_axis1")
_reductions("", None, "reduce_all")


@query(f"WITH {EMB} SELECT 'min' AS f, i0, CAST(min(i1) AS BIGINT) AS idx FROM e WHERE v = (SELECT min(v) FROM e q WHERE q.i0 = e.i0) GROUP BY i0 UNION ALL SELECT 'max', i0, CAST(min(i1) AS BIGINT) FROM e WHERE v = (SELECT max(v) FROM e q WHERE q.i0 = e.i0) GROUP BY i0")
def arg_reduce(spark, sf):
    m = matrix(spark, sf)
    return m.argmin(1).select(F.lit("min").alias("f"), "i0", "idx").union(m.argmax(1).select(F.lit("max").alias("f"), "i0", "idx"))


@query(f"WITH {EMB} SELECT CAST((i0 * 64 + i1) // 128 AS BIGINT) AS i0, CAST((i0 * 64 + i1) // 8 % 16 AS BIGINT) AS i1, CAST((i0 * 64 + i1) % 8 AS BIGINT) AS i2, v FROM e")
def movement_reshape(spark, sf):
    return matrix(spark, sf).reshape(-1, 16, 8).df


@query(f"WITH {EMB} SELECT i0 * 64 + i1 AS i0, v FROM e")
def movement_flatten(spark, sf):
    return matrix(spark, sf).flatten().df


@query(f"WITH {EMB} SELECT CAST(i1 // 8 AS BIGINT) AS i0, i0 AS i1, CAST(i1 % 8 AS BIGINT) AS i2, v FROM e")
def movement_permute(spark, sf):
    return matrix(spark, sf).reshape(-1, 8, 8).permute(1, 0, 2).df


@query(f"WITH {EMB} SELECT i1 AS i0, i0 AS i1, v FROM e")
def movement_transpose(spark, sf):
    return matrix(spark, sf).transpose(0, 1).df


@query(f"WITH {EMB} SELECT i0, CAST((i1 - 5) // 7 AS BIGINT) AS i1, v FROM e WHERE i1 >= 5 AND i1 < 60 AND (i1 - 5) % 7 = 0")
def movement_slice(spark, sf):
    return matrix(spark, sf).slice(1, 5, 60, 7).df


@query(f"WITH {EMB} SELECT i0, CAST((62 - i1) // 3 AS BIGINT) AS i1, v FROM e WHERE i1 <= 62 AND i1 > 4 AND (62 - i1) % 3 = 0")
def movement_slice_back(spark, sf):
    return matrix(spark, sf).slice(1, -2, 4, -3).df


@query(f"WITH {EMB} SELECT i0, v FROM e WHERE i1 = 61")
def movement_select(spark, sf):
    return matrix(spark, sf).select(1, -3).df


@query(f"WITH {EMB} SELECT CAST(k AS BIGINT) AS i0, i0 AS i1, i1 AS i2, v FROM e, range(3) t(k)")
def movement_expand(spark, sf):
    m = matrix(spark, sf)
    return m.expand(3, *m.shape).df


@query(f"WITH {EMB} SELECT i0, CAST(0 AS BIGINT) AS i1, i1 AS i2, v FROM e")
def movement_unsqueeze(spark, sf):
    return matrix(spark, sf).unsqueeze(1).df


@query(f"WITH {EMB} SELECT i0, v FROM e WHERE i1 = 0")
def movement_squeeze(spark, sf):
    return matrix(spark, sf).slice(1, 0, 1).squeeze().df


@query(f"WITH {EMB} SELECT i0, i1, v FROM e UNION ALL SELECT i0, i1 + 64, -v FROM e WHERE i1 < 4")
def movement_cat(spark, sf):
    m = matrix(spark, sf)
    return cat([m, m.slice(1, 0, 4).neg()], 1).df


@query(f"WITH {EMB} SELECT i0, CAST(k AS BIGINT) AS i1, i1 AS i2, v * (k + 1) AS v FROM e, range(2) t(k)")
def movement_stack(spark, sf):
    m = matrix(spark, sf)
    return stack([m, m.mul(2.0)], 1).df


@query(f"WITH {EMB}, m AS (SELECT i1, avg(v) AS m FROM e GROUP BY i1) SELECT e.i0, e.i1, round(e.v - m.m, 6) + 0 AS v FROM e JOIN m ON m.i1 = e.i1")
def broadcast_center(spark, sf):
    m = matrix(spark, sf)
    return _r(m.sub(m.mean(0, keepdim=True)))


@query(f"WITH {EMB} SELECT a.i0, b.i0 AS i1, round(sum(a.v * b.v), 6) + 0 AS v FROM e a JOIN e b ON a.i1 = b.i1 GROUP BY a.i0, b.i0")
def matmul_gram(spark, sf):
    """Of all rows with each other."""
    m = matrix(spark, sf)
    # in binary: decimal rounding would cost more than the products
    return m.matmul(m.transpose(0, 1)).df.withColumn("v", E.rounded("v", 6) + F.lit(0.0))


@query(f"WITH {EMB} SELECT a.i1 AS i0, b.i1 AS i1, round(sum(a.v * b.v), 6) + 0 AS v FROM e a JOIN e b ON a.i0 = b.i0 GROUP BY a.i1, b.i1")
def matmul_gram_whole(spark, sf):
    """Of the columns with each other, over all rows."""
    m = matrix(spark, sf)
    return _r(m.transpose(0, 1).matmul(m))


@query(f"WITH {EMB} SELECT a.i0, CAST(a.i1 // 8 AS BIGINT) AS i1, CAST(b.i1 % 8 AS BIGINT) AS i2, round(sum(a.v * b.v), 6) + 0 AS v FROM e a JOIN e b ON a.i0 = b.i0 AND a.i1 % 8 = b.i1 // 8 GROUP BY 1, 2, 3")
def matmul_batched(spark, sf):
    m = matrix(spark, sf).reshape(-1, 8, 8)
    return _r(m.matmul(m))


_KER = ", ".join(f"({i}, {j}, {_num(v)})" for i, row in enumerate(KERNEL) for j, v in enumerate(row))
_CONV = f"k(ky, kx, w) AS (VALUES {_KER}), o AS (SELECT e0.i0 AS n, oy, ox FROM (SELECT DISTINCT i0 FROM e) e0, range(4) a(oy), range(4) b(ox)), t AS (SELECT e.i0 AS n, o2.oy, o2.ox, k.ky, k.kx, e.v, k.w FROM e, k, (SELECT oy, ox FROM range(4) a(oy), range(4) b(ox)) o2 WHERE e.i1 // 8 = o2.oy * 2 + k.ky - 1 AND e.i1 % 8 = o2.ox * 2 + k.kx - 1)"


@query(f"WITH {EMB}, {_CONV} SELECT o.n AS i0, CAST(0 AS BIGINT) AS i1, CAST(o.oy AS BIGINT) AS i2, CAST(o.ox AS BIGINT) AS i3, round(coalesce(sum(t.v * t.w), 0), 6) + 0 AS v FROM o LEFT JOIN t ON t.n = o.n AND t.oy = o.oy AND t.ox = o.ox GROUP BY o.n, o.oy, o.ox")
def conv2d_embeddings(spark, sf):
    return _r(matrix(spark, sf).reshape(-1, 1, 8, 8).conv2d(Tensor.of(spark, [[KERNEL]]), stride=2, padding=1))


@query(f"WITH {EMB}, m AS (SELECT i1, avg(v) AS m FROM e GROUP BY i1) SELECT round(avg((e.v - m.m) * (e.v - m.m)), 9) AS v FROM e JOIN m ON m.i1 = e.i1")
def mse(spark, sf):
    m = matrix(spark, sf)
    return _r(m.mse(m.mean(0, keepdim=True)), 9)


_LOGIT = f"{EMB}, {LAB}, z AS (SELECT i0, i1, v FROM e WHERE i1 < 10), lse AS (SELECT i0, ln(sum(exp(v))) AS l FROM z GROUP BY i0)"


@query(f"WITH {_LOGIT} SELECT round(avg(lse.l - z.v), 9) AS v FROM z JOIN y ON y.i0 = z.i0 AND y.y = z.i1 JOIN lse ON lse.i0 = z.i0")
def cross_entropy(spark, sf):
    m = matrix(spark, sf)
    return _r(m.slice(1, 0, 10).cross_entropy(labels(spark, sf, m.shape[0])), 9)


@query(f"WITH {_LOGIT} SELECT z.i0, z.i1, round(exp(z.v - lse.l), 9) AS v FROM z JOIN lse ON lse.i0 = z.i0")
def softmax(spark, sf):
    return _r(matrix(spark, sf).slice(1, 0, 10).softmax(1), 9)


@query(f"WITH {_LOGIT} SELECT z.i0, z.i1, round((exp(z.v - lse.l) - CASE WHEN y.y = z.i1 THEN 1 ELSE 0 END) / (SELECT n FROM s), 9) + 0 AS v FROM z JOIN lse ON lse.i0 = z.i0 JOIN y ON y.i0 = z.i0")
def grad_cross_entropy(spark, sf):
    m = matrix(spark, sf)
    z = m.slice(1, 0, 10).detach().requires_grad()
    z.cross_entropy(labels(spark, sf, m.shape[0])).backward()
    return _r(z.grad, 9)


@query(f"WITH {EMB}, m AS (SELECT i0, max(v) AS m FROM e GROUP BY i0), n AS (SELECT e.i0, count(*) AS c FROM e JOIN m ON m.i0 = e.i0 AND m.m = e.v GROUP BY e.i0) SELECT e.i0, e.i1, round(CASE WHEN e.v = m.m THEN 1 / CAST(n.c AS DOUBLE) ELSE 0 END + 2 * e.v, 6) + 0 AS v FROM e JOIN m ON m.i0 = e.i0 JOIN n ON n.i0 = e.i0")
def grad_reduce(spark, sf):
    x = matrix(spark, sf).detach().requires_grad()
    x.max(1).sum().add(x.square().sum()).backward()
    return _r(x.grad)


@query(f"WITH {EMB} SELECT i0, i1, round(exp(v) + (1 - tanh(v) * tanh(v)) + CASE WHEN v > 0 THEN 1 ELSE 0 END + CASE WHEN v > 0 THEN 1 WHEN v < 0 THEN -1 ELSE 0 END + exp(-v) / ((1 + exp(-v)) * (1 + exp(-v))), 6) + 0 AS v FROM e")
def grad_unary(spark, sf):
    x = matrix(spark, sf).detach().requires_grad()
    for part in (x.exp(), x.tanh(), x.relu(), x.abs(), x.sigmoid()):
        part.sum().backward()
    return _r(x.grad)


@query(f"WITH {EMB}, r AS (SELECT i1, sum(v) AS t FROM e GROUP BY i1) SELECT a.i0, a.i1, round(2 * r.t, 6) + 0 AS v FROM e a JOIN r ON r.i1 = a.i1")
def grad_matmul(spark, sf):
    """Of the sum of all products of rows."""
    x = matrix(spark, sf).detach().requires_grad()
    x.matmul(x.transpose(0, 1)).sum().backward()
    return _r(x.grad)


@query(f"WITH {EMB}, r AS (SELECT i0, sum(v) AS t FROM e GROUP BY i0) SELECT a.i0, a.i1, round(2 * r.t, 6) + 0 AS v FROM e a JOIN r ON r.i0 = a.i0")
def grad_matmul_whole(spark, sf):
    """Of the sum of all products of columns, over all rows."""
    x = matrix(spark, sf).detach().requires_grad()
    x.transpose(0, 1).matmul(x).sum().backward()
    return _r(x.grad)


@query(f"WITH {EMB}, {_CONV} SELECT CAST(0 AS BIGINT) AS i0, CAST(0 AS BIGINT) AS i1, CAST(ky AS BIGINT) AS i2, CAST(kx AS BIGINT) AS i3, round(sum(v), 6) + 0 AS v FROM t GROUP BY ky, kx")
def grad_conv2d(spark, sf):
    k = Tensor.of(spark, [[KERNEL]]).requires_grad()
    matrix(spark, sf).reshape(-1, 1, 8, 8).conv2d(k, stride=2, padding=1).sum().backward()
    return _r(k.grad)


@query(f"WITH {EMB} SELECT i0, i1, CASE WHEN i1 >= 2 AND i1 < 40 AND (i1 - 2) % 2 = 0 THEN CAST(3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + 1 AS v FROM e")
def grad_movement(spark, sf):
    x = matrix(spark, sf).detach().requires_grad()
    cat([x.slice(1, 2, 40, 2).mul(3.0), x.transpose(0, 1).reshape(-1, 64).slice(1, 0, 64).reshape(64, -1).transpose(0, 1)], 1).sum().backward()
    return x.grad.df


# --- creation, files, dumps, shuffles, training: what SQL can state of them ----------------------


def _bools(spark, **found) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "k string, v string")


def _said(**found) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in found.items()) + ") t(k, v)"


@query(" UNION ALL ".join(f"SELECT '{k}' AS f, CAST(a AS BIGINT) AS i0, CAST(b AS BIGINT) AS i1, CAST({v} AS DOUBLE) AS v FROM range(3) x(a), range(4) y(b)" for k, v in (("empty", 0), ("zeros", 0), ("ones", 1), ("fill", 2.5), ("of", "a * 4 + b"))))
def creation(spark, sf):
    made = {"empty": Tensor.empty(spark, (3, 4)), "zeros": Tensor.zeros(spark, (3, 4)), "ones": Tensor.ones(spark, (3, 4)), "fill": Tensor.fill(spark, (3, 4), 2.5), "of": Tensor.of(spark, [[4 * a + b for b in range(4)] for a in range(3)])}
    out = None
    for k, t in made.items():
        rows = t.df.select(F.lit(k).alias("f"), "i0", "i1", "v")
        out = rows if out is None else out.union(rows)
    return out


_RANDOM = ("rand", "uniform", "randn", "normal")


@query(" UNION ALL ".join(f"SELECT '{k}' AS f, CAST(20000 AS BIGINT) AS n, CAST(20000 AS BIGINT) AS places, true AS in_range, true AS mean_fits, true AS spread_fits, true AS repeats" for k in _RANDOM))
def random_invariants(spark, sf):
    """Number, places, range, mean and spread of 20,000 draws, and that a seed gives the same ones again."""
    out = None
    make = {"rand": (Tensor.rand, (1,), 0.5, 12**-0.5, (0, 1)), "uniform": (Tensor.uniform, (-1.0, 3.0, 2), 1.0, 4 * 12**-0.5, (-1, 3)), "randn": (Tensor.randn, (3,), 0.0, 1.0, None), "normal": (Tensor.normal, (5.0, 2.0, 4), 5.0, 2.0, None)}
    for k in _RANDOM:
        f, a, mean, spread, limits = make[k]
        t, again = f(spark, (5000, 4), *a), f(spark, (5000, 4), *a)
        inside = F.min((F.col("v") >= limits[0]) & (F.col("v") < limits[1])) if limits else F.min(~F.isnan("v"))
        same = again.sub(t).df.agg(F.max(F.abs("v")).alias("off"))
        rows = t.df.agg(F.count("*").alias("n"), F.count_distinct("i0", "i1").alias("places"), inside.alias("in_range"), (F.abs(F.avg("v") - mean) < 5 * spread / 20000**0.5).alias("mean_fits"), (F.abs(F.stddev_pop("v") / spread - 1) < 0.03).alias("spread_fits"))
        rows = rows.crossJoin(same).select(F.lit(k).alias("f"), "n", "places", "in_range", "mean_fits", "spread_fits", (F.col("off") == 0).alias("repeats"))  # a row by a row
        out = rows if out is None else out.union(rows)
    return out


@query(f"WITH {EMB} SELECT 'ndim' AS k, CAST(2 AS VARCHAR) AS v UNION ALL SELECT 'numel', CAST(n * 64 AS VARCHAR) FROM s UNION ALL SELECT 'shape', concat(n, ',64') FROM s UNION ALL SELECT 'stride', '64,1' UNION ALL SELECT 'scalar', '42.0' UNION ALL SELECT 'first', CAST(v AS VARCHAR) FROM e WHERE i0 = 0 AND i1 = 0")
def tensor_metadata(spark, sf):
    m = matrix(spark, sf)
    first = m.select(0, 0).select(0, 0)
    return _bools(spark, ndim=m.ndim, numel=m.numel, shape=",".join(map(str, m.shape)), stride=",".join(map(str, m.stride)), scalar=Tensor.scalar(spark, 42).item(), first=first.item())


@query(f"WITH {EMB} SELECT i0, i1, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM e")
def npy_round_trip(spark, sf):
    """Through NumPy files of 64 rows each in the shared folder."""
    from ..sources import npy
    from ..sources.tables import new_path

    path = new_path(spark, "npy")
    npy.write(matrix(spark, sf), path, 64)
    return npy.load(spark, path).df


@query(f"WITH {PART} SELECT CAST(count(*) AS BIGINT) AS num, min(x) AS min_0, max(x) AS max_0, min(y) AS min_1, max(y) AS max_1, CAST(count(*) AS BIGINT) AS in_leaves, true AS children_add_up, true AS leaves_small FROM part")
def kd_dump_round_trip(spark, sf):
    """The tree written as text and read again: its root, and what holds of all nodes."""
    from ..sources import dump
    from ..sources.tables import new_path

    path = new_path(spark, "dump")
    dump.write_nodes(part_points(spark, sf).kd_nodes(leaf_size=64), path, 2)
    nodes = dump.read_nodes(spark, path, 2)
    kids = nodes.where("axis >= 0").select("num", F.explode(F.array("left", "right")).alias("idx"), F.col("idx").alias("parent"))
    sums = kids.join(nodes.select("idx", F.col("num").alias("own")), "idx").groupBy("parent", "num").agg(F.sum("own").alias("s")).agg(F.min(F.col("s") == F.col("num")).alias("children_add_up"))
    leaves = nodes.where("axis < 0").agg(F.sum("num").alias("in_leaves"), F.min((F.col("num") <= 64) | (F.col("bbox_min") == F.col("bbox_max"))).alias("leaves_small"))
    root = nodes.where("idx = 0").select("num", *[F.col(f"bbox_{e}")[i].alias(f"{e}_{i}") for i in (0, 1) for e in ("min", "max")])
    return root.crossJoin(leaves).crossJoin(sums).select("num", "min_0", "max_0", "min_1", "max_1", "in_leaves", "children_add_up", "leaves_small")  # a row each


@query(f"WITH {PART}, b AS (SELECT max(x) - min(x) AS x, max(y) - min(y) AS y FROM part), s(side) AS (VALUES {', '.join(f'({_num(v)})' for v in (0.5, 0.9, 0.99, 1.0, 2.0))}) SELECT s.side, b.x > s.side OR b.y > s.side AS refused FROM s, b")
def spread_check(spark, sf):
    """Which periodic boxes are too small for the points."""
    found = []
    for side in (0.5, 0.9, 0.99, 1.0, 2.0):
        try:
            part_points(spark, sf, side)
            found.append((side, False))
        except ValueError:
            found.append((side, True))
    return spark.createDataFrame(found, "side double, refused boolean")


@query(f"WITH {EMB} SELECT i0 AS id, round(sum(v * (i1 + 1)), 6) + 0 AS s, true AS moved FROM e GROUP BY i0")
def shuffle_aligned(spark, sf):
    """Rows and their numbers shuffled together: each number still stands beside its row, and nearly all have moved."""
    from ..operators.tensor import shuffle

    m = matrix(spark, sf)
    ids = Tensor(spark.range(m.shape[0]).select(F.col("id").alias("i0"), F.col("id").cast("double").alias("v")), (m.shape[0],))
    x, y = shuffle([m, ids], 0, seed=3)
    sums = x.df.groupBy("i0").agg((F.round(F.sum(F.col("v") * (F.col("i1") + 1)), 6) + F.lit(0.0)).alias("s"))
    both = sums.join(y.df.select("i0", F.col("v").cast("long").alias("id")), "i0")
    still = both.where("i0 = id").agg((F.count("*") <= F.lit(m.shape[0] / 50 + 5)).alias("moved"))
    return both.select("id", "s").crossJoin(still).select("id", "s", "moved")  # one row


@query(f"WITH {EMB}, m AS (SELECT i1, avg(v) AS m, count(*) AS n FROM e GROUP BY i1) SELECT e.i0, e.i1, round(2 * (e.v - m.m) / m.n * 1000, 6) + 0 AS v FROM e JOIN m ON m.i1 = e.i1")
def grad_var(spark, sf):
    x = matrix(spark, sf).detach().requires_grad()
    x.var(0).sum().mul(1000.0).backward()
    return _r(x.grad)


_TAPS = "k(ky, kx, w) AS (VALUES " + _KER + "), g AS (SELECT y, x, sum(k.w) AS v FROM range(8) a(y), range(8) b(x), range(4) c(oy), range(4) d(ox), k WHERE y = oy * 2 + k.ky - 1 AND x = ox * 2 + k.kx - 1 GROUP BY y, x)"


@query(f"WITH {EMB}, {_TAPS} SELECT i0, CAST(0 AS BIGINT) AS i1, CAST(e.i1 // 8 AS BIGINT) AS i2, CAST(e.i1 % 8 AS BIGINT) AS i3, round(coalesce(g.v, 0), 6) + 0 AS v FROM e LEFT JOIN g ON g.y = e.i1 // 8 AND g.x = e.i1 % 8 UNION ALL SELECT -1, 0, 0, 0, CAST(n * 16 AS DOUBLE) FROM s")
def grad_conv2d_source(spark, sf):
    """Of the source, and (i0 = -1) of the bias."""
    x = matrix(spark, sf).reshape(-1, 1, 8, 8).detach().requires_grad()
    bias = Tensor.of(spark, [0.5]).requires_grad()
    x.conv2d(Tensor.of(spark, [[KERNEL]]), bias, stride=2, padding=1).sum().backward()
    zero = F.lit(0).cast("long")
    return _r(x.grad).union(_r(bias.grad).select(F.lit(-1).cast("long"), zero, zero, zero, "v"))


@query(f"WITH {EMB} SELECT i0, i1, CAST(6 AS DOUBLE) AS v FROM e")
def grad_lifecycle(spark, sf):
    """Copies pass gradients on, signs and views cut off don't, gradients add up until they are dropped."""
    from ..operators.lifecycle import Frame, no_grad

    x = matrix(spark, sf).detach().requires_grad()
    x.sum().backward()
    x.zero_grad()
    with no_grad():
        off = x.mul(7.0)
    with Frame() as frame:
        mark = frame.mark()
        for _ in range(2):
            x.clone().contiguous().mul(3.0).add(x.sign()).add(x.detach()).add(off).sum().backward()
        frame.rollback(mark)
    return x.grad.df


@query(f"WITH {EMB}, {LAB}, n AS (SELECT count(*) AS n FROM y), k AS (SELECT CAST(k AS BIGINT) AS k FROM range(10) t(k)) SELECT CAST(e.i1 AS BIGINT) AS i0, k.k AS i1, round(2 * sum(e.v * (CASE WHEN y.y = k.k THEN 1 ELSE 0 END - CAST('0.1' AS DOUBLE))) / any_value(n.n), 6) + 0 AS v, round(ln(10), 6) AS loss FROM e JOIN y ON y.i0 = e.i0, k, n GROUP BY 1, 2")
def sgd_step(spark, sf):
    """The weights of a linear classifier after one step from zero, and the loss before it."""
    import numpy as np

    from ..operators.training import sgd, softmax_loss

    got, history = sgd(_read(spark, sf, "embeddings"), "embedding", "label", {"w": np.zeros((64, 10)), "b": np.zeros(10)}, softmax_loss, rate=2.0, epochs=1)
    rows = spark.createDataFrame([(i, j, float(got["w"][i, j]), float(history[0])) for i in range(64) for j in range(10)], "i0 long, i1 long, v double, loss double")
    return rows.select("i0", "i1", (F.round("v", 6) + F.lit(0.0)).alias("v"), F.round("loss", 6).alias("loss"))


# points in clusters, and one far from all

CLUSTERS = "far AS (SELECT id, x, y FROM part UNION ALL SELECT -1 AS id, CAST(1000000 AS DOUBLE) AS x, CAST(1000000 AS DOUBLE) AS y)"


def clustered_points(spark, sf) -> PointSet:
    t = part_points(spark, sf).df.select("id", F.col("x0").alias("x"), F.col("x1").alias("y"))
    far = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(1e6).alias("x"), F.lit(1e6).alias("y"))
    return PointSet(t.union(far), "id", ["x", "y"])


@query(f"WITH {PART}, {CLUSTERS} {_knn_sql('far', 'far', D2, 5)}")
def knn_clustered(spark, sf):
    """All but one point in a millionth of the extent."""
    p = clustered_points(spark, sf)
    return p.nearest(p, 5)


@query(f"WITH {PART}, {CLUSTERS} SELECT a.id AS i, b.id AS j FROM far a, far b WHERE a.id < b.id AND {D2} <= {_num(0.03 * 0.03)}")
def pairs_clustered(spark, sf):
    return clustered_points(spark, sf).pairs(0.03)


# --- rows only -----------------------------------------------------------------------------------


@query()
def shuffle_rows(spark, sf):
    return matrix(spark, sf).shuffle(0, seed=3).df


@query()
def random_tensors(spark, sf):
    return cat([f(spark, (50, 4), *a) for f, a in ((Tensor.rand, (1,)), (Tensor.randn, (2,)), (Tensor.uniform, (-1.0, 1.0, 3)), (Tensor.normal, (5.0, 2.0, 4)))], 0).df


@query()
def train_softmax(spark, sf):
    import numpy as np

    from ..operators.training import sgd, softmax_loss

    rows = _read(spark, sf, "embeddings")
    _, history = sgd(rows, "embedding", "label", {"w": np.zeros((64, 10)), "b": np.zeros(10)}, softmax_loss, rate=2.0, momentum=0.5, epochs=3)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(history)], "epoch int, loss double")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
