"""Queries over the test tables, one per operator, and the SQL they are compared with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import integers as I  # noqa: E741
from .functions.views import FACTORIES, Bounds, LeftToRight, RightToLeft, Strided, View
from .operators.arrays import Array, copy_array, fill_value, verify_all
from .operators.arrays import vector_add as add_kernel
from .plans.events import BlockId, EventId
from .plans.runtime import Frames, Host, Runtime, Submission, write
from .sources.tables import read_array, read_vectors

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _column(rt: Runtime, sf: str, table: str, index: str, value: str | Column, shape: tuple[int, ...] | None = None) -> Array:
    path = f"{sf}/{table}.parquet"
    n = rt.spark.read.parquet(path).count()  # from the footers
    return read_array(rt, path, index, value, shape or (n,))


def _vectors(rt: Runtime, sf: str) -> Array:
    path = f"{sf}/embeddings.parquet"
    return read_vectors(rt, path, "vec_id", "embedding", 64, rt.spark.read.parquet(path).count())


@_query("SELECT event_id AS i, value + user_id AS v FROM events")
def vector_add_join(spark: SparkSession, sf: str) -> DataFrame:
    """Two arrays of one table: a join on i, which sides of a known size make a broadcast or a sort-merge join."""
    rt = Runtime(spark)
    a, b = _column(rt, sf, "events", "event_id", "value"), _column(rt, sf, "events", "event_id", F.col("user_id").cast("double"))
    c = rt.declare(a.size(), dtype="float64")
    rt.submit(Host(), add_kernel, a, b, write(c))
    return c.frame()


@_query("SELECT event_id AS i, value + user_id AS v FROM events")
def vector_add(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns of one table are one array of structures: the kernel is a narrow projection of the scan."""
    rt = Runtime(spark)
    both = _column(rt, sf, "events", "event_id", F.struct("value", "user_id"))
    c = rt.declare(both.size(), dtype="float64")
    rt.submit(Host(), lambda s: s["value"] + s["user_id"], both, write(c))
    return c.frame()


@_query("SELECT bool_and(abs((1.0::FLOAT + 2.0::FLOAT) - 3) <= 1e-9) AS ok FROM orders")
def init_verify(spark: SparkSession, sf: str) -> DataFrame:
    rt = Runtime(spark)
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    a, b, c = (rt.declare(n, dtype="float32") for _ in range(3))
    rt.submit(Host(), lambda: (F.lit(1.0), F.lit(2.0)), write(a), write(b))
    rt.submit(Host(), lambda x, y: x + y, a, b, write(c))
    return verify_all(c, 3.0)


@_query("SELECT event_id // 100 AS row, event_id % 100 AS col, value AS v FROM events")
def reshape_2d(spark: SparkSession, sf: str) -> DataFrame:
    a = _column(Runtime(spark), sf, "events", "event_id", "value")
    return a.reshape(a.size() // 100, 100).with_coordinates("row", "col")


_FLAT = "SELECT vec_id * 64 + j AS i, embedding[j + 1] AS v, vec_id AS row, j AS col FROM embeddings, range(64) r(j)"


@_query(f"SELECT i, v FROM ({_FLAT})")
def flatten_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(Runtime(spark), sf).flatten().frame()


@_query(f"SELECT col AS i, v FROM ({_FLAT}) WHERE row = 7")
def drop_axis0(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(Runtime(spark), sf).view().drop_axis(0, 7).frame_of()


@_query(f"SELECT row AS i, v FROM ({_FLAT}) WHERE col = 3")
def drop_axis1(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(Runtime(spark), sf).view().drop_axis(1, 3).frame_of()


@_query(f"SELECT col AS i, v FROM ({_FLAT}) WHERE row = 0")
def drop_axis_default(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(Runtime(spark), sf).view().drop_axis(0).frame_of()


@_query(f"SELECT (row - 10) * 8 + col - 8 AS i, v FROM ({_FLAT}) WHERE row BETWEEN 10 AND 19 AND col BETWEEN 8 AND 15")
def subview(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(Runtime(spark), sf).view().sub((10, 8), (10, 8)).frame_of()


def _points(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select("o_orderkey", F.expr("o_orderkey div 100").alias("row"), (F.col("o_orderkey") % 100).alias("col")), orders.count()


@_query("SELECT o_orderkey, (o_orderkey // 100) * 100 + o_orderkey % 100 AS at FROM orders")
def linearize_row_major(spark: SparkSession, sf: str) -> DataFrame:
    p, n = _points(spark, sf)
    return p.select("o_orderkey", RightToLeft(Bounds(n // 100, 100)).linearize((F.col("row"), F.col("col"))).alias("at"))


@_query("SELECT o_orderkey, o_orderkey // 100 + (o_orderkey % 100) * ((SELECT count(*) FROM orders) // 100) AS at FROM orders")
def linearize_col_major(spark: SparkSession, sf: str) -> DataFrame:
    p, n = _points(spark, sf)
    return p.select("o_orderkey", LeftToRight(Bounds(n // 100, 100)).linearize((F.col("row"), F.col("col"))).alias("at"))


@_query("SELECT o_orderkey, (o_orderkey // 100) * 256 + (o_orderkey % 100) * 2 AS at FROM orders")
def linearize_strided(spark: SparkSession, sf: str) -> DataFrame:
    p, n = _points(spark, sf)
    return p.select("o_orderkey", Strided(Bounds(n // 100, 100), (256, 2)).linearize((F.col("row"), F.col("col"))).alias("at"))


@_query("SELECT o_orderkey, o_orderkey // 100 >= 5 AND o_orderkey // 100 < 10 AND o_orderkey % 100 >= 20 AND o_orderkey % 100 < 60 AS inside FROM orders")
def in_bounds(spark: SparkSession, sf: str) -> DataFrame:
    p, n = _points(spark, sf)
    window = View.of((n // 100, 100)).sub((5, 20), (5, 40))
    return p.select("o_orderkey", window.in_bounds((F.col("row"), F.col("col"))).alias("inside"))


@_query(f"SELECT v FROM ({_FLAT}) WHERE row = 12 AND col = 34")
def point_access(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(Runtime(spark), sf).view()
    return v.frame.where(F.col("i") == v.data_at((12, 34))).select("v")


@_query("SELECT p_partkey AS i, p_retailprice AS v FROM part")
def copy_array_query(spark: SparkSession, sf: str) -> DataFrame:
    rt = Runtime(spark)
    a = _column(rt, sf, "part", "p_partkey", "p_retailprice")
    b = rt.declare(*a.shape, dtype="float64")
    copy_array(rt, a, b)
    return b.frame()


@_query("SELECT p_partkey AS i, 7 AS v FROM part")
def fill_value_query(spark: SparkSession, sf: str) -> DataFrame:
    rt = Runtime(spark)
    a = rt.declare(spark.read.parquet(f"{sf}/part.parquet").count(), dtype="int32")
    fill_value(rt, a, 7)
    return a.frame()


@_query("SELECT i, CAST([3, 5, 8][i % 3 + 1] AS INTEGER) AS v FROM range((SELECT count(*) + 1 FROM part)) r(i)")
def fill_pattern(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/part.parquet").count() + 1
    return Runtime(spark).fill((n,), [3, 5, 8], "int32").frame()


for _name in ("copy_array", "fill_value"):
    _QUERIES[_name], _SQL[_name] = _QUERIES.pop(f"{_name}_query"), _SQL.pop(f"{_name}_query")


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_size") - 10).cast("bigint").alias("x"), (F.col("p_partkey") % 7 - 3).alias("m"))


_P = "(SELECT p_partkey, CAST(p_size - 10 AS BIGINT) AS x, p_partkey % 7 - 3 AS m FROM part)"


@_query(f"SELECT p_partkey, CASE WHEN m = 0 THEN x ELSE CAST(ceil(x / abs(m)::DOUBLE) AS BIGINT) * abs(m) END AS v FROM {_P}")
def round_up_to_multiple(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", I.round_up_to_multiple(F.col("x"), F.col("m")).alias("v"))


@_query(f"SELECT p_partkey, (SELECT min(p) FROM (SELECT CAST(2 ** k AS BIGINT) AS p FROM range(62) r(k)) WHERE p >= x) AS v FROM {_P}")
def round_up_pow2(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", I.round_up_to_power_of_two(F.col("x")).alias("v"))


@_query(f"SELECT p_partkey, CASE WHEN m = 0 THEN 0 ELSE x // abs(m) + CASE WHEN x >= 0 AND x % abs(m) <> 0 THEN 1 ELSE 0 END END AS v FROM {_P}")
def div_ceil(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", I.div_ceil(F.col("x"), F.col("m")).alias("v"))


@_query(f"SELECT p_partkey, x IN (1, 2, 4, 8, 16, 32, 64) AS v FROM {_P}")
def is_pow2(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", I.is_power_of_two(F.col("x")).alias("v"))


@_query(f"SELECT p_partkey, x + m AS a, x * m AS b FROM {_P}")
def checked_add_mul(spark: SparkSession, sf: str) -> DataFrame:
    x, m = F.col("x"), F.col("m")
    return _parts(spark, sf).select("p_partkey", I.checked_add(x, m).alias("a"), I.checked_mul(x, m).alias("b"))


@_query(f"SELECT p_partkey, x + m + p_partkey AS v FROM {_P}")
def checked_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", I.checked_sum(F.array("x", "m", "p_partkey")).alias("v"))


@_query(f"SELECT p_partkey, x * m * p_partkey AS v FROM {_P}")
def checked_product(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", I.checked_product(F.array("x", "m", "p_partkey")).alias("v"))


@_query(f"SELECT p_partkey, x = m AS eq, x < m AS lt FROM {_P}")
def cmp_mixed(spark: SparkSession, sf: str) -> DataFrame:
    x, m = F.col("x"), F.col("m").cast("decimal(20,0)")
    return _parts(spark, sf).select("p_partkey", I.cmp_equal(x, m).alias("eq"), I.cmp_less(x, m).alias("lt"))


@_query(f"SELECT p_partkey, CAST(x AS INTEGER) AS v FROM {_P}")
def checked_cast(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", I.checked_cast(F.col("x"), "int32").alias("v"))


@_query("SELECT s_suppkey, CAST(s_suppkey AS INTEGER) AS v FROM supplier")
def checked_index(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    return s.select("s_suppkey", I.checked_index(F.col("s_suppkey"), F.lit(1 << 40)).alias("v"))


@_query("SELECT s_suppkey, (16 - s_suppkey % 16) % 16 AS v FROM supplier")
def align_pad(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", I.align_pad(F.col("s_suppkey"), F.lit(16).cast("bigint")).alias("v"))


@_query("SELECT o_orderkey AS i, o_totalprice * 2 + 1 AS v FROM orders")
def chained_tasks(spark: SparkSession, sf: str) -> DataFrame:
    rt = Runtime(spark)
    a = _column(rt, sf, "orders", "o_orderkey", "o_totalprice")
    b, c = rt.declare(a.size()), rt.declare(a.size())
    rt.submit(Host(), lambda v: v * 2, a, write(b))
    rt.submit(Host(), lambda v: v + 1, b, write(c))
    return c.frame()


@_query("SELECT o_orderkey AS i, o_totalprice * o_totalprice AS v FROM orders")
def dedup_inputs(spark: SparkSession, sf: str) -> DataFrame:
    rt = Runtime(spark)
    a = _column(rt, sf, "orders", "o_orderkey", "o_totalprice")
    b = rt.declare(a.size())
    rt.submit(Host(), lambda x, y: x * y, a, a, write(b))
    return b.frame()


@_query("SELECT o_orderkey AS i, (o_totalprice + 1) - (o_totalprice - 1) AS v FROM orders")
def join_events(spark: SparkSession, sf: str) -> DataFrame:
    rt = Runtime(spark)
    a = _column(rt, sf, "orders", "o_orderkey", "o_totalprice")
    b, c, d = (rt.declare(a.size()) for _ in range(3))
    both = rt.join(rt.submit(Host(), lambda v: v + 1, a, write(b)), rt.submit(Host(), lambda v: v - 1, a, write(c)))
    rt.submit(Host(), lambda x, y: x - y, b, c, write(d), after=[both])
    return d.frame()


def _told(spark: SparkSession, **values: bool) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


@_query("SELECT true AS raised, true AS same")
def poison(spark: SparkSession, sf: str) -> DataFrame:
    """A failing task: waiting is silent, reading it or what was made from it raises the same error."""
    rt = Runtime(spark)
    a = _column(rt, sf, "orders", "o_orderkey", "o_totalprice")
    b, c = rt.declare(a.size()), rt.declare(a.size())

    def fails(v: Column) -> Column:
        raise ArithmeticError("on purpose")

    rt.submit(Host(), fails, a, write(b))
    rt.wait(rt.submit(Host(), lambda v: v, b, write(c)))
    raised = []
    for x in (b, c):
        try:
            x.read()
        except ArithmeticError as e:
            raised.append(e)
    return _told(spark, raised=len(raised) == 2, same=raised[0] is raised[1])


@_query("SELECT true AS kept")
def prefetch(spark: SparkSession, sf: str) -> DataFrame:
    rt = Runtime(spark)
    a = _column(rt, sf, "orders", "o_orderkey", "o_totalprice")
    rt.wait(a.prefetch())
    kept = a.frame().storageLevel.useMemory
    a.runtime.shutdown()
    return _told(spark, kept=kept)


@_query("SELECT true AS done")
def barrier(spark: SparkSession, sf: str) -> DataFrame:
    rt = Runtime(spark)
    a = _column(rt, sf, "orders", "o_orderkey", "o_totalprice")
    b = rt.declare(a.size())
    event = rt.submit(Host(), lambda v: v + 1, a, write(b))
    rt.synchronize()
    return _told(spark, done=rt.is_done(event))


@_query("SELECT true AS dropped")
def delete(spark: SparkSession, sf: str) -> DataFrame:
    rt = Runtime(spark)
    a = _column(rt, sf, "orders", "o_orderkey", "o_totalprice")
    rt.wait(a.prefetch())
    frame = a.frame()
    a.release()
    rt.synchronize()
    return _told(spark, dropped=not frame.storageLevel.useMemory)


@_query("SELECT r AS round, true AS ok FROM range(20) t(r)")
def rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty rounds of fill, add and verify, five of them open at a time."""
    rt = Runtime(spark)
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    checks: list[Array] = []

    def one(k: int) -> EventId:
        a, b, c, ok = (rt.declare(n, dtype="float32") for _ in range(4))
        rt.submit(Host(), lambda: (F.lit(1.0), F.lit(float(k))), write(a), write(b))
        rt.submit(Host(), add_kernel, a, b, write(c))
        rt.submit(Frames(), lambda f: f.agg(F.bool_and(F.abs(F.col("v") - 1 - k) <= 1e-9).alias("ok")).select(F.lit(k).cast("bigint").alias("round"), "ok"), c, write(ok))
        checks.append(ok)
        return ok.prefetch()

    rt.rounds(20, one)
    return reduce(DataFrame.unionByName, [x.frame() for x in checks])


@_query("SELECT p_partkey AS i, CAST(p_size + p_retailprice AS DOUBLE) AS v FROM part")
def explicit_task(spark: SparkSession, sf: str) -> DataFrame:
    """A task that lists its inputs and outputs itself; a callback learns of the event before submit returns."""
    rt = Runtime(spark)
    a, b = _column(rt, sf, "part", "p_partkey", "p_size"), _column(rt, sf, "part", "p_partkey", "p_retailprice")
    task, seen = Submission(rt), []
    task.add_input(a.block()), task.add_input(b.block()), task.add_output()
    task.after_submission(seen.append)
    x, y = a.block(), b.block()
    event = task.submit(lambda f: [f[x].alias("x").join(f[y].alias("y"), "i").select("i", (F.col("x.v") + F.col("y.v")).cast("double").alias("v"))])
    assert seen == [event]
    return rt.frame(BlockId(event))


@_query("SELECT vec_id * 64 + j AS i, CASE WHEN vec_id BETWEEN 10 AND 19 AND j BETWEEN 8 AND 15 THEN -embedding[j + 1] ELSE embedding[j + 1] END AS v FROM embeddings, range(64) r(j)")
def view_put(spark: SparkSession, sf: str) -> DataFrame:
    """A writable window: its elements change sign."""
    a = _vectors(Runtime(spark), sf)
    return FACTORIES["view_mut"](a.frame(), a.sizes()).sub((10, 8), (10, 8)).put(-F.col("v"))


def _raises(frame: DataFrame, column: Column) -> Column:
    """Whether a run over the table ends in the error of a range."""
    try:
        frame.select(column.alias("x")).agg(F.max("x")).collect()
    except Exception as e:
        return F.lit(any(s in str(e) for s in ("OVERFLOW", "overflow", "out of range")))
    return F.lit(False)


@_query("SELECT true AS added, true AS multiplied, true AS summed, true AS product, true AS narrowed, true AS indexed, false AS fitting")
def overflow(spark: SparkSession, sf: str) -> DataFrame:
    """Checked arithmetic on rows that go out of range, and on rows that just fit."""
    key = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("k"), F.lit((1 << 63) - 1).alias("top"))
    one = F.col("k") * 0 + 1
    return spark.range(1).select(
        _raises(key, I.checked_add(F.col("top"), one)).alias("added"), _raises(key, I.checked_mul(F.col("top"), one + 1)).alias("multiplied"),
        _raises(key, I.checked_sum(F.array("top", one, -one))).alias("summed"), _raises(key, I.checked_product(F.array("top", one + 1))).alias("product"),
        _raises(key, I.checked_cast(F.col("k") + (1 << 31), "int32")).alias("narrowed"), _raises(key, I.checked_index(F.col("k"), F.lit(7))).alias("indexed"),
        _raises(key, I.checked_add(F.col("top") - 1, one)).alias("fitting"),
    )


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
