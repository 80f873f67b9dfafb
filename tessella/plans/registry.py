"""The queries of the engine by name, each with the DuckDB SQL that gives the same rows where SQL can express it.

A sort's order is given as data: each row with its place ``pos`` in the order. Null order is always written out in SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches
from ..operators import dedup, frames, partitioning, sampling, sorting
from ..operators.sorting import Key
from ..sources import writer
from ..sources.formats import register_format
from ..sources.reader import ColumnReader, tolerant
from ..storage import scratch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ColumnReader(spark).load(f"{sf_dir}/{name}.parquet")


def _new_table(spark: SparkSession) -> tuple[str, str]:
    """A name that no table has, and a place for it that is removed when the driver ends."""
    return f"tessella_{uuid.uuid4().hex}", f"{scratch(spark)}/table"


def _read_and_dropped(spark: SparkSession, name: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` makes of a table outside the warehouse; its name leaves the catalog, its files stay."""
    found = read(name)
    spark.sql(f"DROP TABLE {name}")
    return found


# --- scans -----------------------------------------------------------------------------------------------------------


@query("SELECT * FROM orders")
def scan_full(spark, sf_dir):
    return _table(spark, sf_dir, "orders")


@query("SELECT o_totalprice, o_orderkey FROM orders")
def scan_project(spark, sf_dir):
    return frames.project(_table(spark, sf_dir, "orders"), 3, 0)


@query("SELECT o_orderdate, o_custkey FROM orders")
def scan_by_name(spark, sf_dir):
    return frames.by_name(_table(spark, sf_dir, "orders"), "o_orderdate", "no_such_column", "o_custkey")


@query("SELECT * FROM nation")
def scan_with_schema(spark, sf_dir):
    reader = ColumnReader(spark).format("parquet").schema("n_nationkey int, n_name string, n_regionkey int")
    return reader.option("path", f"{sf_dir}/nation.parquet").load()


@query("SELECT * FROM orders UNION ALL SELECT * FROM orders")
def scan_multi_path(spark, sf_dir):
    return ColumnReader(spark).load(f"{sf_dir}/orders.parquet", f"{sf_dir}/orders.parquet")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 5")
def filter_eq(spark, sf_dir):
    return _table(spark, sf_dir, "orders").filter("o_custkey = 5").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (3, 5, 8, 1000000)")
def filter_in(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").filter(F.col("o_custkey").isin(3, 5, 8, 1_000_000))
    return rows.select("o_orderkey", "o_custkey")


@query(
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders "
    "WHERE (o_custkey = 3 OR o_custkey = 5) AND (o_orderstatus = 'O' OR o_totalprice > 100000)"
)
def filter_and_or(spark, sf_dir):
    c = F.col
    keep = ((c("o_custkey") == 3) | (c("o_custkey") == 5)) & ((c("o_orderstatus") == "O") | (c("o_totalprice") > 100_000))
    return _table(spark, sf_dir, "orders").filter(keep).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey FROM orders WHERE nullif(o_custkey % 5, 0) IS NULL")
def filter_isnull(spark, sf_dir):
    return _table(spark, sf_dir, "orders").filter(F.nullif(F.col("o_custkey") % 5, F.lit(0)).isNull()).select("o_orderkey")


@query(
    "SELECT o_orderkey FROM orders WHERE isnan(CASE WHEN o_orderkey % 7 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice END)"
)
def filter_isnan(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 7 == 0, float("nan")).otherwise(F.col("o_totalprice"))
    return _table(spark, sf_dir, "orders").filter(F.isnan(price)).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT DISTINCT FROM 5")
def filter_null_safe(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders")
    return rows.filter(F.col("o_custkey").eqNullSafe(5)).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 5")
def bucket_scan_eq(spark, sf_dir):
    name, path = _new_table(spark)
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    writer.write_bucketed(rows, name, path, 8, "o_custkey")
    return _read_and_dropped(spark, name, lambda x: ColumnReader(spark).table(x).filter("o_custkey = 5"))


@query("SELECT * FROM customer")
def catalog_table(spark, sf_dir):
    name, path = _new_table(spark)
    _table(spark, sf_dir, "customer").write.option("path", path).saveAsTable(name)
    return _read_and_dropped(spark, name, ColumnReader(spark).table)


@query("SELECT * FROM supplier")
def scan_tolerant(spark, sf_dir):
    """Two whole files and a damaged one, which is skipped as the reader is asked to."""
    to = f"{scratch(spark)}/table"
    rows = _table(spark, sf_dir, "supplier")
    writer.write_parquet(rows.repartition(2), to)
    spark.createDataFrame([("not Parquet",)], "value string").coalesce(1).write.mode("append").text(to)
    return tolerant(ColumnReader(spark).schema(rows.schema)).load(to)


@query("SELECT CAST(i AS BIGINT) AS number, CAST(i * i AS BIGINT) AS square FROM range(1000) AS r(i)")
def custom_format(spark, sf_dir):
    import pyarrow as pa

    def split(options):
        step = int(options["step"])
        return [(at, at + step) for at in range(0, int(options["rows"]), step)]

    def read(part):
        numbers = list(range(*part))
        yield pa.RecordBatch.from_pydict({"number": numbers, "square": [x * x for x in numbers]})

    register_format(spark, "tessella_squares", "number long, square long", split, read)
    return ColumnReader(spark).format("tessella_squares").options(rows=1000, step=300).load().filter("number < 1000")


@query("SELECT * FROM customer")
def parquet_roundtrip(spark, sf_dir):
    to = f"{scratch(spark)}/table"
    writer.write_parquet(_table(spark, sf_dir, "customer"), to)
    return ColumnReader(spark).load(to)


@query(
    "SELECT CAST(floor(m // 7) % 10 AS INTEGER) AS numA, CAST(m * 48271 % 2147483647 AS INTEGER) AS numB "
    "FROM (SELECT (id + 4242) * 48271 % 2147483647 AS m FROM range(10000) AS r(id))"
)
def datagen(spark, sf_dir):
    return writer.generate(spark, 10_000)


# --- sorts -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders")
def sort_one_key(spark, sf_dir):
    return sorting.with_position(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS pos FROM orders")
def sort_two_keys(spark, sf_dir):
    return sorting.with_position(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT *, row_number() OVER (ORDER BY COLUMNS(*)) AS pos FROM lineitem")
def sort_all_columns(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    return sorting.with_position(rows, *rows.columns)


_SQL["sort_all_columns"] = (
    "SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
    "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos FROM lineitem"
)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC NULLS LAST) AS pos FROM orders")
def sort_desc(spark, sf_dir):
    return sorting.with_position(_table(spark, sf_dir, "orders").select("o_orderkey"), Key("o_orderkey", descending=True))


@query(
    "SELECT o_orderstatus, o_custkey, o_orderkey, "
    "row_number() OVER (ORDER BY o_orderstatus DESC, o_custkey ASC, o_orderkey DESC) AS pos FROM orders"
)
def sort_mixed_dir(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", "o_orderkey")
    return sorting.with_position(rows, Key("o_orderstatus", True), "o_custkey", Key("o_orderkey", True))


def _null_sorted(descending: bool, first: bool) -> tuple[str, Query]:
    sql = (
        "SELECT nullif(o_custkey % 5, 0) AS k, o_orderkey, row_number() OVER (ORDER BY nullif(o_custkey % 5, 0) "
        f"{'DESC' if descending else 'ASC'} NULLS {'FIRST' if first else 'LAST'}, o_orderkey) AS pos FROM orders"
    )

    def sort(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("k")
        rows = _table(spark, sf_dir, "orders").select(k, "o_orderkey")
        return sorting.with_position(rows, Key("k", descending, first), "o_orderkey")

    return sql, sort


for _name, _descending, _first in (
    ("sort_nulls_first", False, True),
    ("sort_nulls_last", False, False),
    ("sort_desc_nulls_first", True, True),
    ("sort_desc_nulls_last", True, False),
):
    _SQL[_name], _QUERIES[_name] = _null_sorted(_descending, _first)


@query("SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS pos FROM part")
def sort_string(spark, sf_dir):
    return sorting.with_position(_table(spark, sf_dir, "part").select("p_name", "p_partkey"), "p_name", "p_partkey")


@query("SELECT c_acctbal, c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer")
def sort_double(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_acctbal", "c_custkey")
    return sorting.with_position(rows, Key("c_acctbal", True), "c_custkey")


@query("SELECT ts, event_id, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events")
def sort_timestamp(spark, sf_dir):
    return sorting.with_position(_table(spark, sf_dir, "events").select("ts", "event_id"), "ts", "event_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey % 10, o_orderkey) AS pos FROM orders")
def sort_expression(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sorting.with_position(rows, Key(F.col("o_custkey") % 10), "o_orderkey").drop("o_custkey")


@query("SELECT CAST(0 AS BIGINT) AS inversions")
def sort_local(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_custkey").repartition(4, "o_custkey")
    return sorting.inversions(sorting.local_sort(rows, "o_custkey"), "o_custkey")


@query(
    "SELECT CAST(o_orderkey % 4 AS INTEGER) AS part, o_custkey, o_orderkey, "
    "row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_custkey DESC, o_orderkey) AS pos FROM orders"
)
def sort_local_places(spark, sf_dir):
    """Rows dealt to four partitions by key, each with its place in its own partition."""
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    dealt = rows.repartitionById(4, (F.col("o_orderkey") % 4).cast("int"))
    return sorting.local_positions(sorting.local_sort(dealt, Key("o_custkey", True), "o_orderkey"))


@query(
    "SELECT o_orderstatus, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT o_orderstatus, "
    "row_number() OVER (ORDER BY o_orderstatus, o_orderkey) AS pos FROM orders) GROUP BY o_orderstatus"
)
def sort_stable_groups(spark, sf_dir):
    return sorting.group_ranges(_table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sorting.top(rows, 25, Key("o_totalprice", True), "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def take_rows(spark, sf_dir):
    return frames.take(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 100, "o_orderkey")


@query(
    "SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders) "
    "WHERE pos > 50 AND pos <= 80"
)
def take_range(spark, sf_dir):
    return frames.take_range(_table(spark, sf_dir, "orders").select("o_orderkey"), 50, 80, "o_orderkey")


# --- partitioning ----------------------------------------------------------------------------------------------------

_BOUNDS = (100, 200, 400, 800, 1200)


@query(
    "WITH c AS (SELECT o_custkey, sum(count(*)) OVER (ORDER BY o_custkey) AS cum FROM orders GROUP BY o_custkey), "
    "t AS (SELECT count(*) AS n FROM orders), "
    "b AS (SELECT i, (SELECT min(o_custkey) FROM c WHERE cum * 8 >= i * t.n) AS bound FROM t, range(1, 8) AS r(i)) "
    "SELECT bound, CAST(min(i) AS INTEGER) AS bound_idx FROM b GROUP BY bound"
)
def range_bounds(spark, sf_dir):
    return partitioning.range_bounds(_table(spark, sf_dir, "orders"), "o_custkey", 8)


@query(
    "SELECT o_orderkey, CAST((SELECT count(*) FROM (VALUES (100), (200), (400), (800), (1200)) AS b(x) "
    "WHERE x < o_custkey) AS INTEGER) AS bucket FROM orders"
)
def bucket_search(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", partitioning.bucket_of(F.col("o_custkey"), _BOUNDS).cast("int").alias("bucket"))


@query(
    "SELECT o_orderkey, CAST((o_orderstatus, o_custkey) > ('F', 700) AS INTEGER) "
    "+ CAST((o_orderstatus, o_custkey) > ('O', 300) AS INTEGER) AS bucket FROM orders"
)
def bucket_search_two_keys(spark, sf_dir):
    bounds = [("F", 700), ("O", 300)]
    keys = [F.col("o_orderstatus"), F.col("o_custkey").cast("int")]
    return _table(spark, sf_dir, "orders").select("o_orderkey", partitioning.bucket_of_keys(keys, bounds).alias("bucket"))


_HISTOGRAM_SQL = (
    "SELECT CAST((SELECT count(*) FROM (VALUES (100), (200), (400), (800), (1200)) AS b(x) WHERE x < o_custkey) "
    "AS INTEGER) AS bucket, count(*) AS n FROM orders GROUP BY 1"
)


@query(_HISTOGRAM_SQL)
def range_histogram(spark, sf_dir):
    found = partitioning.histogram(_table(spark, sf_dir, "orders"), "o_custkey", _BOUNDS)
    return found.select(F.col("bucket").cast("int").alias("bucket"), "n")


@query(_HISTOGRAM_SQL)
def distribute_by_bucket(spark, sf_dir):
    rows = partitioning.distribute(_table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", _BOUNDS)
    return rows.groupBy(F.spark_partition_id().alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "SELECT count(*) AS n_rows, 12 AS ranges, CAST(0 AS BIGINT) AS overlapping, true AS even FROM orders"
)
def sampled_range_exchange(spark, sf_dir):
    """Rows exchanged by bounds from a weighted sample: all arrive, in disjoint ranges of less than twice the mean."""
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    bounds = partitioning.sampled_bounds(rows, ["o_custkey", "o_orderkey"], 12)
    key = F.struct(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b")).alias("key")
    dealt = partitioning.distribute_by_keys(rows, ["o_custkey", "o_orderkey"], bounds).select(key)
    sizes = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    seen = sizes.agg(
        F.sum("n").alias("n_rows"), F.count("*").cast("int").alias("ranges"), (F.max("n") < 2 * F.avg("n")).alias("even")
    )
    return seen.crossJoin(partitioning.overlaps(dealt, "key"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS total FROM lineitem")
def partition_samples(spark, sf_dir):
    """The weighted samples of the input partitions, of as many keys as these have, stand for all rows."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey").repartition(3)
    found = partitioning.partition_slots(rows, ["l_orderkey"], 1 << 40)
    total = F.sum(F.col("key.l_orderkey") * F.col("weight")).alias("total")
    return found.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n_rows"), total)


@query(
    "WITH b AS (SELECT CAST((SELECT count(*) FROM (VALUES (100), (200), (400), (800), (1200)) AS b(x) WHERE x < o_custkey) "
    "AS INTEGER) AS bucket, o_custkey FROM orders) SELECT bucket, count(*) AS n, true AS sampled, CAST(0 AS BIGINT) AS foreign_keys "
    "FROM b GROUP BY bucket"
)
def bucket_sketch(spark, sf_dir):
    """Of each bucket its rows, whether at most 20 and some of its keys are sampled, and how many of these it lacks."""
    rows = _table(spark, sf_dir, "orders").select("o_custkey")
    found = partitioning.sketch(rows, "o_custkey", _BOUNDS, 20)
    size = F.size("sample")
    sampled = found.select(F.col("bucket").cast("int").alias("bucket"), "n", ((size > 0) & (size <= 20)).alias("sampled"), "sample")
    each = sampled.select("bucket", F.explode("sample").alias("key"))
    own = rows.select(partitioning.bucket_of(F.col("o_custkey"), _BOUNDS).cast("int").alias("bucket"), F.col("o_custkey").alias("key"))
    lacking = each.join(own, ["bucket", "key"], "left_anti").groupBy("bucket").agg(F.count("*").alias("lacking"))
    foreign = F.coalesce("lacking", F.lit(0)).cast("long").alias("foreign_keys")
    return sampled.join(lacking, "bucket", "left").select("bucket", "n", "sampled", foreign)


@query("SELECT CAST(0 AS BIGINT) AS overlapping")
def range_repartition_disjoint(spark, sf_dir):
    rows = partitioning.range_partition(_table(spark, sf_dir, "orders").select("o_custkey"), 4, "o_custkey")
    return partitioning.overlaps(rows, "o_custkey")


@query(
    "SELECT CAST((SELECT count(*) FROM (VALUES (100), (200), (400), (800), (1200)) AS b(x) WHERE x < o_custkey) "
    "AS INTEGER) AS bucket, count(*) AS n, min(o_custkey) AS low, max(o_custkey) AS high FROM orders GROUP BY 1"
)
def partition_sketch(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_custkey")
    bucket = partitioning.bucket_of(F.col("o_custkey"), _BOUNDS).cast("int").alias("bucket")
    return rows.groupBy(bucket).agg(
        F.count("*").alias("n"), F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high")
    )


# --- duplicates ------------------------------------------------------------------------------------------------------


@query(
    "SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus, lag(o_orderstatus) OVER w AS before, "
    "row_number() OVER w AS rn FROM orders WINDOW w AS (ORDER BY o_orderkey)) "
    "WHERE rn = 1 OR before IS DISTINCT FROM o_orderstatus"
)
def adjacent_unique(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return dedup.adjacent_unique(rows, "o_orderstatus", "o_orderkey")


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_key(spark, sf_dir):
    return dedup.first_per_key(_table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query(
    "SELECT * FROM orders QUALIFY row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) = 1"
)
def first_per_key_desc(spark, sf_dir):
    keys = (Key("o_totalprice", True), "o_orderkey")
    return dedup.first_per_key(_table(spark, sf_dir, "orders"), ["o_custkey"], *keys)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, sf_dir):
    return dedup.distinct(_table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"))


# --- samples ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS HUGEINT) * 2654435761 % 1000 < 100")
def hash_sample(spark, sf_dir):
    return sampling.by_hash(_table(spark, sf_dir, "orders"), "o_orderkey", 100).select("o_orderkey")


@query()
def bernoulli_sample(spark, sf_dir):
    return sampling.bernoulli(_table(spark, sf_dir, "orders"), 0.1, 7)


@query()
def reservoir_sample(spark, sf_dir):
    return sampling.reservoir(_table(spark, sf_dir, "orders"), 100, 7)


@query("SELECT o_orderkey, true AS plausible FROM orders")
def bernoulli_and_rest(spark, sf_dir):
    """The sample and the rows outside it are the table again; its size is within six deviations of a tenth."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey")
    found = sampling.bernoulli(rows, 0.1, 7)
    n, total = found.agg(F.count("*")).scalar(), rows.agg(F.count("*")).scalar()
    every = found.unionAll(rows.join(found, "o_orderkey", "left_anti"))
    return every.select("o_orderkey", (F.abs(n - total * 0.1) <= 6 * F.sqrt(total * 0.09)).alias("plausible"))


@query("SELECT o_orderkey, least(100, count(*) OVER ()) AS sampled FROM orders")
def reservoir_and_rest(spark, sf_dir):
    """The sample and the rows outside it are the table again; its size is exact."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey")
    found = sampling.reservoir(rows, 100, 7)
    every = found.unionAll(rows.join(found, "o_orderkey", "left_anti"))
    return every.select("o_orderkey", found.agg(F.count("*")).scalar().alias("sampled"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos, true AS contiguous FROM orders")
def slice_and_rest(spark, sf_dir):
    """The slice and the rows outside it are the table again; its places have no gap."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey")
    found = sampling.random_slice(rows, 7, "o_orderkey")
    placed = sorting.with_position(rows, "o_orderkey")
    own = placed.join(found, "o_orderkey")
    gaps = own.agg((F.coalesce(F.max("pos") - F.min("pos") + 1, F.lit(0)) == F.count("*")).alias("whole")).scalar()
    return own.unionAll(placed.join(found, "o_orderkey", "left_anti")).select("*", gaps.alias("contiguous"))


@query("SELECT least(100, count(*)) AS sampled, count(*) AS total FROM orders")
def sample_and_count(spark, sf_dir):
    return sampling.reservoir_and_count(_table(spark, sf_dir, "orders"), 100, 7)


@query()
def random_slice(spark, sf_dir):
    return sampling.random_slice(_table(spark, sf_dir, "orders").select("o_orderkey"), 7, "o_orderkey")


@query("SELECT 3 AS low, 9 AS high, CAST(10000 AS BIGINT) AS n")
def uniform_ints(spark, sf_dir):
    numbers = spark.range(10_000).select(sampling.uniform_int(3, 9, 7).alias("x"))
    return numbers.agg(
        F.min("x").cast("int").alias("low"), F.max("x").cast("int").alias("high"), F.count("*").alias("n")
    )


# --- frame structure -------------------------------------------------------------------------------------------------


@query(
    "SELECT * FROM (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL "
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P') ORDER BY o_orderkey LIMIT 200"
)
def concat_take(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    parts = [rows.filter(F.col("o_orderstatus") == x) for x in ("F", "P")]
    return frames.concat_take(200, parts, "o_orderkey")


@query("SELECT o_orderkey FROM orders UNION ALL SELECT c_custkey FROM customer")
def concat_frames(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_orderkey"))
    return frames.concat(_table(spark, sf_dir, "orders").select("o_orderkey"), customers)


@query(
    "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 1000 THEN 'head' ELSE 'tail' END AS side "
    "FROM orders"
)
def split_rows(spark, sf_dir):
    head, tail = frames.split_rows(_table(spark, sf_dir, "orders").select("o_orderkey"), 1000, "o_orderkey")
    return head.withColumn("side", F.lit("head")).unionAll(tail.withColumn("side", F.lit("tail")))


@query("SELECT o_orderkey, o_custkey FROM orders")
def split_columns_left(spark, sf_dir):
    return frames.split_columns(_table(spark, sf_dir, "orders"), 2)[0]


@query("SELECT o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def split_columns_right(spark, sf_dir):
    return frames.split_columns(_table(spark, sf_dir, "orders"), 2)[1]


@query(
    "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) "
    "LEFT JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS rn FROM supplier) USING (rn)"
)
def append_columns(spark, sf_dir):
    left = sorting.global_sort(_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    right = sorting.global_sort(_table(spark, sf_dir, "supplier").select("s_suppkey"), Key("s_suppkey", True))
    return frames.append_columns(left, right)


@query(
    "SELECT slot, c_custkey FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 100), (4, 1)) AS p(slot, pos) "
    "JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS pos FROM customer) USING (pos)"
)
def gather(spark, sf_dir):
    places = spark.createDataFrame([(0, 7), (1, 3), (2, 7), (3, 100), (4, 1)], "slot int, pos long")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return frames.gather(rows, places, "c_acctbal", "c_custkey").select("slot", "c_custkey")


@query(
    "SELECT n_nationkey, coalesce(x.name, n_name) AS n_name, coalesce(x.region, n_regionkey) AS n_regionkey FROM nation "
    "LEFT JOIN (VALUES (3, 'CHANGED', 4), (7, 'OTHER', NULL), (999, 'NOWHERE', 0)) AS x(k, name, region) ON k = n_nationkey"
)
def row_overwrite(spark, sf_dir):
    changes = [(3, "CHANGED", 4), (7, "OTHER", None), (999, "NOWHERE", 0)]
    new = spark.createDataFrame(changes, "n_nationkey int, n_name string, n_regionkey int")
    return frames.overwrite(_table(spark, sf_dir, "nation"), new, "n_nationkey")


@query("SELECT CAST(0 AS BIGINT) AS differences")
def frame_equal(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders")
    return frames.differences(rows, rows.repartition(5).select("*"))


@query(
    "WITH a AS (SELECT o_orderstatus, o_custkey % 7 AS k FROM orders), "
    "b AS (SELECT o_orderstatus, o_custkey % 7 AS k FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT 'X', 1) "
    "SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS differences"
)
def frame_differences(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_custkey") % 7).alias("k"), "o_orderkey")
    other = rows.filter("o_orderkey % 3 > 0").drop("o_orderkey").unionAll(spark.sql("SELECT 'X', 1L"))
    return frames.differences(rows.drop("o_orderkey"), other)


@query("SELECT true AS same, true AS changes_seen")
def frame_hash(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders")
    total = lambda df: df.agg(frames.content_hash(df).alias("h")).scalar()
    other = rows.withColumn("o_custkey", F.col("o_custkey") + (F.col("o_orderkey") == 1).cast("long"))
    return spark.range(1).select(
        (total(rows) == total(rows.repartition(3))).alias("same"), (total(rows) != total(other)).alias("changes_seen")
    )


@query("SELECT o_orderkey, o_custkey FROM orders WHERE false")
def empty_like(spark, sf_dir):
    return frames.empty_like(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))


@query("SELECT bool_or(nullif(o_custkey % 5, 0) IS NULL) AS k, bool_or(o_orderkey IS NULL) AS o_orderkey FROM orders")
def any_null(spark, sf_dir):
    k = F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("k")
    return frames.any_null(_table(spark, sf_dir, "orders").select(k, "o_orderkey"))


# --- batches ---------------------------------------------------------------------------------------------------------


@query(
    "SELECT o_orderstatus, chunk, list(o_orderkey ORDER BY o_orderkey) AS values FROM (SELECT o_orderstatus, o_orderkey, "
    "(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders) "
    "GROUP BY o_orderstatus, chunk"
)
def columns_from_batches(spark, sf_dir):
    return batches.column_arrays(_table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", 1000)


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= 700")
def encoded_batches(spark, sf_dir):
    """Batches encoded with caps on columns and rows, and decoded again."""
    rows = sorting.global_sort(_table(spark, sf_dir, "orders"), "o_orderkey").limit(2000).coalesce(1)
    coded = batches.encoded_batches(rows, columns=2, rows=700)

    def decoded(found):
        for batch in found:
            for raw in batch["encoded"].to_pylist():
                yield from (x for _, x in batches.decode(raw))

    return coded.mapInArrow(decoded, "o_orderkey long, o_custkey long")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def batch_roundtrip(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return batches.rows_of(batches.batch_view(rows))


@query("SELECT count(*) AS n FROM lineitem")
def batch_sizes(spark, sf_dir):
    view = batches.batch_view(_table(spark, sf_dir, "lineitem").select("l_orderkey"))
    return batches.batch_sizes(view).agg(F.sum("batch_rows").alias("n"))


@query("SELECT CAST(i AS INTEGER) AS part, CAST(2500 AS BIGINT) AS n FROM range(4) AS r(i)")
def map_with_index(spark, sf_dir):
    import pyarrow as pa

    def counted(part, found):
        n = sum(b.num_rows for b in found)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [n]})

    return batches.map_with_index(spark.range(0, 10_000, 1, 4), counted, "part int, n long")


@query(
    "SELECT CAST(o_orderkey % 4 AS INTEGER) AS part, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1"
)
def map_rows_with_index(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.compute as pc

    def summed(part, found):
        n = total = 0
        for batch in found:
            n, total = n + batch.num_rows, total + (pc.sum(batch["o_custkey"]).as_py() or 0)
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [n], "total": [total]})

    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    dealt = rows.repartitionById(4, (F.col("o_orderkey") % 4).cast("int"))
    return batches.map_with_index(dealt, summed, "part int, n long, total long")


@query("SELECT o_orderkey + 1 AS next_key FROM orders")
def map_batches(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.compute as pc

    def add_one(batch):
        return pa.RecordBatch.from_arrays([pc.add(batch.column(0), 1)], names=["next_key"])

    return batches.map_batches(_table(spark, sf_dir, "orders").select("o_orderkey"), add_one, "next_key long")
