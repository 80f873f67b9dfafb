"""Partitioning, duplicates, frames, batches, reading and streams on small inputs."""

from __future__ import annotations

import bisect
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import batches
from tessella.operators import dedup, frames, partitioning, sampling, sorting
from tessella.operators.sorting import Key
from tessella.sources import writer
from tessella.sources.reader import ColumnReader, tolerant


def values(df, column=0):
    return [r[column] for r in df.collect()]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 30])
def test_bucket_is_the_left_bisection(spark, n):
    bounds = sorted(range(0, 10 * n, 10))
    df = spark.createDataFrame([(x,) for x in range(-5, 10 * n + 6)], "k int")
    found = df.select("k", partitioning.bucket_of(F.col("k"), bounds).alias("b")).collect()
    assert all(r["b"] == bisect.bisect_left(bounds, r["k"]) for r in found)


def test_bounds(spark):
    df = spark.createDataFrame([(x // 3, x) for x in range(100)], "k int, i int")
    found = {r["bound_idx"]: r["bound"] for r in partitioning.range_bounds(df, "k", 4).collect()}
    assert found == {1: 24 // 3, 2: 49 // 3, 3: 74 // 3}
    same = spark.createDataFrame([(1, i) for i in range(10)], "k int, i int")
    assert [tuple(r) for r in partitioning.range_bounds(same, "k", 4).select("bound_idx", "bound").collect()] == [(1, 1)]
    empty = spark.createDataFrame([], "k int, i int")
    assert partitioning.range_bounds(empty, "k", 4).collect() == []
    assert partitioning.range_bounds(df, "k", 1).collect() == []


@pytest.mark.parametrize(("n", "parts"), [(7, 3), (50, 9), (400, 64), (5, 30)])
def test_bounds_against_a_plain_version(spark, n, parts):
    rng = random.Random(n)
    keys = sorted(rng.choice([rng.randrange(40), 7]) for _ in range(n))
    expected = {}
    for i in range(1, parts):
        expected.setdefault(keys[-(-i * n // parts) - 1], i)
    df = spark.createDataFrame([(k,) for k in rng.sample(keys, n)], "k int").repartition(6)
    assert {r["bound"]: r["bound_idx"] for r in partitioning.range_bounds(df, "k", parts).collect()} == expected


def test_weighted_bounds():
    even = [((i,), 1.0) for i in range(100)]
    assert partitioning.weighted_bounds(even, 4) == [(24,), (49,), (74,)]
    assert partitioning.weighted_bounds([((1,), 90.0), ((2,), 5.0), ((3,), 5.0)], 10) == [(1,)]
    assert partitioning.weighted_bounds([((1,), 3.0), ((1,), 2.0)], 4) == [] == partitioning.weighted_bounds([], 4)
    assert partitioning.weighted_bounds([((float("nan"),), 1.0), ((1.0,), 1.0)], 2) == [(1.0,)]


def test_uneven_partitions_are_sampled_again(spark):
    """One input partition has nearly all rows: the ranges still come out alike."""
    few = spark.range(0, 70, 1, 7).withColumn("k", F.col("id") + 1_000_000)
    df = few.unionAll(spark.range(0, 60_000, 1, 1).withColumn("k", F.col("id")))
    bounds = partitioning.sampled_bounds(df, ["k"], 6)
    sizes = [r["n"] for r in partitioning.histogram(df, "k", [b[0] for b in bounds]).collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * sum(sizes) / 6
    sample = partitioning.partition_sample(df, ["k"], 10).collect()
    assert len(sample) == 8 and all(sum(x["weight"] for x in r["sample"]) == r["n"] for r in sample)
    assert all(0 < len(r["sample"]) <= 10 for r in sample)


def test_small_partitions_are_sampled_whole(spark):
    """No two of at most k rows meet in a slot; of more, k are sampled, also such as come after the first k."""
    df = spark.range(0, 2000, 1, 2)
    whole = partitioning.partition_sample(df, ["id"], 1000).collect()
    assert sorted((x["key"]["id"], x["weight"]) for r in whole for x in r["sample"]) == [(i, 1) for i in range(2000)]
    few = partitioning.partition_sample(df, ["id"], 100).collect()
    assert [(r["n"], len(r["sample"]), sum(x["weight"] for x in r["sample"])) for r in few] == [(1000, 100, 1000)] * 2
    assert all(50 < sum(x["key"]["id"] % 1000 >= 100 for x in r["sample"]) <= 100 for r in few)
    assert partitioning.partition_slots(df.filter("id < 0"), ["id"], 10).collect() == []


def test_bucket_by_several_keys(spark):
    rng = random.Random(2)
    bounds = sorted({(rng.choice("abc"), rng.randrange(20)) for _ in range(23)})
    rows = [(rng.choice("abcd"), rng.randrange(21)) for _ in range(300)] + [(None, 3), ("b", None)]
    df = spark.createDataFrame(rows, "s string, i int")
    found = df.select("s", "i", partitioning.bucket_of_keys([F.col("s"), F.col("i")], bounds).alias("b")).collect()
    order = lambda row: [(x is not None, x) for x in row]
    assert all(r["b"] == sum(order(b) < order(r[:2]) for b in bounds) for r in found)


def test_sampled_bounds_and_overlaps(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919 % 1000).cast("int"))
    bounds = [b[0] for b in partitioning.sampled_bounds(df, ["k"], 5)]
    assert len(bounds) == 4 and bounds == sorted(bounds)
    assert partitioning.overlaps(partitioning.distribute(df, "k", bounds), "k").first()[0] == 0
    assert partitioning.overlaps(df.repartition(4), "k").first()[0] > 0
    sketch = partitioning.sketch(df, "k", bounds, 10).collect()
    assert sum(r["n"] for r in sketch) == 1000 and all(0 < len(r["sample"]) <= 10 for r in sketch)


def test_adjacent_unique_across_partitions(spark):
    rows = [(i, v) for i, v in enumerate([None, None, 1, 1, 1, 2, None, 2, 2])]
    df = spark.createDataFrame(rows, "i int, v int").repartition(5)
    assert sorted(values(dedup.adjacent_unique(df, "v", "i"))) == [0, 2, 5, 6, 7]
    constant = spark.range(50).withColumn("v", F.lit(1)).repartition(7)
    assert values(dedup.adjacent_unique(constant, "v", "id")) == [0]
    assert dedup.adjacent_unique(spark.createDataFrame([], "i int, v int"), "v", "i").collect() == []


@pytest.mark.parametrize(
    ("kind", "values_", "expected"),
    [
        ("double", [math.nan, math.nan, None, 1.0, math.nan, -0.0, 0.0], [0, 2, 3, 4, 5]),
        ("string", ["a", "a", "", None, None, "b"], [0, 2, 3, 5]),
        ("array<int>", [[1], [1], [], None, [2], [2]], [0, 2, 3, 4]),
        ("boolean", [True, True, False, None, None], [0, 2, 3]),
    ],
)
def test_adjacent_unique_of_types(spark, kind, values_, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values_)], f"i int, v {kind}")
    for parts in (1, 3):
        assert sorted(values(dedup.adjacent_unique(df.repartition(parts), "v", "i"))) == expected


def test_ranges_and_gathering_do_not_sort_the_whole_table(spark, monkeypatch):
    df = spark.range(500).withColumn("k", (F.col("id") * 7919 % 500).cast("int")).repartition(6)
    found = frames.take_range(df, 50, 80, "k")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
    near = [tuple(r) for r in found.select("k", "pos").collect()]
    assert sorted(near) == [(k, k + 1) for k in range(50, 80)]
    places = spark.createDataFrame([(0, 7), (1, 3), (2, 7), (3, 400), (4, 900)], "slot int, pos long")
    picked = sorted(tuple(r) for r in frames.gather(df, places, "k").select("slot", "k").collect())
    assert picked == [(0, 6), (1, 2), (2, 6), (3, 399)]
    monkeypatch.setattr(frames, "MOST_TAKEN", 10)
    assert sorted(tuple(r) for r in frames.take_range(df, 50, 80, "k").select("k", "pos").collect()) == sorted(near)
    assert sorted(tuple(r) for r in frames.gather(df, places, "k").select("slot", "k").collect()) == picked
    assert frames.take_range(df, 5, 5, "k").count() == 0 == frames.gather(df, places.limit(0), "k").count()


def test_content_hash_of_very_many_rows(spark):
    """The sum passes the range of a long, which raises in ANSI mode."""
    df = spark.createDataFrame([(i,) for i in range(40)], "x long")
    small = [r[0] % (1 << 32) for r in df.select(F.xxhash64("x")).collect()]
    assert df.agg(frames.content_hash(df)).first()[0] == sum(small) % (1 << 32)
    large = spark.range(3).select(F.lit((1 << 62) + 5).cast("decimal(38,0)").alias("x"))
    assert large.agg(F.pmod(F.sum("x"), F.lit(1 << 32).cast("decimal(38,0)")).cast("long")).first()[0] == 15


def test_column_arrays_are_cut(spark):
    rows = [("a", i) for i in range(25)] + [("b", 5), ("b", None), (None, 3), (None, 1)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "g string, v int").repartition(4)
    found = {(r["g"], r["chunk"]): r["values"] for r in batches.column_arrays(df, "g", "v", 10).collect()}
    assert found == {
        ("a", 0): list(range(10)), ("a", 1): list(range(10, 20)), ("a", 2): list(range(20, 25)), ("b", 0): [5], (None, 0): [1, 3],
    }


def test_encoding_and_side_data(spark):
    first, second = (pa.record_batch({"a": [i, i + 1], "b": ["x", None], "c": [1.0, 2.0]}) for i in (0, 10))
    assert batches.encode([]) == b"" and list(batches.decode(b"")) == []
    assert [(s, b) for s, b in batches.decode(batches.encode([first, second]))] == [(b"", first), (b"", second)]
    capped = [b.to_pydict() for _, b in batches.decode(batches.encode([first, second], columns=2, rows=3))]
    assert capped == [{"a": [0, 1], "b": ["x", None]}, {"a": [10], "b": ["x"]}]
    marked = batches.encode([first, second], extra=lambda b: (bytes([b.num_rows]), b.slice(1)))
    assert [(s, b.num_rows) for s, b in batches.decode(marked)] == [(b"\2", 1), (b"\2", 1)]
    df = spark.range(30).repartition(3).sortWithinPartitions("id")
    found = batches.collect_with_side_data(df, lambda b: (str(b.num_rows).encode(), b))
    assert [int(s) for s, b in found] == [b.num_rows for _, b in found] and sum(b.num_rows for _, b in found) == 30


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (2, 9, "c"), (None, 1, "d")], "k int, o int, x string")
    assert sorted(values(dedup.first_per_key(df, ["k"], "o"), 2)) == ["b", "c", "d"]
    assert sorted(values(dedup.first_per_key(df, ["k"], Key("o", True)), 2)) == ["a", "c", "d"]
    text = dedup.first_per_key(df, ["k"], "o")._jdf.queryExecution().executedPlan().toString()
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_frames(spark):
    df = spark.createDataFrame([(42, 24), (28, 11)], "a int, b int")
    assert frames.project(df, 1).columns == ["b"]
    assert frames.by_name(df, "b", "zzz", "a").columns == ["b", "a"]
    head, tail = frames.split_rows(df, 5, "a")
    assert head.count() == 2 and tail.count() == 0
    assert frames.equal(df, df.repartition(2)) and not frames.equal(df, df.limit(1))
    assert not frames.equal(df, df.unionAll(df.limit(1)))
    assert frames.empty_like(df).schema == df.schema
    left = spark.range(5).coalesce(1)
    joined = frames.append_columns(left, spark.createDataFrame([("x",), ("y",)], "s string").coalesce(1))
    assert [tuple(r) for r in joined.collect()] == [(0, "x"), (1, "y"), (2, None), (3, None), (4, None)]
    assert frames.take_range(df, 1, 9, "a").select("a", "pos").collect()[0] == (42, 2)
    assert frames.any_null(frames.empty_like(df)).first() == (False, False)


def test_uniform_int_has_both_ends(spark):
    found = set(values(spark.range(2000).select(sampling.uniform_int(0, 3, 5).alias("x"))))
    assert found == {0, 1, 2, 3}


def test_small_samples(spark):
    df = spark.range(10)
    assert sampling.reservoir(df, 0, 1).count() == 0
    assert sorted(values(sampling.reservoir(df, 50, 1))) == list(range(10))
    assert sampling.reservoir_and_count(df, 3, 1).first() == (3, 10)
    assert sampling.random_slice(spark.range(0), 1, "id").count() == 0


def test_batch_view_round_trip(spark):
    df = spark.createDataFrame([(i, None if i % 3 else str(i), [i, None]) for i in range(25)], "i int, s string, a array<int>")
    view = batches.batch_view(df)
    assert [t for _, t in view.dtypes] == ["array<int>", "array<string>", "array<array<int>>"]
    assert frames.equal(batches.rows_of(view), df)
    assert sum(values(batches.batch_sizes(view))) == 25
    empty = spark.createDataFrame([], "i int")
    assert batches.batch_view(empty).count() == 0


def test_batches_in_python(spark):
    batch = batches.Batch(pa.record_batch({"a": [32, 42], "b": [1.0, None]}))
    more = batches.Batch(pa.record_batch({"a": [16, 54], "b": [0.8, 1.6]}))
    assert (len(batch), batch.num_rows, batch.any_null, more.any_null) == (2, 2, True, False)
    assert batch.row(0) == (32, 1.0) and batch.row(2) is None and batch.column(2) is None and batch.is_null_at(2)
    assert batch.column(0).get(1) == 42 and batch.column(0).get(9) is None and batch.column(1).is_null_at(1)
    assert batch.append(more).row(3) == (54, 1.6)
    assert batch.take(1, 9).row(0) == (42, None) and batch.take(5, 9).num_rows == 0
    assert batch.equals(batch.take(0, 2)) and hash(batch) == hash(batch.take(0, 2)) and not batch.equals(more)
    assert [c.to_list() for c in batches.concat_columns([batch, more])] == [[32, 42, 16, 54], [1.0, None, 0.8, 1.6]]
    assert batch.make_string() == "[32, 42],[1.0, None]" and batch.nbytes > 0 and len(list(batch)) == 2
    with pytest.raises(TypeError):
        batch.column(0).concat(batch.column(1))
    df = spark.range(30).repartition(3)
    assert sum(b.num_rows for b in batches.collect_batches(df)) == 30
    assert sum(b.num_rows for b in batches.iterate_batches(df)) == 30
    assert len(batches.take_batches(df, 2)) == 2 and len(batches.take_batches(df, 99)) == 3


def test_reader(spark, tmp_path):
    path = str(tmp_path / "t")
    df = writer.generate(spark, 100)
    writer.write_parquet(df, path)
    with pytest.raises(Exception, match="already exists"):
        writer.write_parquet(df, path)
    assert frames.equal(ColumnReader(spark).load(path), df)
    assert ColumnReader(spark).options(path=path).load().count() == 100
    assert tolerant(ColumnReader(spark)).schema("numB int").load(path, path).dtypes == [("numB", "int")]
    with pytest.raises(ValueError, match="Hive"):
        ColumnReader(spark).format("hive").load()
    with pytest.raises(ValueError, match="not both"):
        ColumnReader(spark).option("path", path).load(path)
    (tmp_path / "t" / "part-broken.parquet").write_bytes(b"PAR1 no")
    assert tolerant(ColumnReader(spark)).schema("numA int, numB int").load(path).count() == 100


def test_generated_table(spark):
    rows = writer.generate(spark, 2000).collect()
    assert {r["numA"] for r in rows} == set(range(10))
    assert all(0 <= r["numB"] < writer.VALUES for r in rows)
    assert rows == writer.generate(spark, 2000).collect()


def test_catalog_tables(spark, tmp_path):
    name = "tessella_named"
    spark.range(5).write.option("path", str(tmp_path / "t")).saveAsTable(name)
    assert sorted(values(ColumnReader(spark).table(name))) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="own schema"):
        ColumnReader(spark).schema("id long").table(name)
    for reader in (ColumnReader(spark).version(1), ColumnReader(spark).timestamp("2024-01-01 00:00:00")):
        with pytest.raises(Exception, match="TIME_TRAVEL"):
            reader.table(name).collect()
    spark.sql(f"DROP TABLE {name}")


def test_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from tessella import storage

    folder = storage.scratch(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    spark.range(3).write.parquet(f"{folder}/x")
    storage.remove(spark, f"{folder}/x")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{folder}/x")
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="checkpoint.dir"):
        storage.shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_command_lines(spark, tmp_path, capsys):
    from tessella import __main__ as cli

    path = str(tmp_path / "numbers")
    assert cli.main(["generate", "-a", "500", "-p", path]) == 0 and spark.read.parquet(path).count() == 500
    assert cli.main(["generate", "-a", "500", "-p", path]) == 1
    assert cli.main(["time", "-d", path, "-c", "0", "-r", "2", "--log", str(tmp_path / "log")]) == 0
    assert (tmp_path / "log").read_text().strip() in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["time", "-d", path, "-f", path])


def test_bucket_pruning(spark, tmp_path):
    table = writer.write_bucketed(spark.range(100), "pruned", str(tmp_path / "b"), 8, "id")
    found = table.filter("id = 5")
    assert found.count() == 1 and found.rdd.getNumPartitions() == 1 < table.rdd.getNumPartitions()
    joined = table.join(table.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).hint("merge")
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()


def test_stream(spark, tmp_path):
    from tessella.streaming.micro_batches import apply_to_batches

    spark.range(20).withColumn("k", F.col("id") % 3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k long").parquet(str(tmp_path / "in"))
    out, keep = str(tmp_path / "out"), str(tmp_path / "keep")
    apply_to_batches(stream, lambda df: sorting.top(df, 5, "id"), out, keep).awaitTermination(60)
    assert sorted(values(spark.read.parquet(out).select("id"))) == [0, 1, 2, 3, 4]
