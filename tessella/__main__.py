"""Command lines: ``python -m tessella generate`` writes the benchmark's table, ``python -m tessella time`` times its sort.

    python -m tessella generate -a 1500000 -p /data/numbers -l
    python -m tessella time -d /data/numbers -l -c 5 -r 30 --log /tmp/times.txt
"""

from __future__ import annotations

import argparse
import statistics
import sys
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tessella.operators import sorting
from tessella.session import session
from tessella.sources import writer
from tessella.sources.reader import ColumnReader

#: Files that a generated table is cut into.
FILES = 10


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessella")
    commands = top.add_subparsers(dest="command", required=True)
    make = commands.add_parser("generate", help="write numA (0 to 9) and numB (up to the largest 32-bit integer) as Parquet")
    make.add_argument("-a", "--amount", type=int, default=100, help="rows")
    make.add_argument("-p", "--path", required=True, help="a folder that doesn't exist")
    run = commands.add_parser("time", help="time the sort by the first two columns, with this package and without")
    where = run.add_mutually_exclusive_group(required=True)
    where.add_argument("-d", "--data-dir", help="a folder of Parquet files")
    where.add_argument("-f", "--data-file", help="one Parquet file")
    run.add_argument("-c", "--cache", type=int, default=5, help="runs before those that are timed")
    run.add_argument("-r", "--runs", type=int, default=30)
    run.add_argument("--log", help="a file for the times, besides the standard output")
    for command in (make, run):
        command.add_argument("-l", "--local", action="store_true", help="run on four threads of this machine")
        command.add_argument("--spark-local-dir", help="where Spark keeps its own temporary data")
    return top


def started(options: argparse.Namespace) -> SparkSession:
    conf = {"spark__master": "local[4]"} if options.local else {}
    if options.spark_local_dir:
        conf["spark__local__dir"] = options.spark_local_dir
    return session("tessella", **conf)


def generate(spark: SparkSession, amount: int, path: str) -> None:
    writer.write_parquet(writer.generate(spark, amount).coalesce(FILES), path)


def seconds(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def times(spark: SparkSession, path: str, cache: int, runs: int) -> dict[str, list[float]]:
    """Seconds of each timed run, planning and the listing of files included."""

    def keys(df: DataFrame) -> list[str]:
        return df.columns[:2]

    def plain() -> DataFrame:
        df = spark.read.parquet(path)
        return df.orderBy(*keys(df))

    def ours() -> DataFrame:
        df = ColumnReader(spark).load(path)
        return sorting.global_sort(df, *keys(df))

    return {name: [seconds(make()) for _ in range(cache + runs)][cache:] for name, make in (("plain", plain), ("tessella", ours))}


def main(arguments: Sequence[str] | None = None) -> int:
    options = parser().parse_args(arguments)
    spark = started(options)
    if options.command == "generate":
        try:
            generate(spark, options.amount, options.path)
        except AnalysisException as error:  # the path exists
            print(error, file=sys.stderr)
            return 1
        return 0
    found = times(spark, options.data_dir or options.data_file, options.cache, options.runs)
    lines = [f"{name}: median {statistics.median(x):.4f} s, runs {[round(s, 4) for s in x]}" for name, x in found.items()]
    print("\n".join(lines))
    if options.log:
        Path(options.log).write_text("\n".join(lines) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
