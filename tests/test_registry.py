"""Every registered query against its SQL, or its own properties where it has none."""

from __future__ import annotations

import warnings
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from oracle import assert_same

from tessella.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def test_every_sql_has_a_query():
    assert registry.oracle_sql().keys() <= registry.queries().keys()


def test_damaged_tables_fail(spark, sf_dir, tmp_path):
    """Rows aren't left out quietly: the file's footer is whole, its first half is not."""
    raw = Path(f"{sf_dir}/orders.parquet").read_bytes()
    half = len(raw) // 2
    (tmp_path / "orders.parquet").write_bytes(raw[:4] + bytes(half - 4) + raw[half:])
    with pytest.raises(Exception, match="orders.parquet"):
        registry.queries()["scan_full"](spark, str(tmp_path)).collect()


def test_samples(spark, sf_dir):
    orders = {r[0] for r in registry.queries()["scan_full"](spark, sf_dir).select("o_orderkey").collect()}
    for name, n in (("bernoulli_sample", None), ("reservoir_sample", 100)):
        first, second = ([r["o_orderkey"] for r in registry.queries()[name](spark, sf_dir).collect()] for _ in range(2))
        assert sorted(first) == sorted(second)
        assert set(first) <= orders and len(set(first)) == len(first)
        assert n is None and 0 < len(first) < len(orders) or len(first) == n
    cut = sorted(r[0] for r in registry.queries()["random_slice"](spark, sf_dir).collect())
    whole = sorted(orders)
    if cut:
        at = whole.index(cut[0])
        assert cut == whole[at : at + len(cut)]


def test_partition_samples_of_no_rows(spark, sf_dir, tmp_path):
    pq.write_table(pq.read_table(f"{sf_dir}/lineitem.parquet").slice(0, 0), tmp_path / "lineitem.parquet")
    found = registry.queries()["partition_samples"](spark, str(tmp_path))
    assert_same(found, registry.oracle_sql()["partition_samples"], str(tmp_path))


def test_entry_without_what_the_subpackage_needs(monkeypatch):
    """A module that can't be imported takes no other query with it."""
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith("tessella.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("xxhash", "tessella.llm.common"):
        monkeypatch.setitem(sys.modules, name, None)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert __spark_entry__.queries().keys() == registry.queries().keys()
        assert __spark_entry__.oracle_sql() == registry.oracle_sql()


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["o_custkey", "o_orderkey", "pos"] and found.count() == 1500
    assert registry.queries().keys() <= __spark_entry__.queries().keys()
