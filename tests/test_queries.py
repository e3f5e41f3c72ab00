"""Every query with SQL against DuckDB over the smallest tables; the others must run."""

import glob
import os

import duckdb
import pytest

from millrace.plans import catalog


def canonical(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in order)) for r in values)


@pytest.fixture(scope="module")
def views(data):
    connection = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        connection.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, views, name):
    df = catalog.QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLE_SQL:
        want = views.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert canonical(got, df.columns) == canonical(want.fetchall(), want.columns)
    else:
        assert got


@pytest.mark.parametrize("name", ["flow_origin_aggregates", "training_frame", "bio_spans", "plot_scores", "vocabulary"])
def test_partitions_do_not_matter(spark, data, name):
    get = lambda: sorted(map(repr, catalog.QUERIES[name](spark, data).collect()))
    one = get()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert get() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_catalog_needs_no_session():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", ["flow_origin_aggregates", "queen_edges", "training_frame", "instance_iou", "near_dup_pairs"])
def test_plans_have_no_nested_loops(spark, data, name):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = catalog.QUERIES["flow_local_pairs"](spark, data)._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "lineitem" in line)
    assert "l_extendedprice" not in scan and "PushedFilters" in scan


def test_whole_audits_see_every_id(spark, tmp_path):
    spark.range(2000).selectExpr("id AS doc_id", "1L AS n_chars").union(spark.range(1).selectExpr("1500L", "0L")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(2000).where("id <> 1800").union(spark.range(5000, 5001)).union(spark.range(900, 901)).selectExpr("id AS doc_id").write.parquet(f"{tmp_path}/labels.parquet")
    got = catalog.QUERIES["identity_audit"](spark, str(tmp_path)).first()
    assert (got["missing"], got["unexpected"], got["repeated"]) == (1, 1, 1)
    got = catalog.QUERIES["record_audit"](spark, str(tmp_path)).first()
    assert (got["n_rows"], got["null_keys"], got["bad_n_chars"], got["repeated"]) == (2001, 0, 1, 1)


def test_whole_hashes_look_at_every_component(spark, tmp_path):
    up, late = [float(i) for i in range(64)], [float(i) for i in range(64)]
    late[30:] = late[:29:-1]  # differs from the 30th component on
    spark.createDataFrame([(1, "x", up), (2, "x", late), (3, "x", [v + 0.5 for v in up]), (4, "x", up)], "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(tuple(r) for r in catalog.QUERIES["near_dup_pairs"](spark, str(tmp_path)).collect()) == [(1, 3, 0), (3, 4, 0)]  # 1 and 4 are equal, and so no near copies
