"""Rule catalogues with a planted fault for each rule, and the versioned store when writers die or collide."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import rules
from millrace.operators.versioned import Conflict, Manifest, Store, store_rebuilt

GOOD = {
    "code": "C000001", "employed": 10, "home": 3, "other": 2, "fixed": 5, "local": 4, "same_area": 2, "outside": 1, "inbound": 7, "retention": 0.8, "home_share": 0.3,
    "access_3km": 1.0, "access_5km": 2.0, "access_10km": 3.0, "mean_km": 4.0,
}
TYPES = ", ".join(f"{c} {'string' if c == 'code' else 'bigint' if isinstance(v, int) else 'double'}" for c, v in GOOD.items())
#: What breaks each rule that is not of a single column, and which others it breaks too.
FAULTS = {
    "code_malformed": {"code": "C00001"},
    "employed_not_reconciled": {"other": 1},
    "local_above_fixed": {"local": 6, "outside": -1, "retention": 1.2},
    "same_area_above_local": {"same_area": 5},
    "flows_not_conserved": {"outside": 2},
    "retention_not_a_ratio": {"retention": 0.8001},
    "home_share_not_a_ratio": {"home_share": 0.29},
    "access_3km_above_5km": {"access_3km": 2.5},
    "access_5km_above_10km": {"access_5km": 3.5},
    "employed_not_positive": {"employed": 0, "home": 0, "other": -5, "home_share": 0.0},
    "fixed_not_positive": {"fixed": 0, "local": 0, "same_area": 0, "outside": 0, "employed": 5, "home_share": 0.6},
} | {f"{c}_negative": {c: -1 if isinstance(v, int) else -1.0} for c, v in GOOD.items() if c != "code"} | {f"{c}_not_finite": {c: None} for c in GOOD if c != "code"} | {
    f"{c}_not_finite ": {c: bad} for c in (*rules.SHARES, *rules.REACH) for bad in (float("nan"),)
}


def broken(spark, rows):
    df = spark.createDataFrame([tuple(r[c] for c in GOOD) for r in rows], TYPES)
    return {r["rule"]: r["broken"] for r in rules.checked(df, rules.area_contract("C[0-9]{6}"), ["code"]).collect()}


def test_each_rule_has_its_fault(spark):
    assert not any(broken(spark, [GOOD, GOOD | {"code": "C000002"}]).values())
    catalogue = {r.name for r in rules.area_contract("x")}
    assert catalogue == {name.strip() for name in FAULTS} and len(catalogue) > 20
    rows = [GOOD | fault | ({} if "code" in fault else {"code": f"C{i:06}"}) for i, fault in enumerate(FAULTS.values(), 10)]
    df = spark.createDataFrame([(name.strip(), *[r[c] for c in GOOD]) for name, r in zip(FAULTS, rows, strict=True)], "planted string, " + TYPES)
    for rule in rules.area_contract("C[0-9]{6}"):
        hit = df.where(F.coalesce(rule.broken, F.lit(not rule.null_holds))).select("planted").collect()
        assert rule.name in {r[0] for r in hit}, rule.name


def test_keys_and_empty_tables(spark):
    got = broken(spark, [GOOD, GOOD, GOOD, GOOD | {"code": "C000009"}])
    assert got["repeated_key"] == 2 and got["empty"] == 0 and sum(got.values()) == 2
    got = broken(spark, [])
    assert got["empty"] == 1 and sum(got.values()) == 1
    assert rules.missing_columns(spark.range(1), ["id", "b", "a"]) == ["a", "b"]
    with pytest.raises(ValueError, match="twice"):
        rules.checked(spark.range(1), [rules.Rule("a", F.lit(False)), rules.Rule("a", F.lit(True))])


def test_one_pass_over_the_table(spark):
    df = spark.createDataFrame([tuple(GOOD.values())], TYPES)
    plan = rules.checked(df, rules.area_contract("C[0-9]{6}"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1


def test_expected_values_from_both_sides(spark):
    seen = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "rule string, observed long")
    said = spark.createDataFrame([("a", 1), ("b", 5), ("d", 4)], "rule string, expected long")
    assert {r["rule"]: r["agrees"] for r in rules.against(seen, said).collect()} == {"a": True, "b": False, "c": False, "d": False}


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_tables_change_together(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.current() is None
    store.commit(add={"runs": spark.range(2), "rows": spark.range(5)})
    store.commit(add={"rows": spark.range(5, 7)})
    first = store._manifest(1)[0]
    assert ids(store.read("rows")) == [0, 1, 2, 3, 4, 5, 6] and ids(store.read("rows", first)) == [0, 1, 2, 3, 4] and ids(store.read("runs")) == [0, 1]
    with pytest.raises(ValueError, match="other columns"):
        store.commit(add={"rows": spark.range(1).withColumnRenamed("id", "x")})
    with pytest.raises(KeyError):
        store.read("none")


def test_a_writer_that_dies_between_tables_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.commit(add={"runs": spark.range(1), "rows": spark.range(3)})
    write, died = Store._write, []

    def dies(self, name, df):
        if died:
            raise OSError("killed")
        died.append(name)
        return write(self, name, df)

    monkeypatch.setattr(Store, "_write", dies)
    with pytest.raises(OSError):
        store.commit(add={"runs": spark.range(1, 2), "rows": spark.range(3, 9)})
    monkeypatch.undo()
    again = Store(spark, str(tmp_path))
    assert again.current().number == 1 and ids(again.read("runs")) == [0] and ids(again.read("rows")) == [0, 1, 2]
    assert len(list((tmp_path / "tables" / "runs").iterdir())) == 2  # written, and named by no manifest
    again.commit(add={"runs": spark.range(1, 2), "rows": spark.range(3, 9)})
    assert ids(again.read("runs")) == [0, 1] and ids(again.read("rows")) == list(range(9))


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    base = a.commit(add={"t": spark.range(1)})
    a.commit(add={"t": spark.range(1, 2)}, based_on=base)
    with pytest.raises(Conflict):
        b.commit(add={"t": spark.range(5, 6)}, based_on=base)
    assert ids(b.read("t")) == [0, 1] and not list((tmp_path / "beside").iterdir())


def test_steps_of_the_schema_run_once_and_in_order(spark, tmp_path):
    Store(spark, str(tmp_path)).commit(add={"t": spark.range(3), "u": spark.range(1)})
    ran = []

    def step(name, f):
        def run(tables):
            ran.append(name)
            return f(tables)

        return run

    steps = {
        1: step(1, lambda t: t | {"t": t["t"].withColumn("twice", F.col("id") * 2)}),
        2: step(2, lambda t: {"t": t["t"].withColumn("more", F.col("twice") + 1), "v": t["u"]}),
    }
    store = Store(spark, str(tmp_path), 3, steps)
    assert ran == [1, 2] and store.current().schema == 3 and sorted(store.current().tables) == ["t", "v"] and store.current().number == 2
    assert [tuple(r) for r in store.read("t").orderBy("id").collect()] == [(0, 0, 1), (1, 2, 3), (2, 4, 5)]
    Store(spark, str(tmp_path), 3, steps)
    assert ran == [1, 2]
    with pytest.raises(ValueError, match="newer"):
        Store(spark, str(tmp_path), 2, steps)
    with pytest.raises(ValueError, match="no step"):
        Store(spark, str(tmp_path), 5, steps)
    assert Store(spark, str(tmp_path), 3).current() == Manifest(**vars(store.current()))


def test_only_what_can_be_made_again_is_stored(spark, tmp_path):
    store, rows = Store(spark, str(tmp_path)), spark.range(10).withColumn("score", F.col("id") / 4)
    assert store_rebuilt(store, {"season": "2024-25", "period": "3"}, rows, rows.repartition(3)) == "inserted"
    assert store_rebuilt(store, {"season": "2024-25", "period": "3"}, rows, rows) == "replayed"
    for wrong in (rows.where("id < 9"), rows.withColumn("score", F.col("score") + (F.col("id") == 4).cast("int"))):
        with pytest.raises(ValueError, match="not what its inputs give"):
            store_rebuilt(store, {"season": "2024-25", "period": "4"}, wrong, rows)
        with pytest.raises(Conflict):
            store_rebuilt(store, {"season": "2024-25", "period": "3"}, wrong, wrong)
    assert store.current().number == 1 and store.read("rows").count() == 10
    assert store_rebuilt(store, {"season": "2024-25", "period": "4"}, rows, rows) == "inserted"
    assert store.read("rows").join(store.read("runs"), "run_id").groupBy("period").count().orderBy("period").collect() == [("3", 10), ("4", 10)]


def test_the_time_of_a_run_is_recorded(spark, tmp_path):
    before = spark.sql("select current_timestamp()").first()[0]
    store = Store(spark, str(tmp_path))
    store_rebuilt(store, {"k": "1"}, spark.range(3), spark.range(3))
    said = store.read("runs").first()["recorded_at"]
    assert before <= said <= spark.sql("select current_timestamp()").first()[0]
    assert store_rebuilt(store, {"k": "1"}, spark.range(3), spark.range(3)) == "replayed" and store.read("runs").first()["recorded_at"] == said
