"""A store of models and prediction batches that can be written twice without harm.

Tables are Parquet folders. An id is derived from what it identifies, so writing the
same thing again finds it there; a batch has its own folder, written beside and then
renamed, so it is there whole or not at all. There is no transaction over several
tables: one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def digest(columns: list[str]):
    """SHA-256 of columns as text, joined by a unit separator; null is the empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def register(registered: DataFrame, models: DataFrame, identity: list[str]) -> DataFrame:
    """Registered models and those new ones (columns `identity`) that are not there yet, under derived ids."""
    new = models.withColumn("model_id", digest(identity)).dropDuplicates(["model_id"])
    return registered.unionByName(new.join(registered.select("model_id"), "model_id", "left_anti").select(*registered.columns))


def unknown_models(batches: DataFrame, registered: DataFrame) -> DataFrame:
    """Batches of models that are not registered."""
    return batches.join(registered.select("model_id"), "model_id", "left_anti")


def replay_status(stored: DataFrame, offered: DataFrame, key: list[str], record: list[str]) -> DataFrame:
    """What writing each offered batch would do: `insert`, `replay` (the same is stored) or `conflict`."""
    own = offered.select("batch_id", digest(key).alias("idempotency_key"), digest(record).alias("_record"))
    had = stored.select(digest(key).alias("idempotency_key"), digest(record).alias("_stored"))
    status = F.when(F.col("_stored").isNull(), "insert").when(F.col("_stored") == F.col("_record"), "replay").otherwise("conflict")
    return own.join(had, "idempotency_key", "left").select("batch_id", "idempotency_key", status.alias("status"))


def latest(batches: DataFrame, by: list[str], created: str = "created_at", run: str = "run_id") -> DataFrame:
    """The newest batch of each key, ties to the greater run id."""
    order = Window.partitionBy(*by).orderBy(F.desc(created), F.desc(run))
    return batches.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def page(predictions: DataFrame, run_id: str, limit: int) -> DataFrame:
    """The first rows of a batch by rank and entity; a page has 1 to 500 rows."""
    if not 1 <= limit <= 500:
        raise ValueError("a page has 1 to 500 rows")
    return predictions.where(F.col("run_id") == run_id).orderBy("rank", "entity").limit(limit)


def lookup(predictions: DataFrame, wanted: DataFrame, key: str = "entity") -> tuple[DataFrame, int]:
    """Rows of the wanted keys, and how many keys have none."""
    missing = wanted.select(key).distinct().join(predictions.select(key), key, "left_anti").count()
    return predictions.join(wanted.select(key).distinct(), key, "left_semi"), missing


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows and a digest of a table that does not depend on its order.

    Rows are hashed, hashes summed within the classes of their first three digits, and
    the 4096 sums hashed in order, so no task gets all rows.
    """
    row = digest(columns)
    part = F.conv(F.substring(row, 4, 12), 16, 10).cast("decimal(38,0)")
    classes = df.select(F.substring(row, 1, 3).alias("c"), part.alias("v")).groupBy("c").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    return classes.agg(
        F.sum("n").alias("n_rows"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", "s", "n"))), lambda x: F.concat_ws(":", x["c"], x["s"].cast("string"), x["n"].cast("string"))), ";"), 256).alias("digest"),
    )


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table, by name."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def write_batch(spark: SparkSession, root: str, run_id: str, predictions: DataFrame) -> bool:
    """Writes a batch's folder, whole or not at all; False where it is there already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final, beside = (jvm.org.apache.hadoop.fs.Path(f"{root}/{n}") for n in (f"run={run_id}", f".writing-{run_id}"))
    files = final.getFileSystem(conf)
    if files.exists(final):
        return False
    predictions.write.mode("overwrite").parquet(f"{root}/.writing-{run_id}")
    if not files.rename(beside, final):
        files.delete(beside, True)
        return False
    return True


def schema_version(spark: SparkSession, root: str, version: int) -> int:
    """The store's version, set to `version` where it is new or older; a newer store is refused."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    files = folder.getFileSystem(conf)
    found = [int(s.getPath().getName()) for s in files.listStatus(folder)] if files.exists(folder) else []
    had = max(found, default=0)
    if had > version:
        raise ValueError(f"the store has version {had}, newer than {version}")
    if had < version:
        files.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{version}"))
    return had
