"""Sessions, table reads, and tables that cut lineage.

Intermediate results that later steps read more than once, or that must not be
computed twice (anything with a drawn order), are written as Parquet under the
folder the cluster names in ``spark.checkpoint.dir``. Every executor sees that
folder, so a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_OWN_FOLDER = "millrace.own.checkpoint.dir"


def build_session(app: str = "millrace", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the library expects; a cluster's own settings win where given."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one where that is unset and there is one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(_OWN_FOLDER, None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set(_OWN_FOLDER, named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; it is removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: computed once, with its lineage cut."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Removes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/millrace/" in folder:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(conf).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, whatever their search path is."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="millrace-zip-")
    target = os.path.join(folder, "millrace.zip")
    with zipfile.ZipFile(target, "w") as z:
        for top, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("millrace", os.path.relpath(full, _PACKAGE)))
    context.addPyFile(target)
    context._millrace_shipped = True
