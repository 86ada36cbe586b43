"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, app: str = "quillspark") -> SparkSession:
    """A session for tests and benches; on a cluster the submitting job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only a local session, whose tasks run on this machine, gets a temporary one where that is unset; on a cluster it
    must be named, as executors would write where nobody reads.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspark-"))
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def tables_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quillspark-{spark.sparkContext.applicationId}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def discard(spark: SparkSession) -> None:
    """Delete the stored tables of this application now; only once their results are written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, ends the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write to a compressed table in the shared folder and read it back; for results read more than once."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """df for a join that must not send it whole to every task.

    Spark takes a table for small by the bytes of its compressed file, and an explode for as large as what it
    explodes; both may be a hundred times larger in memory, where the driver has to build what it broadcasts.
    """
    return df.hint("merge")


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of df's, whatever it carries."""
    have = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = f"__{w}"
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out
