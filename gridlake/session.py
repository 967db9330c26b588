"""Session helpers: sane defaults for local runs, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "gridlake",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (a cluster passes its own session)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    Read from ``spark.checkpoint.dir`` (a cluster sets it to shared storage).  Only a local
    session without the setting gets a fresh temporary folder; a cluster session without it is
    an error, because a machine-local folder does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
    path = tempfile.mkdtemp(prefix="gridlake-ckpt-")
    sc.setCheckpointDir(path)
    return path


def materialize(df):
    """Cut a long lineage: write ``df`` to the session's checkpoint folder (reliable storage,
    so a lost executor does not replay the plan) and read it back."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df, name: str, sort_by: list[str] | None = None):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back: a table
    built once (e.g. the cells of many workbooks) and then scanned with pushdown by every
    query, instead of a plan recomputed by each branch that uses it."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.parquet(path)
    return spark.read.parquet(path)


def drop_table(df) -> None:
    """Delete the files of a table of :func:`write_table` that nothing will read again."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
