"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# The JVM does not compile methods above this many bytes; longer generated code is split per operator instead.
COMPILED_METHOD_LIMIT = "8000"


def build_session(app: str = "skyledger", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators expect. On a cluster the master comes from spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", COMPILED_METHOD_LIMIT)
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone the results depend on and the code-size limit. Safe to call before every query."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_METHOD_LIMIT)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``; only a local session may fall back to a temporary one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a shared folder; a machine-local folder is lost with its executor")
        shared = tempfile.mkdtemp(prefix="skyledger-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    context.setCheckpointDir(shared)
    return shared


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for this application inside the shared checkpoint folder. It is deleted when the driver ends."""
    root = f"{ensure_checkpoint_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    if root not in _scratch:
        _scratch.add(root)
        atexit.register(_delete, spark, root)
    return f"{root}/{uuid.uuid4().hex}"


_scratch: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is None or jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, *partitions: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as a Parquet table in the scratch folder and read it back: lineage is cut, and what follows still
    prunes columns and partitions and pushes its filters into the scan."""
    path = scratch_folder(df.sparkSession)
    df.write.option("maxRecordsPerFile", rows_per_file).partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table without partitions that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder, so later steps neither recompute nor re-partition it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
