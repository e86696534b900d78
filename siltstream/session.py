"""Session settings and durable intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine needs; everything about size and parallelism is left to the cluster.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("siltstream")
    settings = ENGINE_CONF | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, a laptop) a local temporary folder is used and remembered.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(spark, "_siltstream_folder", None)
        if folder is None:
            folder = "file://" + tempfile.mkdtemp(prefix="siltstream-")
            spark._siltstream_folder = folder
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # the session may be gone already
        pass


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any Hadoop file system, or None where there is none."""
    jvm, place, files = _file_system(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place of the one that is there, as a whole."""
    jvm, place, files = _file_system(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = files.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(part), files.makeQualified(place), options)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a re-read, not a recomputation, and a plan that uses the result several
    times runs it once. The files are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/siltstream-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._siltstream_path = path
    return table


def release(table: DataFrame) -> None:
    """Remove the files of a materialized table before the driver ends: a loop needs those of its last round only."""
    path = getattr(table, "_siltstream_path", None)
    if path:
        _remove(table.sparkSession, path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan for CPU-bound work on each row: dealt out to all cores where its files make fewer tasks than there are.

    Plans with a shuffle are left to AQE, and tables of many files as they are.
    """
    cores, plan = scan.sparkSession.sparkContext.defaultParallelism, scan._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return scan
    return scan.repartition(cores) if plan.toRdd().getNumPartitions() < cores else scan


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers, once a session; a cluster may have no copy of it."""
    if getattr(spark, "_siltstream_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="siltstream-zip-")) / "siltstream.zip"
    with zipfile.ZipFile(archive, "w") as files:
        for source in sorted(package.rglob("*.py")):
            files.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark._siltstream_shipped = True
