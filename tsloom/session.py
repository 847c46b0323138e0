"""Session helpers shared by all queries."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of a batch that Python workers get, unless the session says otherwise than Spark's 64 MB: texts and payloads are long.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


#: With these, what Python workers free goes back to the system at once: they are reused, and so would be the peak of each task.
FRUGAL = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576"}


def ship(spark: SparkSession, frugal: bool = False) -> SparkSession:
    """Let Python workers of this session import the package, hand them small batches and, if frugal, let them keep no freed memory (some CPU for it)."""
    for name, value in FRUGAL.items() if frugal else ():
        spark.sparkContext.environment.setdefault(name, value)
    if frugal:
        trim(spark)
    if spark.conf.get(BATCH).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)
    return spark


def trim(spark: SparkSession) -> str:
    """Gives back what the driver's JVM has freed outside its heap: its allocator keeps that, more with every plan.  Tells by how much; nothing where the JVM can't (before 17.0.9, or not on glibc)."""
    try:
        jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # The server's own class isn't open to py4j, its interface is.
        forms = array(jvm.java.lang.Class, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            forms[i] = jvm.java.lang.Class.forName(name)
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1], args[2], args[3] = bean, "systemTrimNativeHeap", array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", forms)
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Exception:  # noqa: BLE001  it only saves memory
        return ""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Only a session on one machine may go without and gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tsloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: it cuts lineage and outlives executors.  It goes with drop() or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # The table outlives its shuffles: their files go at once, not at some later collection of garbage.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    if FRUGAL.keys() <= spark.sparkContext.environment.keys():
        trim(spark)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop(table: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    _delete(table.sparkSession, table.staged_at)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended; its folder goes with it
        return
