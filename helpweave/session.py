"""Session helpers: table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Lower bound of a merged shuffle partition. Term joins and text rules do much work per byte; Spark's default of
#: 1 MB would fold such a shuffle into a few tasks. A builder option for sessions that run these jobs.
SHUFFLE_CONF = ("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
#: Tables that ``materialize`` has written.
_written: list[str] = []
#: Folder of this process for local sessions that name none; the setting itself is static.
_own_folder: list[str] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the session. Only a local session without one gets its own."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="helpweave-"))
    return _own_folder[0]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    Several readers then share one computation, lineage is cut, lost executors cost nothing,
    and the planner sees the true size of the table.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/helpweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let the driver give back what finished steps held: garbage with the shuffles and broadcasts that hang on it, and memory that its compiler has freed.

    A driver of many steps otherwise grows to its limits however little of it is live: garbage is collected only when the heap has grown, and memory freed outside the
    heap stays with the process. Takes less than a second; results do not depend on it.
    """
    jvm = spark.sparkContext._jvm
    jvm.java.lang.System.gc()
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # by the public interface, as the server's own class is closed to reflection; a JVM without the command keeps that memory
    beans = jvm.java.lang.Class.forName("javax.management.MBeanServer")
    methods = {m.getName(): m for m in beans.getMethods() if m.getName() in ("invoke", "getMBeanInfo")}

    def call(name: str, *args):
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, len(args))
        for i, a in enumerate(args):
            given[i] = a
        return methods[name].invoke(server, given)

    known = {op.getName() for op in call("getMBeanInfo", commands).getOperations()}
    if "systemTrimNativeHeap" in known:
        call("invoke", commands, "systemTrimNativeHeap", None, None)


def release(spark: SparkSession) -> int:
    """Delete the tables that this process has materialised, once no result that reads them is needed; returns their number."""
    jvm = spark.sparkContext._jvm
    for path in _written:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    done = len(_written)
    _written.clear()
    return done


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer partitions than the cluster has cores (a few small files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Partition the small input of an expanding join at full width.

    Such an input is a few kilobytes, so it would otherwise be folded into one task that then
    makes all the pairs.
    """
    spark = df.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(width, *keys)


def deal(df: DataFrame, rows: int, *keys: str, task_rows: int = 250_000) -> DataFrame:
    """Partitions of about ``task_rows`` of the ``rows`` that are made of ``df``, by ``keys`` if there are any; at least one for each core.

    What a task sorts or expands then does not grow with the input, nor with how well its rows are compressed.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions")) if keys else 1
    return df.repartition(max(least, spark.sparkContext.defaultParallelism, -(-rows // task_rows)), *keys)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcast hint only for a side whose counted size is below ``limit``; else leave the choice to Spark."""
    return F.broadcast(df) if rows <= limit else df
