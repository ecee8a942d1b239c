"""Session builder and small session-level helpers shared by every operator."""

from __future__ import annotations

import os
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Least seconds between two calls of ``give_back`` that do something.
GIVE_BACK_EVERY = 4.0
_given_back: dict[str, float] = {}


def build_session(app_name: str = "blockquery", cpus: int | None = None) -> SparkSession:
    """A UTC session with AQE on; shuffle partitions follow the cores in local mode."""
    cores = cpus or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Spark's own reader resolves whatever store ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where it is unset (tests)."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = "/tmp/blockquery-checkpoints"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back(spark: SparkSession) -> bool:
    """Have the driver's JVM collect its garbage and return freed memory to the system; whether it could.

    A run of many small jobs on hundreds of threads leaves garbage in the heap and free
    blocks in the allocator's arenas, which stay mapped. Only what is free is returned, no
    result depends on it, and a JVM that cannot trim is only asked to collect.
    """
    context = spark.sparkContext
    now = time.monotonic()
    if now - _given_back.get(context.applicationId, -GIVE_BACK_EVERY) < GIVE_BACK_EVERY:
        return False
    jvm, gateway = context._jvm, context._gateway
    try:
        jvm.System.gc()
        # By java.lang.reflect: the server's own class is in a package that Py4J may not enter.
        methods = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()
        invoke = next(m for m in methods if m.getName() == "invoke")
        arguments = gateway.new_array(jvm.java.lang.Object, 4)
        arguments[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        arguments[1] = "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)
    except Py4JError:
        return False
    finally:
        _given_back[context.applicationId] = time.monotonic()
    return True


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores is dealt over the cores; any larger one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text-heavy table, so that one small file does not leave all parsing to one core."""
    return spread(table(spark, sf_dir, name))
