"""Session helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import attach

#: Rows with a fixed width that may be broadcast; beyond it a join shuffles.
BROADCAST_ROWS = 50_000


#: Shuffle files go at the end of the query that wrote them, not when the driver happens to collect garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    attach(spark).conf.set(TIDY, "true")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(col.cast("string")) % modulus


def prepare(spark: SparkSession) -> None:
    """Make sure that checkpoints go to the shared folder the cluster names; only a local master may do without."""
    context = attach(spark).sparkContext
    spark.conf.set(TIDY, "true")
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)


def give_back(spark: SparkSession) -> bool:
    """Have the driver's C allocator return its free pages; False where the JVM cannot (before 17.0.9, or without glibc).

    Some 450 threads, 200 of them to remove broadcasts and shuffle files, share 64 arenas there, and each arena
    keeps what its threads have freed: more than 150 MB after a minute of small queries in 211 partitions.
    """
    context = attach(spark).sparkContext
    jvm, array = context._jvm, context._gateway.new_array
    said = [jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None]
    kinds, given = array(jvm.java.lang.Class, len(said)), array(jvm.java.lang.Object, len(said))
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i], given[i] = jvm.java.lang.Class.forName(kind), said[i]
    try:
        # through the public interface, as the server's own class is not open
        call = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        return False
    return True


INFER = "spark.sql.constraintPropagation.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared checkpoint folder: a lost executor costs no recomputation.

    A checkpoint keeps the constraints that Spark has inferred of its plan. In loops that join a frame with
    what follows from it they multiply, up to minutes of planning and the driver's memory; so none are inferred.
    """
    spark = df.sparkSession
    prepare(spark)
    give_back(spark)
    before = spark.conf.get(INFER)
    spark.conf.set(INFER, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(INFER, before)


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), as compressed Parquet in the shared folder, which goes when the session ends."""
    spark = df.sparkSession
    prepare(spark)
    give_back(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """The name, or one made from it, that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint where the counted rows are few; otherwise Spark joins by shuffling."""
    return F.broadcast(df) if rows <= limit else df
