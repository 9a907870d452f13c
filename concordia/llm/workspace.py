"""Tables written into the folder that all machines share, to cut lineage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that may be broadcast: 8 MB of longs at most.
BROADCAST_IDS = 1_000_000
#: Rows in an Arrow batch, so that a batch of very long texts fits a Python worker.
BATCH_ROWS = 256
#: Seconds between two times that the driver gives back memory.
PAUSE = 2.0
_last = 0.0
#: Keys from this on leave no room for the numbers of rows that repeat a key.
_TOP = 1 << 62


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="concordia-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Workspace:
    """Intermediate Parquet tables of one operator call; drop() frees what later steps don't read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, f"{shared_dir(spark)}/concordia/{name}-{uuid.uuid4().hex}", set()

    def cut(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write df and read it back: later plans start at the file, so a lost executor costs one task."""
        path = f"{self.root}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").options(**{"compression": "zstd"} | options).parquet(path)
        give_back(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Drop all tables but these, which the result still reads."""
        self.drop(*(self.names - set(names)))


def give_back(spark: SparkSession) -> None:
    """The driver's JVM gives native memory that it has freed back to the machine, where it has the command for it; at most every PAUSE seconds.

    Compilers and the threads of many small stages each leave some in an allocator's arena of their own.
    """
    global _last
    if time.monotonic() - _last < PAUSE:
        return
    _last = time.monotonic()
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        bean = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kinds, values = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        kinds[0], kinds[1] = jvm.java.lang.Class.forName("javax.management.ObjectName"), jvm.java.lang.Class.forName("java.lang.String")
        kinds[2], kinds[3] = jvm.java.lang.Class.forName("[Ljava.lang.Object;"), jvm.java.lang.Class.forName("[Ljava.lang.String;")
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        values[2], values[3] = new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
        # by the interface's method, as the bean's own class isn't open to calls
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(bean, values)
    except Py4JError:  # a JVM without the command
        pass


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hold Arrow batches to so many rows; texts may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


def select_ids(df: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Semi or anti join on key; ids is broadcast only while it has at most BROADCAST_IDS rows."""
    ids = ids.select(key).where(F.col(key).isNotNull()).distinct()
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, key, how)


def freed(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work over a partition; at its end the Python worker, which lives on beside others, gives freed memory back to the machine."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # a C library without it
            pass

    return run


def numbered(ws: Workspace, docs: DataFrame, key: str, with_null: bool) -> tuple[DataFrame, DataFrame | None]:
    """docs in two parts with a distinct number as uid: rows whose key no other row has, which is their number, and the rest or None.

    The rest are rows that repeat a key, and with with_null rows with a null key; the others of these are left out. They are written
    first, so a number stays with its row however often a task runs.
    """
    ids = docs.select(F.col(key).cast("long").alias("uid"))
    twice = ws.cut(ids.where("uid is not null").groupBy("uid").agg(F.count("*").alias("m")).where("m > 1").select("uid"), "twice")
    low, high, nulls = ids.agg(F.min("uid"), F.max("uid"), F.count_if(F.col("uid").isNull())).first()
    docs = docs.withColumn("uid", F.col(key).cast("long"))
    named = docs.where("uid is not null")
    again = not twice.isEmpty()
    single = select_ids(named, twice, "left_anti", "uid") if again else named
    if not again and not (with_null and nulls):
        return single, None
    odd = select_ids(named, twice, "left_semi", "uid") if again else named.limit(0)
    odd = odd.unionByName(docs.where("uid is null")) if with_null else odd
    number = F.monotonically_increasing_id()
    if (high or 0) < _TOP:
        number = number + max(high or 0, 0) + 1
    elif low > -_TOP:
        number = min(low, 0) - 1 - number
    else:  # keys at both ends: all rows are numbered anew
        return single.limit(0), ws.cut((docs if with_null else named).withColumn("uid", number), "odd")
    return single, ws.cut(odd.withColumn("uid", number), "odd")


def packed_rows(ws: Workspace, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, text, row) of every row of docs: a number of its own, the text (null: empty), and all its columns in one, safe from other names."""
    row = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")
    packed = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), row)
    single, odd = numbered(ws, packed, "key", with_null=True)
    return (single if odd is None else single.unionByName(odd)).select("uid", "text", "row")
