"""Intermediate tables in the shared folder that the cluster names.

Every table is an ordinary Parquet directory below ``spark.checkpoint.dir``, so
it survives lost executors and cuts lineage.  Tables are grouped by owner and
deleted by :func:`release` or when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import threading
import time
import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20

#: Seconds between two looks at the driver's heap.
LOOK_S = 0.5

_OWNER = "default"
_TABLES: dict[str, list[str]] = {}
_SESSIONS: dict[str, SparkSession] = {}
_WATCHES: list[threading.Thread] = []
_ENDED = threading.Event()
_NEXT = 0.0  # when garbage may be collected again


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one of this machine only where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    _TABLES.setdefault(_OWNER, []).append(path)
    _SESSIONS[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table of the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    watch(spark)
    if narrow_heap(spark._jvm):
        free_shuffles(spark)  # what Python's own garbage held
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session have about ``BATCH_BYTES`` at most; the JVM and the worker of each task hold a few of them."""
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def narrow_heap(jvm) -> bool:
    """Collect the driver's garbage if its heap has grown over half of its limit; whether it had.

    A collection that is asked for also gives memory back.  Plans and tasks leave
    much garbage and little else, and the JVM would rather grow to its limit.
    Where it doesn't help, collections still take a tenth of the time at most.
    """
    global _NEXT
    now, began = jvm.java.lang.Runtime.getRuntime(), time.monotonic()
    if began < _NEXT or now.totalMemory() <= now.maxMemory() // 2:
        return False
    jvm.System.gc()
    trim(jvm)
    _NEXT = 11 * time.monotonic() - 10 * began
    return True


def trim(jvm) -> bool:
    """Give freed memory outside the heap back to the system; False where the JVM has no command for it.

    Each of the hundreds of threads that wait for stages allocates from arenas of
    the C library, which keep what was freed.
    """
    named, java = jvm.java.lang.Class.forName, jvm.java.lang
    array = lambda kind, values: _filled(jvm.java.lang.reflect.Array.newInstance(kind, len(values)), values)
    try:  # the server's class is hidden, its interface is not
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(named("java.lang.Class"), [named(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]))
        server = java.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, array(named("java.lang.Object"), [jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None]))
    except Py4JError:
        return False
    return True


def _filled(array: JavaObject, values: list) -> JavaObject:
    for k, x in enumerate(values):
        array[k] = x
    return array


def watch(spark: SparkSession) -> None:
    """From now on look at the driver's heap while actions run too, until the session ends: one action can fill it."""
    if not any(t.is_alive() for t in _WATCHES):
        _WATCHES[:] = [threading.Thread(target=_look, args=(spark.sparkContext,), daemon=True)]
        _WATCHES[0].start()


def _look(context: SparkContext) -> None:
    with contextlib.suppress(Exception):  # the JVM may end first
        while not _ENDED.wait(LOOK_S) and context._jsc is not None:
            narrow_heap(context._jvm)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished, unreferenced jobs."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark._jvm)


@contextlib.contextmanager
def owned_by(owner: str):
    """Tables made inside belong to ``owner``."""
    global _OWNER
    before, _OWNER = _OWNER, owner
    try:
        yield
    finally:
        _OWNER = before


@contextlib.contextmanager
def passing():
    """Tables made inside are deleted at its end, by which all that reads them must have run; gives the owner outside."""
    outer, owner = _OWNER, f"passing-{uuid.uuid4().hex}"
    with owned_by(owner):
        yield outer
    release(owner)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(owner: str) -> None:
    """Delete the tables of ``owner``; only after all that reads them has run."""
    for path in _TABLES.pop(owner, []):
        delete(_SESSIONS.pop(path), path)


@atexit.register
def _release_all() -> None:
    _ENDED.set()
    for owner in list(_TABLES):
        with contextlib.suppress(Exception):  # the session may have ended first
            release(owner)
