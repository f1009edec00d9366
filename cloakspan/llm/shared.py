"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What parts words in the licence and decontamination operators: all of ASCII but letters and digits.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The most rows that a broadcast may have; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or, where that is unset and all runs on this machine, one of it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = _local_dir()
    return found.rstrip("/")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="cloakspan-")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cloakspan/{name}-{uuid.uuid4().hex}"


#: Whether the shuffle files of an execution go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is executed here leaves no shuffle files behind: its result is written and nobody reads them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: Spark starts a thread for each exchange until it has so many (1,024 and 128 by default), though others are idle.
THREADS = {"spark.sql.shuffleExchange.maxThreadThreshold": "16", "spark.sql.broadcastExchange.maxThreadThreshold": "16"}


def few_threads(spark: SparkSession) -> None:
    """Holds the driver's threads for exchanges at a few, unless the caller has set how many; they wait for jobs only, and take memory outside the heap.

    The settings are read when the first exchange of the application is planned; later this does nothing.
    """
    own = spark._jsparkSession.sessionState().conf()
    for key, n in THREADS.items():
        if not spark.sparkContext.getConf().contains(key):
            own.setConfString(key, n)


def trimmed(spark: SparkSession) -> str | None:
    """Gives what the driver's JVM has freed outside its heap back to the system; what the JVM says of it, None where it can't.

    Compiling plans and threads take such memory, and the C library keeps what they free. It takes some milliseconds.
    """
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def array(kind, items: list):
        out = new(kind, len(items))
        for k, x in enumerate(items):
            out[k] = x
        return out

    try:
        of, bean = jvm.java.lang.Class.forName, jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        types = [of(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = of("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, types))
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, [bean, "systemTrimNativeHeap", None, None]))
    except Py4JError:  # not all JVMs have the command
        return None


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    with cleaned(spark):
        df.write.parquet(path)
    trimmed(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.cloakspan_folder = path
    return out


def deleted(*tables: DataFrame) -> None:
    """Removes tables made by written() that nothing reads any more: what came of them is written itself."""
    for table in tables:
        spark = table.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.cloakspan_folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a table, marked for broadcast if it has at most `rows` rows (narrow ones), else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def alnum_words(text: Column) -> Column:
    """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ in lower case; split() is linear in the text, regexp_extract_all is not.

    lower() changes letters beyond ASCII too: such a word stays one word and equals no template word it didn't before,
    but for the Kelvin sign, which is kept apart.
    """
    kept = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u2c69"))
    return F.array_remove(F.split(F.lower(kept), ALNUM_GAP), "")


def clash_free(columns: Iterable[str], *names: str) -> list[str]:
    """For each name, itself or the name with as many underscores as make it differ from the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
