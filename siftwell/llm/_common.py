"""What the operators of this subpackage share: the folder for intermediate tables and row identity."""

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words here.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: A key that holds more than one in HOT of all rows is hot, so fewer than HOT keys are; its rows go to SALTS tasks.
HOT, SALTS = 1000, 128

#: The C library's way to return freed memory, where there is one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

_made: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor reaches; only where it is unset and everything runs in one
    process, as in tests, a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append(("path", path))
    return path


def fresh_table(spark: SparkSession, tag: str) -> str:
    name = f"{tag}_{uuid.uuid4().hex}"
    _made.append(("table", name))
    return name


def clean(spark: SparkSession) -> None:
    """Remove the intermediate tables and folders of this process; results not written elsewhere can't be read after."""
    while _made:
        kind, name = _made.pop()
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def joined_on(left: DataFrame, right: DataFrame, keys: list[str], weight: str, spread: Column, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key and in `weight` the number of its rows on the left.

    The rows of hot keys are dealt to SALTS tasks by a hash of `spread`, and their one row on the right is there once
    for each; the hot keys, fewer than HOT, are broadcast to mark them. Rows with a null key, which meet nothing, are dealt
    so too. right should be written, as it is read thrice.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.where(F.col(weight) * HOT > total).select(*keys, F.lit(True).alias("__hot"))
    marked = left.join(F.broadcast(hot), keys, "left")
    marked = marked.withColumn("__salt", F.when(F.col("__hot") | F.col(keys[0]).isNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")).drop("__hot")
    copies = F.when(F.col(weight) * HOT > total, SALTS - 1).otherwise(0)
    dealt = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), copies)))
    return marked.join(dealt, [*keys, "__salt"], how).drop("__salt")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished jobs now, not when the heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _given_back(out):
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
    return out


def trimmed(f: Callable) -> Callable:
    """f, a function of one or two Arrow tables, that gives freed memory back to the system when it is done: a worker that
    waits for its next task, or for another stage, holds none of the last one's."""

    if f.__code__.co_argcount == 1:
        return lambda group: _given_back(f(group))
    return lambda group, other: _given_back(f(group, other))


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share a doc_id; rows equal in both columns get equal keys and equal treatment."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.xxhash64(text).cast("string"))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
