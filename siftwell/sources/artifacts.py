"""Where artifacts come from: files, archives, lists, tables of captured responses."""

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of files that are scanned.
EXTENSIONS = ("html", "js", "ts", "jsx", "wasm", "zip", "jar")
ARTIFACT = "source string, ord bigint, body string, is_js boolean"
MOST_BYTES = 64 << 20


def is_script(source):
    """Whether a name, query and fragment aside, is that of a script."""
    return F.lower(F.regexp_replace(source, "[?#].*$", "")).rlike(r"\.(?:js|jsx|mjs|cjs|ts|tsx|wasm)$")


def from_table(df: DataFrame, source, body: str, order: str) -> DataFrame:
    """Artifacts (source, ord, body, is_js) of a table; a null body is left out."""
    return df.where(F.col(body).isNotNull()).select(source.alias("source"), F.col(order).cast("long").alias("ord"), F.col(body).alias("body"), is_script(source).alias("is_js"))


def from_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder with one of the extensions, archives as their members; larger ones are cut at 64 MiB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.where(F.lower("path").rlike(rf"\.(?:{'|'.join(EXTENSIONS)})$")).select("path", "content")

    def expand(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if path.lower().endswith((".zip", ".jar")):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        found = [(f"{path}:{n}", z.open(n).read(MOST_BYTES)) for n in z.namelist() if n.lower().rsplit(".", 1)[-1] in EXTENSIONS]
                else:
                    found = [(path.rsplit("/", 1)[-1], content)]
                for name, data in found:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data[:MOST_BYTES].decode("utf-8", "replace")])], names=["source", "body"])

    return files.mapInArrow(expand, "source string, body string").withColumn("ord", F.lit(0).cast("long")).withColumn("is_js", is_script(F.col("source"))).select("source", "ord", "body", "is_js")


def from_stdin(spark: SparkSession, text: str) -> DataFrame:
    """What came by standard input, whole, as one artifact that counts as a script."""
    return spark.createDataFrame([("stdin", 0, text, True)], ARTIFACT)


def listed_targets(spark: SparkSession, path: str | None, given: list[str]) -> DataFrame:
    """The targets of a list, then those given beside it, in order."""
    more = spark.createDataFrame([(t,) for t in given], "target string")
    return more if path is None else targets(spark, path).union(more)


def targets(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a target list without blank ones and comments."""
    line = F.btrim(F.col("value"))
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(line.alias("target"))


def captured_index(spark: SparkSession, path: str) -> DataFrame:
    """The addresses of a dump of {"url": ...} lines; broken lines are left out."""
    return spark.read.schema("url string").json(path).where("url is not null")
