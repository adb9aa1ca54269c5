"""The scan over a stream of captured responses."""

from pyspark.sql import DataFrame, SparkSession

from ..operators.reduce import keep_top_severity, unique
from ..operators.scan import scan


def responses(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scanned(artifacts: DataFrame, rules=None) -> DataFrame:
    """Each response scanned by itself: stateless, so no watermark and no state to keep."""
    return scan(artifacts, rules)


def run(artifacts: DataFrame, out: str, checkpoint: str, rules=None):
    """Write each batch's findings, deduplicated within the batch, under its number, so that a repeated batch overwrites itself."""

    def batch(df: DataFrame, number: int) -> None:
        keep_top_severity(unique(scan(df, rules))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return artifacts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
