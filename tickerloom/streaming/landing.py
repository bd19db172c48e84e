"""Ingest of newly arrived price files.

The file source remembers which files it has read in its checkpoint, so a file lands once however
often the job runs, and a run that is cut short picks up where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.sources.prices import price_file_schema, typed_prices


def land_new_files(spark: SparkSession, source: str, target: str, checkpoint: str, header: list[str]) -> DataFrame:
    """Append the files not seen before to the table at ``target`` and return the whole table.

    ``target`` and ``checkpoint`` belong on shared storage.
    """
    arriving = (
        spark.readStream.schema(price_file_schema(header))
        .option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
        .csv(source)
    )
    run = (
        typed_prices(arriving).writeStream.format("parquet")
        .option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(target)
