"""What has landed: datasets, raw files, manifest, universe."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.constants import DEFAULT_BENCHMARK, DEFAULT_UNIVERSE
from tickerloom.operators.statistics import listed_in_blocks
from tickerloom.sources.prices import price_lines, price_texts


def universe_table(
    spark: SparkSession, symbols: Sequence[str] = tuple(DEFAULT_UNIVERSE), benchmark: str = DEFAULT_BENCHMARK
) -> DataFrame:
    rows = [(s, False) for s in symbols] + [(benchmark, True)]
    return spark.createDataFrame(rows, "symbol string, is_benchmark boolean")


def universe_of(panel: DataFrame, benchmark: str) -> DataFrame:
    """The symbols a panel holds, with the benchmark marked."""
    return panel.select("symbol").distinct().withColumn("is_benchmark", F.col("symbol") == benchmark)


def catalog_entry(df: DataFrame) -> DataFrame:
    """Rows, columns with types, first and last day, number of symbols; one row."""
    kinds = F.lit(", ".join(f"{n} {t}" for n, t in df.dtypes))
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    if "date" in df.columns:
        aggregates += [F.min("date").alias("first_date"), F.max("date").alias("last_date")]
    if "symbol" in df.columns:
        aggregates.append(F.count_distinct("symbol").alias("n_symbols"))
    return df.agg(*aggregates).withColumns({"n_columns": F.lit(len(df.columns)).cast("long"), "columns": kinds})


def catalog_symbols(df: DataFrame) -> DataFrame:
    """Sorted distinct symbols in comma-joined blocks."""
    distinct = df.select("symbol").where(F.col("symbol").isNotNull()).distinct().withColumn("dataset", F.lit("panel"))
    return listed_in_blocks(distinct, ["dataset"], "symbol", "symbols").drop("dataset")


_READ_AT_ONCE = 4 << 20


def _opened(path: str):
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem().open_input_stream("/" + path[5:].lstrip("/"), compression=None)
    store, name = pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_stream(name, compression=None)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            with _opened(path) as stream:
                while part := stream.read(_READ_AT_ONCE):
                    digest.update(part)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("bytes"), pa.array(found, pa.string())], names=["path", "bytes", "sha256"])


def raw_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every file below ``path`` with its size and SHA-256. Only names and sizes are rows; a task reads its files as streams, a
    few megabytes at a time, so a file of any size is hashed (on local disks, HDFS, S3 and GCS, which pyarrow opens)."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    ).select("path", F.col("length").alias("bytes"))
    return files.mapInArrow(_digests, "path string, bytes long, sha256 string")


def landing_manifest(requested: DataFrame, landed: DataFrame) -> DataFrame:
    """A row for every requested symbol; one that never arrived is a failure, not empty data."""
    found = landed.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.min("provider").alias("provider"),
    )
    df = requested.select("symbol").distinct().join(found, "symbol", "left")
    arrived = F.col("rows").isNotNull()
    return df.select(
        "symbol",
        arrived.alias("success"),
        F.coalesce("rows", F.lit(0).cast("long")).alias("rows"),
        "first_date", "last_date", "provider",
        F.when(arrived, "").otherwise("no rows landed").alias("note"),
    )


def request_start(end: Column, years: int) -> Column:
    """First day to ask for: whole years back plus a week."""
    return F.date_sub(end, 365 * years + 7)


def not_yet_landed(requested: DataFrame, manifest: DataFrame, overwrite: bool = False) -> DataFrame:
    """Symbols still to be fetched; those landed with rows are skipped unless ``overwrite``."""
    if overwrite:
        return requested
    done = manifest.where(F.col("success") & (F.col("rows") > 0)).select("symbol")
    return requested.join(done, "symbol", "left_anti")


def provider_betas(symbols: DataFrame, overviews: DataFrame, provider: str = "provider overview") -> DataFrame:
    """Provider beta per symbol with its status; a missing beta stays null."""
    from tickerloom.functions.scalars import lenient_number

    df = symbols.select("symbol").join(overviews.withColumn("_found", F.lit(True)), "symbol", "left")
    return df.select(
        "symbol",
        lenient_number(F.col("Beta")).alias("provider_beta"),
        F.lit(provider).alias("provider"),
        F.when(F.col("_found"), "cached").otherwise("error").alias("provider_status"),
        F.when(F.col("_found"), "").otherwise("overview missing").alias("provider_error"),
        lenient_number(F.col("Beta")).isNotNull().alias("provider_beta_available"),
    )


def file_manifest(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """``path, bytes, success, rows, failed_rows, first_date, last_date, note``: a row for every file of a price folder.

    A file that is empty, lacks a column or holds rows that are not of their type is a row with its reason, not an end to
    the job; the other files stay usable (see ``prices.read_price_folder``).
    """
    texts = price_texts(spark, path, pattern)
    # Readers pass over files of no bytes, so names come from the listing that the reader holds anyway. It stays in the JVM.
    jvm = spark.sparkContext._jvm
    names = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(texts._jdf.inputFiles())
    found = spark._jsparkSession.createDataset(names, jvm.org.apache.spark.sql.Encoders.STRING())
    # One way to write a local path; the listing and the reader have two.
    local = r"^file:/+"
    listed = DataFrame(found.toDF(), spark).select(F.regexp_replace("value", local, "file:/").alias("path"))
    headers, rows = (df.withColumn("path", F.regexp_replace("path", local, "file:/")) for df in price_lines(texts))
    counted = rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("_lines"), F.count("problem").alias("failed_rows"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("line"))).alias("_first"),
        F.min(F.when(F.col("problem").isNull(), F.col("date"))).alias("first_date"), F.max(F.when(F.col("problem").isNull(), F.col("date"))).alias("last_date"),
    )
    df = listed.join(headers.select("path", "bytes", "missing"), "path", "left").join(counted, "path", "left")
    failed = F.coalesce("failed_rows", F.lit(0).cast("long"))
    note = (
        F.when(F.col("missing").isNull(), "empty file")
        .when(F.size("missing") > 0, F.concat(F.lit("missing columns: "), F.array_join("missing", ", ")))
        .when(F.col("_lines").isNull(), "no rows")
        .when(failed > 0, F.concat(failed.cast("string"), F.lit(" rows failed, first: "), F.col("_first")))
        .otherwise("")
    )
    return df.select(
        "path", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"), (note == "").alias("success"), (F.coalesce("_lines", F.lit(0).cast("long")) - failed).alias("rows"),
        failed.alias("failed_rows"), "first_date", "last_date", note.alias("note"),
    )
