"""Price files and provider payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.constants import OHLC, PRICE_COLUMNS
from tickerloom.functions.scalars import finite, strict_trading_date, trading_date
from tickerloom.operators.keys import DataQualityError
from tickerloom.stage import stage

NUMBERS = [*OHLC, "adjusted_close", "volume"]
_SERIES_KEY = "Time Series (Daily)"
#: Columns of a file beyond these are not looked at.
_MOST_COLUMNS = 32
_FIELDS = ["open", "high", "low", "close", "volume"]


def price_file_schema(header: list[str]) -> T.StructType:
    """Numbers typed, everything else text, in the order of the files."""
    return T.StructType(
        [T.StructField(c, T.DoubleType() if c in NUMBERS else T.StringType()) for c in header]
    )


def read_price_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of CSV files with one header. A file with another header, or a value that is not of
    its type, fails the job; Spark's message names the file."""
    header = spark.read.option("header", True).csv(path).columns  # reads one header line
    missing = sorted(set(PRICE_COLUMNS) - set(header))
    if missing:
        raise DataQualityError(f"price files in {path} are missing columns: {missing}")
    rows = (
        spark.read.schema(price_file_schema(header))
        .option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
        .csv(path)
    )
    return typed_prices(rows)


def price_texts(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """The lines of a folder of CSV files; the listing of the reader names every file, those of no bytes too."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)


def _cells(line: Column) -> Column:
    return F.from_csv(line, ", ".join(f"c{i} string" for i in range(_MOST_COLUMNS)))


def _listed(cells: str) -> Column:
    return F.array(*[F.col(f"{cells}.c{i}") for i in range(_MOST_COLUMNS)])


def price_lines(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The headers and the rows of ``price_texts``, whatever is in them.

    Headers: ``path, bytes, header, missing`` (columns that a price file must have and this one lacks); a file of no line is
    not there. They are read first and staged, so Spark can send them to the lines where their size allows. Rows of complete
    files: ``path, line, problem`` and the price columns, found by the file's own header; ``problem`` names the first column
    whose text is not of its type.
    """
    # Lines of a file are in order of the part that holds them and of their place in it.
    lines = text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_begin"),
        F.monotonically_increasing_id().alias("line"), F.col("value"),
    )
    sized = lines.withColumn("bytes", F.col("_metadata.file_size"))
    first = sized.groupBy("path").agg(F.max("bytes").alias("bytes"), F.min_by("value", F.struct("_begin", "line")).alias("_text"))
    wanted = F.array(*[F.lit(c) for c in PRICE_COLUMNS])
    named = first.withColumn("_cells", _cells(F.col("_text"))).select("path", "bytes", "_text", F.transform(_listed("_cells"), F.trim).alias("header"))
    headers = stage(
        named.withColumns({
            "missing": F.array_except(wanted, F.col("header")),
            "_at": F.transform(wanted, lambda c: F.array_position("header", c).cast("int") - 1),
            "_width": F.coalesce(F.array_max(F.transform("header", lambda c, i: F.when(c.isNotNull(), i + 1))), F.lit(0)),
        }), "price-headers",
    )
    complete = headers.where(F.size("missing") == 0).select("path", "_text", "_at", "_width")
    kept = lines.join(complete, "path").where((F.col("value") != F.col("_text")) & (F.trim("value") != ""))
    # A line with fewer cells than the schema is an exception to the parser, each time. A quote might stay open.
    full = F.concat("value", F.repeat(F.lit(","), F.lit(_MOST_COLUMNS) - F.col("_width")))
    parsed = kept.withColumn("_cells", _cells(F.when(F.contains("value", F.lit('"')), F.col("value")).otherwise(full)))
    split = parsed.select("path", "line", "_at", _listed("_cells").alias("_cells"))
    texts = split.select("path", "line", *[F.nullif(F.trim(F.get("_cells", F.get("_at", F.lit(i)))), F.lit("")).alias(c) for i, c in enumerate(PRICE_COLUMNS)])
    typed = texts.select(
        "*", *[F.col(c).try_cast("double").alias(f"_{c}") for c in NUMBERS], F.col("date").try_cast("date").alias("_date")
    )
    faults = [F.when(F.col("_date").isNull(), "date"), F.when(F.col("symbol").isNull(), "symbol")]
    faults += [F.when(F.col(c).isNotNull() & F.col(f"_{c}").isNull(), c) for c in NUMBERS]
    shown = {c: finite(F.col(f"_{c}")) for c in NUMBERS} | {"date": F.col("_date"), "symbol": F.col("symbol"), "provider": F.col("provider")}
    return headers.select("path", "bytes", "header", "missing"), typed.select(
        "path", "line", F.coalesce(*faults).alias("problem"), *[shown[c].alias(c) for c in PRICE_COLUMNS]
    )


def read_price_folder(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """The usable rows of a folder of CSV files; ``catalog.file_manifest`` says what was left out and why."""
    _, rows = price_lines(price_texts(spark, path, pattern))
    return rows.where(F.col("problem").isNull()).select(PRICE_COLUMNS)


def typed_prices(rows: DataFrame) -> DataFrame:
    return rows.select(
        strict_trading_date(F.col("date")).alias("date"), "symbol",
        *[finite(F.col(c)).alias(c) for c in NUMBERS], "provider",
    ).select(PRICE_COLUMNS)


def read_fundamental_csv(spark: SparkSession, path: str, number_columns: list[str]) -> DataFrame:
    """Snapshot CSV; columns ending in ``_period_end`` or ``_filed`` become dates, bad ones null."""
    raw = spark.read.option("header", True).csv(path)
    columns = []
    for c in raw.columns:
        if c.endswith(("_period_end", "_filed")):
            columns.append(trading_date(F.col(c)).alias(c))
        elif c in number_columns:
            columns.append(finite(F.col(c).try_cast("double")).alias(c))
        else:
            columns.append(F.col(c))
    return raw.select(columns)


def _short_names(fields: Column) -> Column:
    """Field name after the last ". ", in lower case."""
    return F.transform_keys(fields, lambda k, _: F.lower(F.regexp_replace(k, r"^.*\. ", "")))


def _bars(df: DataFrame, rows: Column, provider: str) -> DataFrame:
    """``rows``: array of (day text, field map) of one payload."""
    df = df.withColumn("_rows", rows)
    named = F.transform("_rows", lambda r: F.struct(r["day"].alias("day"), _short_names(r["fields"]).alias("f")))
    df = df.withColumn("_rows", named)
    names = F.array_distinct(F.flatten(F.transform("_rows", lambda r: F.map_keys(r["f"]))))
    df = df.withColumn("_names", names)
    missing = F.array_except(F.array(*[F.lit(c) for c in _FIELDS]), F.col("_names"))
    message = F.concat(F.lit(f"{provider} response for "), F.col("symbol"), F.lit(" is missing fields: "), F.array_join(missing, ", "))
    empty = F.concat(F.lit(f"unexpected {provider} response for "), F.col("symbol"))
    checked = (
        F.when(F.col("_rows").isNull() | (F.size("_rows") == 0), F.raise_error(empty).cast("boolean"))
        .when(F.size(missing) > 0, F.raise_error(message).cast("boolean"))
        .otherwise(F.lit(True))
    )
    row = F.col("_row")

    def number(field: str) -> Column:
        return finite(F.try_element_at(row["f"], F.lit(field)).try_cast("double"))

    has_adjusted = F.array_contains("_names", "adjusted close")
    return (
        df.where(checked)
        .withColumn("_row", F.explode("_rows"))
        .select(
            trading_date(row["day"]).alias("date"),
            F.upper("symbol").alias("symbol"),
            *[number(c).alias(c) for c in OHLC],
            F.when(has_adjusted, number("adjusted close")).otherwise(number("close")).alias("adjusted_close"),
            number("volume").alias("volume"),
            F.lit(provider).alias("provider"),
        )
    )


def bars_from_date_maps(payloads: DataFrame, provider: str = "alpha_vantage") -> DataFrame:
    """``symbol, payload`` where the payload maps each day to its numbered fields."""
    schema = f"struct<`{_SERIES_KEY}`: map<string, map<string, string>>>"
    entries = F.map_entries(F.from_json("payload", schema)[_SERIES_KEY])
    rows = F.transform(entries, lambda e: F.struct(e["key"].alias("day"), e["value"].alias("fields")))
    return _bars(payloads, rows, provider)


def bars_from_value_lists(payloads: DataFrame, provider: str = "twelve_data") -> DataFrame:
    """``symbol, payload`` where the payload lists the days under ``values``."""
    values = F.from_json("payload", "struct<values: array<map<string, string>>>")["values"]
    rows = F.transform(
        values,
        lambda v: F.struct(
            F.try_element_at(v, F.lit("datetime")).alias("day"), F.map_filter(v, lambda k, _: k != "datetime").alias("fields")
        ),
    )
    return _bars(payloads, rows, provider)
