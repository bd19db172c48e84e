"""Nested filing documents, company identity and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.scalars import lenient_date, zero_padded_cik

TAXONOMY = "us-gaap"
_FACT = "struct<val: double, start: string, end: string, filed: string, form: string, frame: string>"
FACTS_SCHEMA = f"struct<entityName: string, facts: map<string, map<string, struct<units: map<string, array<{_FACT}>>>>>>"
SUBMISSION_SCHEMA = (
    "struct<name: string, sic: string, sicDescription: string, fiscalYearEnd: string, exchanges: array<string>>"
)


def read_documents(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``symbol, document`` from a folder of ``<SYMBOL><suffix>`` files, or of ``symbol=<SYMBOL>`` folders with such files; one
    document per file."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    folder = F.regexp_extract(F.element_at(parts, -2), "^symbol=(.+)$", 1)
    name = F.regexp_replace(F.element_at(parts, -1), f"{suffix}$", "")
    files = spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.coalesce(F.nullif(folder, F.lit("")), name).alias("symbol"), F.col("value").alias("document"))


def flatten_company_facts(documents: DataFrame, taxonomy: str = TAXONOMY) -> DataFrame:
    """One row per reported value. ``seq`` is the place of the value in its list."""
    parsed = documents.select("symbol", F.from_json("document", FACTS_SCHEMA).alias("d"))
    by_tag = parsed.select("symbol", F.explode(F.try_element_at("d.facts", F.lit(taxonomy))).alias("tag", "concept"))
    by_unit = by_tag.select("symbol", "tag", F.explode("concept.units").alias("unit", "items"))
    items = by_unit.select("symbol", "tag", "unit", F.posexplode("items").alias("seq", "i"))
    return items.select(
        "symbol", "tag", "unit",
        F.col("i.val").alias("val"),
        lenient_date(F.col("i.start")).alias("period_start"),
        lenient_date(F.col("i.end")).alias("period_end"),
        lenient_date(F.col("i.filed")).alias("filed"),
        F.col("i.form").alias("form"),
        F.col("i.frame").alias("frame"),
        "seq",
    )


def company_identity(documents: DataFrame) -> DataFrame:
    """``symbol, submissions, facts`` (JSON text) to one identity row per symbol; absent text is ""."""
    s = F.from_json("submissions", SUBMISSION_SCHEMA)
    entity = F.from_json("facts", "struct<entityName: string>")["entityName"]
    df = documents.select("symbol", s.alias("s"), entity.alias("entity"))

    def text(c):
        return F.coalesce(c, F.lit(""))

    return df.select(
        "symbol",
        text(F.coalesce(F.nullif(F.col("s.name"), F.lit("")), F.col("entity"))).alias("company_name"),
        text(F.col("s.sic")).alias("sic"),
        text(F.col("s.sicDescription")).alias("sic_description"),
        text(F.col("s.fiscalYearEnd")).alias("fiscal_year_end"),
        text(F.get("s.exchanges", F.lit(0))).alias("exchange"),
    )


def ticker_cik_map(payloads: DataFrame) -> DataFrame:
    """``payload``: JSON object of {ticker, cik_str} entries."""
    entries = F.from_json("payload", "map<string, struct<ticker: string, cik_str: string>>")
    return payloads.select(F.explode(F.map_values(entries)).alias("e")).select(
        F.upper("e.ticker").alias("ticker"), zero_padded_cik(F.col("e.cik_str")).alias("cik")
    )


def read_overviews(spark: SparkSession, path: str, suffix: str = "_overview.json") -> DataFrame:
    """Provider overview objects; every field is text, the symbol comes from the name of the file or its folder."""
    documents = read_documents(spark, path, suffix)
    return parse_overviews(documents)


def parse_overviews(documents: DataFrame) -> DataFrame:
    o = F.from_json("document", "struct<PERatio: string, EPS: string, Beta: string>")
    return documents.select("symbol", o.alias("o")).select("symbol", "o.PERatio", "o.EPS", "o.Beta")
