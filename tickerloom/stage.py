"""Stage tables: cut the lineage of a plan by writing it once to shared storage.

A stage is a Parquet table below the folder that ``spark.checkpoint.dir`` names, so it outlives
executors, is read back column by column, and carries its true size: joins against it are
broadcast by Spark only when the written bytes are below ``autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: How a stage is written. No exchange is left on the disks of executors: nothing reads those of a stage again. The JVM never
#: compiles a method of more than 8,000 bytes; operators whose generated code would need one run one by one.
WRITTEN_WITH = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}
#: Buckets that Spark allows a table.
MOST_BUCKETS = 100_000
#: Stage tables that have not been dropped, by path.
_open: dict[str, DataFrame] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; without one there is no place that every executor can reach."""
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        raise RuntimeError(f"set {_SETTING} to a folder that every executor can reach")
    return folder.rstrip("/")


@contextmanager
def _written_with(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with these settings; afterwards with its own."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, name: str, distinct: Sequence[str] = (), buckets: int | None = None, key: str = "symbol") -> DataFrame:
    """Write ``df`` once and continue from the written table. Columns named in ``distinct`` hardly repeat a value: Parquet
    does not try a dictionary for them. With ``buckets`` the table knows in which of so many parts a ``key`` lies, and what
    is read back needs no exchange on it: the catalog names such a table until it is dropped."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in distinct})
    with _written_with(spark, WRITTEN_WITH):
        if buckets:
            table = f"stage_{uuid.uuid4().hex}"
            writer.option("path", path).bucketBy(min(buckets, MOST_BUCKETS), key).saveAsTable(table, format="parquet")
            staged = spark.table(table)
            staged.stage_table = table
        else:
            writer.parquet(path)
            staged = spark.read.schema(df.schema).parquet(path)
    staged.stage_path = path
    _open[path] = staged
    return staged


def drop(staged: DataFrame) -> None:
    """Remove a stage table that nothing will read again."""
    spark = staged.sparkSession
    _open.pop(staged.stage_path, None)
    if table := getattr(staged, "stage_table", None):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged.stage_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_all() -> None:
    """Remove every stage table that is left, those inside operators too. What was built on them cannot be read again."""
    for staged in list(_open.values()):
        if staged.sparkSession.sparkContext._jsc is None:  # its session has ended
            _open.pop(staged.stage_path)
        else:
            drop(staged)
