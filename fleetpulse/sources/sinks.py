"""Writers for files, tables and topics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A small long-format report as one text file, one ``a | b | c`` line per row."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns]
    lines = report.select(F.concat_ws(" | ", *cells).alias("value"))
    lines.coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def replace_table(
    df: DataFrame, name: str, url: str | None = None, options: Mapping[str, str] | None = None
) -> None:
    """Replace a catalog or JDBC table as a whole (``options`` may name a catalog table's ``path``)."""
    if url is None:
        df.write.mode("overwrite").format("parquet").options(**(options or {})).saveAsTable(name)
    else:
        df.write.mode("overwrite").format("jdbc").options(
            url=url, dbtable=name, **(options or {})
        ).save()


def fill_table(df: DataFrame, name: str) -> None:
    """Replace the rows of an existing table whose declared columns stay; a different set of columns is an error."""
    declared = df.sparkSession.table(name).columns
    if sorted(declared) != sorted(df.columns):
        raise ValueError(f"{name} has other columns: {sorted(set(declared) ^ set(df.columns))}")
    df.select(*declared).write.mode("overwrite").insertInto(name)


def append_table(
    df: DataFrame, name: str, url: str | None = None, options: Mapping[str, str] | None = None
) -> None:
    if url is None:
        df.write.mode("append").format("parquet").options(**(options or {})).saveAsTable(name)
    else:
        df.write.mode("append").format("jdbc").options(
            url=url, dbtable=name, **(options or {})
        ).save()


def as_messages(df: DataFrame) -> DataFrame:
    """One JSON ``value`` per row, the form a topic takes."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def publish(df: DataFrame, servers: str, topic: str) -> None:
    """Batch publish to a Kafka topic."""
    as_messages(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).save()
