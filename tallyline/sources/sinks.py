"""Exports: CSV data rooms with digests, and merges into stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.text import redact
from tallyline.operators.scratch import materialise


def csv_cell(c: Column) -> Column:
    """A value as a CSV cell: null is empty, quotes are doubled, quoted only where it must be."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(df: DataFrame, order: list[str], redacted: list[str] | None = None) -> DataFrame:
    """(line) of a table in order, columns named in redacted with personal data masked."""
    for name in redacted or []:
        df = df.withColumn(name, redact(F.col(name)))
    cells = F.concat_ws(",", *(csv_cell(F.col(c)) for c in df.columns))
    return df.orderBy(*order).select(cells.alias("line"))


def export(df: DataFrame, path: str, order: list[str], redacted: list[str] | None = None, files: int | None = None) -> None:
    """Write a table as CSV in order, with a header in every file: by default as many files as there are shuffle partitions with rows; files=1 passes all through one task, which suits a small data room."""
    for name in redacted or []:
        df = df.withColumn(name, redact(F.col(name)))
    ranged = df.coalesce(1) if files == 1 else df.repartitionByRange(*([files] if files else []), *order)
    df = ranged.sortWithinPartitions(*order)
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def content_digest(df: DataFrame, order: list[str]) -> str:
    """A digest of a table's rows in order: the root over the hashes of its rows, so no row passes through the driver."""
    from tallyline.operators.ordered import merkle_root

    hashed = df.withColumn("_h", F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256))
    return merkle_root(hashed, order, "_h") or ""


def manifest(tables: dict[str, tuple[DataFrame, list[str]]]) -> list[tuple[str, int, str]]:
    """(name, rows, digest) of each table with its order: one line a table."""
    return [(name, df.count(), content_digest(df, order)) for name, (df, order) in sorted(tables.items())]


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a Parquet table that df may itself read from: the new rows are written aside first."""
    materialise(df, "overwrite").write.mode("overwrite").parquet(path)
