"""Writers. Nothing here brings rows to the driver."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from tierflow.plans import policy
from tierflow.sources import files


#: A CSV part that quotes line breaks is read by one task, so no part gets longer than this.
CSV_ROWS = 1_000_000


def write_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Create or replace a catalog table, or with ``path`` a parquet dataset.

    The rows are written beside the old ones first and put in their place when all are
    there. So the frame may read what it replaces, and a failed run leaves that as it was.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex[:12]
    if path is not None:
        staged = f"{path.rstrip('/')}__staged_{mark}"
        df.write.format("parquet").save(staged)
        files.swap(spark, staged, path.rstrip("/"))
        spark.catalog.refreshByPath(path)
        return
    staged = f"{name}__staged_{mark}"
    df.write.format("parquet").saveAsTable(staged)
    spark.sql(f"drop table if exists {name}")
    # the new name of a rename has no database of its own
    spark.sql(f"alter table {staged} rename to {name}")


def _save(df: DataFrame, writer: DataFrameWriter, path: str, fmt: str) -> None:
    """The rows with a manifest of their columns; values keep their blanks and line breaks."""
    if fmt == "csv":
        options = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "lineSep": "\n"}
        blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.option("maxRecordsPerFile", CSV_ROWS).options(**options, **blanks).csv(path)
    else:
        writer.format(fmt).save(path)
    files.write_manifest(df.sparkSession, path, df.schema)


def write_delta(df: DataFrame, path: str) -> None:
    """Diff or audit rows as CSV with a header."""
    _save(df, df.write.mode("overwrite"), path, "csv")


def write_by_tier(
    df: DataFrame, path: str, column: str = "proposed_velocity", fmt: str = "csv"
) -> None:
    """One output per tier A to E, ``tier=A`` and so on; other tiers are left out.

    The rebalance hint lets adaptive execution cut a crowded tier into several
    files and gather a thin one, where a hash by tier would give each one task.
    """
    tier = F.upper(F.trim(F.col(column)))
    rows = df.withColumn("tier", tier).filter(F.col("tier").isin(*policy.TIERS))
    _save(df, rows.hint("rebalance", "tier").write.mode("overwrite").partitionBy("tier"), path, fmt)


def write_report(
    parts: Mapping[str, DataFrame], directory: str, fmt: str = "csv"
) -> dict[str, str]:
    """Several named result sets, one dataset each below the directory."""
    paths = {name: f"{directory.rstrip('/')}/{name}" for name in parts}
    for name, df in parts.items():
        _save(df, df.write.mode("overwrite"), paths[name], fmt)
    return paths


def preview(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Read-back check of an output: rows, newest creation date, rows of another day."""
    created = F.col("table_created_date")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(created).alias("last_created_date"),
        F.count_if(~created.eqNullSafe(F.lit(as_of))).alias("rows_of_other_days"),
    )
