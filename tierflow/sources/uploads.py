"""Readers of upload files, state reports and saved deltas. Every column is text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tierflow.functions import text
from tierflow.plans import policy
from tierflow.sources import files


def read_text_table(
    spark: SparkSession, path: str, fmt: str = "csv", line_breaks: bool = True
) -> DataFrame:
    """CSV with a header, or another format cast to text; nothing is inferred.

    A quoted value may hold line breaks; such a file is read by one task (the parts that
    the sinks write are bounded). With ``line_breaks=False`` files are split, for
    large foreign files without such values. A dataset of the sinks is read by the
    columns of its manifest, also where it has no rows.
    """
    kept = files.read_manifest(spark, path)
    reader = spark.read
    if fmt == "csv":
        reader = reader.options(header=True, inferSchema=False, quote='"', escape='"', multiLine=line_breaks)
        if kept is not None:
            names = StructType([StructField(f.name, StringType()) for f in kept])
            return reader.schema(names).option("lineSep", "\n").csv(path)
        return reader.csv(path)
    df = (reader if kept is None else reader.schema(kept)).format(fmt).load(path)
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def normalise_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Headers without outer blanks; required ones, found in any case, in their own spelling."""
    out = df.toDF(*[str(c).strip() for c in df.columns])
    spelled = {c.upper(): c for c in out.columns}
    required = list(required)
    missing = [r for r in required if r.upper() not in spelled]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return out.withColumnsRenamed({spelled[r.upper()]: r for r in required})


def find_proposed_column(columns: Iterable[str]) -> str:
    """Name of the proposed-tier column: a known spelling, else one that says so."""
    columns = list(columns)
    spelled = {c.upper().strip(): c for c in columns}
    for known in policy.PROPOSED_HEADERS:
        if known in spelled:
            return spelled[known]
    for upper, name in spelled.items():
        if "PROPOSED" in upper and "VELOC" in upper:
            return name
    raise ValueError(f"no proposed velocity column among {columns}")


def ensure_columns(df: DataFrame) -> DataFrame:
    """Upload with all its optional columns, trimmed, blanks for null."""
    out = df
    if "PROPOSED_VELOCITY_" not in df.columns:
        out = out.withColumn("PROPOSED_VELOCITY_", F.col("PROPOSED_VELOCITY"))
    optional = ["SERVICE_LEVEL", "SAP_VELOCITY", "VELOCITY_REASON"]
    for name in optional:
        if name not in df.columns:
            out = out.withColumn(name, F.lit(""))
    return out.withColumns(
        {c: text(c) for c in ["PROPOSED_VELOCITY", "PROPOSED_VELOCITY_", *optional]}
    )


def as_upload(df: DataFrame) -> DataFrame:
    """Any upload-like frame in the canonical shape: trimmed keys, one proposed column."""
    out = normalise_columns(df, policy.UPLOAD_KEYS)
    proposed = find_proposed_column(out.columns)
    if proposed != "PROPOSED_VELOCITY":
        out = out.withColumnRenamed(proposed, "PROPOSED_VELOCITY")
    # optional headers in any case take their own spelling too
    spelled = {c.upper(): c for c in out.columns}
    known = ["PROPOSED_VELOCITY_", "SERVICE_LEVEL", "SAP_VELOCITY", "VELOCITY_REASON"]
    out = out.withColumnsRenamed({spelled[k]: k for k in known if k in spelled})
    keys = {k: F.trim(F.col(k).cast("string")) for k in policy.UPLOAD_KEYS}
    return ensure_columns(out.withColumns(keys))


def read_upload(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return as_upload(read_text_table(spark, path, fmt))


def read_segmented(
    spark: SparkSession, paths_by_tier: Mapping[str, str], fmt: str = "csv"
) -> DataFrame:
    """Upload kept as one part per tier: the rows of every part given."""
    if not paths_by_tier:
        raise ValueError("no part of the upload was given")
    frames = [read_text_table(spark, p, fmt) for p in paths_by_tier.values()]
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return as_upload(out)


def read_by_tier(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Upload written by ``write_by_tier``, whichever tiers have rows."""
    return as_upload(read_text_table(spark, path, fmt).drop("tier"))


def read_sheet(
    spark: SparkSession, directory: str, name: str = policy.STATE_SHEET, fmt: str = "csv"
) -> DataFrame:
    """One named dataset of a report directory."""
    return read_text_table(spark, f"{directory.rstrip('/')}/{name}", fmt)


def as_state(df: DataFrame) -> DataFrame:
    """State report with canonical key headers, keys and tier trimmed."""
    out = normalise_columns(df, policy.STATE_HEADERS)
    return out.withColumns({c: F.trim(F.col(f"`{c}`")) for c in policy.STATE_HEADERS})


def read_state(
    spark: SparkSession, directory: str, name: str = policy.STATE_SHEET, fmt: str = "csv"
) -> DataFrame:
    return as_state(read_sheet(spark, directory, name, fmt))


def upload_from_delta(delta: DataFrame) -> DataFrame:
    """Saved not-updated rows in the 8-column upload template."""
    df = normalise_columns(
        delta,
        (
            "ITEM",
            "DC NUMBER",
            "proposed_velocity",
            "parm_velocity",
            "SAP_VELOCITY",
            "SERVICE_LEVEL",
            "VELOCITY_REASON",
        ),
    )
    return df.select(
        text("ITEM").alias("JDA_ITEM"),
        text("`DC NUMBER`").alias("JDA_LOC"),
        text("proposed_velocity").alias("PROPOSED_VELOCITY"),
        text("proposed_velocity").alias("PROPOSED_VELOCITY_"),
        text("SERVICE_LEVEL").alias("SERVICE_LEVEL"),
        text("parm_velocity").alias("SAP_VELOCITY"),
        text("VELOCITY_REASON").alias("VELOCITY_REASON"),
        text("SAP_VELOCITY").alias("Old_Proposed_Velocity"),
    )
