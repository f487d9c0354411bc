"""Source tables by logical name, and the staging folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierflow.sources import files

Source = str | Mapping[str, Any] | DataFrame | Callable[[], DataFrame]


class Tables(Mapping[str, DataFrame]):
    """Logical name to DataFrame; a source is resolved when it is first asked for."""

    def __init__(self, spark: SparkSession, sources: Mapping[str, Source]):
        self._spark = spark
        self._sources = dict(sources)
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name not in self._sources:
                raise KeyError(f"no source for table {name!r}; known: {sorted(self._sources)}")
            self._frames[name] = read_source(self._spark, self._sources[name])
        return self._frames[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._sources)

    def __len__(self) -> int:
        return len(self._sources)


def tables(spark: SparkSession, mapping: Mapping[str, Source]) -> Tables:
    return Tables(spark, mapping)


def read_source(spark: SparkSession, source: Source) -> DataFrame:
    """Catalog table name, or a dict with ``table``, or ``path`` and ``format``, or ``jdbc``.

    A dict may also hold reader ``options`` and ``rename``, old name to new.
    """
    if isinstance(source, DataFrame):
        return source
    if callable(source):
        return source()
    if isinstance(source, str):
        return spark.table(source)
    if "table" in source:
        df = spark.table(source["table"])
    elif "jdbc" in source:
        df = spark.read.format("jdbc").options(**source["jdbc"]).load()
    else:
        df = (
            spark.read.format(source.get("format", "parquet"))
            .options(**source.get("options", {}))
            .load(source["path"])
        )
    return df.withColumnsRenamed(dict(source.get("rename", {})))


def staging_dir(spark: SparkSession) -> str | None:
    """Shared folder that the session names for cut lineage, or None."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/") if folder else None


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared folder, deleted when the application ends.

    Where no shared folder is set, a local session, as in tests, gets one; on a cluster that
    is an error, since executors do not see each other's disks.
    """
    folder = staging_dir(spark)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tierflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    own = files.qualified(spark, f"{folder}/tierflow-{spark.sparkContext.applicationId}")
    if own not in _owned:
        files.remove_at_exit(spark, own)
        _owned.add(own)
    return own


_owned: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the application's scratch folder."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for held in _scopes:
        held.append(path)
    return path


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, what is staged inside: for a run whose result is written by then."""
    held: list[str] = []
    _scopes.append(held)
    try:
        yield
    finally:
        _scopes.remove(held)
        for path in held:
            files.remove(spark, path)
        for key in [k for k, (path, _) in _written.items() if path in held]:
            del _written[key]


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """The frame written to a fresh path and read back, by column and without its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """The frame as a written table in the shared folder.

    A frame with several readers is then computed once and survives lost executors.
    """
    return write_scratch(df, name)


_written: dict[tuple[str, str], tuple[str, StructType]] = {}


def written_once(
    spark: SparkSession, key: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """The frame, written on first use of this key in this application and read from then on."""
    full_key = (spark.sparkContext.applicationId, key)
    if full_key not in _written:
        df = build()
        path = scratch_path(spark, name)
        df.write.parquet(path)
        _written[full_key] = path, df.schema
    path, schema = _written[full_key]
    return spark.read.schema(schema).parquet(path)


def profile(df: DataFrame, n: int = 5) -> DataFrame:
    """Row count, column count, column names and the first n rows of an input, in one pass.

    ``first_rows`` holds them in the order of Spark's partitions, which is the order of the
    files and of the rows in them. Each task passes on a count and n rows at most.
    """
    position = F.monotonically_increasing_id()
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), position.alias("at"))
    early = F.when(F.col("at").bitwiseAND((1 << 33) - 1) < n, F.struct("at", "row"))
    parts = whole.groupBy(F.shiftright("at", 33).alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.collect_list(early).alias("early")
    )
    first = F.slice(F.array_sort(F.flatten(F.collect_list("early"))), 1, n)
    totals = parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), first.alias("first"))
    return totals.select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
        F.transform("first", lambda x: x["row"]).alias("first_rows"),
    )


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """First rows of an input with their place, from 1 on."""
    rows = profile(df, n).select(F.posexplode("first_rows").alias("at", "row"))
    return rows.select((F.col("at") + 1).alias("place"), "row.*")
