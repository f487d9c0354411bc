"""Paths in any store that Spark knows: manifests beside datasets, swaps and scratch folders."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

#: Spark's readers pass over names that begin with an underscore.
MANIFEST = "_tierflow.json"


def _located(spark: SparkSession, path: str):
    """The store of a path and the path in it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def qualified(spark: SparkSession, path: str) -> str:
    store, place = _located(spark, path)
    return store.makeQualified(place).toString()


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _located(spark, path)
    return store.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    store, place = _located(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    store, place = _located(spark, path)
    store.delete(place, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM delete the path when it ends."""
    store, place = _located(spark, path)
    store.mkdirs(place)
    store.deleteOnExit(place)


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """Put the staged dataset in the place of another; the old one is deleted last.

    Between the two renames a reader finds no dataset, never half of one. A store without
    renames copies.
    """
    store, new = _located(spark, staged)
    _, place = _located(spark, path)
    _, old = _located(spark, f"{staged}-old")
    had = store.exists(place)
    if had and not store.rename(place, old):
        raise OSError(f"could not move {path} aside")
    store.mkdirs(place.getParent())
    if not store.rename(new, place):
        if had:
            store.rename(old, place)
        raise OSError(f"could not move {staged} to {path}")
    if had:
        store.delete(old, True)


def write_manifest(spark: SparkSession, path: str, schema: StructType) -> None:
    """Keep the columns of a dataset beside its parts, for readers that find no rows."""
    store, place = _located(spark, f"{path.rstrip('/')}/{MANIFEST}")
    out = store.create(place, True)
    try:
        out.write(bytearray(json.dumps({"schema": schema.jsonValue()}).encode()))
    finally:
        out.close()


def read_manifest(spark: SparkSession, path: str) -> StructType | None:
    """The columns that were kept beside a dataset, None where it has no manifest."""
    store, place = _located(spark, f"{path.rstrip('/')}/{MANIFEST}")
    if not store.exists(place):
        return None
    file = store.open(place)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    finally:
        file.close()
    return StructType.fromJson(json.loads(text)["schema"])
