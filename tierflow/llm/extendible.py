"""Sharding by extendible hashing, in DataFrame functions only.

A directory is indexed by the leading bits of a hash of the key. A bucket over the byte
limit splits on the next bit, the others stay as they are, until every shard fits. The
splits of several bits are found in one aggregate: bytes are summed by fine prefix, each
fine prefix is counted for all its shorter ones, and a bucket is a shard where it fits
and the one that a bit less names doesn't. Only prefixes that are still too large go into
another round with more bits.

Rows with the same key share all bits of the first hash (60), so a second hash, of the
row's place in the stored table, follows it: a key with any number of rows splits on.

Defined results: a null text has 0 bytes, a null key is a key of its own; repeated rows
are rows of their own and may lie in different shards only where one can't hold them;
a single row above the limit is a shard alone (`shard_bytes` shows it); an empty table
gives an empty result. Extra columns are ignored unless named in `carry`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.llm.shared import stored

#: Production limit of a shard: a mebibyte of text.
LIMIT = 1 << 20
#: Bits that one round can add below the depth at which an even split would fit.
STEP = 6
_BITS, _MORE = 60, 60


def _hash_bits(value: Column) -> Column:
    """The first 60 bits of an MD5 as text of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(value), 1, 15), 16, 2), _BITS, "0")


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Key, bytes and hash bits of every row, written once: later rounds read no text."""
    place = F.xxhash64(F.monotonically_increasing_id())
    first = _hash_bits(F.coalesce(F.col(key).cast("string"), F.lit("null")))
    second = F.lpad(F.conv(F.hex(F.shiftrightunsigned(place, 64 - _MORE)), 16, 2), _MORE, "0")
    df = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"), F.concat(first, second).alias("bits"), *[F.col(f"`{c}`").alias(f"carry_{c}") for c in carry])
    return stored(df, "shard-keys")


def directory(rows: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """The shards: prefix (text of bits), its depth and bytes. rows as from keyed()."""
    total, most = rows.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    depth = min(_BITS + _MORE, max(0, math.ceil(math.log2(max(1, (total or 0) / limit)))) + step) if most else 0
    cells = rows.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    found, above = None, 0
    while True:
        nodes = cells.select(F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("depth"), "cell", "bytes", "n")
        nodes = nodes.groupBy(F.expr("substring(cell, 1, depth)").alias("prefix"), "depth").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        nodes = stored(nodes, "shard-nodes")
        last = depth >= _BITS + _MORE
        fits = (F.col("bytes") <= limit) | (F.col("n") == 1) | F.lit(last)
        parents = nodes.where(~fits).select(F.col("prefix").alias("up"), (F.col("depth") + 1).alias("below"))
        shards = nodes.where(fits).join(parents, (F.expr("substring(prefix, 1, depth - 1)") == F.col("up")) & (F.col("depth") == F.col("below")), "left")
        shards = shards.where(F.col("up").isNotNull() | (F.col("depth") == 0)).select("prefix", "depth", "bytes")
        found = shards if found is None else found.unionByName(shards)
        over = nodes.where((F.col("depth") == depth) & ~fits).select("prefix")
        if last or over.isEmpty():
            return found
        above, longer = depth, min(_BITS + _MORE, 2 * depth + step)
        narrow = rows.join(over.withColumnRenamed("prefix", "wide"), F.substring("bits", 1, depth) == F.col("wide"), "left_semi")
        cells = narrow.groupBy(F.substring("bits", 1, longer).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        depth = longer


def assigned(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """rows with the prefix, depth and bytes of their shard.

    One join per depth that occurs would read the rows often; instead each row meets the
    few depths that occur as prefixes of its own bits, and exactly one names a shard.
    """
    depths = [r[0] for r in shards.select("depth").distinct().collect()]  # at most one per bit
    names = shards.select(F.col("prefix").alias("shard"), F.col("depth").alias("shard_depth"), F.col("bytes").alias("shard_bytes"))
    if len(depths) <= 1:
        depth = depths[0] if depths else 0
        return rows.withColumn("at", F.substring("bits", 1, depth)).join(names, F.col("at") == F.col("shard")).drop("at")
    tried = rows.withColumn("at", F.explode(F.array(*[F.substring("bits", 1, d) for d in depths])))
    return tried.join(names, F.col("at") == F.col("shard")).drop("at")


def sharded(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, bytes, shard (its bits), shard_depth, shard_bytes and the carried columns."""
    rows = keyed(docs, key, text, carry)
    return assigned(rows, stored(directory(rows, limit), "shards")).drop("bits").withColumnsRenamed({f"carry_{c}": c for c in carry})


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write docs as Parquet with one folder per shard, each of about a file."""
    carry = tuple(c for c in docs.columns if c != "doc_id")
    out = sharded(docs, limit, carry=carry).select(F.concat(F.lit("b"), "shard").alias("shard"), *docs.columns)
    out.repartition("shard").write.partitionBy("shard").parquet(path)
