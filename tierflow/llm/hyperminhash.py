"""MinHash near-dedup with HyperMinHash sketches.

A document is the set of its distinct 5-word shingles. Its sketch has 256 buckets; each
keeps, for the smallest hash that fell into it, the number of leading zeros and the ten
bits after the leading one: 16 bits instead of 64. An empty bucket borrows the register
of a bucket chosen by a fixed probe sequence. Bands of five registers are the candidate
keys: two sets of similarity 0.75 miss all 51 bands about once in a million times.

Work is on classes: documents with the same shingle set share a class, so copies never
meet. Sets are told apart by 128 bits: a 64-bit key, and 64 more that part keys of unlike sets. In each bucket of a band that holds two classes or more, pivots are compared with
all other members: first by the slots that their shingles fill among 1,024 (an upper bound
of the intersection, so no link is lost), then by the sketch (share of equal registers,
corrected for chance collisions), then by the full sets from both texts. The sketch drops a
pair whose estimate lies SIGMAS standard errors below the threshold; the error follows
from the number of filled buckets, so small sets are always compared in full. Pairs whose
classes are connected already need no comparison, and a pair that shares several bands meets in
the smallest of them only. Members that were pivots leave the bucket; rounds with more and
more pivots go on until no bucket holds two components. So every pair that shares a band is
ruled out by a bound, compared, or known to be connected, and a large group of copies costs a
few comparisons for each.

Defined results: a null text is empty; a document without words has no shingles, links
with nothing and is kept; with one to four words the whole sequence is its one shingle;
repeated rows are documents of the class of their text; a null doc_id takes no part in
the minimum (component_id is null only where no document of the component has an id);
extra columns are ignored by `report` and kept by `deduplicated`; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.llm.shared import stored
from tierflow.llm.words import mix, sliced, text_bytes, word_hashes

SHINGLE = 5
BUCKETS = 256
MANTISSA = 10
ROWS, BANDS = 5, 51
#: A pair is dropped by its estimate only so many standard errors below the threshold: a pair
#: at the threshold is lost with a chance of about 2e-8, whatever the sizes.
SIGMAS = 5.5
#: 64-bit words of the slots that a set's shingles fill.
SLOT_WORDS = 16
#: Pivots of a bucket in the first round; a bucket with fewer members outside its largest
#: component is done in one.
PIVOTS = 256
_ROW = "__near_row"

_U = np.uint64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)
_PROBES = np.argsort(mix(np.arange(BUCKETS * BUCKETS, dtype=_U)).reshape(BUCKETS, BUCKETS), axis=1)
_SALTS = mix(np.arange(1, BANDS + 1, dtype=_U))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    data, borders = text_bytes(texts)
    words, places = word_hashes(data, borders)
    grams = np.zeros(0, _U)
    if len(words) >= SHINGLE:
        grams = words[: len(words) - SHINGLE + 1] * _FACTORS[0]
        for k in range(1, SHINGLE):
            grams = grams + words[k : len(words) - SHINGLE + 1 + k] * _FACTORS[k]
        grams = mix(grams)
    sets = []
    for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
        if b - a >= SHINGLE:
            sets.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            sets.append(mix((words[a:b] * _FACTORS[: b - a]).sum(keepdims=True, dtype=_U) + _U(b - a)))
        else:
            sets.append(np.zeros(0, _U))
    return sets


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty sorted set: leading zeros and mantissa per bucket."""
    bucket = (hashes >> _U(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    low = (hashes[first] & _U((1 << 56) - 1)).astype(np.float64)
    mantissa, exponent = np.frexp(low)
    value = ((56 - exponent) << MANTISSA) | np.maximum(0, ((2 * mantissa - 1) * (1 << MANTISSA)).astype(np.int64))
    out = np.zeros(BUCKETS, np.uint16)
    filled = np.zeros(BUCKETS, bool)
    out[bucket[first]], filled[bucket[first]] = value, True
    empty = np.flatnonzero(~filled)
    if len(empty):
        donor = _PROBES[empty, filled[_PROBES[empty]].argmax(axis=1)]
        out[empty] = out[donor]
    return out


def slots(hashes: np.ndarray) -> np.ndarray:
    """Which of 64 * SLOT_WORDS slots the hashes of a set fill, as signed words."""
    filled = np.zeros(64 * SLOT_WORDS, np.uint8)
    filled[(hashes % _U(len(filled))).astype(np.int64)] = 1
    return np.packbits(filled).view(np.int64)


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in sliced(whole, 2):
            key, check, n, sketch, words = [], [], [], [], []
            for s in shingle_sets(b.column(2)):
                n.append(len(s))
                if len(s):
                    mixed = mix(s ^ _FACTORS[1])
                    again = mix(s ^ _FACTORS[2])
                    names = np.array([mixed.sum(dtype=_U) + _U(len(s)), again.sum(dtype=_U)], _U)
                    for column, name in zip((key, check), mix(names).view(np.int64).tolist()):
                        column.append(name)
                    sketch.append(registers(s).tobytes())
                    words.append(slots(s))
                else:
                    key.append(None)
                    check.append(None)
                    sketch.append(None)
                    words.append(None)
            columns = [b.column(0), b.column(1), pa.array(key, pa.int64()), pa.array(check, pa.int64()), pa.array(n, pa.int64()), pa.array(sketch, pa.binary())]
            columns.append(pa.array(words, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "key", "check", "n_shingles", "sketch", "slots"])


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row, written once so that the numbers hold."""
    return stored(docs.withColumn(_ROW, F.monotonically_increasing_id()), "near-rows")


def sketches(rows: DataFrame) -> DataFrame:
    """row, doc_id, key of the class (null without words), check, n_shingles, sketch and slots of numbered rows."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    df = rows.select(F.col(_ROW).alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    table = df.mapInArrow(_sketch, f"row long, doc_id {kind}, key long, check long, n_shingles long, sketch binary, slots array<long>")
    return parted(stored(table, "sketches"))


def parted(table: DataFrame) -> DataFrame:
    """table with new keys where sets of different checks share one (at 10**10 sets, a few do)."""
    while True:
        shared = table.groupBy("key").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high")
        shared = stored(shared.select(F.col("key").alias("shared")), "shared-keys")
        if shared.isEmpty():
            return table
        key = F.when(F.col("shared").isNull(), F.col("key")).otherwise(F.xxhash64("key", "check"))
        table = table.join(shared, F.col("key") == F.col("shared"), "left").withColumn("key", key).drop("shared")
        table = stored(table, "sketches")


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS)[:, : ROWS * BANDS].astype(_U)
        bands = mix((regs.reshape(-1, BANDS, ROWS) * _FACTORS[:ROWS]).sum(axis=2, dtype=_U) ^ _SALTS)
        again = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(bands.ravel().view(np.int64)), b.column(0).take(again)], ["band", "key"])


def _estimates(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = [b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 3)]
            regs = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS) for i in (4, 5)]
            equal = (regs[0] == regs[1]).mean(axis=1)
            # Chance that registers of unlike hashes agree: same zeros, then the same mantissa.
            zeros = np.arange(57)
            share = [np.exp(-x[:, None] / BUCKETS * 2.0 ** -(zeros + 1)) - np.exp(-x[:, None] / BUCKETS * 2.0**-zeros) for x in n]
            chance = (share[0] * share[1]).sum(axis=1) / (1 << MANTISSA)
            jaccard = (equal - chance) / (1 - chance)
            # Filled buckets count; those that lend registers weigh more, which adds to the error.
            filled = BUCKETS * -np.expm1(-np.minimum(*n) / BUCKETS)
            lent = BUCKETS / filled
            error = np.sqrt(threshold * (1 - threshold) / filled * (1 + (lent - 1) / lent**2))
            yield b.filter(pa.array(jaccard >= threshold - SIGMAS * error)).select([0, 1])

    return run


def _verified(threshold_percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot_text, pivot = None, None
        for whole in batches:
            for b in sliced(whole, 2):
                linked = []
                for s, other in zip(shingle_sets(b.column(2)), b.column(3)):
                    if pivot_text is None or other != pivot_text:
                        pivot_text = other
                        pivot = shingle_sets(pa.array([other.as_py()], pa.string()))[0]
                    both = len(np.intersect1d(s, pivot, assume_unique=True))
                    linked.append(100 * both >= threshold_percent * (len(s) + len(pivot) - both))
                yield b.filter(pa.array(linked, pa.bool_())).select([0, 1])

    return run


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """key and component (its smallest key) of all keys in links (a, b).

    Each round takes the smallest label among neighbours and then that label's own label,
    until no label changes; labels are rewritten to the shared folder each time. start has
    labels from before: each key must point to a key that points to itself.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    keys = both.select(F.col("a").alias("key")).distinct()
    labels = keys.withColumn("component", F.col("key"))
    if start is not None:
        labels = start.unionByName(labels.join(start, "key", "left_anti"))
    while True:
        other = labels.select(F.col("key").alias("b"), F.col("component").alias("near"))
        own = labels.select(F.col("key").alias("a"), F.col("component").alias("root"))
        # Where a link joins two components, the larger root takes the smaller one's label.
        seen = both.join(other, "b").join(own, "a").where("near < root").groupBy(F.col("root").alias("key")).agg(F.min("near").alias("near"))
        seen = stored(seen, "labels")
        if seen.isEmpty():
            return labels
        labels = labels.join(seen, "key", "left").select("key", F.least("component", F.coalesce("near", "component")).alias("component"))
        changed = True
        while changed:
            labels = stored(labels, "labels")
            up = labels.select(F.col("key").alias("component"), F.col("component").alias("up"))
            jumped = labels.join(up, "component").select("key", F.col("up").alias("component"), (F.col("up") != F.col("component")).alias("changed"))
            changed = not jumped.where("changed").isEmpty()
            labels = jumped.drop("changed") if changed else labels


def _filled(words: Column) -> Column:
    """How many slots the words name."""
    return sum((F.bit_count(F.get(words, F.lit(i))) for i in range(1, SLOT_WORDS)), F.bit_count(F.get(words, F.lit(0))))


def _may_link(a: str, b: str, threshold: float) -> Column:
    """Sets of a and b (prefixes of n, filled, slots) can reach the threshold (exact: true of all that do)."""
    percent = round(100 * threshold)
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    shared = [F.bit_count(F.get(f"{a}slots", F.lit(i)).bitwiseAND(F.get(f"{b}slots", F.lit(i)))) for i in range(SLOT_WORDS)]
    common = sum(shared[1:], shared[0])
    # A slot that the other set leaves empty holds at least one shingle that it lacks.
    most = F.least(n - F.col(f"{a}filled"), m - F.col(f"{b}filled")) + common
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & ((100 + percent) * most >= percent * (n + m))


def _compared(pairs: DataFrame, rows: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """The pairs (key, pivot) that link: by slots, by sketch, then by the sets of both texts."""
    percent = round(100 * threshold)
    own = held.select("key", "n", "filled", "slots", "sketch")
    other = own.toDF("pivot", "pivot_n", "pivot_filled", "pivot_slots", "other")
    met = pairs.join(own, "key").join(other, "pivot").where(_may_link("", "pivot_", threshold)).select("key", "pivot", "n", "pivot_n", "sketch", "other")
    near = stored(met.mapInArrow(_estimates(threshold), "key long, pivot long"), "near-pairs")
    wanted = held.select("row", "key").join(near.select("key").union(near.select("pivot")).distinct(), "key", "left_semi")
    texts = rows.select(F.col(_ROW).alias("row"), F.col("text").cast("string").alias("text")).join(wanted, "row").select("key", "text")
    full = near.join(texts, "key").join(texts.toDF("pivot", "pivot_text"), "pivot").select("key", "pivot", "text", "pivot_text")
    return full.mapInArrow(_verified(percent), "key long, pivot long")


def _meetings(known: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Pairs (key, pivot) of different components that share a bucket and may link, each once.

    known has band, key, component and chosen. A pair meets in the smallest of its common
    buckets. That bucket is left by one of the two only as a pivot, after this comparison, or
    when it holds one component, so a pair that another bucket passes over is not lost.
    """
    places = known.groupBy("key").agg(F.min("component").alias("component"), F.collect_list(F.struct("band", "chosen")).alias("places"))
    # A class meets its facts once; its buckets are unfolded after that.
    facts = held.select("key", "n", "filled", "slots").join(places, "key")
    full = facts.select("key", "component", "n", "filled", "slots", F.col("places.band").alias("bands"), F.inline("places"))
    pivots = full.where("chosen").select("band", *[F.col(c).alias(f"pivot_{c}") for c in ("key", "component", "n", "filled", "slots", "bands")])
    apart = (F.col("component") != F.col("pivot_component")) & (~F.col("chosen") | (F.col("key") > F.col("pivot_key")))
    here = F.array_min(F.array_intersect("bands", "pivot_bands")) == F.col("band")
    met = full.join(pivots, "band").where(apart & _may_link("", "pivot_", threshold) & here)
    return met.select(F.greatest("key", "pivot_key").alias("key"), F.least("key", "pivot_key").alias("pivot"))


def linked_classes(rows: DataFrame, table: DataFrame, threshold: float = 0.75) -> DataFrame:
    """key and component of all classes that link with another; numbered rows and their sketches().

    First every member of a bucket is compared with the smallest. Then members outside
    the largest component of their bucket are pivots, PIVOTS of a bucket in the first
    round and 64 times as many in each further one.
    """
    bands = table.where("key is not null").select("key", "sketch").mapInArrow(_bands, "band long, key long")
    crowded = bands.groupBy("band").agg(F.min("key").alias("first"), F.max("key").alias("most")).where("first <> most")
    members = stored(bands.join(crowded.select("band", "first"), "band").distinct(), "band-members")
    # One row stands for each class.
    slim = table.select("key", "row").join(members.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    held = table.join(slim.select("row"), "row", "left_semi")
    held = stored(held.select("row", "key", F.col("n_shingles").alias("n"), _filled(F.col("slots")).alias("filled"), "slots", "sketch"), "representatives")
    members = members.where("key <> first")
    pairs = stored(members.select("key", F.col("first").alias("pivot")).distinct(), "pairs")
    members = members.select("band", "key")
    tested, labels, most = pairs, None, PIVOTS
    while True:
        found = stored(_compared(pairs, rows, held, threshold).toDF("a", "b"), "links")
        if labels is None or not found.isEmpty():
            labels = components(found, labels)
        known = members.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
        parts = known.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
        mixed = parts.groupBy("band").agg(F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts"))
        mixed = mixed.where("parts > 1").select("band", F.col("largest.component").alias("largest"), (most / (F.col("all") - F.col("largest.n"))).alias("share"))
        # Buckets of one component are done; of the others the pivots leave after this round.
        # All buckets take the smallest hashes first, so that they share their pivots.
        chosen = (F.col("component") != F.col("largest")) & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
        known = stored(known.join(mixed, "band").select("band", "key", "component", chosen.alias("chosen")), "band-members")
        if known.isEmpty():
            return labels
        pairs = stored(_meetings(known, held, threshold).join(tested, ["key", "pivot"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        members = known.where(~F.col("chosen")).select("band", "key")
        most *= 64


def grouped(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """doc_id, key, n_shingles, component (null: alone) and component_id of every row."""
    rows = numbered(docs.select("doc_id", "text"))
    table = sketches(rows)
    labels = linked_classes(rows, table, threshold)
    classes = table.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    classes = classes.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    whole = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.select("key", "component").join(whole, "component")
    out = table.select("doc_id", "key", "n_shingles").join(named, "key", "left")
    return out.withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def report(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    kept = F.col("doc_id").isNull() & F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return grouped(docs, threshold).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The rows of docs without near copies: one row of each component stays.

    It is a row with the component's smallest id (null ids last); of several such rows one
    stays. Documents without words all stay.
    """
    rows = numbered(docs)
    table = sketches(rows)
    labels = linked_classes(rows, table, threshold)
    placed = table.where("key is not null").select("row", "doc_id", "key").join(labels, "key", "left")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = placed.groupBy(F.coalesce("component", "key").alias("component")).agg(F.min(order)["row"].alias(_ROW))
    alone = table.where("key is null").select(F.col("row").alias(_ROW))
    return rows.join(first.select(_ROW).union(alone), _ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
