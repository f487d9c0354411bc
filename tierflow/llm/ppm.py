"""LM scoring by prediction by partial matching over bytes, pretrained on the corpus.

The trie of byte contexts up to `ORDER` is a table: counts of (context, next byte) for
every order, and for every context its total, its number of different next bytes, and
what an escape from it excludes one order down. A byte is coded at the longest context in
which it occurred; each longer known context adds an escape (method C: different bytes
over total plus different bytes), and bytes that a longer context knows are excluded from
the shorter ones. Below order 0 the unseen bytes share evenly. A text ends with byte
0xFF and begins in the context of such bytes; neither occurs in UTF-8. A-Z are lowered.

As the model is fixed while it scores, the code length of a byte depends only on it and
the `ORDER` bytes before. So probabilities are worked out once for each different gram,
by joins. Texts are stored in blocks of bounded size; a block says which grams and words
it holds, gets the values of just these back as a file of its own in the shared folder,
and is scored by lookups. No table of the corpus is broadcast or held by one task.

The base is a unigram model of words with add-one smoothing; words are known by 63-bit
hashes of their bytes.

Defined results: a null text is empty (one token, the end); a null doc_id counts as the
empty text for the split; repeated rows are documents of their own in counts and scores;
extra columns are ignored; without training documents all probabilities are those of an
empty model; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.llm.shared import new_folder, stored
from tierflow.llm.words import lowered, sliced, text_bytes, word_hashes

ORDER = 4
END = 0xFF
#: Text bytes of a block; a longer text is a block alone.
BLOCK_BYTES = 32 << 20
_CHUNK = 2 << 20


def is_held_out(doc_id: object) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def _blocked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
    held = 0
    for whole in batches:
        for b in sliced(whole, 1):
            n = int(pa.compute.sum(pa.compute.binary_length(b.column(1))).as_py() or 0)
            if held and held + n > BLOCK_BYTES:
                block, held = block + 1, 0
            held += n
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, block)), b.column(0), b.column(1)], ["block", "doc_id", "text"])


def _grams(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all predicted bytes of some texts, where each text's codes start, and which are pads.

    Texts lie one after the other, each after ORDER end bytes and followed by one.
    """
    n = len(borders) - 1
    starts = borders[:-1] + (ORDER + 1) * np.arange(n)
    line = np.full(len(data) + (ORDER + 1) * n, END, np.uint8)
    for at, a, b in zip((starts + ORDER).tolist(), borders[:-1].tolist(), borders[1:].tolist()):
        line[at : at + b - a] = data[a:b]
    code = line.astype(np.int64)
    for k in range(1, ORDER + 1):
        code[k:] |= line[:-k].astype(np.int64) << (8 * k)
    pad = np.zeros(len(line), bool)
    for k in range(ORDER):
        pad[starts + k] = True
    return code, starts, pad


def _word_codes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes below 0 of all words, and the place of each text's first word."""
    words, places = word_hashes(data, borders)
    return (words | np.uint64(1 << 63)).view(np.int64), places


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([c for c, _ in parts])
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(np.concatenate([n for _, n in parts])[order], first)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, code and count in training texts, of every gram and word of the block."""

    def out(block: int) -> pa.RecordBatch:
        codes, n = _summed(parts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block)), pa.array(codes), pa.array(n)], ["block", "code", "n"])

    block, parts = None, []
    for whole in batches:
        for b in sliced(whole, 2, _CHUNK):
            blocks = b.column(0).to_numpy(zero_copy_only=False)
            held = np.array([is_held_out(x) for x in b.column(1).to_pylist()], bool)
            for now in dict.fromkeys(blocks.tolist()):
                if block is not None and now != block:
                    yield out(block)
                    parts = []
                block = now
                for side in (False, True):
                    texts = b.column(2).filter(pa.array((blocks == now) & (held == side)))
                    if not len(texts):
                        continue
                    data, borders = text_bytes(texts)
                    code, _, pad = _grams(lowered(data), borders)
                    for c in (code[~pad], _word_codes(data, borders)[0]):
                        if len(c):
                            codes, n = np.unique(c, return_counts=True)
                            parts.append((codes, np.zeros(len(n), np.int64) if side else n.astype(np.int64)))
                if len(parts) > 64:
                    parts = [_summed(parts)]
    if parts:
        yield out(block)


def _trie(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts (k, code, n) of all orders, and contexts (k, context, total, kinds, out_n).

    out_n is the count, one order down, of the bytes that this context knows.
    """
    orders = grams.where("n > 0").select(F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k"), "code", "n")
    shorter = F.col("code").bitwiseAND(F.expr("shiftleft(1L, 8 * (k + 1)) - 1"))
    counts = stored(orders.groupBy("k", shorter.alias("code")).agg(F.sum("n").alias("n")), "ppm-counts")
    down = counts.select((F.col("k") + 1).alias("k"), F.col("code").alias("down"), F.col("n").alias("down_n"))
    known = counts.withColumn("down", F.col("code").bitwiseAND(F.expr("shiftleft(1L, 8 * k) - 1")))
    known = known.join(down, ["k", "down"], "left")
    contexts = known.groupBy("k", F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("down_n").alias("out_n"))
    return counts, stored(contexts, "ppm-contexts")


def _unseen(grams: DataFrame, counts: DataFrame, contexts: DataFrame) -> DataFrame:
    """code and log10 probability of grams that no training text has: the chain of escapes."""
    rows = grams.select("code", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k"))
    rows = rows.withColumn("part", F.col("code").bitwiseAND(F.expr("shiftleft(1L, 8 * (k + 1)) - 1"))).withColumn("context", F.shiftright("part", 8))
    rows = rows.join(counts.withColumnRenamed("code", "part"), ["k", "part"], "left").join(contexts, ["k", "context"], "left")
    names = ("n", "total", "kinds", "out_n")
    wide = rows.groupBy("code").agg(*[F.max(F.when(F.col("k") == k, F.col(n))).alias(f"{n}{k}") for k in range(ORDER + 1) for n in names])
    at = lambda n, k: F.coalesce(F.col(f"{n}{k}"), F.lit(0)) if k <= ORDER else F.lit(0)
    left = F.lit(0.0)
    # From below upwards: what follows an escape from order k is the value of order k - 1.
    value = -F.log10(256 - at("kinds", 0))
    for k in range(ORDER + 1):
        total, kinds = at("total", k) - at("out_n", k + 1), at("kinds", k) - at("kinds", k + 1)
        found = F.log10(at("n", k) / (total + kinds))
        escape = F.log10(kinds / (total + kinds)) + value
        value = F.when(F.col(f"total{k}").isNull() | (total + kinds <= 0), value).when(at("n", k) > 0, found).otherwise(escape)
    return wide.select("code", (value + left).alias("value"))


def gram_values(grams: DataFrame) -> DataFrame:
    """code and log10 probability of every gram in (code, n); n is its count in training."""
    counts, contexts = _trie(grams)
    longest = contexts.where(F.col("k") == ORDER).select("context", "total", "kinds")
    seen = grams.where("n > 0").withColumn("context", F.shiftright("code", 8)).join(longest, "context")
    seen = seen.select("code", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("value"))
    return seen.unionByName(_unseen(grams.where("n = 0"), counts, contexts))


class _Lookup:
    """Values of 64-bit codes: a table by hash, and a sorted list for codes whose place is taken."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(8 * max(1, len(codes)) - 1).bit_length())
        self.codes, self.values = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits)
        taken = np.zeros(1 << self.bits, bool)
        places, first = np.unique(self._place(codes), return_index=True)
        self.codes[places], self.values[places], taken[places] = codes[first], values[first], True
        # An empty place holds a code that belongs elsewhere, so it never matches.
        if len(codes):
            self.codes[~taken] = codes[first[0]]
            if not taken[self._place(codes[first[:1]])[0]]:
                raise AssertionError("the first code has its place")
        rest = np.ones(len(codes), bool)
        rest[first] = False
        order = np.argsort(codes[rest], kind="stable")
        self.more, self.more_values = codes[rest][order], values[rest][order]

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        place = self._place(codes)
        out = self.values[place]
        missed = np.flatnonzero(self.codes[place] != codes)
        if len(missed):
            at = np.searchsorted(self.more, codes[missed])
            if not len(self.more) or at.max() >= len(self.more) or (self.more[at] != codes[missed]).any():
                raise LookupError("a block holds a code that its table lacks")
            out[missed] = self.more_values[at]
        return out


def _scored(folder: str, tokens: int, kinds: int, ends: int, doc_type: pa.DataType):
    scale, known_end = tokens + kinds + 1, ends > 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        block, grams, words = None, None, None
        for whole in batches:
            for b in sliced(whole, 2, _CHUNK):
                blocks = b.column(0).to_numpy(zero_copy_only=False)
                for now in dict.fromkeys(blocks.tolist()):
                    if now != block:
                        grams = words = None
                        table = ds.dataset(f"{top}/block={now}", filesystem=store, format="parquet").to_table(columns=["code", "value"])
                        codes, values = table["code"].to_numpy(), table["value"].to_numpy()
                        block, grams, words = now, _Lookup(codes[codes >= 0], values[codes >= 0]), _Lookup(codes[codes < 0], values[codes < 0])
                    part = b.filter(pa.array(blocks == now))
                    data, borders = text_bytes(part.column(2))
                    code, starts, pad = _grams(lowered(data), borders)
                    value = np.zeros(len(code))
                    value[~pad] = grams(code[~pad])
                    score = np.add.reduceat(value, starts)
                    code, places = _word_codes(data, borders)
                    count = words(code) if len(code) else np.zeros(0)
                    run_up = lambda x: np.concatenate([[0.0], np.cumsum(x)])
                    log, known = np.log10((count + 1) / scale), run_up(count > 0)
                    base = np.array([math.fsum(log[i:j]) for i, j in zip(places[:-1].tolist(), places[1:].tolist())]) + math.log10((ends + 1) / scale)
                    n = np.diff(places)
                    n_known = (known[places[1:]] - known[places[:-1]]).astype(np.int64) + known_end
                    held = [is_held_out(x) for x in part.column(1).to_pylist()]
                    m = part.num_rows
                    columns = [part.column(1), pa.array(held, pa.bool_()), pa.array(n + 1), pa.array(n_known), pa.array(np.full(m, tokens)), pa.array(base), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _held(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 7 == 2


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    blocks = stored(df.mapInArrow(_blocked, f"block long, doc_id {kind}, text string"), "ppm-blocks")
    codes = stored(blocks.mapInArrow(_counted, "block long, code long, n long"), "ppm-block-codes")
    totals = stored(codes.groupBy("code").agg(F.sum("n").alias("n")), "ppm-totals")
    ends = blocks.where(~_held(F.col("doc_id"))).count()
    words = totals.where("code < 0")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    values = words.select("code", F.col("n").cast("double").alias("value")).unionByName(gram_values(totals.where("code >= 0")))
    folder = new_folder(docs.sparkSession, "ppm-values")
    codes.select("block", "code").join(values, "code").repartition("block").write.partitionBy("block").parquet(folder)
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.mapInArrow(_scored(folder, tokens + ends, kinds + (ends > 0), ends, pa.int64()), schema)
