"""Packing by power-of-two decomposition.

A document of n tokens is cut into whole sequences of the longest length and then into
the binary digits of the rest, longest first. Every piece is a sequence of its own whose
length is a power of two, so no sequence crosses documents and none needs padding. Each
task deals its sequences into buckets of equal length, BUCKET_TOKENS tokens to a bucket:
`bucket` names it, `place` is the sequence's row in it. Only the last bucket of a length
in a task may hold fewer. Nothing is shuffled; `batches` deals other sizes afterwards.

Defined results: a null text counts as empty and has the end id alone; repeated rows and
ids are packed row by row; null ids pass through; extra columns are ignored; an empty
table gives an empty result. Sequence ids are unique: the task's partition, then a count.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LONGEST = 2048
END_ID = 1
#: Above this many characters `tokenizers` encodes the text: tiktoken recurses over it.
LONG_TEXT = 200_000
TEXTS_AT_ONCE = 256
BUCKET_TOKENS = 1 << 19


@cache
def _encoders(vocabulary: str) -> tuple[tiktoken.Encoding, str]:
    """tiktoken over the same vocabulary as the named JSON file; it is several times faster."""
    json_path = public_tokenizers.path(vocabulary)
    with open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)}), json_path


@cache
def _slow(json_path: str) -> Tokenizer:
    return Tokenizer.from_file(json_path)


def encode(text: str, vocabulary: str = "byte_bpe_50k.json") -> np.ndarray:
    """Ids of a text as `tokenizers` gives them with add_special_tokens=False."""
    fast, json_path = _encoders(vocabulary)
    if len(text) > LONG_TEXT:
        return np.array(_slow(json_path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return np.array(fast.encode(text, allowed_special="all"), dtype=np.uint32)


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Piece lengths of n tokens: whole sequences, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def _pieces(vocabulary: str, longest: int, with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        sequence, held = task << 40, Counter()
        kind = pa.list_(pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                doc, start, length, crc, total, ids_out, bucket, place = [], [], [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(encode(text or "", vocabulary), np.uint32(END_ID)).astype("<u4")
                    done = 0
                    for n in lengths(len(ids), longest):
                        doc.append(i)
                        start.append(done)
                        length.append(n)
                        total.append(len(ids))
                        piece = ids[done : done + n]
                        crc.append(zlib.crc32(piece.tobytes()))
                        number, row = divmod(held[n], max(1, BUCKET_TOKENS // n))
                        bucket.append(f"{task}-{n}-{number}")
                        place.append(row)
                        held[n] += 1
                        if with_ids:
                            ids_out.append(piece.astype(np.int32))
                        done += n
                n = len(doc)
                columns = [part.column(0).take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(np.arange(sequence, sequence + n), pa.int64()), pa.array(np.zeros(n, np.int64)), pa.array(bucket, pa.string()), pa.array(place, pa.int64())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "place"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids_out, kind)], [*names, "ids"]
                sequence += n
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def packed(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, place, ids."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket string, place long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_pieces(vocabulary, longest, with_ids), schema)


def batches(pieces: DataFrame, tokens: int = 1 << 19) -> DataFrame:
    """pieces with batch_id and row: sequences of equal length, `tokens` tokens to a batch.

    Batches fill up within the partition that a sequence id names, length by length, so
    numbering needs no global order; the last batch of each may hold fewer sequences.
    """
    from pyspark.sql import Window

    part = F.shiftright("sequence_id", 40)
    number = F.row_number().over(Window.partitionBy(part, "length").orderBy("sequence_id")) - 1
    per = F.greatest(F.lit(1), (F.lit(tokens) / F.col("length")).cast("long"))
    return pieces.withColumn("number", number).withColumns({"batch_id": F.concat_ws("-", part, "length", F.floor(F.col("number") / per)), "row": F.pmod("number", per)}).drop("number")


def report(docs: DataFrame) -> DataFrame:
    """The pieces without their ids."""
    return packed(docs, with_ids=False)
