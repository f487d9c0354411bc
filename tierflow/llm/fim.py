"""Fill-in-middle transformation with cuts found in a wavelet matrix of character classes.

Every code point has a class: inside a run of letters, first letter of a run, line break,
or any other. A unit (token) starts at each code point that is not inside a run. The
classes of many texts form one wavelet matrix: a bit vector with ranks for each bit of the
class. The ranks of the starting classes add up to the number of units that start before
a place; a bisection on that sum finds where a given number of units ends. Both cuts of
all texts are searched together.

A text is cut into prefix, middle and suffix and put out as prefix-suffix-middle (psm) or
suffix-prefix-middle (spm), each part after its mark. A text that holds a mark, or is
empty, stays plain; so `restored` is exact. The choice depends on the seed and doc_id only.

Defined results: a null text counts as empty (plain); a null doc_id takes the hash of the seed
alone; rows that repeat an id get the same numbers; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.llm.words import sliced

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
INSIDE, LETTER, BREAK, OTHER = range(4)
#: The classes at which a unit starts.
TOKENS, LINES = (LETTER, BREAK, OTHER), (BREAK,)
SEED = "1"
#: Of 100 documents so many are transformed, and of 100 transformed ones so many are spm.
RATE, SPM = 90, 20

_U = np.uint64
_LETTER = np.zeros(128, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class _Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, _U)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        low = (_U(1) << (i & 63).astype(_U)) - _U(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Ranks of symbols below 2**bits."""

    def __init__(self, symbols: np.ndarray, bits: int = 2):
        self.levels: list[tuple[int, _Bits, int]] = []
        for k in range(bits - 1, -1, -1):
            ones = (symbols >> k & 1).astype(bool)
            self.levels.append((k, _Bits(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before each place in i."""
        first, i = np.zeros(1, np.int64), np.asarray(i, np.int64)
        for k, bits, zeros in self.levels:
            if symbol >> k & 1:
                first, i = zeros + bits.rank(first), zeros + bits.rank(i)
            else:
                first, i = first - bits.rank(first), i - bits.rank(i)
        return i - first

    def starts(self, classes: Iterable[int], i: np.ndarray) -> np.ndarray:
        """How many units start before each place in i."""
        return sum(self.rank(c, i) for c in classes)


def char_classes(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The class of each code point; no run of letters reaches across a border between texts."""
    letter = np.zeros(len(points), bool)
    ascii = points < 128
    letter[ascii] = _LETTER[points[ascii]]
    goes_on = np.zeros(len(points), bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[borders[borders < len(points)]] = False
    out = np.where(letter, LETTER, np.where(points == 10, BREAK, OTHER)).astype(np.uint8)
    out[goes_on] = INSIDE
    return out


def cut_places(matrix: WaveletMatrix, low: np.ndarray, high: np.ndarray, units: np.ndarray, classes: Iterable[int] = TOKENS) -> np.ndarray:
    """The last place of each [low, high] that no more than so many units start before, from low on."""
    most = matrix.starts(classes, low) + units
    low, high = low.copy(), high.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        fits = matrix.starts(classes, middle) <= most
        low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
    return low


def numbers(doc_id: object, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(hexed[i : i + 8], 16) for i in range(0, 32, 8))


def _transform(seed: str, rate: int, spm: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in sliced(whole, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                h = np.array([numbers(x, seed) for x in part.column(0).to_pylist()], np.int64).reshape(-1, 4)
                borders = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
                matrix = WaveletMatrix(char_classes(points, borders))
                n = np.diff(matrix.starts(TOKENS, borders))
                picks = h[:, :2] % (n + 1)[:, None]
                first, second = (cut_places(matrix, borders[:-1], borders[1:], k) - borders[:-1] for k in (picks.min(axis=1), picks.max(axis=1)))
                form, out, sizes = [], [], []
                for t, i, j, h3, h4 in zip(texts, first.tolist(), second.tolist(), h[:, 2].tolist(), h[:, 3].tolist()):
                    if not t or any(mark in t for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
                        form.append("plain")
                        out.append(t)
                        sizes.append((None, None))
                        continue
                    head, middle, tail = t[:i], t[i:j], t[j:]
                    is_spm = h4 % 100 < spm
                    form.append("spm" if is_spm else "psm")
                    out.append(f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{middle}" if is_spm else f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{middle}")
                    sizes.append((i, j - i))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), *(pa.array([s[k] for s in sizes], pa.int64()) for k in (0, 1)), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transformed(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and output of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_transform(seed, rate, spm), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    parts = F.split(output, "<[PSM]>", -1)
    # A text holds no mark, so an output has the empty piece before the first mark and three more.
    put = lambda *order: F.concat(*[parts[k] for k in order])
    return F.when(form == "psm", put(1, 3, 2)).when(form == "spm", put(2, 3, 1)).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """The rows of `transformed` with digests of the output and of the text read back from it."""
    rows = transformed(docs)
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
