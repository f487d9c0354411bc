"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both tokenizers cut the same bytes. A byte offset where a token of each ends is a cut; the
stretches between cuts are the groups. An interval that begins and ends at cuts looks for
a cut near its middle by bisecting the token ends of A and B in turns, first upwards, then
downwards; it is split there and both halves go on. An interval without an inner cut is a
leaf: one group. All intervals of one depth, of many texts, are handled together, so a
text of n tokens takes about log2(n) steps of numpy.

A link is a pair of tokens that end together. Of two tokens that end together the shorter
one is a byte suffix of the longer one, so the number of different linked id pairs is bounded by the
vocabularies alone (`pair_bound`), however large the corpus is. That table is checked
against its bound and broadcast to score each text's links.

A is encoded with tiktoken over the vocabulary of the JSON file, which gives the ids of
`tokenizers` at a fifth of the time (tested); texts above LONG_TEXT characters, over which
tiktoken recurses, go to `tokenizers` itself (tested on the same texts).

Defined results: a null or empty text, and one whose bytes a tokenizer does not give back
(say one with U+2581, which B takes for a space), has no tokens: zeros and an empty digest.
Repeated rows count as often as they occur; null ids pass through; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tierflow.llm.shared import stored
from tierflow.llm.words import sliced

A_VOCABULARY = "byte_bpe_50k.json"
B_MODEL = "piece_bpe_32k.model"
#: Above this many characters `tokenizers` encodes the text instead of tiktoken.
LONG_TEXT = 200_000
#: Text bytes aligned together; a longer text comes alone.
CHUNK = 1 << 20
#: The broadcast pair table may take this many bytes by its bound.
MOST_PAIR_BYTES = 256 << 20
_PAIR_BYTES = 8 + 8 + 1


class _Encoder(NamedTuple):
    fast: tiktoken.Encoding
    json_path: str
    tokens: list[bytes]


@cache
def encoder_a(vocabulary: str = A_VOCABULARY) -> _Encoder:
    with open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _Encoder(fast, public_tokenizers.path(vocabulary), tokens)


@cache
def _slow_a(json_path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(json_path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def ids_a(text: str, vocabulary: str = A_VOCABULARY) -> np.ndarray:
    """A's ids of a space and the text; strings of special tokens are plain text."""
    own = encoder_a(vocabulary)
    if len(text) > LONG_TEXT:
        return np.array(_slow_a(own.json_path).encode(" " + text, add_special_tokens=False).ids, np.int64)
    return np.array(own.fast.encode_ordinary(" " + text), np.int64)


@cache
def encoder_b(model: str = B_MODEL) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    tokens = []
    for i in range(own.get_piece_size()):
        piece = own.id_to_piece(i)
        tokens.append(bytes([int(piece[3:-1], 16)]) if own.is_byte(i) else piece.replace("▁", " ").encode())
    return own, tokens


@cache
def _tables(vocabulary: str, model: str) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """Bytes and lengths of A's and B's tokens, and the digest's text of each id."""
    a, b = encoder_a(vocabulary).tokens, encoder_b(model)[1]
    # First A's ids inside and at the end of a group's first part, then B's of its second part.
    words = [f"{i}{sign}" for n, signs in ((len(a), ",|"), (len(b), ",;")) for sign in signs for i in range(n)]
    size = lambda tokens: np.array([len(t) for t in tokens], np.int64)
    return pa.array(a, pa.large_binary()), size(a), pa.array(b, pa.large_binary()), size(b), pa.array(words, pa.large_string())


def pair_bound(vocabulary: str = A_VOCABULARY, model: str = B_MODEL) -> int:
    """How many id pairs could ever be linked: one token's bytes end the other's."""
    a, b = encoder_a(vocabulary).tokens, encoder_b(model)[1]
    n_a, n_b = Counter(a), Counter(b)
    return sum(n_b[t[k:]] for t in a for k in range(len(t))) + sum(n_a[t[k:]] for t in b for k in range(1, len(t)))


def leaf_groups(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group in order, the number of A and of B tokens up to its end.

    ends_a and ends_b are the ascending byte ends of all tokens of texts that lie one after
    the other; text i has the tokens first_a[i] to first_a[i + 1], at least one.
    """
    a0, a1, b0, b1 = first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(a0):
        leaf = (a1 - a0 == 1) | (b1 - b0 == 1)
        done.append((a1[leaf], b1[leaf]))
        a0, a1, b0, b1 = a0[~leaf], a1[~leaf], b0[~leaf], b1[~leaf]
        middle = (a0 + a1 - 1) >> 1
        cut_a, cut_b, cutless = _nearest_cuts(ends_a, ends_b, a0, a1, b0, b1, middle)
        done.append((a1[cutless], b1[cutless]))
        some = ~cutless
        a0, a1, b0, b1, cut_a, cut_b = (x[some] for x in (a0, a1, b0, b1, cut_a, cut_b))
        a0, a1 = np.stack([a0, cut_a], 1).ravel(), np.stack([cut_a, a1], 1).ravel()
        b0, b1 = np.stack([b0, cut_b], 1).ravel(), np.stack([cut_b, b1], 1).ravel()
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group_a, group_b = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(group_a, kind="stable")
    return group_a[order], group_b[order]


def _nearest_cuts(ends_a, ends_b, a0, a1, b0, b1, middle) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each interval, the token counts up to an inner cut, and whether it has none.

    The cut is the first one from the middle upwards, else the last one below it.
    """
    cut_a, cut_b = np.zeros(len(a0), np.int64), np.zeros(len(a0), np.int64)
    lost = []
    at, i = np.arange(len(a0)), middle
    while len(at):
        x = ends_a[i]
        j = np.searchsorted(ends_b, x)
        y = ends_b[j]
        found = (x == y) & (i < a1[at] - 1)
        cut_a[at[found]], cut_b[at[found]] = i[found] + 1, j[found] + 1
        # The end of the interval is a cut itself, so every search upwards stops there.
        over = i >= a1[at] - 1
        lost.append(at[over])
        go = ~found & ~over
        at = at[go]
        i = np.searchsorted(ends_a, y[go])
    at = np.concatenate(lost) if lost else at
    j = np.searchsorted(ends_b, ends_a[middle[at]]) - 1
    while len(at):
        at, j = at[j >= b0[at]], j[j >= b0[at]]
        y = ends_b[j]
        i = np.searchsorted(ends_a, y, "right") - 1
        at, i, j, y = (v[i >= a0[at]] for v in (at, i, j, y))
        x = ends_a[i]
        found = x == y
        cut_a[at[found]], cut_b[at[found]] = i[found] + 1, j[found] + 1
        at, x = at[~found], x[~found]
        j = np.searchsorted(ends_b, x, "right") - 1
    return cut_a, cut_b, cut_a == 0


def _given_back(tokens: pa.Array, ids: list[np.ndarray], wanted: list[bytes]) -> list[bool]:
    """Of each text, whether its tokens' bytes are the wanted ones."""
    out = tokens.take(pa.array(np.concatenate(ids)))
    offsets = np.frombuffer(out.buffers()[1], np.int64)
    data = memoryview(out.buffers()[2])
    places = offsets[np.concatenate([[0], np.cumsum([len(x) for x in ids])])].tolist()
    return [bytes(data[a:b]) == w for a, b, w in zip(places, places[1:], wanted)]


class _Aligned(NamedTuple):
    """Tokens and groups of the texts that both tokenizers give back (`rows` says which)."""

    rows: np.ndarray
    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    first_group: np.ndarray


def _first(counts: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)


def align(texts: list[str | None], vocabulary: str = A_VOCABULARY, model: str = B_MODEL) -> _Aligned:
    bytes_a, size_a, bytes_b, size_b, _ = _tables(vocabulary, model)
    rows = [i for i, t in enumerate(texts) if t]
    a = [ids_a(texts[i], vocabulary) for i in rows]
    b = [np.array(x, np.int64) for x in encoder_b(model)[0].encode([texts[i] for i in rows], num_threads=1)] if rows else []
    if rows:
        wanted = [b" " + texts[i].encode() for i in rows]
        fine = [x and y for x, y in zip(_given_back(bytes_a, a, wanted), _given_back(bytes_b, b, wanted))]
        rows, a, b = ([x for x, ok in zip(v, fine) if ok] for v in (rows, a, b))
    first_a, first_b = _first([len(x) for x in a]), _first([len(x) for x in b])
    all_a, all_b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    group_a, group_b = leaf_groups(np.cumsum(size_a[all_a]), np.cumsum(size_b[all_b]), first_a, first_b)
    return _Aligned(np.array(rows, np.int64), all_a, all_b, first_a, first_b, group_a, group_b, np.searchsorted(group_a, first_a, "right"))


def _digests(x: _Aligned, vocabulary: str, model: str) -> list[str]:
    """Hex digests of `a1,a2|b1;a3|b2,b3`, written for all texts by one take of the ids' texts."""
    _, size_a, _, size_b, words = _tables(vocabulary, model)
    in_a, in_b = np.diff(x.group_a, prepend=0), np.diff(x.group_b, prepend=0)
    line = np.zeros(len(x.a) + len(x.b), np.int64)
    last_a, last_b = np.zeros(len(x.a), bool), np.zeros(len(x.b), bool)
    last_a[x.group_a - 1] = last_b[x.group_b - 1] = True
    line[np.arange(len(x.a)) + np.repeat(x.group_b - in_b, in_a)] = x.a + last_a * len(size_a)
    line[np.arange(len(x.b)) + np.repeat(x.group_a, in_b)] = 2 * len(size_a) + x.b + last_b * len(size_b)
    written = words.take(pa.array(line))
    offsets = np.frombuffer(written.buffers()[1], np.int64)
    places = offsets[x.first_a + x.first_b].tolist()
    data = memoryview(written.buffers()[2]) if len(line) else memoryview(b"")
    return [hashlib.sha256(data[i : j - 1]).hexdigest() for i, j in zip(places, places[1:])]


def _links(x: _Aligned, kinds_b: int, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of each text's different linked id pairs, how often each occurs, and where a text's begin."""
    n = np.diff(x.first_group)
    code = x.a[x.group_a - 1] * kinds_b + x.b[x.group_b - 1]
    both, times = np.unique(code + np.repeat(np.arange(len(n)), n) * pairs, return_counts=True)
    return both % pairs, times, np.searchsorted(both, np.arange(len(n) + 1) * pairs)


def _spread(rows: np.ndarray, values: Iterable, n: int, empty) -> list:
    out = [empty] * n
    for i, v in zip(rows.tolist(), values):
        out[i] = v
    return out


def _lists(rows: np.ndarray, first: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list for each of n rows; rows names those that have one, whose values lie one after the other."""
    counts = np.zeros(n, np.int64)
    counts[rows] = np.diff(first)
    return pa.ListArray.from_arrays(pa.array(_first(counts.tolist()), pa.int32()), pa.array(values, kind))


def _align_batches(vocabulary: str, model: str, with_groups: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, size_a, _, size_b, _ = _tables(vocabulary, model)
        for whole in batches:
            for part in sliced(whole, 1, CHUNK):
                n = part.num_rows
                x = align(part.column(1).to_pylist(), vocabulary, model)
                codes, times, first_code = _links(x, len(size_b), len(size_a) * len(size_b))
                long = lambda first: pa.array(_spread(x.rows, np.diff(first).tolist(), n, 0), pa.int64())
                # Each group holds one link: the tokens that end it on both sides.
                columns = [part.column(0), long(x.first_a), long(x.first_b), long(x.first_group), long(x.first_group), pa.array(_spread(x.rows, _digests(x, vocabulary, model), n, ""), pa.string())]
                columns += [_lists(x.rows, first_code, codes, n, pa.int64()), _lists(x.rows, first_code, times, n, pa.int64())]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                if with_groups:
                    own = [np.repeat(f[:-1], np.diff(x.first_group)) for f in (x.first_a, x.first_b)]
                    columns += [_lists(x.rows, x.first_a, x.a, n, pa.int32()), _lists(x.rows, x.first_b, x.b, n, pa.int32())]
                    columns += [_lists(x.rows, x.first_group, x.group_a - own[0], n, pa.int32()), _lists(x.rows, x.first_group, x.group_b - own[1], n, pa.int32())]
                    names += ["a_ids", "b_ids", "a_cuts", "b_cuts"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def aligned(docs: DataFrame, vocabulary: str = A_VOCABULARY, model: str = B_MODEL, with_groups: bool = True) -> DataFrame:
    """A row per document: counts, digest, its linked pairs (code a * kinds of b + b) and times.

    With groups also a_ids, b_ids, and a_cuts, b_cuts: how many tokens of each side lie
    before the end of each group.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    schema += ", a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>" * with_groups
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_align_batches(vocabulary, model, with_groups), schema)


def pair_counts(links: DataFrame, kinds_b: int) -> DataFrame:
    """pair, a_id, b_id, n (links that hold it) and best (n is the highest of its b_id)."""
    each = links.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    counts = counts.withColumns({"a_id": F.floor(F.col("pair") / kinds_b), "b_id": F.col("pair") % kinds_b})
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return counts.join(most, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def _weighed(table):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = table.value
        for b in batches:
            codes, times = (b.column(i).flatten().to_numpy() for i in (6, 7))
            first = _first(pa.compute.list_value_length(b.column(6)).to_numpy().tolist())
            at = np.searchsorted(pair, codes)
            run_up = lambda x: np.concatenate([[0], np.cumsum(x)])
            sums = [run_up(times * best[at]), run_up(times * count[at])] if len(codes) else [np.zeros(1, np.int64)] * 2
            columns = [pa.array(s[first[1:]] - s[first[:-1]], pa.int64()) for s in sums]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *columns], [*b.schema.names[:6], "n_best", "count_sum"])

    return run


def report(docs: DataFrame, vocabulary: str = A_VOCABULARY, model: str = B_MODEL) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of every row."""
    bound = pair_bound(vocabulary, model)
    if bound * _PAIR_BYTES > MOST_PAIR_BYTES:
        raise ValueError(f"these vocabularies allow {bound} pairs, too many to broadcast")
    links = stored(aligned(docs, vocabulary, model, with_groups=False), "align-links")
    rows = pair_counts(links, len(encoder_b(model)[1])).select("pair", "n", "best").toArrow().sort_by("pair")
    if rows.num_rows > bound:
        raise AssertionError("more pairs than the vocabularies allow")
    table = docs.sparkSession.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("pair", "n", "best")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return links.mapInArrow(_weighed(table), schema)


import pyarrow.compute  # noqa: E402,F401  pa.compute is loaded on import
