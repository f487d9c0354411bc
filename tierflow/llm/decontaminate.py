"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and texts are normalised to words (A-Z lowered; a word is a run of ASCII letters,
digits and characters beyond ASCII). The automaton holds every run of words of every item;
each state knows which items hold the window that ends there. Texts stream through it: a
state and the length of the longest match are carried from word to word. Where that length
reaches the window, the match is a run of windows, and its words are hit. An item shorter
than the window is a window as a whole; a state knows the nearest such item that ends its
match.

Only stretches whose neighbouring words all follow each other in some item are streamed, as
no match leaves them; all stretches of a batch go on in step, by numpy. The automaton is
built in tasks, in blocks of BLOCK_WORDS item words, and kept in the shared folder; a task
holds one block at a time, so the size of the benchmark is not limited by memory. An item
longer than PART_WORDS is cut into parts that overlap by a window less one word, which
keeps every window. Words are known by 64-bit hashes (10^6 item words meet 10^13 words of
text with a chance of a few percent of one false word, which hits only inside a window
otherwise equal).

Defined results: a null text has no words and is clean; a null item text has none and never
occurs; a null item_id reads as the empty text; rows that repeat an item_id are one item with
the windows of all; repeated documents are rows of their own; extra columns are ignored by
`report` and kept by `cleaned`, whatever their names; without documents the result is empty, without items all
is clean.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.shared import new_folder, stored
from tierflow.llm.words import sliced, spans, text_bytes, word_hashes

WINDOW = 10
#: Item words of one automaton, and of one part of an item.
BLOCK_WORDS, PART_WORDS = 1 << 18, 1 << 12
#: Words of a text that one lane streams; lanes of a stretch overlap by a window less one word.
LANE_WORDS = 512
#: A text with a larger share of hit words is removed as a whole.
MOST_COVERED = 0.5

_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[48:58], _NORMAL[97:123], _NORMAL[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_NORMAL[65:91] = np.arange(97, 123)


def normalised(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lowered and a space for each byte that is no part of a word."""
    return _NORMAL[data]


class Automaton:
    """The suffix automaton of some word sequences, frozen into arrays.

    State 0 is the start. Transitions are sorted codes state * words + word. `window_state`
    is the state of a match's last `window` words, `short_state` the nearest state on the
    chain of suffixes that is a whole short item; 0 stands for none.
    """

    FIELDS = ("vocabulary", "bigrams", "codes", "to", "link", "length", "window_state", "short_state", "holders", "holder_first", "names", "window", "least")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        self.item_names: list[str] = json.loads(self.names.tobytes())

    @classmethod
    def build(cls, items: list[tuple[str, np.ndarray]], window: int) -> Automaton:
        """Of named sequences of word hashes; names may repeat."""
        items = [(name, words) for name, words in items if len(words)]
        vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        lines = [(name, np.searchsorted(vocabulary, w).tolist()) for name, w in items]
        following: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        ends = [cls._add(following, link, length, line) for _, line in lines]
        order = np.argsort(length, kind="stable").tolist()
        window_state, short_state = [0] * len(link), [0] * len(link)
        for (_, line), end in zip(lines, ends):
            if len(line) < window:
                short_state[end] = end
        for v in order[1:]:
            up = link[v]
            window_state[v] = v if length[up] < window <= length[v] else window_state[up]
            short_state[v] = short_state[v] or short_state[up]
        holders = set()
        names = sorted({name for name, _ in lines})
        number = {name: i for i, name in enumerate(names)}
        for (name, line), end in zip(lines, ends):
            if len(line) < window:
                holders.add((end, number[name]))
            v = 0
            for k, word in enumerate(line):
                v = following[v][word]
                if k + 1 >= window:
                    holders.add((window_state[v], number[name]))
        held = np.array(sorted(holders), np.int64).reshape(-1, 2)
        steps = sorted((v * len(vocabulary) + w, to) for v, out in enumerate(following) for w, to in out.items())
        codes = np.array(steps, np.int64).reshape(-1, 2)
        pairs = [a * len(vocabulary) + b for _, line in lines for a, b in zip(line, line[1:])]
        return cls(
            vocabulary=vocabulary,
            bigrams=np.unique(np.array(pairs, np.int64)),
            codes=codes[:, 0].copy(),
            to=codes[:, 1].copy(),
            link=np.maximum(np.array(link, np.int64), 0),
            length=np.array(length, np.int64),
            window_state=np.array(window_state, np.int64),
            short_state=np.array(short_state, np.int64),
            holders=held[:, 1].copy(),
            holder_first=np.searchsorted(held[:, 0], np.arange(len(link) + 1)),
            names=np.frombuffer(json.dumps(names).encode(), np.uint8),
            window=np.array(window),
            least=np.array(min([window, *(len(line) for _, line in lines)])),
        )

    @staticmethod
    def _add(following: list[dict[int, int]], link: list[int], length: list[int], line: list[int]) -> int:
        """Put one sequence in, from the start state on; the state of the whole sequence."""

        def split(p: int, word: int, q: int) -> int:
            # A state of its own for the matches of q that go through p.
            clone = len(link)
            following.append(dict(following[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = clone
            while p != -1 and following[p].get(word) == q:
                following[p][word] = clone
                p = link[p]
            return clone

        last = 0
        for word in line:
            q = following[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else split(last, word, q)
                continue
            new = len(link)
            following.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and word not in following[p]:
                following[p][word] = new
                p = link[p]
            if p != -1:
                q = following[p][word]
                link[new] = q if length[q] == length[p] + 1 else split(p, word, q)
            last = new
        return last

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Automaton:
        with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
            return cls(**arrays)

    def _lookup(self, sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The place of each code, -1 where it is not there."""
        if not len(sorted_codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
        return np.where(sorted_codes[at] == codes, at, -1)

    def _lanes(self, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the lanes that can hold a match of the least length."""
        joined = np.zeros(len(ids) + 1, bool)  # whether a word goes on from the one before it
        both = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0)) + 1
        joined[both] = self._lookup(self.bigrams, ids[both - 1] * len(self.vocabulary) + ids[both]) >= 0
        joined[places] = False
        first = np.flatnonzero((ids >= 0) & ~joined[:-1])
        breaks = np.flatnonzero(~joined)
        size = breaks[np.searchsorted(breaks, first, "right")] - first
        first, size = first[size >= self.least], size[size >= self.least]
        step = LANE_WORDS - int(self.window) + 1
        n = 1 + np.maximum(0, -(-(size - LANE_WORDS) // step))
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(first, n) + k * step, np.minimum(LANE_WORDS, np.repeat(size, n) - k * step)

    def matches(self, words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ends and lengths of hit stretches; places and numbers of the items found there.

        words are the hashes of all words of some texts, places where each text begins (and
        the end of the last).
        """
        ids = self._lookup(self.vocabulary, words)
        first, size = self._lanes(ids, places)
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        state, match = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        ends, lengths, seen_at, seen = [], [], [], []
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, "left"))  # lanes longer than t
            at, v, m = first[:n] + t, state[:n], match[:n]
            word = ids[at]
            step = self._lookup(self.codes, v * len(self.vocabulary) + word)
            stuck = np.flatnonzero((step < 0) & (v > 0))
            while len(stuck):
                v[stuck] = self.link[v[stuck]]
                m[stuck] = self.length[v[stuck]]
                step[stuck] = self._lookup(self.codes, v[stuck] * len(self.vocabulary) + word[stuck])
                stuck = stuck[(step[stuck] < 0) & (v[stuck] > 0)]
            v[:], m[:] = np.where(step >= 0, self.to[step], 0), np.where(step >= 0, m + 1, 0)
            full = m >= self.window
            covered = np.where(full, m, 0)
            seen_at.append(at[full])
            seen.append(self.window_state[v[full]])
            # Short items that end here: the nearest one, then those that end it in turn.
            short = self.short_state[v]
            short = np.where(self.length[short] <= m, short, self.short_state[self.link[v]])
            covered = np.maximum(covered, self.length[short])
            on = np.flatnonzero(short)
            while len(on):
                seen_at.append(at[on])
                seen.append(short[on])
                short[on] = self.short_state[self.link[short[on]]]
                on = on[short[on] > 0]
            hit = covered > 0
            ends.append(at[hit])
            lengths.append(covered[hit])
        if not ends:
            return (np.zeros(0, np.int64),) * 4
        seen_at, seen = np.concatenate(seen_at), np.concatenate(seen)
        count = self.holder_first[seen + 1] - self.holder_first[seen]
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.concatenate(ends), np.concatenate(lengths), np.repeat(seen_at, count), self.holders[np.repeat(self.holder_first[seen], count) + k]


def _item_parts(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, 1):
                data, borders = text_bytes(b.column(1))
                words, places = word_hashes(normalised(data), borders)
                names, parts = [], []
                for name, i, j in zip(b.column(0).to_pylist(), places[:-1].tolist(), places[1:].tolist()):
                    starts = range(i, j - window + 1, PART_WORDS - window + 1) if j - i >= window else [i] * (j > i)
                    for s in starts:
                        names.append(name)
                        parts.append(words[s : min(j, s + PART_WORDS)].astype("<u8").tobytes())
                n = [len(p) // 8 for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary()), pa.array(n, pa.int64())], ["name", "words", "n"])

    return run


def _built(window: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["name", "words"])
        items = [(name, np.frombuffer(w, "<u8")) for name, w in zip(part["name"], part["words"])]
        return pd.DataFrame({"block": part["block"].iloc[:1].to_numpy(), "automaton": [Automaton.build(items, window).dumped()]})

    return run


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[str, int]:
    """Write the items' automata, each holding about block_words words; their folder and number."""
    if not 1 <= window <= LANE_WORDS // 2:
        raise ValueError(f"a window has 1 to {LANE_WORDS // 2} words")
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string").alias("text"))
    parts = stored(named.mapInArrow(_item_parts(window), "name string, words binary, n long").distinct(), "benchmark-parts")
    blocks = max(1, -(-(parts.agg(F.sum("n")).first()[0] or 0) // block_words))
    folder = new_folder(items.sparkSession, "benchmark-automata")
    blocked = parts.select(F.pmod(F.xxhash64("name", "words"), F.lit(blocks)).alias("block"), "name", "words")
    blocked.groupBy("block").applyInPandas(_built(window), "block long, automaton binary").write.partitionBy("block").parquet(folder)
    return folder, blocks


@lru_cache(maxsize=2)
def _block(folder: str, block: int) -> Automaton | None:
    """One automaton; None where no part fell into the block."""
    store, top = fs.FileSystem.from_uri(folder)
    path = f"{top}/block={block}"
    if store.get_file_info(path).type != fs.FileType.Directory:
        return None
    return Automaton.loaded(ds.dataset(path, filesystem=store, format="parquet").to_table(columns=["automaton"])["automaton"][0].as_py())


def _hit_words(n: int, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n words lie in a stretch."""
    change = np.bincount(ends - lengths + 1, minlength=n + 1) - np.bincount(ends + 1, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _spans(text: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code points from the first to the last word of each run of hit words of a text's bytes."""
    starts, ends = spans(normalised(text), np.array([0, len(text)]))
    first = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
    last = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]]))
    points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    return list(zip(points[starts[first]].tolist(), points[ends[last]].tolist()))


def _scan(folder: str, blocks: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            text_at = whole.num_columns - 1
            for b in sliced(whole, text_at):
                data, borders = text_bytes(b.column(text_at))
                words, places = word_hashes(normalised(data), borders)
                ends, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                found: list[set[str]] = [set() for _ in range(b.num_rows)]
                for block in range(blocks):
                    automaton = _block(folder, block)
                    if automaton is None:
                        continue
                    e, m, seen_at, seen = automaton.matches(words, places)
                    ends.append(e)
                    lengths.append(m)
                    rows = np.searchsorted(places, seen_at, "right") - 1
                    for code in np.unique(rows * len(automaton.item_names) + seen).tolist():
                        row, item = divmod(code, len(automaton.item_names))
                        found[row].add(automaton.item_names[item])
                hit = _hit_words(len(words), np.concatenate(ends), np.concatenate(lengths))
                run_up = np.concatenate([[0], np.cumsum(hit)])
                n_hit = run_up[places[1:]] - run_up[places[:-1]]
                cut = [_spans(data[borders[i] : borders[i + 1]], hit[places[i] : places[i + 1]]) if n_hit[i] else [] for i in range(b.num_rows)]
                columns = [pa.array(np.diff(places), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                columns.append(pa.array([[{"start": i, "end": j} for i, j in x] for x in cut], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*whole.schema.names, "n_words", "n_hit", "items", "spans"])

    return run


def _scanned(columns: DataFrame, folder: str, blocks: int) -> DataFrame:
    """columns (the last is the text) with n_words, n_hit, items and spans beside them."""
    schema = ", ".join(f"`{c}` {kind}" for c, kind in columns.dtypes)
    return columns.mapInArrow(_scan(folder, blocks), f"{schema}, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>")


def scanned(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids that occur) and spans (code points) of every row."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return _scanned(rows, *automata(items, window)).drop("text")


def cleaned(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_covered: float = MOST_COVERED) -> DataFrame:
    """The rows of docs without the hit spans of their texts.

    A row of whose words a larger share than most_covered is hit goes as a whole. Columns
    of any name pass through.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    rows = _scanned(docs.toDF(*names).withColumn("scanned", F.col(text).cast("string")), *automata(items, window))
    # What stays lies between the end of one span and the start of the next.
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length("scanned").cast("long")))
    rest = F.zip_with(starts, ends, lambda i, j: F.substring(F.col("scanned"), i.cast("int") + 1, (j - i).cast("int")))
    stays = F.col("n_hit") <= most_covered * F.col("n_words")
    out = rows.where(stays).withColumn(text, F.when(F.col("n_hit") > 0, F.array_join(rest, "")).otherwise(F.col(text)))
    return out.select(*names).toDF(*docs.columns)


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    rows = scanned(docs, items, window)
    digest = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

