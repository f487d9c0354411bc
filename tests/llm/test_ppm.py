"""PPM scoring beside a plain trie that codes byte after byte."""

import math
import re
from collections import Counter, defaultdict

import pytest

from tierflow.llm import ppm

ORDER, END = ppm.ORDER, ppm.END


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall("[^\x20\x09-\x0d]+", lower)


def line(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [END] * ORDER + list(lower.encode()) + [END]


def brute(rows):
    """doc rows -> results by a trie of dicts and a walk down the contexts."""
    rows = [(d, t or "") for d, t in rows]
    train = [t for d, t in rows if not ppm.is_held_out(d)]
    trie = defaultdict(Counter)
    for t in train:
        s = line(t)
        for i in range(ORDER, len(s)):
            for k in range(ORDER + 1):
                trie[tuple(s[i - k : i])][s[i]] += 1
    words = Counter(w for t in train for w in tokens(t))
    ends = len(train)
    n, v = sum(words.values()) + ends, len(words) + (ends > 0)
    out = []
    for d, t in rows:
        s, score = line(t), 0.0
        for i in range(ORDER, len(s)):
            excluded = set()
            for k in range(ORDER, -1, -1):
                node = trie.get(tuple(s[i - k : i]))
                if not node:
                    continue
                open_ = {b: c for b, c in node.items() if b not in excluded}
                total = sum(open_.values()) + len(open_)
                if not total:
                    continue
                if s[i] in open_:
                    score += math.log10(open_[s[i]] / total)
                    break
                score += math.log10(len(open_) / total)
                excluded |= set(node)
            else:
                score -= math.log10(256 - len(excluded))
        found = tokens(t)
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in found) + math.log10((ends + 1) / (n + v + 1))
        out.append((d, ppm.is_held_out(d), len(found) + 1, sum(words[w] > 0 for w in found) + (ends > 0), n, base, score))
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted(map(tuple, ppm.scored(df).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[6])), sorted(want, key=lambda r: (str(r[0]), r[6]))):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_matches_a_plain_trie(spark):
    texts = ["The cat sat on the mat.", "the CAT ran", "", None, "xyz xyz xyz", "Ünïcödé, the cat\n\tsat", "a", "the mat the mat " * 20]
    check(spark, [(i, f"{texts[i % len(texts)]}" if texts[i % len(texts)] is not None else None) for i in range(40)] + [(40, "zebra quartz \x00 %%"), (2, "repeated id"), (None, "no id"), (None, None)])


def test_blocks_smaller_than_the_table(spark, monkeypatch):
    check(spark, [(i, "alpha beta gamma delta " * (i % 7) + str(i)) for i in range(60)], parts=7)


def test_without_training_rows_and_empty(spark):
    held = [i for i in range(200) if ppm.is_held_out(i)][:3]
    check(spark, [(i, "abc abc") for i in held], parts=1)
    assert ppm.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_probabilities_of_a_context_sum_to_one(spark):
    rows = [(i, "abra cadabra") for i in range(5)]
    codes = [(int.from_bytes(bytes([*b"abra", b]), "big"), 0) for b in range(256)]
    data = [ppm.END] * ppm.ORDER + list(b"abra cadabra") + [ppm.END]
    counts = Counter(int.from_bytes(bytes(data[i - 4 : i + 1]), "big") for i in range(4, len(data)))
    grams = spark.createDataFrame([(c, 5 * counts.pop(c, 0)) for c, _ in codes] + [(c, 5 * n) for c, n in counts.items()], "code long, n long")
    values = {r.code: r.value for r in ppm.gram_values(grams).collect()}
    assert len(rows) == 5 and sum(10 ** values[c] for c, _ in codes) == pytest.approx(1.0)


def test_query_reads_everything(spark):
    from tierflow.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in QUERIES["op10_ppm"](spark, sf).collect()}
    for w in brute(rows):
        assert tuple(got[w[0]])[:5] == w[:5]
        assert tuple(got[w[0]])[5:] == pytest.approx(w[5:], rel=1e-9)
    # On held-out texts contexts help: shorter than the bytes' own frequencies would allow.
    train = Counter(b for d, t in rows if not ppm.is_held_out(d) for b in line(t)[ORDER:])
    held = [(d, t) for d, t in rows if ppm.is_held_out(d)]
    plain = sum(math.log10((train[b] + 1) / (sum(train.values()) + 256)) for d, t in held for b in line(t)[ORDER:])
    assert sum(got[d].score for d, _ in held) > 0.75 * plain
