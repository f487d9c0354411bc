"""The classifier and the five stages of the pipeline beside plain versions of them."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tierflow.llm import hyperminhash, oracle, packing, weak_label

SF = "/root/testdata/sf0.001"


# A plain weak-label classifier: one text at a time, EM over texts, dense logistic regression


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def plain_measures(text):
    words, data = words_of(text), text.encode()
    n, nan = len(words), math.nan
    letters = len(re.findall("[A-Za-z]", text))
    chars = sum(b > 32 and b & 0xC0 != 0x80 for b in data)
    same = [False] + [a == b for a, b in zip(words, words[1:])]
    windows = list(zip(words, words[1:], words[2:]))
    stop = set(weak_label.STOP_WORDS)
    return {
        "symbols": sum(chr(b) in weak_label.SYMBOLS for b in data) / chars if chars else nan,
        "stop_words": sum(w in stop and not s for w, s in zip(words, same)) / n if n >= 10 else nan,
        "shouts": text.count("!") / n if n else nan,
        "new_windows": len(set(windows)) / max(1, n - 2) if n >= 20 else nan,
        "capitals": len(re.findall("[A-Z]", text)) / letters if letters > 20 else nan,
        "words": n,
        "word_length": chars / n if n else nan,
        "repeats": sum(same) / n if n >= 10 else nan,
    }


def plain_votes(text):
    m, votes = plain_measures(text), []
    for x in weak_label.LABELLERS:
        v = m[x.measure]
        votes.append(-1 if v < x.bad_low or v > x.bad_high else 1 if x.good_low <= v <= x.good_high else 0)
    return tuple(votes)


def plain_em(votes, rounds=200):
    """P(good) of every text, by EM over the texts themselves."""
    good = [0.5 + 0.4 * (1 if sum(v) + 0.5 > 0 else -1) for v in votes]
    for _ in range(rounds):
        share = (sum(good) + 1) / (len(good) + 2)
        accuracy = []
        for k in range(len(votes[0])):
            cast = [(v[k], g) for v, g in zip(votes, good) if v[k]]
            right = sum(g if v > 0 else 1 - g for v, g in cast)
            accuracy.append(min(max((right + 1.8) / (len(cast) + 2), weak_label.LEAST_ACCURACY), 0.99))
        new = []
        for v in votes:
            logit = math.log(share / (1 - share)) + sum(x * math.log(a / (1 - a)) for x, a in zip(v, accuracy))
            new.append(1 / (1 + math.exp(-logit)))
        done, good = max(abs(a - b) for a, b in zip(good, new)) < 1e-9, new
        if done:
            break
    return good, share, accuracy


def plain_shares(text):
    data = text.encode()
    grams = Counter(((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2**32) >> (32 - weak_label.BUCKET_BITS) for i in range(len(data) - 2))
    row = np.zeros(1 << weak_label.BUCKET_BITS, np.float32)
    for k, n in grams.items():
        row[k] = n / sum(grams.values())
    return row.astype(float)


def plain_classifier(texts):
    """Weak label and score of each text; fitted on each different text once."""
    different = sorted(set(texts))
    posterior, share, _ = plain_em([plain_votes(t) for t in different])
    label = dict(zip(different, posterior))
    x, target = np.array([plain_shares(t) for t in different]), np.array(posterior)
    x, target = x[x.sum(axis=1) > 0], target[x.sum(axis=1) > 0]
    mean = min(max(target.mean(), 1e-3), 1 - 1e-3)
    importance = target / (2 * mean) + (1 - target) / (2 * (1 - mean))
    weights, seen, seen_bias, bias = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-12), 1e-12, 0.0
    for _ in range(weak_label._EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -50, 50)))
        error = (p - target) * importance / len(x)
        gradient = error @ x + weak_label._DECAY * weights
        seen, seen_bias = seen + gradient**2, seen_bias + error.sum() ** 2
        weights = weights - weak_label._RATE * gradient / np.sqrt(seen)
        bias -= 0.1 * error.sum() / np.sqrt(seen_bias)
    score = {t: 1 / (1 + math.exp(-min(max(float(plain_shares(t) @ weights) + bias, -50), 50))) for t in different}
    return label, score


@pytest.fixture(scope="module")
def stages(spark):
    """Rows that go into each stage, and what the last returns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_em_over_patterns_equals_em_over_texts():
    rng = np.random.default_rng(5)
    texts = [tuple(rng.choice([-1, 0, 1], 8, p=[0.2, 0.4, 0.4]).tolist()) for _ in range(400)]
    code = lambda v: sum({0: 0, -1: 1, 1: 2}[x] * 3**i for i, x in enumerate(v))
    counts = Counter(map(code, texts))
    pattern = np.array(sorted(counts), np.int64)
    good, share, accuracy = weak_label.posteriors(pattern, np.array([counts[p] for p in pattern.tolist()], float))
    by_pattern = dict(zip(pattern.tolist(), good))
    want, want_share, want_accuracy = plain_em(texts)
    assert np.allclose([by_pattern[code(v)] for v in texts], want, atol=1e-6)
    assert math.isclose(share, want_share, abs_tol=1e-6) and np.allclose(accuracy, want_accuracy, atol=1e-6)


def test_classifier_query_beside_a_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    label, score = plain_classifier(list(texts.values()))
    for r in weak_label.scored(docs).collect():
        assert math.isclose(r.weak_label, label[texts[r.doc_id]], abs_tol=0.02)
        assert math.isclose(r.score, score[texts[r.doc_id]], abs_tol=0.05), r.doc_id
        if abs(score[texts[r.doc_id]] - weak_label.KEEP) > 0.05:
            assert r.kept == (score[texts[r.doc_id]] >= weak_label.KEEP)


def test_many_copies_of_a_text_leave_the_verdicts(spark):
    good = [f"the {a} of a {b} is in the {a} and it was for that {b} to see {a}{b} with" for a in ("river", "garden", "city", "market", "letter") for b in ("house", "winter", "story", "friend", "window", "morning")]
    bad = [f"!!! $$$ {a} ### {b} &&& !!! *** {a} <<< >>> {b}!!!" for a in ("win", "cash", "buy", "now", "free") for b in ("big", "deal", "hot", "top", "best", "click")]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    many = once.union(spark.range(20_000).select((F.col("id") + 1000).alias("doc_id"), F.lit(bad[0]).alias("text")))
    verdicts = lambda df, sample: {r.doc_id: r.kept for r in weak_label.scored(df, weak_label.fit(df, sample)).where("doc_id < 1000").collect()}
    for sample in (4000, 40):
        assert verdicts(once, sample) == verdicts(many, sample)
    assert verdicts(many, 4000) == {i: i < len(good) for i, _ in rows}


# The pipeline, stage by stage


def registered(df):
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    return con


def test_rules_stage(stages):
    rows = registered(stages[0]).execute(f"select doc_id from ({oracle.quality_rules()}) where kept").fetchall()
    assert Counter(r.doc_id for r in stages[1].collect()) == Counter(r[0] for r in rows)
    assert stages[1].columns == stages[0].columns


def test_classifier_stage(stages):
    texts = {r.doc_id: r.text or "" for r in stages[1].collect()}
    _, score = plain_classifier(list(texts.values()))
    kept = {r.doc_id for r in stages[2].collect()}
    sure = {i for i, t in texts.items() if abs(score[t] - weak_label.KEEP) > 0.05}
    assert kept & sure == {i for i in sure if score[texts[i]] >= weak_label.KEEP} and len(sure) > 0.9 * len(texts)


def test_near_dedup_stage(stages):
    def shingles(text):
        w = words_of(text or "")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {r.doc_id: shingles(r.text) for r in stages[2].collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in stages[3].collect()} == {i for i in sets if find(i) == i}


def test_mixing_stage(stages):
    sql = f"select doc_id, taken from ({oracle.systematic_mix()})"
    want = {i: n for i, n in registered(stages[3]).execute(sql).fetchall() if n}
    got = Counter()
    for r in stages[4].collect():
        got[r.doc_id] += len(words_of(r.text or ""))
    assert got == want and stages[4].columns == stages[0].columns


def test_packing_stage(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in stages[4].collect():
        want[r.doc_id, (*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID)] += 1
    by_doc, buckets = {}, {}
    for r in stages[5].collect():
        assert len(r.ids) == r.length and r.length & (r.length - 1) == 0 and r.length <= packing.LONGEST and r.offset == 0
        by_doc.setdefault(r.doc_id, []).append((r.start, tuple(r.ids), r.doc_tokens))
        buckets.setdefault(r.bucket, []).append((r.length, r.place))
    for doc_id, pieces in by_doc.items():
        copies = [ids for (d, ids), n in want.items() if d == doc_id for _ in range(n)]
        parts = Counter((start, ids) for start, ids, _ in pieces)
        for ids in copies:
            assert all(total == len(ids) for _, _, total in pieces)
            at = 0
            for n in packing.lengths(len(ids)):
                parts[at, ids[at : at + n]] -= 1
                at += n
        assert not +parts and not -parts
    assert set(by_doc) == {d for d, _ in want}
    for rows in buckets.values():
        assert len({n for n, _ in rows}) == 1 and sorted(p for _, p in rows) == list(range(len(rows)))
        assert sum(n for n, _ in rows) <= packing.BUCKET_TOKENS


def test_pipeline_of_odd_and_no_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).union(docs.limit(3)).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))
    for name, df in (("odd", odd.withColumn("shard", F.lit(1))), ("none", docs.where("doc_id < 0"))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert {"doc_id", "ids", "bucket", "place"} <= set(out.columns)
        assert out.count() == 0 if name == "none" else out.count() >= 0


@pytest.mark.parametrize("n", [6, 40, 64, 150])
def test_recall_at_the_threshold(spark, n):
    """Pairs of n shingles each, just at or above a similarity of 0.75."""
    common = math.ceil(3 * n * 2 / 7)
    rows, links = [], 0
    for k in range(40):
        words = [f"p{k}w{i}" for i in range(n + 4)]
        other = words[: common + 4] + [f"q{k}w{i}" for i in range(n - common)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        links += 100 * common >= 75 * (2 * n - common)
    got = hyperminhash.report(spark.createDataFrame(rows, "doc_id long, text string")).where("not kept").count()
    assert links == 40 and got >= 0.9 * links


# Archives and vectors as they come


def test_torn_padded_and_foreign_archives(spark, tmp_path):
    import base64
    import gzip

    from tierflow.llm import warc

    def member(i, payload, label):
        http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: {label}\r\nContent-Length: {len(http)}\r\n\r\n"
        return gzip.compress(head.encode() + http + b"\r\n\r\n")

    body = b"<html>some page</html>"
    sha1 = hashlib.sha1(body)
    labels = [
        "sha1:" + base64.b32encode(sha1.digest()).decode().lower(), "sha1:" + sha1.hexdigest(), "sha256:" + hashlib.sha256(body).hexdigest(),
        "blake3:abc", "sha1:AAAA",
    ]
    members = [member(i, body, x) for i, x in enumerate(labels)]
    torn = members[0][: len(members[0]) // 2]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members) + b"\0" * 700)
    (tmp_path / "b.warc.gz").write_bytes(members[0] + torn + members[1] + members[2] + torn)
    for split in (64, 1 << 20):
        files = [(f"file://{tmp_path}/{n}.warc.gz", (tmp_path / f"{n}.warc.gz").stat().st_size) for n in "ab"]
        rows = warc.read(spark, files, split=split).collect()
        at = lambda n: sorted((r for r in rows if r.path.endswith(f"{n}.warc.gz")), key=lambda r: r.offset)
        assert [r.headers.get("WARC-Record-ID") for r in at("a")] == [f"<urn:page:{i}>" for i in range(5)]
        assert [r.digest_agrees for r in at("a")] == [True, True, True, None, False]
        whole = [r for r in at("b") if r.headers]
        assert [r.headers["WARC-Record-ID"] for r in whole] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:2>"]
        assert all(bytes(r.payload) == body for r in whole)
        assert split == 64 or len(at("b")) > len(whole)


def test_scores_beyond_64_bits_are_an_error(spark):
    from tierflow.llm import topk

    vectors = spark.createDataFrame([(0, [1e10, 1e10]), (1, [1e10, -1e10])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64-bit"):
        topk.report(vectors)
