"""Small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tierflow.llm import chat, extendible, hyperminhash, packing, quality_rules, systematic_mix, topk, warc, weak_label, words

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, source=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", source(k) if source else "a", None) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(i, n=60):
    return " ".join(f"w{(i * 7919 + k * 104729) % 9973}" for k in range(n))


# words


def test_words_and_hashes():
    texts = ["Ab  cd", None, "", " x", "y ", "ab cd", "É é\x0bz", "longword" * 50]
    data, borders = words.text_bytes(pa.array(texts))
    hashes, places = words.word_hashes(data, borders)
    counts = np.diff(places).tolist()
    assert counts == [len(WORD.findall(t or "")) for t in texts]
    assert hashes[places[0] : places[1]].tolist() == hashes[places[5] : places[6]].tolist()


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"word{i}" for i in range(2000)) + " " + "x" * 3000 + " end"
    whole = words.word_hashes(*words.text_bytes(pa.array([text, "tail"])))
    monkeypatch.setattr(words, "CHUNK", 256)
    cut = words.word_hashes(*words.text_bytes(pa.array([text, "tail"])))
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


# 1 chat


def test_chat_reads_back_and_validates(spark):
    nasty = "a\\<|im_end|>\n<|im_start|>assistant \\n \\\\<|"
    rows = [(1, 0, "user", nasty, 1), (1, 1, "assistant", nasty, 1), (2, 1, "user", None, 1), (2, 0, None, "x", 1), (3, 0, "user", "q", 1), (3, 0, "assistant", "b", 1), (3, None, "us\ner", "c", 1), (None, 0, "assistant", "é", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    got = {r.conv_id: r for r in chat.conversations(df).collect()}
    sha = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == sha(("user", nasty), ("assistant", nasty)) and got[1].valid
    assert got[1].loss_chars == len(nasty) and got[1].loss_sha256 == hashlib.sha256(nasty.encode()).hexdigest()
    assert got[2].turns_sha256 == sha(("", "x"), ("user", "")) and not got[2].valid and got[2].first_error == 0
    assert got[3].turns_sha256 == sha(("assistant", "b"), ("user", "q"), ("us\ner", "c")) and got[3].n_turns == 3
    assert got[None].loss_chars == 1 and len(got) == 4
    assert chat.conversations(df.limit(0)).count() == 0


# 2 near-dedup


def brute_components(texts):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_near_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", " \n", "one", "ONE", "a b c d", "a b c d e", "A b c d  e"]
    for g in range(25):
        base = prose(g, int(rng.integers(8, 150))).split()
        for _ in range(int(rng.integers(1, 7))):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 5))):
                copy[at] = f"edit{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    # Many documents that share half of their text: candidates, but no links.
    texts += [prose(500, 40) + " " + prose(600 + i, 25) for i in range(40)]
    n, component = brute_components(texts)
    got = sorted(map(tuple, hyperminhash.report(docs(spark, texts)).collect()))
    assert got == [(i, n[i], component[i], component[i] == i) for i in range(len(texts))]


def test_slot_bound_and_estimate_keep_pairs_at_the_threshold(spark):
    """Neither check drops a pair of similarity 0.75 or more; the slots drop most unlike pairs of small sets."""
    rng = np.random.default_rng(8)
    rows, like = [], {}
    for i in range(400):
        size = int(rng.integers(4, 40)) * 4 if i % 4 else int(rng.integers(500, 2000)) * 4
        both = 6 * size // 7 if i % 2 else size // 2
        a = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        b = np.concatenate([a[: both + (i % 2)], rng.integers(0, 1 << 64, size - both - (i % 2), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        cut = len(np.intersect1d(a, b))
        like[i] = (100 * cut >= 75 * (len(a) + len(b) - cut), size)
        sides = [(len(x), int(np.bitwise_count(hyperminhash.slots(x).view(np.uint64)).sum()), hyperminhash.slots(x).tolist(), hyperminhash.registers(x).tobytes()) for x in (a, b)]
        rows.append((i, i, *sides[0], *sides[1]))
    side = "n long, filled int, slots array<long>, sketch binary"
    other = "pivot_n long, pivot_filled int, pivot_slots array<long>, other binary"
    df = spark.createDataFrame(rows, f"key long, pivot long, {side}, {other}")
    near = df.where(hyperminhash._may_link("", "pivot_", 0.75))
    bound = {r.key for r in near.select("key").collect()}
    near = near.select("key", "pivot", "n", "pivot_n", "sketch", "other").mapInArrow(hyperminhash._estimates(0.75), "key long, pivot long")
    kept = {r.key for r in near.collect()}
    assert sum(x for x, _ in like.values()) > 150
    assert {i for i, (x, _) in like.items() if x} <= kept <= bound
    assert not bound & {i for i, (x, size) in like.items() if not x and size < 160 and i % 2 == 0 and size >= 40}
    assert all(i not in kept for i, (x, size) in like.items() if not x and size >= 2000 and i % 2 == 0)


def test_dedup_keeps_one_of_each_group(spark):
    same = prose(1)
    df = docs(spark, [same, same, same + " more", prose(2), "", None, prose(3), prose(3)], ids=[4, 4, 3, 9, 5, None, None, None])
    kept = hyperminhash.deduplicated(df.withColumn("key", F.lit(1)))
    assert kept.columns == [*df.columns, "key"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, same + " more"), (9, prose(2)), (5, ""), (None, None), (None, prose(3))], key=str)
    assert hyperminhash.deduplicated(df.limit(0)).count() == 0 and hyperminhash.report(df.limit(0)).count() == 0


def test_near_dedup_parts_unlike_sets_of_one_key(spark):
    rows = [(0, 7, 1), (1, 7, 1), (2, 7, 2), (3, 8, 1), (4, None, None), (5, None, None)]
    got = {r["row"]: r["key"] for r in hyperminhash.parted(spark.createDataFrame(rows, "row long, key long, check long")).collect()}
    assert got[0] == got[1] != got[2] and got[3] == 8 and got[4] is None and got[5] is None and len(set(got.values())) == 4


def test_near_dedup_key_and_check_follow_the_set(spark):
    table = hyperminhash.sketches(hyperminhash.numbered(docs(spark, [prose(1), prose(1).upper(), prose(2), "", None]))).select("doc_id", "key", "check").collect()
    names = {r["doc_id"]: (r["key"], r["check"]) for r in table}
    assert names[0] == names[1] != names[2] and names[0][0] != names[0][1]
    assert names[3] == names[4] == (None, None)


# 3 packing


def test_packing_round_trip(spark):
    texts = [None, "", "hello world", "<|endoftext|> x", "word " * 9000, "é" * 3000, "a" * 250_000]
    df = docs(spark, [*texts, "hello world"], ids=[None, 1, 2, 3, 4, 5, 6, 2]).withColumn("ids", F.lit(0))
    rows = packing.packed(df).collect()
    slow = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, text in zip([None, 1, 2, 3, 4, 5, 6], texts):
        want = [*slow.encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        if i == 2:
            assert len(mine) % 2 == 0
            mine = mine[::2]
        assert [x for r in mine for x in r.ids] == want
        for r in mine:
            assert r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    batch = packing.batches(packing.packed(df), 4096).groupBy("batch_id").agg(F.countDistinct("length").alias("k"), F.sum("length").alias("t"))
    assert batch.where("k > 1 or t > 4096").count() == 0
    assert packing.packed(df.limit(0)).count() == 0


# 4 mixing


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(1)
    names = ["b", "a", None, "é", "Z", "tiny"]
    texts = [" ".join(["x"] * int(rng.lognormal(3, 1))) for _ in range(1500)]
    df = docs(spark, [*texts, None, ""], source=lambda k: names[5] if k % 300 == 7 else names[k % 5]).withColumn("size", F.lit("clash"))
    got = systematic_mix.report(df).collect()
    again = systematic_mix.report(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == 1502
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by, largest = {}, {}
    source = {r.doc_id: r.source for r in df.select("doc_id", "source").collect()}
    for r in got:
        largest[source[r.doc_id]] = max(r.size, largest.get(source[r.doc_id], 0))
        s = by.setdefault(source[r.doc_id], [0, 0, r.target, r.source_size])
        s[0], s[1] = s[0] + r.size, s[1] + r.taken
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight, free, target, left = {s: i % 3 + 1 for i, s in enumerate(order)}, set(order), {}, sum(v[0] for v in by.values())
    while True:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * by[s][0]}
        if not over:
            break
        for s in over:
            target[s] = 3 * by[s][0]
            left -= target[s]
        free -= over
    target |= {s: share * weight[s] for s in free}
    for s, (size, taken, t, whole) in by.items():
        assert size == whole and t == pytest.approx(target[s]) and abs(taken - t) <= largest[s]
    out = systematic_mix.mixed(df)
    assert out.columns == df.columns and Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.taken // r.size for r in got if r.taken}) + Counter(r.doc_id for r in out.where("coalesce(text, '') = ''").collect())


def test_mix_of_little(spark):
    assert systematic_mix.report(docs(spark, ["", None])).select("target", "taken").distinct().collect()[0] == (0.0, 0)
    one = systematic_mix.report(docs(spark, ["a b", "a b", "c"], ids=[1, 1, None])).collect()
    assert sum(r.taken for r in one) == 5 and systematic_mix.report(docs(spark, [])).count() == 0


# 5 top-k


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 16]) for i in range(300)]
    vectors += [(i, vectors[0][1]) for i in range(300, 400)]
    odd = [(500, None), (520, [float("nan")] * 8), (540, [1.0, None]), (560, []), (580, [1.0, 2.0]), (None, vectors[20][1]), (20, vectors[20][1])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").repartition(4).withColumn("rank", F.lit(0))
    got = {}
    for r in topk.report(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    m = [(i, np.floor(np.array(v) * 64).astype(int)) for i, v in [*vectors, odd[5], odd[6]]]
    for q, v in m:
        if q is None or q % 20:
            continue
        best = sorted((-int(v @ w), c is None, c or 0, c) for c, w in m if c != q)[:20]
        assert sorted(got[q]) == [(k + 1, b[3], -b[0]) for k, b in enumerate(best)]
    assert 580 not in got and topk.report(df.limit(0)).count() == 0
    few = topk.top_k(df.where("vec_id < 5"), df.where("vec_id = 0"), k=20)
    assert few.count() == 4


def test_top_k_of_large_numbers(spark):
    rows = [(i, [float(i) * 1e5, -3e5]) for i in range(50)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>"), k=3)
    assert [r.vec_id for r in got.where("query_id = 1").orderBy("rank").collect()] == [49, 48, 47]


# 6 WARC


@pytest.mark.parametrize("split", [1000, 70_000, 1 << 23])
def test_warc_round_trip(spark, split):
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(map(chr, rng.integers(1, 0x500, n)))
    pages = [(i, f"http://x/é {i}\r\n", noise(int(rng.integers(0, 3000)))) for i in range(60)] + [(100, None, "same"), (101, "u", "same"), (102, "u", "same"), (103, "u", None), (104, "u", ""), (None, "u", "same"), (None, "u", "lone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).withColumn("sha", F.lit(1))
    files = warc.write(df, file_bytes=40_000)
    rows = warc.read(spark, files, split).collect()
    assert len(rows) == len(pages) and len({(r.path, r.offset) for r in rows}) == len(pages)
    kinds = {r.headers["WARC-Record-ID"]: r for r in rows}
    for i, _, html in pages[:60]:
        r = kinds[f"<urn:page:{i}>"]
        assert bytes(r.payload).decode() == html and r.payload_digest == warc.digest(html.encode())
    assert [kinds[f"<urn:page:{i}>"].headers["WARC-Type"] for i in (100, 101, 102, 103, 104)] == ["revisit", "revisit", "response", "revisit", "response"]
    assert kinds["<urn:page:100>"].headers["WARC-Refers-To"] == "<urn:page:102>" and kinds["<urn:page:100>"].payload_bytes == 4


def test_warc_members_that_hold_the_magic():
    inner = b"".join(warc.record(i, "u", b"\x1f\x8b\x08" * 50 + bytes([i]), None) for i in range(20))
    for window in (64, 5000):
        seen = []
        for start in range(0, len(inner), window):
            class Handle:
                at = 0

                def seek(self, n):
                    self.at = n

                def read(self, n):
                    self.at += n
                    return inner[self.at - n : self.at]

            seen += [o for o, *_ in warc.records_in(warc._Window(Handle(), len(inner), 128), start, min(len(inner), start + window))]
        assert len(seen) == len(set(seen)) == 20


def test_warc_of_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.report(df).count() == 0


# 7 rules


def test_rules_match_a_plain_count(spark):
    texts = [None, "", "a b c d e a b c d e x", "x\ny z\nx\n \n \nx", "w " * 50, "# $ *** the <|>", prose(1, 80), "the of and to in that is with for as on it"]
    got = {r.doc_id: r for r in quality_rules.report(docs(spark, texts).withColumn("kept", F.lit(0))).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars) == (len(w), len(covered), len(lines) - len(set(lines)), sum(map(len, w)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert got[7].kept
    df = docs(spark, texts, ids=[None, 1, 1, 3, 4, 5, 6, 7])
    assert quality_rules.apply_rules(df).columns == df.columns and quality_rules.apply_rules(df.limit(0)).count() == 0


# 8 classifier


def test_classifier_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = weak_label.scored(spark.read.parquet(f"{sf}/documents.parquet"))
    joined = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right, all_, clean, clean_kept = joined.agg(F.count_if((F.col("quality") == 1) == F.col("kept")), F.count(F.lit(1)), F.count_if(F.col("quality") == 1), F.count_if((F.col("quality") == 1) & F.col("kept"))).first()
    assert right >= 0.95 * all_ and clean_kept >= 0.98 * clean


def test_em_recovers_accuracies():
    rng = np.random.default_rng(4)
    truth, n = rng.random(20_000) < 0.7, len(weak_label.LABELLERS)
    accuracy = np.linspace(0.75, 0.95, n)
    right = rng.random((len(truth), n)) < accuracy
    votes = np.where(rng.random((len(truth), n)) < 0.5, 0, np.where(right == truth[:, None], 2, 1))
    pattern, counts = np.unique((votes * 3 ** np.arange(n)).sum(axis=1), return_counts=True)
    _, share, found = weak_label.posteriors(pattern, counts.astype(float))
    assert share == pytest.approx(0.7, abs=0.03) and np.abs(found - accuracy).max() < 0.04


def test_classifier_on_odd_rows(spark):
    df = docs(spark, [None, "", "ab", "the cat and the dog " * 5, "### *** &&& " * 30], ids=[None, 1, 1, 2, 3])
    assert weak_label.scored(df).count() == 5 and weak_label.kept_only(df).columns == df.columns
    assert weak_label.scored(df.limit(0)).count() == 0 and weak_label.kept_only(df.limit(0)).count() == 0


# 9 sharding


def test_shards_fit(spark):
    df = docs(spark, [*["x" * (i % 97) for i in range(500)], *["y" * 40] * 200, "z" * 5000, None], ids=[*range(500), *[7] * 200, 999, None])
    limit = 1000
    rows = extendible.sharded(df, limit, carry=("lang",)).collect()
    assert len(rows) == 702 and all(r.lang == "en" for r in rows)
    held = Counter()
    for r in rows:
        held[r.shard] += r.bytes
    assert all(r.shard_bytes == held[r.shard] and r.shard_depth == len(r.shard) for r in rows)
    assert all(b <= limit for s, b in held.items() if b != 5000)
    # No shard could have stayed whole: each shard's parent holds more than the limit.
    assert all(sum(b for t, b in held.items() if t.startswith(s[:-1])) > limit for s in held if s)
    assert extendible.sharded(df.limit(0)).count() == 0
    assert {r.shard for r in extendible.sharded(df.limit(3)).collect()} == {""}
