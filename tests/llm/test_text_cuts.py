"""Alignment of tokenizers, fill-in-middle and decontamination against brute force on small fixtures."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tierflow.llm import align, decontaminate, fim

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " ", "\n", "a", "don't stop", "two  spaces\t\ttabs", "é中文字 🙂🙂", "x" * 5000, "<|endoftext|> <s>", "a▁b", "ab " * 4000, "\u0000nul", "<P> kept", "same text", "same text", "end<", "  lead"]


def odd_docs(spark):
    """Nulls, ties, repeats, long texts and an extra column with a clashing name."""
    rows = [(i if i != 3 else None, t, 7) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a long")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Alignment ---------------------------------------------------------------------------


def byte_alphabet():
    """Byte-level BPE writes each byte as a printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import sentencepiece

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), byte_alphabet()


def slow_alignment(texts, tokenizers):
    a_model, b_model, alphabet = tokenizers
    out, counts = [], Counter()
    for text in texts:
        own = None
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text)
            size = [[bytes(alphabet[c] for c in a_model.id_to_token(i)) for i in a], []]
            for i in b:
                piece = b_model.id_to_piece(i)
                size[1].append(bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode())
            if all(b"".join(x) == (" " + text).encode() for x in size):
                ends = [np.cumsum([len(t) for t in x]).tolist() for x in size]
                groups, i, j, links = [], 0, 0, []
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    m, n = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
                    groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
                    links.append((a[m - 1], b[n - 1]))
                    i, j = m, n
                counts.update(links)
                own = len(a), len(b), groups, links
        out.append(own)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    rows = []
    for own in out:
        if own is None:
            rows.append((0, 0, 0, 0, "", 0, 0))
        else:
            n_a, n_b, groups, links = own
            rows.append((n_a, n_b, len(groups), len(links), sha(";".join(groups)), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links)))
    return rows


def test_alignment_of_odd_texts(spark, tokenizers):
    got = [tuple(r)[1:] for r in align.report(odd_docs(spark).coalesce(1)).collect()]
    assert got == slow_alignment(ODD_TEXTS, tokenizers)
    assert got[0] == got[1] == got[10] == (0, 0, 0, 0, "", 0, 0)


def test_alignment_query_beside_brute_force(spark, tokenizers):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, slow_alignment(texts.values(), tokenizers)))
    assert {r.doc_id: tuple(r)[1:] for r in align.report(docs).collect()} == want


def test_alignment_of_an_empty_table(spark):
    assert align.report(odd_docs(spark).where("doc_id < 0")).collect() == []


def test_groups_are_put_out(spark):
    rows = align.aligned(odd_docs(spark)).where("n_groups > 0").collect()
    for r in rows:
        assert (len(r.a_ids), len(r.b_ids), len(r.a_cuts), len(r.b_cuts)) == (r.n_a, r.n_b, r.n_groups, r.n_groups)
        assert (r.a_cuts[-1], r.b_cuts[-1]) == (r.n_a, r.n_b)
        a = [r.a_ids[i:j] for i, j in zip([0, *r.a_cuts], r.a_cuts)]
        b = [r.b_ids[i:j] for i, j in zip([0, *r.b_cuts], r.b_cuts)]
        assert sha(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(a, b))) == r.groups_sha256


@pytest.mark.parametrize("extra", [-1, 0, 1])
def test_both_encoders_give_the_same_ids_at_the_limit(tokenizers, extra):
    text = ("Ein Wort, <|endoftext|> two words\n\n  é🙂 1234 " * 6000)[: align.LONG_TEXT + extra]
    assert align.ids_a(text).tolist() == tokenizers[0].encode(" " + text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.randoms(use_true_random=False)), min_size=1, max_size=4))
def test_leaf_groups_are_the_stretches_between_common_ends(texts):
    ends_a, ends_b, first_a, first_b, base, want = [], [], [0], [0], 0, []
    for sizes, random in texts:
        total = sum(sizes)
        a = np.cumsum(sizes).tolist()
        b = sorted({total, *random.sample(range(1, total + 1), random.randint(0, total))})
        ends_a += [base + x for x in a]
        ends_b += [base + x for x in b]
        want += [base + x for x in sorted(set(a) & set(b))]
        first_a.append(len(ends_a))
        first_b.append(len(ends_b))
        base += total
    got_a, got_b = align.leaf_groups(*(np.array(x, np.int64) for x in (ends_a, ends_b, first_a, first_b)))
    assert [ends_a[i - 1] for i in got_a] == [ends_b[i - 1] for i in got_b] == want


def test_pairs_stay_below_their_bound(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = align.pair_counts(align.aligned(docs, with_groups=False), 32000).collect()
    a, b = align.encoder_a().tokens, align.encoder_b()[1]
    assert all(a[r.a_id].endswith(b[r.b_id]) or b[r.b_id].endswith(a[r.a_id]) for r in counts)
    assert 0 < len(counts) < align.pair_bound() < 1_000_000


# Fill-in-middle ----------------------------------------------------------------------


def slow_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    head, middle, tail = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{tail}<P>{head}<M>{middle}") if h[3] % 100 < 20 else ("psm", f"<P>{head}<S>{tail}<M>{middle}")
    return doc_id, len(units), form, len(head), len(middle), sha(out), sha(text)


def test_fill_in_middle_of_odd_texts(spark):
    docs = odd_docs(spark)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in fim.report(docs).collect()), key=key)
    assert got == sorted((slow_fim(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}
    assert fim.report(docs.where("doc_id < 0")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZ1 \né🙂<PSM>", max_size=40), min_size=1, max_size=5), st.integers(0, 1 << 30))
def test_wavelet_matrix_counts_and_cuts(texts, pick):
    borders = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    classes = fim.char_classes(points, borders)
    matrix = fim.WaveletMatrix(classes)
    places = np.arange(len(points) + 1)
    for c in range(4):
        assert matrix.rank(c, places).tolist() == [int((classes[:i] == c).sum()) for i in places]
    units = [re.findall("[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert np.diff(matrix.starts(fim.TOKENS, borders)).tolist() == [len(u) for u in units]
    k = np.array([pick % (len(u) + 1) for u in units])
    cuts = fim.cut_places(matrix, borders[:-1], borders[1:], k) - borders[:-1]
    assert cuts.tolist() == [len("".join(u[:n])) for u, n in zip(units, k.tolist())]


def test_lines_as_units():
    text = "one\ntwo\n\nthree"
    points, borders = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0, len(text)])
    matrix = fim.WaveletMatrix(fim.char_classes(points, borders))
    cut = fim.cut_places(matrix, borders[:1], borders[1:], np.array([2]), fim.LINES)
    assert text[: cut[0]] == "one\ntwo\n"


# Decontamination ---------------------------------------------------------------------


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_report(text, items, window):
    words, hit, found = norm(text), set(), set()
    for name, item in items:
        own = norm(item)
        k = min(window, len(own))
        grams = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        for p in range(len(words) - k + 1):
            if tuple(words[p : p + k]) in grams:
                hit |= set(range(p, p + k))
                found.add("" if name is None else str(name))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


ITEMS = [(1, "alpha beta gamma delta eps zeta eta theta iota kappa lamda my"), (2, "Short ITEM!"), (3, None), (4, ""), (5, "beta gamma"), (2, "second text of two"), (None, "no id here"), (10, "a b a b a b a b a b a b a b"), (11, "one"), (1, "alpha beta gamma delta eps zeta eta theta iota kappa lamda my"), (12, "é中 🙂 x1")]
TEXTS = [
    None, "", "...", "clean text without anything", "x Alpha, BETA gamma delta eps zeta eta theta iota kappa y", "alpha beta gamma delta eps zeta eta theta iota", "short item short item", "a b " * 1500, "b a b a b a b a b a b",
    "no id here", "say é中 🙂 X1 now", "the one", "alpha beta gamma delta eps zeta eta theta iota kappa lamda my " * 300, "alpha beta", "second text of two second text of", "oneone one1",
]


def item_table(spark, items):
    return spark.createDataFrame([(*x, "extra") for x in items], "item_id int, text string, n_words string")


@pytest.mark.parametrize("window", [1, 2, 3, 10])
@pytest.mark.parametrize("block_words", [1 << 18, 8])
def test_decontamination_beside_brute_force(spark, monkeypatch, window, block_words):
    whole = decontaminate.automata
    monkeypatch.setattr(decontaminate, "automata", lambda items, w: whole(items, w, block_words))
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_hit int")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs, item_table(spark, ITEMS), window).collect()}
    assert got == {i: slow_report(t, ITEMS, window) for i, t in enumerate(TEXTS)}


def test_long_items_are_cut_without_losing_windows(spark):
    words = [f"w{i * 7919 % 5003}" for i in range(3 * decontaminate.PART_WORDS)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[4080:4110])), (2, " ".join(reversed(words)))], "doc_id int, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.report(docs, item_table(spark, [(1, " ".join(words))])).collect()}
    assert got == {0: len(words), 1: 30, 2: 0}


def test_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    none = item_table(spark, ITEMS).where("item_id > 100")
    assert [tuple(r) for r in decontaminate.report(docs, none).collect()] == [(1, 3, 0, 0, sha(""), False)]
    assert decontaminate.report(docs.where("doc_id > 1"), item_table(spark, ITEMS)).collect() == []


def test_spans_are_removed_and_covered_texts_go(spark):
    rows = [(1, "Keep é this. Short item! And this.", "a"), (2, "short item", "b"), (3, None, "c"), (4, "clean", "d")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, spans string").withColumn("c0", F.lit(1))
    out = decontaminate.cleaned(docs, item_table(spark, [(2, "Short ITEM!")]))
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "Keep é this. ! And this.", "a", 1), (3, None, "c", 1), (4, "clean", "d", 1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=5), st.lists(st.integers(0, 4), max_size=60), st.integers(1, 5))
def test_automaton_finds_every_window(items, text, window):
    named = [(str(i), np.array(x, np.uint64)) for i, x in enumerate(items)]
    automaton = decontaminate.Automaton.loaded(decontaminate.Automaton.build(named, window).dumped())
    ends, lengths, at, seen = automaton.matches(np.array(text, np.uint64), np.array([0, len(text)]))
    got = decontaminate._hit_words(len(text), ends, lengths)
    hit, found = set(), set()
    for i, x in enumerate(items):
        k = min(window, len(x))
        for p in range(len(text) - k + 1 if k else 0):
            if any(text[p : p + k] == x[q : q + k] for q in range(len(x) - k + 1)):
                hit |= set(range(p, p + k))
                found.add(str(i))
    assert set(np.flatnonzero(got).tolist()) == hit
    assert {automaton.item_names[s] for s in seen.tolist()} == found


def test_word_bytes_are_those_of_the_pattern():
    text = "".join(map(chr, range(1, 400))) + "ÀÉaZ09"
    data = np.frombuffer(text.encode(), np.uint8)
    assert re.findall("[^ ]+", decontaminate.normalised(data).tobytes().decode()) == norm(text)
