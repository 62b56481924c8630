"""Ranked search, target resampling and prefix BPE against brute force, and on nulls, empty tables, ties and repeated rows."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.test_llm import P, docs, edge_rows, lower, words
from tests.llm.test_partitions import ODD, parted

from stratalens.llm import prefix_bpe, pretokens, ranked, resampling

PATH = P.path("byte_bpe_50k.json")
ITEMS = "item_id long, text string, rank int, doc_id long"


def items(spark, rows):
    return spark.createDataFrame([(i, t, 0, 1) for i, t in rows], ITEMS)


def found_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def brute_search(rows, queries, top=50):
    have = [(i, Counter(found_terms(t))) for i, t in rows]
    have = [(i, c, sum(c.values())) for i, c in have if c]
    n, total, df = len(have), sum(x[2] for x in have), Counter(w for _, c, _ in have for w in c)
    wanted, out = {}, {}
    for i, t in queries:
        wanted.setdefault(i, set()).update(found_terms(t))
    for i, ts in wanted.items():
        scores = []
        for d, c, size in have:
            m = 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in ts if w in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out[i] = [(k + 1, None if missing else d, -s) for k, (s, missing, d) in enumerate(sorted(scores)[:top])]
    return {i: x for i, x in out.items() if x}


def searched(out):
    got = {}
    for r in sorted(out.collect(), key=lambda r: (str(r.item_id), r.rank)):
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    return got


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "中文", "naïve", "x9"]
    return [(i, " ".join(rng.choice(vocabulary).upper() if rng.random() < 0.2 else rng.choice(vocabulary) + rng.choice(["", ",", "_", "-b"]) for _ in range(rng.randrange(1, 40)))) for i in range(n)]


def test_search_matches_brute_force(spark, monkeypatch):
    rows = [*corpus(300, 1), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (None, "w1 w2"), (301, None), (302, ""), (303, " ,;_ ")]
    queries = [(k, t) for k, (_, t) in enumerate(corpus(12, 2))] + [(3, "w5 extra"), (90, None), (91, "nowhere"), (None, "w1")]
    want = brute_search(rows, queries)
    assert 90 not in want and 91 not in want and None in want
    assert searched(ranked.search(docs(spark, rows).repartition(5), items(spark, queries))) == want
    # small blocks of queries, small groups of documents, and heaps that are cut often give the same
    monkeypatch.setattr(ranked, "BLOCK", 40)
    assert searched(ranked.search(docs(spark, rows), items(spark, queries), top=3)) == {i: x[:3] for i, x in want.items()}


def test_search_sums_in_groups_and_cuts_its_heaps(monkeypatch):
    rng = np.random.default_rng(3)
    best, seen = ranked.Best(4, 5), []
    best.limit = 60
    for _ in range(40):
        query, score, doc = rng.integers(0, 4, 30), rng.integers(1, 200, 30), rng.integers(0, 10**6, 30)
        seen += list(zip(query.tolist(), score.tolist(), doc.tolist(), strict=True))
        best.add(query, score, doc, np.zeros(30, bool))
    query, score, doc, _ = best.select()
    for q in range(4):
        want = sorted(((-s, d) for k, s, d in seen if k == q))[:5]
        assert sorted((-s, d) for k, s, d in zip(query, score, doc, strict=True) if k == q) == want
    keys = rng.integers(0, 1 << 40, 5000)
    assert (ranked.radix_order(keys) == np.argsort(keys, kind="stable")).all() and not len(ranked.radix_order(np.zeros(0, np.int64)))
    n = np.array([1, 10**6, 5 * 10**8])
    assert ranked._damped(n, 10**12, 10**15, 50).tolist() == [50 + (50 * 10**12 * int(x)) // 10**15 for x in n]


def test_search_tells_equal_hashes_apart(spark, monkeypatch):
    """A document's term that has only the hash of a query's is none of its terms."""
    monkeypatch.setattr(ranked, "range_hashes", lambda raw, start, end: np.full(len(start), 5, np.uint64))
    index = ranked.Index([1, 2], ["ab", "c"])
    assert index.numbers(b"abxx", np.array([0, 2]), np.array([2, 4]), np.array([5, 5], np.uint64)).tolist() == [0, -1]


def test_search_edges(spark):
    some, none = docs(spark, edge_rows()), docs(spark, [])
    assert ranked.search(some, items(spark, [])).count() == 0 and ranked.search(none, items(spark, [(1, "a")])).count() == 0
    assert ranked.search(some, items(spark, [(1, None)])).count() == 0
    got = searched(ranked.search(some, items(spark, [(1, "a"), (2, "one")])))
    assert got == brute_search(edge_rows(), [(1, "a"), (2, "one")]) and [x[1] for x in got[1]] == [1, 1, 8, None]
    odd = parted(spark, "doc_id long, text string", [(1, "a b"), (2, "a")], [(100, None)], [(101, " ")])
    assert len(searched(ranked.search(odd, items(spark, [(1, "a")])))[1]) == 2


def brute_resample(rows, target, longest=1, buckets=10_000, least=20, share=10, seed=2024):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    runs = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    own = [(i, words_of(t)) for i, t in rows]
    raw, aim = Counter(b for _, w in own for b in runs(w)), Counter(b for _, t in target for b in runs(words_of(t)))
    total, aimed, out = sum(raw.values()), sum(aim.values()), []
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (total + buckets) / ((raw[b] + 1) * (aimed + buckets)))) for b in raw}
    for i, w in own:
        found = runs(w)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    ranks = {id(x): k + 1 for k, x in enumerate(able[: share * len(able) // 100])}
    return sorted(((*x[:4], ranks.get(id(x))) for x in out), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_matches_brute_force(spark, longest):
    rows = [*corpus(400, 4), (9, " ".join(words(50, 1))), (401, None), (402, ""), (None, " ".join(words(30, 2))), (403, "one")]
    target = corpus(20, 5)
    out = resampling.resample(docs(spark, rows).repartition(5), items(spark, target), longest=longest)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == brute_resample(rows, target, longest) and sum(r[4] is not None for r in got) > 10


def test_resampling_draws_some_all_or_none(spark):
    rows, target = [(i, t) for i, t in corpus(60, 6)] + [(5, corpus(60, 6)[5][1])] * 3, corpus(3, 7)
    for share, least in ((100, 0), (0, 0), (37, 1)):
        got = resampling.resample(docs(spark, rows), items(spark, target), share=share, least_words=least).collect()
        want = brute_resample(rows, target, least=least, share=share)
        assert sorted((r.rank for r in got if r.rank)) == sorted(x[4] for x in want if x[4]) and len(got) == 63
        assert sorted((r.score, r.rank is None) for r in got) == sorted((x[3], x[4] is None) for x in want)


def test_resampling_edges(spark):
    none = docs(spark, [])
    assert resampling.resample(none, items(spark, [(1, "a")])).count() == 0
    got = sorted(map(tuple, resampling.resample(docs(spark, edge_rows()), items(spark, [])).collect()), key=str)
    assert got == brute_resample(edge_rows(), [])
    table = parted(spark, "doc_id long, text string", [(i, " ".join(words(40, i))) for i in range(30)], [(100, None)], [(101, "  \n")], [(102, ""), (103, None)])
    out = resampling.resample(table, items(spark, [(1, None), (2, "w1 w2")])).collect()
    assert len(out) == 34 and all(r.weight == r.n_features == 0 for r in out if r.doc_id in ODD) and sum(r.rank is not None for r in out) == 3


def odd_texts():
    rng = random.Random(8)
    pool = "ab zA9 \n\t'!.,éßΩ中\U0001f600̀\xa0\x85\x1c sdtl<|endoftext|>"
    out = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(1500)]
    out += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "a" * 20_000, " " * 3000, "\n \n" * 500, "thethethe" * 1000, "it's we'll I'd", "'s't"]
    out += ["".join(rng.choice(string.ascii_lowercase[:6]) for _ in range(2000)) for _ in range(10)]
    return [*out, "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)]


def test_prefix_bpe_equals_the_library(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, texts, own = Tokenizer.from_file(PATH), odd_texts(), prefix_bpe.encoder(PATH)
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    for limit in (1 << 20, 1000):  # also where texts are cut into parts
        monkeypatch.setattr(pretokens, "LIMIT", limit)
        ids, bounds = own.encode(texts)
        assert all(x.ids == ids[a:z].tolist() for x, a, z in zip(want, bounds[:-1], bounds[1:], strict=True))
    assert all(own.decode(np.array(x.ids, np.int64)) == tokenizer.decode(x.ids, skip_special_tokens=False) for x in want)


def test_long_texts_are_cut_in_the_order_of_rows(monkeypatch):
    monkeypatch.setattr(pretokens, "LIMIT", 10)
    texts = ["a b", "c", "d e f g h i j k l m n\x1cp q r s t u v", "w", "x" * 30, "y"]
    found = [x for part in pretokens.parts(texts) for x in part]
    assert [r for r, _ in found] == sorted(r for r, _ in found)
    assert ["".join(t for r, t in found if r == k) for k in range(len(texts))] == texts and not any(t.startswith("\x1c") for _, t in found)


def test_prefix_bpe_pairs_agree_with_plain_merging():
    """Two tokens stand side by side if and only if merging their bytes step by step ends in these two."""
    own, rng = prefix_bpe.encoder(PATH), random.Random(9)

    def merged(raw):
        now = list(raw)
        while True:
            ranks = [(own.pairs.get(p, 1 << 40), k) for k, p in enumerate(zip(now, now[1:]))]
            if not ranks or min(ranks)[0] == 1 << 40:
                return now
            rank, at = min(ranks)
            now[at : at + 2] = [rank]

    tokens = [rng.randrange(50_256) for _ in range(3000)] + [rng.randrange(600) for _ in range(3000)]
    for x, y in zip(tokens, tokens[1:]):
        assert own.beside(x, y) == (merged(own.bytes[x] + own.bytes[y]) == [x, y])


def test_prefix_bpe_on_odd_rows(spark):
    from tokenizers import Tokenizer

    rows = [*edge_rows(), (11, "x<|endoftext|>")]
    table, tokenizer = docs(spark, rows), Tokenizer.from_file(PATH)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in prefix_bpe.round_trip(table, PATH).collect()}
    ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert got == {(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids}
    encoded = prefix_bpe.encode_texts(table, PATH)
    assert sorted((str(r.doc_id), r.ids) for r in encoded.collect()) == sorted((str(i), x) for i, x in ids)
    assert sorted((str(r.doc_id), r.text) for r in prefix_bpe.decode_ids(encoded, PATH).collect()) == sorted((str(i), t or "") for i, t in rows)
    assert prefix_bpe.round_trip(docs(spark, []), PATH).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [50256, -4, 99999, None, 64])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in prefix_bpe.decode_ids(odd, PATH).collect()} == {1: "", 2: "<|endoftext|>a"}
    nulls = parted(spark, "doc_id long, text string", [(1, "a b")], [(100, None)], [(101, " ")])
    assert {r.doc_id: r.n_tokens for r in prefix_bpe.round_trip(nulls, PATH).collect()} == {1: 2, 100: 0, 101: 1}


def test_prefix_bpe_refuses_files_of_another_kind():
    with pytest.raises(ValueError):
        prefix_bpe.Encoder(P.path("word_bpe_49k.json"))
