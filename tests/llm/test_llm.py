"""Each operator against a brute-force version, and on nulls, empty tables, ties and repeated rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stratalens.llm import bpe, components, embeddings, fingerprint, hashing, licenses, minhash, packing, pretokens, quality, repeats, urlfilter, warc

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, id string, sign long"  # two columns with names that the operators use inside


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def edge_rows():
    long = " ".join(words(30_000, 1))
    return [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, "  \n "), (5, "one two"), (6, long), (7, long), (None, "a b c d e f g"), (8, "A B c d e f g")]


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def shingles(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(x))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_copies(seed=0, families=12, size=7):
    rng, rows, n = random.Random(seed), [], 0
    for f in range(families):
        base = words(120, 100 + f)
        for k in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 7)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append((n, " ".join(own) if k else " ".join(base)))
            n += 1
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1])]
    rng.shuffle(rows)
    return rows


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_minhash_finds_the_components_of_brute_force(spark):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_minhash_edges(spark):
    out = minhash.near_duplicates(docs(spark, edge_rows())).collect()
    assert len(out) == 10
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for r in by[1]] == [1, 1] and by[8][0].component_id == 1
    assert by[2][0].n_shingles == by[3][0].n_shingles == by[4][0].n_shingles == 0 and by[2][0].kept
    assert by[7][0].component_id == 6 and not by[7][0].kept
    assert by[None][0].component_id is None and by[None][0].kept
    assert minhash.near_duplicates(docs(spark, []).limit(0)).count() == 0
    assert minhash.keep_one(docs(spark, edge_rows())).columns == ["doc_id", "text", "id", "sign"]


def test_minhash_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    rows = near_copies(seed=5, families=2, size=30)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {k: v[1] for k, v in brute_components(rows).items()}


def test_minhash_outsider_with_the_smallest_id(spark):
    """Its stars find nothing, so the family is found by comparing its buckets."""
    rng, base = random.Random(31), words(120, 77)
    rows = [(0, " ".join(base[:84] + words(36, 78)))]  # some 0.5 alike: it shares buckets with the family
    for i in range(1, 121):
        own = list(base)
        for _ in range(1 + i % 2):
            own[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {k: v[1] for k, v in brute_components(rows).items()} and len({*got.values()}) == 2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def complements(n):
    """Two words of Thue-Morse order: polynomial sums modulo 2**64 can't tell them apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_minhash_tells_complementary_words_apart(spark):
    one, two = complements(2048)
    rows = [(1, f"{one} x y z w"), (2, f"{two} x y z w"), (3, f"{one} x y z w")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_shingle_hashes_cross_chunks(monkeypatch):
    import pyarrow as pa

    text = pa.array([" ".join(words(400, 3)), None, "x"])
    whole = hashing.shingle_sets(text)
    monkeypatch.setattr(hashing, "CHUNK", 64)
    assert all((a == b).all() for a, b in zip(whole, hashing.shingle_sets(text), strict=True))


def test_fingerprints(spark):
    rows = [(i, " ".join(words(80 + 7 * i, i))) for i in range(12)] + [(20, None), (21, ""), (22, "two words"), (None, "alone here")]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    ordered = sorted((i, t or "") for i, t in rows if i is not None)
    errors = []
    for k, (i, t) in enumerate(ordered):
        cut, nxt = len(t) // 4, ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        errors.append(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1.0))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert np.abs(errors).mean() < 0.06
    assert got[20].fingerprint == "" and got[20].near_edited == 1.0
    same = fingerprint.edited_fingerprints(docs(spark, [(1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert same[0].fingerprint == same[1].fingerprint and same[0].near_next == 1.0
    assert fingerprint.edited_fingerprints(docs(spark, [])).count() == 0


def test_likeness_follows_the_true_one(spark):
    """Over the whole range, and for very long texts."""
    rng, rows, want = random.Random(12), [], []
    for i, share in enumerate([0, 0.2, 0.4, 0.6, 0.8, 0.95, 1] * 4):
        base = words(900, 50 + i)
        n = int(share * 900)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:n] + [f"o{rng.randrange(10**6)}" for _ in range(900 - n)]))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        want.append(len(a & b) / len(a | b))
    got = {r.doc_id: r.near_next for r in fingerprint.edited_fingerprints(docs(spark, rows)).collect()}
    errors = [got[2 * i] - w for i, w in enumerate(want)]
    assert max(map(abs, errors)) < 0.15 and abs(np.mean(errors)) < 0.03
    long = fingerprint.edited_fingerprints(docs(spark, [(1, "ab cd ef gh ij kl " * 60_000), (2, " ".join(words(100_000, 2)))])).collect()
    assert [r.n_chars for r in sorted(long)] == [18 * 60_000, len(" ".join(words(100_000, 2)))]


def brute_repeats(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(x[p : p + length] for _, x in raw for p in range(len(x) - length + 1))
    out = []
    for i, x in raw:
        gone = [False] * len(x)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeat_rows(seed):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    passages = [letters(rng.randrange(30, 160)) for _ in range(6)]
    rows = [(i, letters(rng.randrange(0, 60)) + "".join(rng.choice(passages) + letters(rng.randrange(0, 9)) for _ in range(rng.randrange(0, 4)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "ab" * 150), (103, "z" * 90), (104, rows[3][1]), (104, rows[3][1]), (None, passages[0])]


@pytest.mark.parametrize("length", [40, 75])
def test_repeats_match_brute_force(spark, length):
    rows = repeat_rows(length)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeat_report(docs(spark, rows), length=length).collect()]
    assert sorted(got, key=str) == brute_repeats(rows, length)


def test_repeats_of_large_groups_and_pieces(spark, monkeypatch):
    rows = repeat_rows(3)
    monkeypatch.setattr(repeats, "GROUP", 2)
    monkeypatch.setattr(repeats, "FEW", 1)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeat_report(docs(spark, rows), length=40).collect()]
    assert sorted(got, key=str) == brute_repeats(rows, 40)
    raw = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    z, offsets = repeats.sizes(40), np.array([0, len(raw)])
    one = [x.tolist() for x in repeats.anchors(raw, offsets, z)]
    monkeypatch.setattr(repeats, "PIECE", 150)
    parts = list(repeats._pieces(raw, offsets, z))
    assert [sum((p[k].tolist() for p in parts), []) for k in range(4)] == one


def test_strip_texts_keeps_characters_whole(spark):
    body = "é" * 60
    out = repeats.strip_texts(docs(spark, [(1, "a" + body + "b"), (2, "c" + body + "d"), (3, None)]), length=41)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == ["doc_id", "text", "id", "sign"] and got[3] is None
    assert got[1] == "ab" and got[2] == "cd"
    assert repeats.repeat_report(docs(spark, [])).count() == 0
    clash = ["__id", "__own", "__tag", "__KEPT"]
    named = docs(spark, [(1, "a" + body + "b"), (2, "c" + body + "d")]).selectExpr("*", *[f"{k} as {c}" for k, c in enumerate(clash)])
    assert [tuple(r)[1:] for r in sorted(repeats.strip_texts(named, length=41).collect())] == [("ab", "x", 1, 0, 1, 2, 3), ("cd", "x", 1, 0, 1, 2, 3)]


def test_repeats_tell_rows_without_an_id_apart(spark):
    body, rng = "q" * 10 + "".join(chr(97 + i % 26) for i in range(80)), random.Random(4)
    rows = [(None, "".join(rng.choice("xyz ") for _ in range(50)) + str(i) + (body if i % 2 else "")) for i in range(6)] + [(None, None)]
    got = sorted((r.n_bytes, r.n_removed) for r in repeats.repeat_report(docs(spark, rows), length=60).collect())
    assert got == sorted((len(t or ""), len(body) if t and body in t else 0) for _, t in rows)
    left = {r.text for r in repeats.repeat_report(docs(spark, rows), length=60).collect()}
    assert left == {(t or "").replace(body, "") for _, t in rows}


def test_license_scan(spark):
    rows = [
        (1, "This is under the MIT License and the GNU General Public License, mit-license."), (2, None), (3, ""), (4, "mit"), (5, "cc by cc by"), (5, "cc by cc by"), (None, "Apache\nLicense 2"),
        (6, "Permission is hereby granted, free of charge, to any lucky person obtaining a copy of it"), (7, "émit license mit licenseé"), (8, "the licen\u212ae, \u212a mit license"), (9, "mit license " * 20_000),
    ]
    got = licenses.license_scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        starts, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for k in range(len(w)):
                if w[k : k + len(p)] == p:
                    starts.append(k)
                    labels.add(label)
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(starts), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert next(r for r in got if r.doc_id == 6).labels == "mit"
    assert licenses.license_scan(docs(spark, [])).count() == 0


ALPHABET = "ab 'sdtrevlm\n\t,.!12é  ''ßÀ  x中́İΣ"


def mixed_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_byte_bpe_is_the_librarys(spark, monkeypatch):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*enumerate(mixed_texts(200, 2)), (900, None), (901, ""), (902, "it's " * 3000), (5, "again"), (None, "no id <|endoftext|>")]
    frame = docs(spark, rows)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(frame, path, P.PATTERN).collect())
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    back = {r.doc_id: r.bytes for r in bpe.decode_ids(bpe.encode_texts(frame, path, P.PATTERN), path).collect()}
    assert bytes(back[902]).decode() == "it's " * 3000
    assert bpe.round_trip(docs(spark, []), path, P.PATTERN).count() == 0


@pytest.mark.parametrize("ids", [[1, 2, 3, 4], [None] * 4])
def test_byte_bpe_of_blocks_with_equal_texts(spark, ids):
    """Equal last blocks of two partitions, and consecutive blocks of copies."""
    import tiktoken

    path, text = P.path("byte_bpe_50k.tiktoken"), " ".join(words(60, 3))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    short = bpe.encode_texts(docs(spark, [(i, text) for i in ids]).repartition(2), path, P.PATTERN)
    assert [r.ids for r in short.collect()] == [enc.encode_ordinary(text)] * 4
    long = (text + " ") * (bpe.BLOCK // len(text) + 1)
    want = hashlib.sha256(" ".join(map(str, enc.encode_ordinary(long))).encode()).hexdigest()
    copies = bpe.round_trip(docs(spark, [(i, long) for i in ids]).coalesce(1), path, P.PATTERN)
    assert [r.ids_sha256 for r in copies.collect()] == [want] * 4


def test_byte_bpe_of_complementary_words_and_rows_that_were_shuffled(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, f"{w} tail") for i, w in enumerate(complements(2048))]
    out = bpe.encode_texts(docs(spark, rows).repartition(3, "doc_id"), path, P.PATTERN).collect()
    assert {r.doc_id: r.ids for r in out} == {i: enc.encode_ordinary(t) for i, t in rows}


def test_packing_of_complementary_words(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = list(enumerate(complements(2048)))
    want = {i: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids + [2] for i, t in rows}
    got = {}
    for r in sorted(packing.pack(docs(spark, rows), path, with_ids=True).collect(), key=lambda r: r.start):
        got[r.doc_id] = got.get(r.doc_id, []) + r.ids
    assert got == want


def test_long_texts_are_cut_where_it_does_no_harm(monkeypatch):
    regex = pytest.importorskip("regex")
    monkeypatch.setattr(pretokens, "LIMIT", 20)
    text = "it's  two\n\n words 's, and 12 more\t\tthings " * 4
    got = []
    for part in pretokens.parts([text]):
        joined, s, e, _, _ = pretokens.split([x for _, x in part], True)
        got += [joined[a:z] for a, z in zip(s, e, strict=True)]
    assert got == regex.findall(P.PATTERN, text)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = [*enumerate(mixed_texts(150, 4)), (900, None), (901, ""), (902, "word " * 9000), (903, "x<|endoftext|>y"), (5, "again")]
    got = packing.pack(docs(spark, rows), path, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want[(i, len(ids))] += len(ids)
    have = Counter()
    for r in got:
        have[(r.doc_id, r.doc_tokens)] += r.length
        assert zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == r.length
    assert have == want
    by_doc = sorted((r.start, r.ids) for r in got if r.doc_id == 902)
    assert [x for _, ids in by_doc for x in ids] == tokenizer.encode("word " * 9000, add_special_tokens=False).ids + [2]
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert total <= 4096 * len(sequences) <= 1.25 * total + 8 * 4096  # a worker has one open bin a class at most
    assert packing.pack(docs(spark, []), path).count() == 0


def test_harmonic_classes():
    for n in range(1, 20_000, 7):
        sizes = packing.cuts(n)
        assert sum(sizes) == n and min(sizes) > 0 and all(x == 4096 for x in sizes[: n // 4096]) and len(sizes) <= n // 4096 + 4
        for size in sizes:
            j = packing.class_of(size)
            assert j * size <= 4096 and (size <= 256 or j * size >= 0.93 * 4096)


def test_harmonic_bins_waste_little(spark, monkeypatch):
    rng = np.random.default_rng(3)
    lengths = [x for n in rng.lognormal(6, 1, 20_000).astype(int) + 1 for x in packing.cuts(int(n))]
    frame = spark.createDataFrame([(i, 0, n, i % 97, n) for i, n in enumerate(lengths)], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    got = packing.assign(frame, 4).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(got) == len(lengths) and 4096 * len(bins) < 1.05 * sum(lengths)


def quality_rows(seed=6):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(600):
        text = [f"w{rng.randrange(300)}" for _ in range(60)]
        toxic, shouted = i % 5 == 0, i % 10 == 1
        if toxic:
            text[rng.randrange(60)] = rng.choice(["stupid", "idiot"])
        if shouted:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        if i < 450:
            labels.append((i, 0 if shouted else 1, 1 if toxic else None if i % 3 == 2 else 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_quality_log_weights_match_brute_force(spark):
    rows, labels = quality_rows()
    have = {i: set(quality.features([t])[1].tolist()) for i, t in rows}
    good = {i for i, q, x in labels if q == 1 and not x}
    bad = {i for i, *_ in labels} - good
    share, want = len(good) / (len(good) + len(bad)), {}
    count = lambda ids, f: sum(f in have[i] for i in ids)
    ratio = {}
    for f in set().union(*have.values()):
        t, o, r = count(good, f), count(bad, f), count(have, f)
        e = (t + o) * share
        z = (t - e) / (e * (1 - share) + 0.5) ** 0.5
        ratio[f] = np.log((t + 0.5) / (r * len(good) / len(rows) + 0.5)) * max(0.0, 1 - (2 / max(abs(z), 1e-9)) ** 2)
    want = {i: sum(ratio[f] for f in fs) for i, fs in have.items()}
    assert min(ratio.values()) < 0 < max(ratio.values())
    out = quality.weights(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows) and all(abs(r.log_weight - want[r.doc_id]) < 1e-9 for r in out)
    # the k largest keys, k the documents that weigh as much as all but a hundredth of the good ones
    k = sum(w >= np.quantile([want[i] for i in good], 0.01) - 1e-12 for w in want.values())
    assert {r.doc_id for r in sorted(out, key=lambda r: -r.key)[:k]} == {r.doc_id for r in out if r.kept}
    noise = [r.key - r.log_weight / quality.TEMPERATURE for r in out]
    assert 0.3 < np.mean(noise) < 0.85 and 1.0 < np.std(noise) < 1.6  # Gumbel: 0.577 and 1.283


def test_quality_on_held_out_documents(spark):
    rows, labels = quality_rows()
    rows = [*rows, (900, None), (901, ""), (5, rows[5][1]), (None, "no id")]
    frame = docs(spark, rows)
    given = spark.createDataFrame([*labels, (None, 1, 0), (7, None, None)], LABELS)
    out = quality.judge(frame, given).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.doc_id is not None and 450 <= r.doc_id < 600]
    is_bad = lambda i: i % 5 == 0 or i % 10 == 1
    assert np.mean([r.kept != is_bad(r.doc_id) for r in held]) > 0.9
    assert all(r.log_weight == 0 for r in out if r.doc_id in (900, 901))
    assert quality.judge(frame, given.limit(0)).where("kept").count() == len(rows)
    assert quality.judge(docs(spark, []), given).count() == 0
    assert sorted((str(r.doc_id), r.kept) for r in out) == sorted((str(r.doc_id), r.kept) for r in quality.weights(frame, given).collect())
    drawn = sorted((str(r.doc_id), r.text) for r in out if r.kept)
    for name in ("key", "Kept", "log_weight"):
        named = frame.withColumnRenamed("sign", name)
        assert f"_{name.lower()}" in quality.judge(named, given).columns
        stays = quality.keep_drawn(named, given)
        assert stays.columns == named.columns and sorted((str(r.doc_id), r.text) for r in stays.collect()) == drawn


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(1)
    values = [*rng.normal(size=300).tolist(), *[5.0] * 20, -1e6, 1e6]
    frame = spark.createDataFrame([(float(x),) for x in values], "x double")
    for k in (1, 2, 15, 22, 200, len(values)):
        assert quality.kth_largest(frame, "x", k) == sorted(values, reverse=True)[k - 1]


def test_embeddings_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for c in range(30):
        centre = rng.normal(size=32)
        for _ in range(6):
            rows.append((n, (centre + rng.normal(size=32) * rng.choice([0.0, 0.15, 0.25])).astype(np.float32).tolist(), c % 3))
            n += 1
    rows += [(500, None, 1), (501, [0.0] * 32, 1), (502, [float("nan")] * 32, 1), (503, rows[0][1], None), (504, [None, 1.0], 1), (505, [], 1), (None, rows[0][1], 0), (506, [1.0, 2.0], 0), (507, [2.0, 4.0], 0)]
    frame = spark.createDataFrame([(i, v, k, "x") for i, v, k in rows], "vec_id long, embedding array<float>, label int, id string")
    ok = [(i, np.array(v, float), k) for i, v, k in rows if i is not None and v and k is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = Counter({i: 0 for i, *_ in rows})
    parent = {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ok:
        for b in ok:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93:
                links[a[0]] += 1
                links[b[0]] += 1
                u, v = find(a[0]), find(b[0])
                parent[max(u, v)] = min(u, v)
    for block in (1024, 3):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        got = embeddings.embedding_links(frame).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], find(r.vec_id), r.vec_id is None or find(r.vec_id) == r.vec_id), r
    assert embeddings.embedding_links(frame.limit(0)).count() == 0


@pytest.mark.parametrize("kind, dim", [("float", 64), ("double", 256)])
def test_embedding_recall_on_planted_pairs(spark, kind, dim):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(600, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u = rng.normal(size=(600, dim))
    u -= (u * a).sum(axis=1, keepdims=True) * a
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cosine = rng.uniform(0.9301, 0.99, (600, 1))
    b = cosine * a + np.sqrt(1 - cosine**2) * u
    rows = [(2 * i + k, x[i].tolist(), i % 3) for i in range(600) for k, x in enumerate((a, b))]
    got = embeddings.embedding_links(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()
    assert np.mean([r.n_links == 1 and r.component_id == r.vec_id // 2 * 2 for r in got]) > 0.98 and max(r.n_links for r in got) == 1


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 8)) * 2
    near = embeddings.nearest_e8(x) / 2
    gap = ((x - near) ** 2).sum(axis=1)
    for v in embeddings._neighbours() / 2:
        assert (((x - near - v) ** 2).sum(axis=1) >= gap - 1e-9).all()


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 500)
    monkeypatch.setattr(warc, "BUNDLE", 900)
    rows = [(i, f"http://x.org/{i}\r\nEvil: 1", f"<p>{'é' * (i % 7)}</p>") for i in range(60)] + [(100, None, None), (101, "u", ""), (102, "u", "a" * 5000), (None, "u", "<p></p>"), (None, "u", "only"), (103, "u", "dup"), (103, "u", "dup")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.archive_round_trip(spark, frame).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = best.get(h or "")
        want.append((i, len(raw), digest, "response" if first == i else "revisit", None if first == i else first))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    table = warc.bundles(frame)
    found = warc.fetch(table, [6, 102]).collect()
    assert {(r.page_id, r.payload_bytes) for r in found} == {(6, 7 + 12), (102, 5000)}
    warc.export(table, f"file://{tmp_path}/out")
    import zstandard

    for f in (tmp_path / "out").iterdir():
        raw = f.read_bytes()
        frames = warc.frames_of(raw)
        plain = [zstandard.ZstdDecompressor().decompress(raw[a : a + packed], max_output_size=size) for a, packed, size in frames]
        assert [len(x) for x in plain] == [x[2] for x in frames] and all(list(warc.parse(x)) for x in plain)
    assert warc.archive_round_trip(spark, frame.limit(0)).count() == 0


def test_url_rules_and_list(spark, monkeypatch):
    urls = [
        "http://A.ORG/x", "http://b.a.org", "https://www.example.org/es/1?q", "http://example.org/en/12", "http://xexample.org/es/", "http://q.com/fr/a#f", "http://q.com/de/", "http://q.com/fr", "no scheme", None, "http://t.net/a", "http://www.t.net/a/",
        "http://t.net/a?x=1", "http://u.net/a", "http://u.net/a", "://h/p",
    ]
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(frame).collect()}
    assert len(got) == len(urls)
    assert got[0] == ("a.org", "/x", "org/", "allow") and got[1] == ("b.a.org", "", None, "allow")
    assert got[2][2:] == ("example.org/es/", "block") and got[3][2:] == ("example.org/en/1", "block") and got[4][2:] == ("org/", "allow")
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block") and got[7][2:] == (None, "allow")
    assert got[8] == got[9] == ("", "", None, "allow") and got[15] == ("h", "/p", None, "allow")
    assert [got[i][3] for i in (10, 11, 12, 13, 14)] == ["block"] * 3 + ["allow"] * 2
    listed = spark.createDataFrame([(f"z{i}.net/",) for i in range(500)] + [(None,)], "canon string")
    probes = spark.createDataFrame([(f"z{i}.net/",) for i in range(0, 1000, 3)], "canon string")
    for limit in (urlfilter.BROADCAST, 0):
        monkeypatch.setattr(urlfilter, "BROADCAST", limit)
        assert sorted(r.canon for r in urlfilter.listed_hits(probes.union(probes), listed).collect()) == sorted(f"z{i}.net/" for i in range(0, 500, 3))
    long = urlfilter.judge_urls(spark.createDataFrame([(1, "http://x.org/" + "a" * 100_000), (2, None)], "page_id long, url string")).collect()
    assert {(r.page_id, r.verdict, len(r.path)) for r in long} == {(1, "allow", 100_001), (2, "allow", 0)}
    assert urlfilter.judge_urls(frame.limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    frame, path = spark.read.parquet(f"{sf}/documents.parquet"), sf
    columns, before = frame.columns, frame.count()
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, path)
        if name != "packing":
            assert frame.columns == columns
            frame = frame.persist()
            now = frame.count()
            assert 0 < now <= before
            before = now
    ids = frame.groupBy("doc_id").agg({"doc_tokens": "max", "length": "sum"}).collect()
    assert len(ids) == before and all(r["max(doc_tokens)"] == r["sum(length)"] for r in ids)


def test_pipeline_drops_what_it_should(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage = prose(70)
    rows = [(i, prose(90)) for i in range(60)]
    rows += [(60 + i, prose(90) + f" stupid {prose(5)}") for i in range(20)]
    copy = rows[0][1].split()
    copy[3] = "w77"
    rows += [(90, " ".join(copy)), (91, rows[1][1]), (92, prose(100) + " " + passage), (93, passage + " " + prose(100))]
    spark.createDataFrame([(i, 0 if i >= 90 else 1, int(60 <= i < 80)) for i, _ in rows if i < 76], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, frame, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if not 60 <= i < 80}
    kept = stages["near_dedup"](spark, kept, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if not 60 <= i < 80} - {90, 91}
    out = {r.doc_id: r for r in stages["repeats"](spark, kept, str(tmp_path)).collect()}
    assert passage not in out[92].text and passage not in out[93].text and out[5].text == rows[5][1]
    assert out[92].n_chars == len(out[92].text)


def test_pipeline_matches_brute_force(spark, tmp_path):
    """Every stage of run() against plain Python; only the noise of the draw comes from Spark."""
    import corpus_pipeline
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    rng = random.Random(21)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage = prose(70)
    rows = [(i, prose(90) + (f" stupid {prose(5)}" if i % 4 == 0 else "")) for i in range(120)]
    rows += [(200 + i, rows[4 * i + 1][1] + " " + prose(4)) for i in range(6)] + [(300 + i, prose(40) + " " + passage + " " + prose(30)) for i in range(5)] + [(400, None), (401, "")]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(0, 100)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    # quality
    have = {i: set(quality.features([t or ""])[1].tolist()) for i, t in rows}
    good, bad = {i for i, _, x in labels if not x}, {i for i, _, x in labels if x}
    share, ratio = len(good) / 100, {}
    for f in set().union(*have.values()):
        t, o, r = (sum(f in have[i] for i in ids) for ids in (good, bad, have))
        e = (t + o) * share
        z = (t - e) / (e * (1 - share) + 0.5) ** 0.5
        ratio[f] = np.log((t + 0.5) / (r * len(good) / len(rows) + 0.5)) * max(0.0, 1 - (2 / max(abs(z), 1e-9)) ** 2)
    weight = {i: sum(ratio[f] for f in fs) for i, fs in have.items()}
    frame = spark.createDataFrame(rows, "id long, text string")
    noise = {r.id: r.noise for r in frame.select("id", quality.gumbel_key(F.lit(0.0), "id", "text").alias("noise")).collect()}
    k = sum(w >= np.quantile([weight[i] for i in good], 0.01) - 1e-12 for w in weight.values())
    kept = set(sorted(weight, key=lambda i: -(weight[i] / quality.TEMPERATURE + noise[i]))[:k])
    assert len(kept & bad) < len(bad) / 4 and len(kept & good) > 0.9 * len(good)
    left = [(i, t) for i, t in rows if i in kept]
    # near duplicates, then repeats, then packing
    components = brute_components(left)
    left = [(i, t) for i, t in left if components[i][1] == i]
    assert not {i for i, _ in left} & {200 + i for i in range(6) if 4 * i + 1 in kept}
    raw = [(t or "").encode() for _, t in left]
    seen = Counter(b[p : p + 240] for b in raw for p in range(len(b) - 239))
    texts = {}
    for (i, _), b in zip(left, raw, strict=True):
        gone = [False] * len(b)
        for p in range(len(b) - 239):
            if seen[b[p : p + 240]] > 1:
                gone[p : p + 240] = [True] * 240
        texts[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode()
    assert all(passage not in texts[i] for i in range(300, 305) if i in texts)
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4"))
    assert sum(r.length for r in got) == sum(map(len, want.values()))


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, ties, repeated rows, clashing names, no n_chars, an empty table."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    long = " ".join(words(2000, 7))
    rows = [(1, "a b c d e f g", "x", 1), (1, "a b c d e f g", "x", 1), (1, "other words under the same id here", None, 2), (2, None, "y", None), (3, "", None, 0), (None, "no id at all", "z", 1), (None, None, None, None), (4, long, "x", 1), (5, long, "x", 1), (6, "  \n ", "x", 1)]
    schema = "doc_id long, text string, id string, sign long"
    frame, stages = spark.createDataFrame(rows, schema), dict(corpus_pipeline.STAGES)
    for name in ("quality", "near_dedup", "repeats"):
        out = stages[name](spark, frame, str(tmp_path))
        assert out.columns == frame.columns and stages[name](spark, frame.limit(0), str(tmp_path)).count() == 0
    kept = sorted(map(tuple, stages["near_dedup"](spark, frame, str(tmp_path)).collect()), key=str)
    assert [r[0] for r in kept] == [1, 2, 3, 4, 6, None, None] and kept == sorted(map(tuple, stages["near_dedup"](spark, frame.repartition(5), str(tmp_path)).collect()), key=str)
    texts = {(r.doc_id, r.text) for r in stages["repeats"](spark, frame, str(tmp_path)).collect()}
    assert (4, "") in texts and (5, "") in texts and (2, None) in texts and (1, "a b c d e f g") in texts
    packed = stages["packing"](spark, frame, str(tmp_path)).collect()
    assert len({(r.doc_id, r.doc_tokens) for r in packed}) >= 7 and stages["packing"](spark, frame.limit(0), str(tmp_path)).count() == 0
    named = frame.selectExpr("*", *[f"{k} as {c}" for k, c in enumerate(("__id", "__row", "kept", "key", "LOG_WEIGHT", "tag", "bucket"))])
    for stage, n in (("quality", None), ("near_dedup", 7), ("repeats", 10)):
        out = stages[stage](spark, named, str(tmp_path))
        assert out.columns == named.columns and out.count() in (n, n or stages[stage](spark, frame, str(tmp_path)).count())
