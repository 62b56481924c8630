"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding by the token-byte table.

Texts are split into pre-tokens in blocks. A block keeps, for each text, the
positions of its pre-tokens as numbers into the block's own word list, and
explodes that list into rows keyed by a hash bucket of the word. All blocks'
words meet in their bucket, each distinct word is encoded once there, and its
ids go back to the blocks, where every text is reassembled by position.
Decoding joins the ids with the table of token bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import partitions, slices
from .pretokens import distinct, parts, ragged, split

#: Code points of a block; more texts start a new one. Bytes read, and code points split, at a time: a task's memory, not its result.
BLOCK, SLICE, PART = 1 << 22, 2_000_000, 1 << 18
_SCHEMA = "block long, kind int, bucket int, id long, n long, data binary"
_NAMES = ["block", "kind", "bucket", "id", "n", "data"]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes end to end, and the offset of each id's."""
    by_id = {i: b for b, i in _ranks(path).items()}
    rows = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return np.frombuffer(b"".join(rows), np.uint8), np.append(0, np.cumsum([len(x) for x in rows]))


@cache
def _decimal(path: str) -> list[str]:
    return [str(i) for i in range(len(token_bytes(path)[1]))]


def _pack(*arrays: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, compressed."""
    raw = b"".join(np.uint32(len(a)).tobytes() + np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    while at < len(raw):
        n = int(raw[at : at + 4].view("<u4")[0])
        out.append(np.ascontiguousarray(raw[at + 4 : at + 4 + 4 * n].reshape(4, n).T).view("<u4").ravel())
        at += 4 + 4 * n
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _block(ids: list, texts: list[str], buckets: int, words_wanted: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one block: of kind 1 with its words by bucket, or of kind 0 with each text's word numbers.

    The block's key is a hash of its ids and texts, so were rows to come in
    another order, its words would be missed, not mistaken.
    Blocks of equal ids and texts share a key and have equal words.
    """
    digest = hashlib.blake2b(digest_size=8)
    for i, text in zip(ids, texts, strict=True):
        digest.update(f"{i} {len(text)} ".encode() + text.encode())
    key = int.from_bytes(digest.digest(), "little", signed=True)
    hashes, owners, known = [], [], {}
    for part in parts(texts, PART):
        joined, start, end, hashed, row = split([x for _, x in part], True)
        keys, words, _ = distinct(joined, start, end, hashed)
        if words_wanted:
            known.update(zip(keys.tolist(), words, strict=True))
        hashes.append(hashed)
        owners.append(np.array([r for r, _ in part])[row])
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    keys, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    frequent = np.argsort(-count, kind="stable")
    number = np.empty(len(keys), np.int64)
    number[frequent] = np.arange(len(keys))
    if words_wanted:
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((number, bucket))
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            mine = order[bounds[b] : bounds[b + 1]]
            if len(mine):
                words = [known[k].encode() for k in keys[mine].tolist()]
                sizes = _pack(number[mine], np.array([len(x) for x in words]))
                rows.append((key, 1, b, None, len(sizes), sizes + zstandard.ZstdCompressor(level=3).compress(b"".join(words))))
        if rows:
            yield _rows(rows)
        return
    per_text = np.bincount(np.concatenate(owners), minlength=len(texts)) if owners else np.zeros(len(texts), np.int64)
    cuts = np.append(0, np.cumsum(per_text))
    numbers = number[inverse]
    for i in range(0, len(texts), 512):
        yield _rows([(key, 0, -1, ids[j], int(per_text[j]), _pack(numbers[cuts[j] : cuts[j + 1]])) for j in range(i, min(i + 512, len(texts)))])


def _to_blocks(buckets: int, words_wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, total = [], [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(text or "")
                    total += len(texts[-1])
                    if total >= BLOCK:
                        yield from _block(ids, texts, buckets, words_wanted)
                        ids, texts, total = [], [], 0
        if texts:
            yield from _block(ids, texts, buckets, words_wanted)

    return run


def _encode_words(path: str, pattern: str):
    """Rows come sorted by bucket; each distinct word of a bucket is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bucket, done = _encoding(path, pattern).encode_ordinary, None, {}
        for batch in batches:
            rows = []
            for key, _, b, _, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    bucket, done = b, {}
                number, sizes = _unpack(data[:n])
                text, at, out = zstandard.ZstdDecompressor().decompress(data[n:]), 0, []
                for size in sizes.tolist():
                    word = text[at : at + size]
                    at += size
                    ids = done.get(word)
                    if ids is None:
                        ids = done[word] = encode(word.decode())
                    out.append(ids)
                flat = np.array([x for ids in out for x in ids], np.uint32)
                rows.append((key, 1, b, None, 0, _pack(number, np.array([len(x) for x in out]), flat)))
            if rows:
                yield _rows(rows)

    return run


def _assemble(path: str):
    """Rows come sorted by block, its words before its texts; blocks that share a key have the same words, which count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, table, values, offsets = None, {}, None, None
        for batch in batches:
            ids, sequences = [], []
            for key, kind, b, i, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != block:
                    block, table, values = key, {}, None
                if kind:
                    if b not in table:
                        table[b] = _unpack(data)
                    continue
                if values is None:
                    if not table and n:
                        raise RuntimeError("a block's words are missing; rows said to be in order came in another one when they were read again")
                    number = np.concatenate([x[0] for x in table.values()] or [np.zeros(0, np.uint32)])
                    sizes = np.concatenate([x[1] for x in table.values()] or [np.zeros(0, np.uint32)]).astype(np.int64)
                    flat = np.concatenate([x[2] for x in table.values()] or [np.zeros(0, np.uint32)])
                    order = np.argsort(number)
                    values, _ = ragged(flat, np.append(0, np.cumsum(sizes)), order)
                    offsets, table = np.append(0, np.cumsum(sizes[order])), {}
                ids.append(i)
                sequences.append(ragged(values, offsets, _unpack(data)[0])[0].astype(np.int32))
            if ids:
                bounds = np.append(0, np.cumsum([len(x) for x in sequences])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sequences)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], names=["id", "ids"])

    return run


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, ids_sha, decoded_sha = [], [], []
            for ids in batch.column("ids"):
                own = ids.values.to_numpy()
                count.append(len(own))
                decimal = _decimal(path)
                ids_sha.append(hashlib.sha256(" ".join([decimal[x] for x in own.tolist()]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decode(own, path)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def decode(ids: np.ndarray, path: str) -> bytes:
    """The bytes of the ids, by the token-byte table."""
    values, offsets = token_bytes(path)
    return ragged(values, offsets, ids)[0].tobytes()


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", in_order: bool = False) -> DataFrame:
    """(id, ids array<int>) for every row of ``docs``, as the library encodes ordinary text.

    A null or empty text has no ids. Rows that repeat an id each get a row and a
    null id stays null. Other columns are ignored. The texts are read twice and
    must come in one order both times, also when a lost task is run again:
    partitions are sorted for that, unless ``in_order`` says that rows come
    straight from files.
    """
    n = partitions(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not in_order:
        own = own.sortWithinPartitions("id", F.xxhash64("text"), "text")
    words = own.mapInArrow(_to_blocks(n, True), _SCHEMA).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(path, pattern), _SCHEMA)
    joined = own.mapInArrow(_to_blocks(n, False), _SCHEMA).unionByName(words).repartition(n, "block").sortWithinPartitions("block", F.desc("kind"))
    return joined.mapInArrow(_assemble(path), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes) of ``ids`` lists by a join with the token-byte table, which is shipped to every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x.values.to_numpy(), path) for x in batch.column(1)], pa.binary())], names=["id", "bytes"])

    return encoded.select(F.col(id_col).alias("id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "id long, bytes binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", in_order: bool = False) -> DataFrame:
    """Per row the number of ids, a digest of the ids and a digest of the bytes that they decode to, as of :func:`encode_texts`."""
    encoded = encode_texts(docs, path, pattern, id_col, text_col, in_order).select(F.col(id_col).alias("id"), "ids")
    return encoded.mapInArrow(_digests(path), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
