"""Harmonic packing of tokenised documents into sequences of at most 4096 ids.

Lengths fall into classes of reciprocal capacity: a bin of class j holds exactly
j pieces of at most 4096 / j ids. Long texts are cut into pieces of 4096, 2048
and 1024 ids, which fill their shares; what remains is one piece, kept whole
unless its class would waste over a sixteenth of the share, in which case the
next class's share is cut off. Workers (hash buckets of pieces, as many as the
ids call for) fill the bins of each class on their own. What a worker has left
over of all classes shares mixed bins: shares rounded up to powers of two, the
largest first, never cross the end of a bin.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import map_arrow, materialise, partitions, slices
from .pretokens import distinct, parts, ragged, split

CAPACITY, END_ID = 4096, 2
#: Pieces of a bin by class; short pieces share wider classes, so that few bins are left over.
CLASSES = (1, 2, *range(4, 17), 18, 20, 24, 28, 32, 40, 48, 64, 96, 128, 256, 512, 1024, 4096)
#: Ids of a worker.
WORKER = 2_000_000
#: Words whose ids a worker process remembers.
REMEMBERED = 500_000
_known: dict[str, bytes] = {}
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _special(path: str) -> re.Pattern:
    import json

    with open(path) as f:
        words = [x["content"] for x in json.load(f)["added_tokens"]]
    return re.compile("|".join(map(re.escape, words)) or "(?!)")


def _normalised(text: str, path: str) -> str:
    """As the tokenizer normalises; Latin-1 text is composed already and lower-cases alike everywhere."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _tokenizer(path).normalizer.normalize_str(text)
    return text.lower()


def encode_rows(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each text by the word-level vocabulary, each distinct word of the process encoded once."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    special = _special(path)
    plain = []
    for i, text in enumerate(texts):
        if "<|" in text and special.search(text):
            out[i].append(np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32))
            plain.append("")
        else:
            plain.append(_normalised(text, path))
    for part in parts(plain):
        joined, start, end, hashed, row = split([x for _, x in part], False)
        _, words, number = distinct(joined, start, end, hashed)
        if len(_known) > REMEMBERED:
            _known.clear()
        new = [w for w in words if w not in _known]
        for i in range(0, len(new), 4096):
            found = _tokenizer(path).encode_batch_fast(new[i : i + 4096], add_special_tokens=False)
            _known.update((w, array("I", x.ids).tobytes()) for w, x in zip(new[i : i + 4096], found, strict=True))
        ids = [_known[w] for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        values, count = ragged(flat, np.append(0, np.cumsum(sizes)), number)
        per_row = np.bincount(row, weights=count, minlength=len(part)).astype(np.int64)
        for (i, _), own in zip(part, np.split(values, np.cumsum(per_row)[:-1]), strict=True):
            out[i].append(own)
    return [np.concatenate([*x, [END_ID]]).astype("<u4") for x in out]


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """The class of a piece: the largest one whose share holds it."""
    most = capacity // length
    return max(j for j in CLASSES if j <= most)


def cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Sizes of the pieces: full bins, then halves and quarters, then what remains in one piece or two."""
    out, rest = [capacity] * (length // capacity), length % capacity
    for part in (capacity // 2, capacity // 4):
        if rest > capacity // 4 and rest >= part:
            out.append(part)
            rest -= part
    if rest > capacity // 16:
        j = class_of(rest, capacity)
        share = capacity // CLASSES[CLASSES.index(j) + 1]
        if 16 * rest * j < 15 * capacity:
            out.append(share)
            rest -= share
    return [*out, rest] if rest else out


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) for every piece of every document."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            names, first, size, crc, total, kept = [], [], [], [], [], []
            for i, ids in zip(part.column("id").to_pylist(), encode_rows([x or "" for x in part.column("text").to_pylist()], path), strict=True):
                at = 0
                for n in cuts(len(ids)):
                    own = ids[at : at + n]
                    names.append(i)
                    first.append(at)
                    size.append(n)
                    crc.append(zlib.crc32(own))
                    total.append(len(ids))
                    if with_ids:
                        kept.append(own.tolist())
                    at += n
            columns = [pa.array(x, pa.int64()) for x in (names, first, size, crc, total)]
            more = [pa.array(kept, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*columns, *more], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(own, run, _SCHEMA + ", ids array<int>" * with_ids)


def assign(cut: DataFrame, workers: int, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with the sequence and the offset of each piece."""
    most = F.floor(F.lit(capacity) / F.col("length"))
    number = F.lit(0)  # of the class among the classes
    for i, j in enumerate(CLASSES):
        number = F.when(most >= j, i).otherwise(number)
    placed = cut.withColumn("__worker", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(workers))).withColumn("__class", number)
    # all windows are over parts of one worker, so one exchange serves them
    placed = placed.repartition(partitions(cut.sparkSession), "__worker")
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    group = Window.partitionBy("__worker", "__class")
    per = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("__class") + 1)
    placed = placed.withColumn("__rank", F.row_number().over(group.orderBy(*order)) - 1).withColumn("__all", F.count("*").over(group))
    placed = placed.withColumn("__left", F.col("__rank") >= F.floor(F.col("__all") / per) * per)
    share = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("length").cast("double")))).cast("long")
    mixed = Window.partitionBy("__worker", "__left").orderBy(F.desc("__share"), *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("__share", share).withColumn("__at", F.sum("__share").over(mixed) - F.col("__share"))
    own = F.when(F.col("__left"), F.floor(F.col("__at") / capacity)).otherwise(F.floor(F.col("__rank") / per))
    key = (F.col("__worker") * 64 + F.when(F.col("__left"), len(CLASSES)).otherwise(F.col("__class"))) * F.lit(1 << 30) + own
    placed = placed.withColumn("sequence_id", key.cast("long"))
    inside = Window.partitionBy("__worker", "sequence_id").orderBy("__at", "__rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(*cut.columns, "sequence_id", (F.sum("length").over(inside) - F.col("length")).alias("offset"))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every id of every document in exactly one piece, and each piece's place in a sequence.

    A null or empty text is the end id alone. Rows that repeat an id are packed
    each; a null id stays null. Other columns are ignored; ``with_ids`` adds the
    ids of each piece. Sequences are to be padded to their capacity.
    """
    cut = materialise(pieces(docs, path, id_col, text_col, with_ids))
    ids = cut.agg(F.sum("length")).first()[0] or 0
    out = assign(cut, 1 + ids // WORKER)
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)
