"""Byte-level BPE by dynamic programming over prefixes, and decoding.

BPE gives every prefix of a pre-token one encoding, and the encoding of a
longer prefix is that of a shorter one and one more token. So it is enough to
store each prefix's last token. An automaton lists the tokens that end at a
place; the one that belongs there is the one that can stand beside the last
token of the prefix before it. Back-pointers from the end give the ids. Work
grows with the length of a pre-token, whatever it holds.

Two tokens can stand side by side if no merge would have crossed their border.
At any time one piece of each token lies at the border; taking back the latest
merge of the two, again and again, meets every pair of pieces that lay there
together, and no such pair may be a merge of an earlier rank than what made
the pieces disappear.

Tasks need nothing from each other: no shuffle, and the file's path is all that
is sent. Distinct pre-tokens of a slice are encoded once, and a task remembers
a bounded number of them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import map_arrow, slices
from .pretokens import distinct, parts, ragged, split

#: Pre-tokens and pairs of tokens that a task remembers before it starts over; longer pre-tokens are not remembered.
REMEMBERED, PAIRS, SHORT = 200_000, 2_000_000, 64


@cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: a printable byte is its own, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """The tokens of one tokenizer file.

    Tokens go by their rank here: single bytes below 256, then merges in the
    file's order, which is the order in which BPE applies them. ``ids`` gives
    the file's id of a rank.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        split_as_known = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        if not plain or not split_as_known or spec.get("normalizer") or (spec.get("decoder") or {}).get("type") != "ByteLevel" or any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec.get("added_tokens") or []):
            raise ValueError("only byte-level BPE files without a normaliser, a prefix space or stripping added tokens are read")
        letters, vocab = byte_letters(), model["vocab"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        rank = {c: b for c, b in letters.items()}
        for k, (a, z) in enumerate(merges):
            if rank.setdefault(a + z, 256 + k) != 256 + k:
                raise ValueError("a token that two merges make is not read")
        self.pairs, self.left, self.right = {}, list(range(256)), list(range(256))
        self.bytes: list[bytes] = [bytes([b]) for b in range(256)]
        self.ids = np.array([vocab[c] for c in sorted(letters, key=letters.get)] + [vocab[a + z] for a, z in merges], np.uint32)
        for k, (a, z) in enumerate(merges):
            x, y = rank[a], rank[z]
            self.pairs[x, y] = 256 + k
            self.left.append(x)
            self.right.append(y)
            self.bytes.append(self.bytes[x] + self.bytes[y])
        self.automaton, reached = ahocorasick.Automaton(), [True] * 256
        for t in range(len(self.bytes)):
            if t >= 256:  # a token that its own bytes would not be encoded as never ends a prefix
                x, y = self.left[t], self.right[t]
                reached.append(reached[x] and reached[y] and self.beside(x, y, t))
            if reached[t]:
                self.automaton.add_word(self.bytes[t].decode("latin-1"), (t, len(self.bytes[t])))
        self.automaton.make_automaton()
        # an added token stands for its bytes, unless all of its letters stand for bytes
        text = {i: bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode() for s, i in self.special.items()}
        known = dict(zip(self.ids.tolist(), self.bytes, strict=True)) | text
        rows = [known.get(i, b"") for i in range(max(known) + 1)]
        self.values, self.offsets = np.frombuffer(b"".join(rows), np.uint8), np.append(0, np.cumsum([len(x) for x in rows]))
        self.marks = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, np.ndarray] = {}

    def beside(self, x: int, y: int, limit: int = 1 << 40) -> bool:
        """Whether no merge below ``limit`` crosses the border of tokens x and y.

        Of two merges of one rank the one further left comes first, so the
        piece on the left is gone before a merge of the rank that takes it, and
        the piece on the right is not.
        """
        while True:
            if self.pairs.get((x, y), limit) < limit:
                return False
            if x > y:
                if x < 256:
                    return True
                limit, x = x, self.right[x]
            else:
                if y < 256:
                    return True
                limit, y = y + 1, self.left[y]

    def word(self, text: str) -> np.ndarray:
        """The ids of one pre-token."""
        raw = text.encode().decode("latin-1")
        last, fits = [-1] * (len(raw) + 1), self.fits
        for at, (token, size) in self.automaton.iter(raw):
            if last[at + 1] >= 0:
                continue
            if size <= at:
                key = (last[at + 1 - size], token)
                good = fits.get(key)
                if good is None:
                    good = fits[key] = self.beside(*key)
                if not good:
                    continue
            last[at + 1] = token
        if len(fits) > PAIRS:
            fits.clear()
        out, at = [], len(raw)
        while at:
            out.append(last[at])
            at -= len(self.bytes[last[at]])
        return self.ids[out[::-1]]

    def words(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = []
        for text in texts:
            ids = self.known.get(text)
            if ids is None:
                ids = self.word(text)
                if len(text) <= SHORT:
                    self.known[text] = ids
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the bounds of each text's."""
        pieces, owner, marks = [], [], []
        for row, text in enumerate(texts):
            cut = self.marks.split(text) if self.marks and any(x in text for x in self.special) else [text]
            for k, x in enumerate(cut):
                marks.append(self.special[x] if k % 2 else -1)
                pieces.append("" if k % 2 else x)
                owner.append(row)
        ids, size = [np.zeros(0, np.uint32)], np.zeros(len(pieces), np.int64)
        for part in parts(pieces):
            joined, start, end, hashed, row = split([x for _, x in part], True)
            if len(row):
                _, words, number = distinct(joined, start, end, hashed)
                own = self.words(words)
                flat, sizes = ragged(np.concatenate(own), np.append(0, np.cumsum([len(x) for x in own])), number)
                ids.append(flat)
                size += np.bincount(np.array([r for r, _ in part])[row], weights=sizes, minlength=len(pieces)).astype(np.int64)
        flat, marked = np.concatenate(ids), np.array(marks)
        special = np.flatnonzero(marked >= 0)
        if len(special):
            flat = np.insert(flat, np.append(0, np.cumsum(size))[special], marked[special].astype(np.uint32))
            size[special] = 1
        return flat, np.append(0, np.cumsum(np.bincount(np.array(owner, np.int64), weights=size, minlength=len(texts)).astype(np.int64)))

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special ones too; bytes that are no character are replaced."""
        return ragged(self.values, self.offsets, ids)[0].tobytes().decode("utf-8", "replace")


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    for part in slices(batch, "text"):
        yield part.column("id"), [x or "" for x in part.column("text").to_pylist()]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row of ``docs``, as the tokenizers library encodes without adding special tokens.

    A special token's own text becomes that token, as there. A null or empty
    text has no ids. Rows that repeat an id each get a row, a null id stays
    null, and other columns are ignored, whatever their names.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batch):
            flat, bounds = encoder(path).encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids, lists], names=["id", "ids"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(own, run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of ``ids`` lists; null is no ids, and an id that the file lacks stands for nothing."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = encoder(path)
        texts = [found.decode(own[(own >= 0) & (own < len(found.offsets) - 1)]) for own in (np.array(x, np.int64) for x in batch.column("ids").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    own = encoded.select(F.col(id_col).cast("long").alias("id"), F.filter(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda x: x.isNotNull()).alias("ids"))
    return map_arrow(own, run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the number of ids, a digest of the ids and a digest of the text that they decode to; rows as in :func:`encode_texts`.

    Both ways are taken in one task, so that ids need not leave it.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = encoder(path)
        for ids, texts in _texts(batch):
            flat, bounds = found.encode(texts)
            flat, each = flat.astype("<u4"), list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            ids_sha = [hashlib.sha256(flat[a:z].tobytes()).hexdigest() for a, z in each]
            decoded = [hashlib.sha256(found.decode(flat[a:z]).encode()).hexdigest() for a, z in each]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(own, run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
