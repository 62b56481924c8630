"""Exact repeats of long byte strings, found with suffix order and backward extension.

Windows of ``length`` bytes that are equal pick the same anchor: the smallest
hash of a shorter string inside them. So anchors are sampled from every
text, counted, and only occurrences whose anchor hash occurs again go on. Each
distinct surrounding of such an anchor is one suffix with its left context.
Per group of one anchor the suffixes are sorted, their common prefixes taken,
and intervals are expanded breadth-first by one preceding byte at a time, as
in backward search on a Burrows-Wheeler transform: a stable sort by that byte
splits each interval, common prefixes follow by range minima, an interval of
one suffix ends, and extension stops where left and right reach ``length``.
Surroundings that occur twice or more are repeats outright.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import free, map_arrow, materialise, partitions, slices
from .hashing import _BASE, _CODES, _INVERSE, flat, mix, powers

#: Bytes of a string that counts as a repeat.
LENGTH = 400
#: Distinct surroundings of one anchor that one task sorts; larger groups are counted window by window.
GROUP = 16_384
#: Surroundings that occur again which an anchor's places get as a list; anchors with more are joined by surroundings.
FEW = 1024
#: Documents up to which texts are filtered by a broadcast of ids before a shuffle.
BROADCAST_IDS = 4_000_000
#: Bytes of one text handled at a time.
PIECE = 1 << 19
_NO_ID = -(1 << 63)


class Sizes(NamedTuple):
    """Bytes of a repeat, of an anchor, and of a repeat besides its anchor."""

    length: int
    gram: int
    reach: int


def sizes(length: int) -> Sizes:
    """Anchors of two fifths of the length leave about one anchor per third of it."""
    gram = max(1, 2 * length // 5)
    return Sizes(length, gram, length - gram)


def _prefix(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[raw] * powers(_BASE, len(raw)), out=out[1:])
    return out


def anchors(raw: np.ndarray, offsets: np.ndarray, z: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position, hash and surroundings' hash of every anchor of the rows end to end in ``raw``.

    Rolling sums only choose the anchors; what is compared are xxHash digests of
    the bytes. Anchors meet by their own digest and then by that of the
    surroundings, so two independent ones of 64 bits stand for equal bytes.
    """
    lengths = np.diff(offsets)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if not (lengths >= z.length).any():
        return none
    prefix = _prefix(raw)
    n, window = len(raw) - z.gram + 1, z.reach + 1
    keys = mix((prefix[z.gram:] - prefix[:-z.gram]) * powers(_INVERSE, n))
    place = np.arange(n, dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    keys = (keys & ~low) | (low - place)
    padded = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    edges = np.zeros(len(raw) + 1, np.int32)
    long = lengths >= z.length
    np.add.at(edges, offsets[:-1][long], 1)
    np.add.at(edges, (offsets[1:] - z.length + 1)[long], -1)
    valid = np.cumsum(edges)[: len(least)] > 0
    fresh = valid.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    at = np.unique((low - (least[fresh] & low)).astype(np.int64))
    row = np.searchsorted(offsets, at, "right") - 1
    left = np.minimum(z.reach, at - offsets[row])
    right = np.minimum(z.length, offsets[row + 1] - at)
    data, spans = memoryview(np.ascontiguousarray(raw)), zip(at.tolist(), left.tolist(), right.tolist(), strict=True)
    digests = [(xxhash.xxh3_64_intdigest(data[p : p + z.gram]), xxhash.xxh3_64_intdigest(data[p - m : p + n], m << 20 | n)) for p, m, n in spans]
    gram, around = np.array(digests, np.uint64).reshape(-1, 2).T
    return row, at - offsets[row], gram, around


def _pieces(raw: np.ndarray, offsets: np.ndarray, z: Sizes) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of all rows; a row over ``PIECE`` bytes is read in overlapping pieces."""
    if len(raw) <= 2 * PIECE:
        yield anchors(raw, offsets, z)
        return
    for i in range(len(offsets) - 1):
        text, found = raw[offsets[i] : offsets[i + 1]], {}
        for s in range(0, max(1, len(text) - z.length + 1), PIECE):
            # window starts s..s+PIECE; anchors and their surroundings reach further on both sides
            e = min(s + PIECE, len(text) - z.length + 1)
            a, b = max(0, s - z.reach), min(len(text), e + z.length + z.reach + z.length)
            piece = text[a:b]
            _, pos, gram, around = anchors(piece, np.array([0, len(piece)]), z)
            for p, g, c in zip((pos + a).tolist(), gram, around, strict=True):
                if (p - z.reach >= a or a == 0) and (p + z.length <= b or b == len(text)):
                    found[p] = (g, c)
        at = np.array(sorted(found), np.int64)
        yield np.full(len(at), i), at, np.array([found[p][0] for p in at.tolist()], np.uint64), np.array([found[p][1] for p in at.tolist()], np.uint64)


def _anchor_rows(batch: pa.RecordBatch, z: Sizes) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text", PIECE):
        ids, tags = part.column("id").to_numpy(), part.column("tag").to_numpy()
        for row, pos, gram, around in _pieces(*flat(part.column("text")), z):
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(tags[row]), pa.array(pos.astype(np.int32)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (gram, around))], names=["id", "tag", "pos", "h", "ctx"])


_CONTEXT = "id long, tag long, pos int, h long, single boolean, left binary, right binary"
_HIT = "id long, tag long, pos int, lo int, hi int"


def _cut(batch: pa.RecordBatch, z: Sizes) -> Iterator[pa.RecordBatch]:
    """The bytes around the wanted anchors of each text."""
    for part in slices(batch, "text"):
        ids, tags, pos, h, single, left, right = ([] for _ in range(7))
        for i, tag, text, wanted in zip(part.column("id").to_pylist(), part.column("tag").to_pylist(), part.column("text"), part.column("wanted").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            for x in wanted:
                p = x["pos"]
                ids.append(i)
                tags.append(tag)
                pos.append(p)
                h.append(x["h"])
                single.append(x["single"])
                left.append(raw[max(0, p - z.reach) : p])
                right.append(raw[p : p + z.length])
        columns = [pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(pos, pa.int32()), pa.array(h, pa.int64()), pa.array(single, pa.bool_()), pa.array(left, pa.binary()), pa.array(right, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "tag", "pos", "h", "single", "left", "right"])


def expand(groups: list[int], lefts: list[bytes], rights: list[bytes], z: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest left reach at which each suffix starts a string that occurs again; -1: none."""
    n = len(groups)
    rank = sorted(range(n), key=lambda i: (groups[i], rights[i]))
    gid = np.array([groups[i] for i in rank])
    sizes = np.array([len(rights[i]) for i in rank])
    depth = np.array([len(lefts[i]) for i in rank])
    table = np.frombuffer(b"".join(rights[i].ljust(z.length, b"\0") for i in rank), np.uint8).reshape(n, z.length)
    before = np.frombuffer(b"".join(lefts[i][::-1].ljust(z.reach, b"\0") for i in rank), np.uint8).reshape(n, z.reach)
    common = np.zeros(n, np.int64)
    if n > 1:
        unequal = table[1:] != table[:-1]
        common[1:] = np.where(unequal.any(axis=1), unequal.argmax(axis=1), z.length)
        common[1:] = np.minimum(common[1:], np.minimum(sizes[1:], sizes[:-1]))
        common[1:][gid[1:] != gid[:-1]] = 0
    minima = [common]  # minima[k][i]: the least of common[i : i + 2**k]
    while 2 << (len(minima) - 1) <= n:
        last, step = minima[-1], 1 << (len(minima) - 1)
        minima.append(np.minimum(last[:-step], last[step:]))
    least, most = np.full(n, -1), np.full(n, -1)
    act = np.arange(n)
    interval = gid.copy()
    for reach in range(z.reach + 1):
        together = interval[1:] == interval[:-1]
        a, b = act[:-1][together] + 1, act[1:][together] + 1
        power = np.frexp((b - a).astype(float))[1] - 1
        shared = np.zeros(len(act) + 1, np.int64)
        inner = np.empty(len(a), np.int64)
        for k in np.unique(power).tolist():
            of = power == k
            inner[of] = np.minimum(minima[k][a[of]], minima[k][b[of] - (1 << k)])
        shared[1:-1][together] = inner
        best = np.maximum(shared[:-1], shared[1:])
        hit = act[best >= z.length - reach]
        most[hit] = reach
        least[hit[least[hit] < 0]] = reach
        alive = (best >= z.length - depth[act]) & (depth[act] > reach)
        act, interval = act[alive], interval[alive]
        if not len(act) or reach == z.reach:
            break
        key = before[act, reach].astype(np.int64)
        order = np.lexsort((act, key, interval))
        act, key, interval = act[order], key[order], interval[order]
        interval = np.cumsum(np.append(False, (interval[1:] != interval[:-1]) | (key[1:] != key[:-1])))
        size = np.bincount(interval)[interval]
        act, interval = act[size > 1], interval[size > 1]
        if not len(act):
            break
    lo, hi = np.empty(n, np.int64), np.empty(n, np.int64)
    lo[rank], hi[rank] = least, most
    return lo, hi


def _expand_rows(batches: Iterator[pa.RecordBatch], z: Sizes) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor hash; some thousand suffixes of whole groups are expanded at a time."""
    held: list[tuple] = []

    def done() -> Iterator[pa.RecordBatch]:
        lo, hi = expand([x[3] for x in held], [x[5] for x in held], [x[6] for x in held], z)
        at = [i for i in np.flatnonzero(hi >= 0).tolist() if held[i][4]]
        places = [pa.array([held[i][k] for i in at], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*places, pa.array(lo[at], pa.int32()), pa.array(hi[at], pa.int32())], names=["id", "tag", "pos", "lo", "hi"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(held) >= 4096 and held[-1][3] != row[3]:
                yield from done()
                held.clear()
            held.append(row)
    if held:
        yield from done()


def _windows(batch: pa.RecordBatch, z: Sizes) -> Iterator[pa.RecordBatch]:
    """A digest of every window around each anchor, for groups too large to sort in one task."""
    for i, tag, pos, h, single, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        data, m = memoryview(left + right), len(left)
        reach = np.arange(max(0, z.length - len(right)), m + 1, dtype=np.int32)
        digest = np.array([xxhash.xxh3_64_intdigest(data[m - r : m - r + z.length], r) for r in reach.tolist()], np.uint64).view(np.int64)
        n = len(reach)
        columns = [np.full(n, i), np.full(n, tag), np.full(n, pos, np.int32), np.full(n, h), np.full(n, single), reach, digest]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["id", "tag", "pos", "h", "single", "reach", "digest"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), text.alias("text")).withColumn("tag", F.xxhash64("text"))


def _filtered(texts: DataFrame, ids: DataFrame, anti: bool = False) -> DataFrame | None:
    """The texts of these ids by a broadcast of bounded size, or None beyond the bound."""
    if ids.count() > BROADCAST_IDS:
        return None
    return texts.join(F.broadcast(ids), "id", "left_anti" if anti else "left_semi")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Texts (id, text, tag) and, by id and tag, the spans around anchors whose bytes repeat."""
    z = sizes(length)
    texts = _texts(docs, id_col, text_col)
    found = materialise(map_arrow(texts.where(F.octet_length("text") >= z.length), partial(_anchor_rows, z=z), "id long, tag long, pos int, h long, ctx long"))
    # tables are written before they are joined: between two plain exchanges, a hot anchor's rows can be split
    again = materialise(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    shared = materialise(found.join(again.hint("merge"), "h", "left_semi"))
    kinds = materialise(shared.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("id", "tag", "pos")).alias("at")))
    # an anchor's surroundings that occur again are few as a rule: they go to its places as a list, by one join on the anchor
    rank = F.row_number().over(Window.partitionBy("h").orderBy("ctx"))
    often = kinds.where("n > 1").select("h", "ctx").withColumn("rank", rank).where(F.col("rank") <= FEW + 1).groupBy("h").agg(F.collect_list("ctx").alias("often"))
    known = materialise(kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).join(often, "h", "left"))
    repeated = F.when(F.col("often").isNull(), False).when(F.size("often") <= FEW, F.array_contains("often", F.col("ctx")))
    placed = materialise(shared.join(known.hint("merge"), "h").select("id", "tag", "pos", "h", "ctx", "kinds", repeated.alias("repeated")))
    unclear = placed.where("repeated is null")
    if not unclear.isEmpty():
        twice = kinds.where("n > 1").select("h", "ctx", F.lit(True).alias("hit"))
        clear = unclear.join(twice, ["h", "ctx"], "left").withColumn("repeated", F.coalesce("hit", F.lit(False)))
        placed = placed.where("repeated is not null").unionByName(clear.select(*placed.columns))
    # surroundings that occur again are repeats outright; those that occur once are compared with all others of their anchor
    outright = placed.where("repeated").select("id", "tag", "pos", F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    one = kinds.where("n > 1").join(known.where("fewest = 1").select("h", "kinds"), "h").select("h", F.lit(False).alias("single"), "kinds", "at.*")
    wanted = materialise(placed.where("not repeated").select("h", F.lit(True).alias("single"), "kinds", "id", "tag", "pos").unionByName(one))
    by_text = wanted.groupBy("id", "tag").agg(F.collect_list(F.struct("pos", "h", "single")).alias("wanted"))
    some = _filtered(texts, wanted.select("id").distinct())
    around = map_arrow((texts if some is None else some).join(by_text, ["id", "tag"]).select("id", "tag", "text", "wanted"), partial(_cut, z=z), _CONTEXT)
    large = wanted.where(F.col("kinds") > GROUP).select("h").distinct()
    counted, columns = None, ["id", "tag", "pos", "h", "single", "left", "right"]
    if not large.isEmpty():
        around = materialise(around)
        digests = map_arrow(around.join(large, "h", "left_semi").select(*columns), partial(_windows, z=z), "id long, tag long, pos int, h long, single boolean, reach int, digest long")
        twice = digests.groupBy("h", "digest").agg(F.count("*").alias("n")).where("n > 1").select("h", "digest")
        counted = digests.where("single").join(twice, ["h", "digest"], "left_semi").groupBy("id", "tag", "pos").agg(F.min("reach").alias("lo"), F.max("reach").alias("hi"))
        around = around.join(large, "h", "left_anti")
    n = partitions(docs.sparkSession)
    spans = around.select(*columns).repartition(n, "h").sortWithinPartitions("h").mapInArrow(partial(_expand_rows, z=z), _HIT).unionByName(outright)
    if counted is not None:
        spans = spans.unionByName(counted)
    return texts, materialise(spans.groupBy("id", "tag").agg(F.collect_set(F.struct("pos", "lo", "hi")).alias("spans")))


def _strip(batch: pa.RecordBatch, z: Sizes) -> Iterator[pa.RecordBatch]:
    """The texts without the bytes of their spans; (-1, -1) stands for the full reach."""
    for part in slices(batch, "text"):
        size, removed, runs, kept = [], [], [], []
        for text, spans in zip(part.column("text"), part.column("spans").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            n = len(raw)
            pos = np.array([x["pos"] for x in spans])
            lo, hi = np.array([x["lo"] for x in spans]), np.array([x["hi"] for x in spans])
            lo = np.where(lo < 0, np.maximum(0, z.length - (n - pos)), lo)
            hi = np.where(hi < 0, np.minimum(z.reach, pos), hi)
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, pos - hi, 1)
            np.add.at(edge, pos - lo + z.length, -1)
            gone = np.cumsum(edge)[:n] > 0
            size.append(n)
            removed.append(int(gone.sum()))
            runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tag"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["id", "tag", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: id, tag, n_bytes, n_removed, n_spans and ``kept``, the bytes that stay.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere
    else too, in this text or another; strings never cross texts and are judged
    on the input. A null text is empty. Rows that repeat a text lose it whole if
    it has ``length`` bytes or more. ``kept`` may end inside a character. ``tag``
    is a 64-bit hash of the input text that tells rows with equal ids apart; a null id
    stays null. Other columns are ignored.
    """
    z = sizes(length)
    texts, spans = repeated_spans(docs, id_col, text_col, length)
    ids = spans.select("id").distinct()
    some, rest = _filtered(texts, ids), _filtered(texts, ids, anti=True)
    untouched = lambda x: x.select("id", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.encode("text", "UTF-8").alias("kept"))
    both = (texts if some is None else some).join(spans, ["id", "tag"], "left").select("id", "tag", "text", "spans")
    out = map_arrow(both.where("spans is not null"), partial(_strip, z=z), "id long, tag long, n_bytes long, n_removed long, n_spans long, kept binary").unionByName(untouched(both.where("spans is null")))
    if rest is not None:
        out = out.unionByName(untouched(rest))
    return out.withColumn(id_col, F.when(F.col("id") != _NO_ID, F.col("id"))).select(id_col, "tag", "n_bytes", "n_removed", "n_spans", "kept")


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """:func:`remove_repeats` with a SHA-256 of the bytes that stay in their place, and the text that they leave.

    In ``text``, bytes of a character that was cut through are left out; a null text is empty.
    """
    out = remove_repeats(docs, id_col, text_col, length)
    return out.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), _whole(F.col("kept")).alias("text"))


def _whole(kept: Column) -> Column:
    """The bytes as text, without those of characters that were cut through."""
    text = kept.cast("string")
    return F.coalesce(F.try_validate_utf8(text), F.regexp_replace(F.make_valid_utf8(text), "\uFFFD", ""))


def strip_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeats taken out of the text; bytes of a character that was cut through go too.

    Rows are matched by id and text, so rows that repeat both get the same text;
    a null text stays null.
    """
    own_id, own, tag, stays = free(docs, "__id", "__own", "__tag", "__kept")
    kept = remove_repeats(docs, id_col, text_col, length).where("n_removed > 0")
    kept = kept.groupBy(F.col(id_col).alias(own_id), F.col("tag").alias(tag)).agg(F.first("kept").alias(stays))
    tagged = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = tagged.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.col(own) == F.col(tag)), "left")
    text = F.when(F.col(stays).isNull(), F.col(text_col)).otherwise(_whole(F.col(stays)))
    return joined.withColumn(text_col, text).select(*docs.columns)
