"""MinHash near-duplicates: one-permutation hashing with optimal densification.

Each distinct shingle set gets one 128-bin signature; empty bins borrow from
filled ones along a fixed random order of their own. Bands of four bins give
buckets, each bucket offers only a star of edges to its smallest member, and
every edge is confirmed on the full shingle sets. Buckets whose members are
not yet in one component are then compared block by block on their signatures,
so that no link is lost because the star's centre was the wrong member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .core import free, map_arrow, materialise, partitions, slices
from .hashing import jaccard, mix, shingle_sets

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Members of a bucket that one task compares with as many others at a time.
BLOCK = 1024
#: Ids of unconfirmed pairs up to which the texts are filtered by a broadcast before they are shuffled.
BROADCAST_IDS = 4_000_000
#: How far the share of equal bins may fall short of the threshold before a pair is left unconfirmed: six deviations.
SLACK = 6 * (0.75 * 0.25 / BINS) ** 0.5
#: Bins of the finer signature, eight bits each, that members of mixed buckets are compared on.
FINE = 1024
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
_ORDER = np.random.default_rng(7).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)


def signature(hashes: np.ndarray, edges: np.ndarray = _EDGES, order: np.ndarray = _ORDER) -> np.ndarray:
    """The densified bins of a non-empty sorted set of hashes."""
    at = np.searchsorted(hashes, edges)
    filled = np.append(at[1:], len(hashes)) > at
    out = hashes[np.minimum(at, len(hashes) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        donors = order[empty]
        out[empty] = out[donors[np.arange(len(empty)), filled[donors].argmax(axis=1)]]
    return out


def _sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text", 1_000_000):
        n, low, high, signs = [], [], [], []
        for hashes in shingle_sets(part.column("text")):
            n.append(len(hashes))
            low.append(int(hashes.sum(dtype=np.uint64).view(np.int64)))
            high.append(int(mix(hashes ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64).view(np.int64)))
            signs.append((signature(hashes) & np.uint64(0xFFFF)).astype(np.uint16).tobytes() if len(hashes) else None)
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(signs, pa.binary())],
            names=["id", "n", "low", "high", "sign"],
        )


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, low, high, sign): set size, 128-bit digest of the set, the low 16 bits of each bin."""
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), _sign, "id long, n long, low long, high long, sign binary")


@cache
def _fine() -> tuple[np.ndarray, np.ndarray]:
    return np.arange(FINE, dtype=np.uint64) << np.uint64(54), np.random.default_rng(8).permuted(np.tile(np.arange(FINE), (FINE, 1)), axis=1)


def _sign_finely(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text", 1_000_000):
        signs = [(signature(x, *_fine()) & np.uint64(0xFF)).astype(np.uint8).tobytes() for x in shingle_sets(part.column("text"))]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(signs, pa.binary())], names=["id", "fine"])


def _chosen(docs: DataFrame, ids: DataFrame, count: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of these ids: by a broadcast of bounded size, or else by a shuffle of the texts."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets are alike by ``percent`` at least."""
    ids = materialise(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    texts = _chosen(docs, ids, ids.count(), id_col, text_col)
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def check(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text_b", 1_000_000):
            keep, seen, last = [], None, None
            second = shingle_sets(part.column("text_b"))
            first = part.column("text_a")
            for i, other in enumerate(second):
                text = first[i].as_py()
                if text != seen or last is None:
                    seen, last = text, shingle_sets(pa.array([text]))[0]
                same, union = jaccard(last, other)
                keep.append(union > 0 and 100 * same >= percent * union)
            yield part.select(["a", "b"]).filter(pa.array(keep))

    return map_arrow(both.select("a", "b", "text_a", "text_b"), check, "a long, b long")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs over the floor between the components of one bucket's block; rows come sorted by key."""

    def pairs(rows: list) -> Iterator[pa.RecordBatch]:
        ids = np.array([x[1] for x in rows], np.int64)
        groups = np.array([x[2] for x in rows], np.int64)
        signs = np.frombuffer(b"".join(x[3] for x in rows), np.uint16).reshape(len(rows), BINS)
        bands = signs.view(np.uint64)
        fine = np.frombuffer(b"".join(x[7] for x in rows), np.uint8).reshape(len(rows), FINE)
        left = np.array([x[4] for x in rows], bool)
        right = np.array([x[5] for x in rows], bool)
        second = np.flatnonzero(right)
        for i in np.flatnonzero(left):
            others = second[(groups[second] != groups[i]) & (ids[second] != ids[i])]
            if len(others):
                close = others[(signs[others] == signs[i]).mean(axis=1) >= rows[0][6]]
                # low bits also agree by chance, once in 256
                close = close[(fine[close] == fine[i]).mean(axis=1) >= rows[0][8] + (1 - rows[0][8]) / 256]
                # a pair that meets in several buckets is told in the first
                close = close[(bands[close] == bands[i]).argmax(axis=1) == rows[0][9]]
                if len(close):
                    a, b = np.minimum(ids[i], ids[close]), np.maximum(ids[i], ids[close])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key and held:
                yield from pairs(held)
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield from pairs(held)


def residual_pairs(members: DataFrame, percent: int) -> DataFrame:
    """``members(band, bucket, id, component, sign, fine)`` -> pairs of a bucket, in different components, that look alike.

    Both signatures may fall short of ``percent`` by six standard deviations.

    A bucket of more than ``BLOCK`` members is cut into blocks, and each pair of
    blocks is one group, so no task holds more than two blocks of a bucket.
    """
    counts = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    spread = members.join(counts, "bucket").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sides = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = sides.select(
        F.concat_ws("-", "bucket", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id", "component", "sign",
        (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"), F.lit(percent / 100 - SLACK).alias("floor"), "fine", F.lit(percent / 100 - SLACK * (BINS / FINE) ** 0.5).alias("fine_floor"), "band",
    )
    n = partitions(members.sparkSession)
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_alike, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their
    distinct five-word shingles; component_id is the smallest id reachable and
    kept marks it. Null or blank texts have no shingles, form a component alone
    and are kept. A null id is never linked: its component_id is null and it is
    kept. Rows that repeat an id each get a row and count as one document:
    what is linked with the text of one is linked with all of them.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    signed = materialise(signatures(docs, id_col, text_col))
    sets = signed.where("n > 0 and id is not null")
    # one representative per distinct set: exact copies never enter a bucket
    distinct = materialise(sets.groupBy("n", "low", "high").agg(F.min(F.struct("id", "sign")).alias("r")).select("n", "low", "high", "r.*"))
    banded = distinct.select("id", "sign", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    banded = banded.select("id", "band", F.xxhash64("band", F.substring("sign", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("size")).where("size > 1").select("bucket", "centre")
    stars = materialise(banded.join(shared, "bucket"))
    edges = materialise(stars.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())
    links = materialise(confirm(edges, docs, id_col, text_col, percent))
    labels = connected_components(links)
    open_buckets = stars.join(labels, "id", "left").select("band", "bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed = open_buckets.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi and size > 2").select("bucket")
    members = materialise(open_buckets.join(mixed, "bucket"))
    ids = materialise(members.select("id").distinct())
    count = ids.count()
    if count:
        fine = materialise(map_arrow(_chosen(docs.where(F.col(id_col).isNotNull()), ids, count, id_col, text_col), _sign_finely, "id long, fine binary").dropDuplicates(["id"]))
        members = members.join(distinct.join(ids, "id", "left_semi").select("id", "sign").join(fine, "id"), "id")
        rest = materialise(residual_pairs(members, percent).join(edges, ["a", "b"], "left_anti"))
        more = materialise(confirm(rest, docs, id_col, text_col, percent))
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more))
    classes = distinct.select("n", "low", "high", F.col("id").alias("representative")).join(labels.withColumnRenamed("id", "representative"), "representative", "left")
    classes = classes.select("n", "low", "high", F.coalesce("component", "representative").alias("component"))
    return signed.select("id", "n", "low", "high").join(classes, ["n", "low", "high"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    Of rows that repeat that id the one whose text has the smallest hash stays,
    then the smallest by the other columns. Rows with a null id all stay.
    """
    own, whole = free(docs, "__id", "__row")
    kept = near_duplicates(docs, id_col, text_col, percent).where("kept").select(F.col(id_col).alias(own)).distinct()
    first = docs.join(kept, F.col(id_col).eqNullSafe(F.col(own)), "left_semi")
    order = F.struct(F.xxhash64(text_col), *[c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    one = first.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(own)).agg(F.min_by(F.struct(*docs.columns), order).alias(whole)).select(f"{whole}.*")
    return one.unionByName(first.where(F.col(id_col).isNull()))
