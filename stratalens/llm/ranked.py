"""Ranked lexical search by sort-based accumulation.

Texts are read once and leave the postings of the terms that some query has:
per document the terms' numbers and how often they occur. Their counts give the
weights. A task then owns a range of the documents, as they lie in their
partitions: it puts the (query, document) pairs of all matched terms end to
end with their impacts, sorts the packed pairs by radix, sums runs of equal
pairs, and keeps a heap of the best documents of each query. No pair of one
range occurs in another, so heaps are all that ranges send each other.

Queries come in blocks of a bounded number of (query, term) pairs; the terms of
one block are what is sent to all tasks, and each block reads the texts again.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import materialise, partitions, slices
from .hashing import range_hashes, terms
from .pretokens import ragged

#: Documents returned for each query; how much length counts, in hundredths; how fast repeats of a term count less, in tenths.
TOP, LENGTH_SHARE, DAMPING = 50, 50, 20
#: (query, term) pairs of a block of queries; matched pairs that a task sums at a time.
BLOCK, MATCHED = 1_000_000, 2_000_000


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each row."""
    for batch in batches:
        for part in slices(batch, "text"):
            raw, start, end, hashed, bounds = terms(part.column("text"))
            row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            _, first = np.unique(np.stack([row.astype(np.uint64), hashed]), axis=1, return_index=True)
            data = raw.tobytes()
            words = [data[a:z].decode() for a, z in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row[first])), pa.array(words, pa.string())], names=["item", "term"])


class Index:
    """The terms of a block of queries: each term's number, and which queries have it."""

    def __init__(self, items: list, words: list[str]) -> None:
        self.items = sorted({*items}, key=lambda x: (x is None, x))
        self.words = {w.encode(): k for k, w in enumerate(sorted({*words}))}
        place = {x: k for k, x in enumerate(self.items)}
        term, item = np.array([self.words[w.encode()] for w in words], np.int64), np.array([place[x] for x in items], np.int64)
        order = np.lexsort((item, term))
        self.queries, self.offsets = item[order], np.searchsorted(term[order], np.arange(len(self.words) + 1))
        every = b"".join(self.words)
        sizes = np.array([len(w) for w in self.words], np.int64)
        ends = np.cumsum(sizes)
        self.hashes = np.sort(range_hashes(np.frombuffer(every, np.uint8), ends - sizes, ends))

    def numbers(self, raw: bytes, start: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """The number of each of the distinct terms, -1 for those that no query has; hashes are compared first, then the bytes."""
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        out = np.full(len(hashed), -1, np.int64)
        for k in np.flatnonzero(self.hashes[at] == hashed).tolist():
            out[k] = self.words.get(raw[start[k] : end[k]], -1)
        return out


def _postings(index) -> object:
    """Per document with terms their number, and the numbers and occurrences of those that a query has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            for part in slices(batch, "text"):
                raw, start, end, hashed, bounds = terms(part.column("text"))
                count = np.diff(bounds)
                row = np.repeat(np.arange(len(count)), count)
                keys, first, which = np.unique(hashed, return_index=True, return_inverse=True)
                number = known.numbers(raw.tobytes(), start[first], end[first], keys)[which]
                found = np.flatnonzero(number >= 0)
                pair, times = np.unique(row[found] * len(known.words) + number[found], return_counts=True)
                cuts = np.searchsorted(pair // len(known.words), np.arange(len(count) + 1)).astype(np.int32)
                numbers, occurs = (pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (pair % len(known.words), times))
                some = pa.array(count > 0)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(count, pa.int64()), numbers, occurs], names=["id", "n", "terms", "times"]).filter(some)

    return run


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of non-negative numbers, digit by digit of 16 bits from the lowest; equal ones stay in their order."""
    order, top = np.arange(len(keys)), int(keys.max()) if len(keys) else 0
    for shift in range(0, top.bit_length(), 16):
        digit = ((keys >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]  # of 16-bit numbers this is a radix sort
    return order


class Best:
    """The best documents of each query so far; rows that can't be among them any more are left out."""

    def __init__(self, queries: int, top: int) -> None:
        self.queries, self.top, self.least = queries, top, np.ones(queries, np.int64)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows, self.limit = 0, max(4 * queries * top, 200_000)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray, missing: np.ndarray) -> None:
        good = score >= self.least[query]
        self.held.append((query[good], score[good], doc[good], missing[good]))
        self.rows += int(good.sum())
        if self.rows > self.limit:
            self.select()

    def select(self) -> tuple[np.ndarray, ...]:
        query, score, doc, missing = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64),) * 4
        order = radix_order(query)
        bounds, kept = np.searchsorted(query[order], np.arange(self.queries + 1)).tolist(), []
        ranks = list(zip((-score[order]).tolist(), missing[order].tolist(), doc[order].tolist(), order.tolist(), strict=True))
        for k, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            best = heapq.nsmallest(self.top, ranks[a:z])
            kept += [x[3] for x in best]
            if len(best) == self.top:
                self.least[k] = -best[-1][0]
        picked = np.array(kept, np.int64)
        self.held = [(query[picked], score[picked], doc[picked], missing[picked])]
        self.rows = len(picked)
        return self.held[0]


def _damped(n: np.ndarray, documents: int, total: int, length_share: int) -> np.ndarray:
    """A document's length against the mean one, in hundredths, of which ``length_share`` count."""
    if int(n.max(initial=0)) * length_share * documents < 1 << 63:
        return 100 - length_share + (length_share * documents * n) // total
    return 100 - length_share + np.array([(length_share * documents * x) // total for x in n.tolist()], np.int64)


def _accumulate(index, weights, documents: int, total: int, top: int, length_share: int, damping: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        best, per_term = Best(len(known.items), top), np.diff(known.offsets)
        for batch in batches:
            term, times = (batch.column(x).flatten().to_numpy().astype(np.int64) for x in ("terms", "times"))
            count = np.diff(batch.column("terms").offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), count)
            length = _damped(batch.column("n").to_numpy(), documents, total, length_share)
            impact = weights.value[term] * ((1_000_000_000 * times) // (1000 * times + damping * length[row]))
            doc, missing = batch.column("id").fill_null(0).to_numpy(), batch.column("id").is_null().to_numpy(zero_copy_only=False)
            matched = np.cumsum(np.bincount(row, weights=per_term[term], minlength=batch.num_rows)).astype(np.int64)
            posting, start = np.append(0, np.cumsum(count)), 0
            while start < batch.num_rows:
                before = int(matched[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(matched, before + MATCHED, "right")))
                own = slice(posting[start], posting[stop])
                query, sizes = ragged(known.queries, known.offsets, term[own])
                if len(query):
                    pair = query * (stop - start) + np.repeat(row[own] - start, sizes)
                    order = radix_order(pair)
                    pair, points = pair[order], np.repeat(impact[own], sizes)[order]
                    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                    score, at = np.add.reduceat(points, first), pair[first] % (stop - start) + start
                    best.add(pair[first] // (stop - start), score, doc[at], missing[at])
                start = stop
        query, score, doc, missing = best.select()
        items = pa.array([known.items[k] for k in query.tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([items, pa.array(doc, pa.int64(), mask=missing.astype(bool)), pa.array(score, pa.int64())], names=["item", "doc", "score"])

    return run


def _first(rows: DataFrame, top: int, *groups: str) -> DataFrame:
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("doc")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= top)


def _search_block(texts: DataFrame, pairs: DataFrame, top: int, length_share: int, damping: int) -> DataFrame:
    """The candidates of one block's queries: the best of each range of documents."""
    context, own = texts.sparkSession.sparkContext, pairs.toPandas()
    index = context.broadcast(Index([None if x != x else int(x) for x in own["item"].tolist()], own["term"].tolist()))
    postings = materialise(texts.mapInArrow(_postings(index), "id long, n long, terms array<int>, times array<int>"))
    size = postings.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
    # no more rows than the block has terms
    holders = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(max(1, len(index.value.words)), np.int64)
    for r in holders:
        weights[r["term"]] = math.floor(1000 * math.log((2 * size["documents"] + 2) / (2 * r["count"] + 1)))
    run = _accumulate(index, context.broadcast(weights), size["documents"], size["total"] or 1, top, length_share, damping)
    return materialise(postings.select("id", "n", "terms", "times").mapInArrow(run, "item long, doc long, score long"))


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text: str = "text", top: int = TOP, length_share: int = LENGTH_SHARE, damping: int = DAMPING) -> DataFrame:
    """(query id, rank, document id, score): the ``top`` best documents of each query, scores above 0 only.

    Terms are runs of ASCII letters and digits and of all other characters
    beyond ASCII; A-Z are lower-cased and nothing else. A null text has none. A
    query's terms count once each; rows that repeat a query's id are one query
    with the terms of all, a null id among them. Rows that repeat a document's
    id are a document each; a null document id comes after the others of its
    score. Queries without terms, or whose terms no document has, return
    nothing, and so do empty tables. Other columns are ignored, whatever their
    names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = queries.select(F.col(query_col).cast("long").alias("id"), F.col(query_text).alias("text"))
    pairs = materialise(asked.mapInArrow(_query_terms, "item long, term string").distinct())
    blocks = -(-pairs.count() // BLOCK)
    block = F.pmod(F.xxhash64("item"), F.lit(max(1, blocks)))
    parts = [_search_block(texts, pairs.where(block == r["block"]), top, length_share, damping) for r in pairs.select(block.alias("block")).distinct().collect()]
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "item long, doc long, score long")
    # ranges of documents meet in two steps, so that a query's last step is as large as the root of their number
    some = math.isqrt(partitions(spark)) + 1
    found = _first(found.withColumn("group", F.spark_partition_id() % some), top, "item", "group").drop("rank")
    return _first(found.repartitionByRange(partitions(spark), "item"), top, "item").select(F.col("item").alias(query_col), "rank", F.col("doc").alias(id_col), "score")
