"""Target-distribution importance resampling over an integer word dictionary.

A slice of texts gets a dictionary from its distinct words to integers, and a
run of n words is a tuple of such integers. Tuples are made distinct as
numbers; of each distinct one the bytes are put together and hashed once, and
the hash goes back to every place of the tuple. Counts of hash buckets over the
whole corpus and over the target texts give each bucket a gain, a document
weighs the mean gain of its tuples, and noise drawn from its id decides with
the weight which documents are drawn.

The dictionary is a slice's own. One for the whole corpus would shuffle every
word of every text to save hashing a word again in another slice, and the hash
is that of the bytes either way. What tasks send is a count per bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .core import map_arrow, materialise, slices
from .hashing import terms

#: Buckets of hashed runs; the longest run of words; words that a document needs to be drawn; hundredths of those that are drawn; the draw's seed.
BUCKETS, LONGEST, LEAST_WORDS, SHARE, SEED = 10_000, 1, 20, 10, 2024


def _tuples(number: np.ndarray, row: np.ndarray, n: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a run of n words of one row starts, the run's number among the distinct ones, and a place of each distinct one."""
    at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if n <= len(row) else np.zeros(0, np.int64)
    code = number[at]
    for k in range(1, n):
        # numbers of runs so far are below the count of places, so a pair of them fits into 64 bits
        code = np.unique(code, return_inverse=True)[1] * words + number[at + k]
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    return at, inverse, at[first]


def features(column: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every run of 1 to ``longest`` words, in the order of rows, and each row's number of words."""
    raw, start, end, hashed, bounds = terms(column)
    count = np.diff(bounds)
    row = np.repeat(np.arange(len(count)), count)
    known, first, number = np.unique(hashed, return_index=True, return_inverse=True)
    data = raw.tobytes()
    words = [data[a:z] for a, z in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    rows, found = [], []
    for n in range(1, longest + 1):
        at, inverse, places = _tuples(number, row, n, len(known))
        runs = np.array([zlib.crc32(b" ".join([words[number[p + k]] for k in range(n)])) % buckets for p in places.tolist()], np.int64)
        rows.append(row[at])
        found.append(runs[inverse] if len(at) else np.zeros(0, np.int64))
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(rows, kind="stable") if longest > 1 else slice(None)
    return rows[order], found[order], count


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many runs of words fall into each bucket, repeats counted; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(features(part.column("text"), longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _gathered(counts: DataFrame, buckets: int) -> list[int]:
    """The counts as a list; there are no more of them than buckets."""
    out = [0] * buckets
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: list[int], target: list[int]) -> np.ndarray:
    """Of each bucket, a thousand times the logarithm of its share of the target's runs over that of the corpus', one added to each count."""
    n, total, aimed = len(raw), sum(raw), sum(target)
    return np.array([np.floor(1000 * np.log(((t + 1) * (total + n)) / ((s + 1) * (aimed + n)))) for s, t in zip(raw, target, strict=True)]).astype(np.int64)


def document_weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(id, n_features, n_words, weight) of every row; the weight is the mean gain of the runs, rounded down, 0 without words."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            rows, found, words = features(part.column("text"), longest, len(shared.value))
            count = np.bincount(rows, minlength=part.num_rows)
            ends = np.cumsum(count)
            sums = np.append(0, np.cumsum(shared.value[found]))
            weight = (sums[ends] - sums[ends - count]) // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(count, pa.int64()), pa.array(words, pa.int64()), pa.array(weight, pa.int64())], names=["id", "n_features", "n_words", "weight"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(own, run, "id long, n_features long, n_words long, weight long")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a digest of the seed and the id; a null id has that of no digits."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score and rank.

    Of the rows with ``least_words`` words the ``share`` hundredths with the
    highest scores are drawn, equal scores by ascending id, and ranked from 1;
    other rows have no rank. A null or empty text has no features, weight 0 and
    is never drawn, unless no words are asked for. Rows that repeat an id each
    get a row and may each be drawn; a null id stays null and comes after the
    others of its score. Without target texts every bucket's gain is what its
    count in the corpus gives. Other columns are ignored, whatever their names.

    The least score that is drawn comes from counts of equal scores, which are
    whole numbers within some 10**5 of zero however large the corpus is. Only
    rows that reach it are put in order, range by range.
    """
    gain = gains(_gathered(bucket_counts(docs, text_col, longest, buckets), buckets), _gathered(bucket_counts(target, target_col, longest, buckets), buckets))
    rows = document_weights(docs, gain, id_col, text_col, longest)
    rows = materialise(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    scores = rows.where(F.col("n_words") >= least_words).groupBy("score").count().orderBy(F.desc("score")).collect()
    wanted = sum(r["count"] for r in scores) * share // 100
    least, seen = None, 0
    for r in scores:
        if seen >= wanted:
            break
        least, seen = r["score"], seen + r["count"]
    high = F.lit(False) if least is None else (F.col("n_words") >= least_words) & (F.col("score") >= least)
    drawn = numbered(rows.where(high), "rank", F.desc("score"), F.asc_nulls_last("id")).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long"))).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
