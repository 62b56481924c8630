"""Quality classifier by importance resampling over hashed n-grams.

Two generative models say in what share of texts a hashed feature occurs: one
of target text (labelled good and not toxic), one of the raw corpus, counted
over all documents. A document's log weight is the sum of log(p_target / p_raw)
over its distinct features, of either sign. Each log ratio is shrunk by how
surely the labels tell target from raw text at that feature: with z the
deviation of the feature's labelled target count from what its labelled count
gives, by max(0, 1 - (SURE / z)**2). So rare words, and those of a group of
copies, weigh little or nothing, as nothing is known about them.

Keys are log weight / temperature plus Gumbel noise, and the k largest keys are
kept, which draws k documents without replacement in proportion to their
weights; k is the number of documents whose weight is at least that of all but
a hundredth of the labelled target ones.

Features: each word in lower case, and trigrams of word shapes (upper case,
digits, punctuation, or the same word again), which carry what is wrong with
shouted, tabular and repetitive text whatever its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import free, map_arrow, materialise, slices
from .hashing import mix
from .pretokens import distinct, parts, split

#: Buckets of hashed features; deviations under which a feature says nothing; what is added to counts.
BUCKETS, SURE, SMOOTHING = 1 << 20, 2.0, 0.5
#: Bytes of text handled at a time, and code points that are split at a time: a task's memory, not its result.
SLICE, PART = 1_000_000, 1 << 18
#: Share of the labelled target documents that may weigh less than what is drawn; how much the noise counts.
LEAVE, TEMPERATURE = 0.01, 0.5
SAME, LOWER, UPPER, DIGIT = 0, 1, 2, 3


def _shape(word: str) -> int:
    if word.isnumeric():
        return DIGIT
    if word[0].isalpha():
        return UPPER if len(word) > 1 and word.isupper() else LOWER
    return 4 + sum(ord(c) << (21 * i) for i, c in enumerate(word[:2]))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of the distinct features of each text."""
    rows_of, keys_of = [], []
    for part in parts(texts, PART):
        joined, start, end, hashed, row = split([x for _, x in part], False)
        if not len(row):
            continue
        _, words, number = distinct(joined, start, end, hashed)
        rows = np.array([r for r, _ in part])
        lower = [w.lower() for w in words]
        word = np.array([xxhash.xxh64_intdigest(w) for w in lower], np.uint64)
        kind, again = np.array([_shape(w) for w in words], np.uint64)[number], word[number]
        repeat = np.zeros(len(row), bool)
        repeat[1:] = (again[1:] == again[:-1]) & (row[1:] == row[:-1]) & (kind[1:] != DIGIT)
        kind = np.where(repeat, np.uint64(SAME), kind)
        inside = np.flatnonzero(row[2:] == row[:-2])
        three = mix(mix(mix(kind[inside] + np.uint64(11)) + kind[inside + 1]) + kind[inside + 2])
        # shapes are few and words many: both are made distinct by number before they are by hash
        pairs = np.unique(row * len(words) + number)
        shapes, which = np.unique(three, return_inverse=True)
        more = np.unique(row[inside] * max(1, len(shapes)) + which)
        rows_of += [rows[pairs // len(words)], rows[more // max(1, len(shapes))]]
        keys_of += [word[pairs % len(words)], shapes[more % max(1, len(shapes))] if len(shapes) else shapes]
    if not rows_of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, key = np.concatenate(rows_of), (mix(np.concatenate(keys_of)) % np.uint64(BUCKETS)).astype(np.int64)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))
    return row[first], key[first]


def packed(row: np.ndarray, key: np.ndarray, n: int) -> pa.Array:
    """The features of each of n rows as bytes, three to a bucket."""
    ends = np.append(0, 3 * np.cumsum(np.bincount(row, minlength=n))).astype(np.int32)
    data = np.ascontiguousarray(key.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of what :func:`packed` wrote."""
    row = np.repeat(np.arange(len(column)), pc.binary_length(column).to_numpy(zero_copy_only=False) // 3)
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 3).astype(np.int64)
    return row, data[:, 0] | data[:, 1] << 8 | data[:, 2] << 16


def featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, drawn, features) of every row as written: texts are read once, and from then on stand for their features."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", SLICE):
            row, key = features([x or "" for x in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("drawn"), packed(row, key, part.num_rows)], names=["id", "drawn", "features"])

    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("drawn"), F.col(text_col).alias("text"))
    return materialise(map_arrow(own, run, T.StructType([*own.schema.fields[:2], T.StructField("features", T.BinaryType())])))


def _count_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and bucket, target and other labelled documents that have it."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for part in slices(batch, "features", SLICE):
            row, key = unpacked(part.column("features"))
            target = part.column("target").to_numpy(zero_copy_only=False)[row]
            counts += np.bincount(key[target], minlength=BUCKETS), np.bincount(key[~target], minlength=BUCKETS)
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["key", "target", "other"])


_SLICES, _PARTS = 32, "slice int, documents long, counts binary"


def _parts(counts: list[np.ndarray], documents: list[int], numbers: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(documents, pa.int64()), pa.array([x.tobytes() for x in counts], pa.binary())], names=["slice", "documents", "counts"])


def _count_raw(wanted: np.ndarray):
    """Per task, in how many documents each wanted bucket is, as a few arrays; and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, total = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in slices(batch, "features", SLICE):
                raw += np.bincount(unpacked(part.column("features"))[1], minlength=BUCKETS)
                total += part.num_rows
        yield _parts(np.array_split(raw[wanted], _SLICES), [total] * _SLICES, list(range(_SLICES)))

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each slice's arrays, one after another."""
    sums: dict[int, np.ndarray] = {}
    totals: dict[int, int] = {}
    for batch in batches:
        for k, n, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(counts, np.int64)
            totals[k] = totals.get(k, 0) + n
    if sums:
        yield _parts(list(sums.values()), list(totals.values()), list(sums))


def targets(labels: DataFrame) -> DataFrame:
    """(__label, target) of all labelled ids: whether good and not toxic."""
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return own.select(F.col("doc_id").alias("__label"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("target"))


def log_ratios(target, other, raw, targets: int, others: int, documents: int):
    """The shrunk log ratios of features from their counts, and the numbers of target, other and all documents."""
    share = targets / (targets + others)
    expected = (target + other) * share
    z = (target - expected) / np.sqrt(expected * (1 - share) + SMOOTHING)
    shrink = np.maximum(0.0, 1 - (SURE / np.maximum(np.abs(z), 1e-9)) ** 2)
    return np.log((target + SMOOTHING) / (raw * (targets / documents) + SMOOTHING)) * shrink


def fit(rows: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """The log ratio of every bucket from rows of :func:`featured`; None without labels of both kinds.

    Labels grow with the documents, so they are dealt by id at any size and
    never broadcast; features are what comes to them, not texts. What reaches the driver is bounded by the number of buckets, whatever the
    input's size: buckets at which the labels say something.
    """
    labelled = rows.join(targets(labels).hint("merge"), F.col("id") == F.col("__label")).select("features", "target")
    n = labelled.agg(F.count_if("target").alias("target"), F.count_if(~F.col("target")).alias("other")).first()
    if not n["target"] or not n["other"]:
        return None
    share = n["target"] / (n["target"] + n["other"])
    expected = (F.col("target") + F.col("other")) * share
    sums = labelled.mapInArrow(_count_labelled, "key long, target long, other long").groupBy("key").agg(F.sum("target").alias("target"), F.sum("other").alias("other"))
    found = sums.where(F.abs(F.col("target") - expected) > SURE * F.sqrt(expected * (1 - share) + SMOOTHING)).toPandas().sort_values("key")
    keys = found["key"].to_numpy(np.int64)
    counted = rows.select("features").mapInArrow(_count_raw(keys), _PARTS).repartition(_SLICES, "slice").mapInArrow(_add_up, _PARTS).orderBy("slice").collect()
    raw = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in counted])
    model = np.zeros(BUCKETS)
    model[keys] = log_ratios(found["target"].to_numpy(), found["other"].to_numpy(), raw, n["target"], n["other"], counted[0]["documents"])
    return model


def scored(docs: DataFrame, model: np.ndarray | None, text_col: str = "text", name: str = "log_weight") -> DataFrame:
    """``docs`` with its log weight as the column ``name``, which must be free; a null or blank text has 0."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, batch.schema.names[text_at], SLICE):
            row, key = features([x or "" for x in part.column(text_at).to_pylist()])
            # of no features at all numpy counts in whole numbers
            weight = np.bincount(row, weights=shared.value[key], minlength=part.num_rows).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(weight)], names=[*part.schema.names, name])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def _weighed(rows: DataFrame, model: np.ndarray | None) -> DataFrame:
    """(id, drawn, log_weight) of rows of :func:`featured`, as :func:`scored` weighs their texts."""
    if model is None:
        return rows.select("id", "drawn", F.lit(0.0).alias("log_weight"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "features", SLICE):
            row, key = unpacked(part.column("features"))
            weight = np.bincount(row, weights=shared.value[key], minlength=part.num_rows).astype(np.float64)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("drawn"), pa.array(weight)], names=["id", "drawn", "log_weight"])

    return map_arrow(rows, run, T.StructType([*rows.schema.fields[:2], T.StructField("log_weight", T.DoubleType())]))


def gumbel_key(weight: Column, *seed: str) -> Column:
    """log weight / temperature plus Gumbel noise drawn from a hash of the row."""
    return _noisy(weight, F.xxhash64(*seed))


def _noisy(weight: Column, drawn: Column) -> Column:
    uniform = (F.shiftrightunsigned(drawn, 11).cast("double") + 0.5) / float(1 << 53)
    return weight / TEMPERATURE - F.log(-F.log(uniform))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value: counts of 1024 equal ranges narrow it down, round after round."""
    row = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    x = F.col(column)
    while lo < hi:
        step = (hi - lo) / 1024
        if not step or lo + step == lo:
            break
        inside = values.where((x >= lo) & (x <= hi)).groupBy(F.least(F.floor((x - lo) / step), F.lit(1023)).alias("range"))
        ranges = inside.agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("range")).collect()
        for part in ranges:
            if k <= part["n"]:
                if (lo, hi) == (part["lo"], part["hi"]):
                    return lo
                lo, hi = part["lo"], part["hi"]
                break
            k -= part["n"]
    return lo


def quantile(values: DataFrame, column: str, share: float) -> float:
    """The exact quantile, straight between the two values beside it, of any number of rows and in no single task."""
    n = values.count()
    place = (n - 1) * share
    low, high = int(np.floor(place)), int(np.ceil(place))
    below = kth_largest(values, column, n - low)
    return below if low == high else (high - place) * below + (place - low) * kth_largest(values, column, n - high)


def _drawn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray | None, DataFrame, float | None]:
    """The model, (id, log_weight, key) of every row as written, and the least key that is drawn, None for all."""
    rows = featured(docs, id_col, text_col)
    model = fit(rows, labels)
    keys = materialise(_weighed(rows, model).select("id", "log_weight", _noisy(F.col("log_weight"), F.col("drawn")).alias("key")))
    if model is None:
        return model, keys, None
    good = targets(labels).where("target").select(F.col("__label").alias("id"))
    least = quantile(materialise(keys.join(good.hint("merge"), "id", "left_semi").select("log_weight")), "log_weight", LEAVE)
    row = keys.agg(F.count_if(F.col("log_weight") >= least).alias("k"), F.count("*").alias("n")).first()
    return model, keys, None if row["k"] == row["n"] else kth_largest(keys, "key", row["k"])


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, log_weight, key, kept) of every row, as of :func:`judge`, without reading the texts once more."""
    _, keys, least = _drawn(docs, labels, id_col, text_col)
    return keys.withColumn("kept", F.lit(True) if least is None else F.col("key") >= least).withColumnRenamed("id", id_col)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with log_weight, key and kept.

    ``labels(doc_id, quality, toxic)`` may cover any part of ``docs``; a null
    quality is no label, a null toxic is 0, and of several labels of one id the
    worst counts. The k largest keys are kept, and rows that tie with the last
    of them; equal rows have equal keys. A null or blank text has weight 0;
    without labels of both kinds among the documents all weights are 0 and all
    rows are kept, and an empty table stays empty. The columns of ``docs`` pass
    through and come first; where one has the name of a new column, the new one
    is led by an underscore.
    """
    weight, key, kept = free(docs, "log_weight", "key", "kept")
    model, _, least = _drawn(docs, labels, id_col, text_col)
    out = scored(docs, model, text_col, weight).withColumn(key, gumbel_key(F.col(weight), id_col, text_col))
    return out.withColumn(kept, F.lit(True) if least is None else F.col(key) >= least)


def keep_drawn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their own columns only."""
    judged = judge(docs, labels, id_col, text_col)
    return judged.where(F.col(judged.columns[-1])).select(*docs.columns)
