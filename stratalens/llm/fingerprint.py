"""Document fingerprints in SQL expressions only: one-permutation MinHash with low-order bits.

The shingle hashes of a text are sorted once; the first value of each of 256
equal ranges is that bin's minimum. Empty bins copy a filled one found along
an order that depends on the bin alone (optimal densification), and the low
four bits of every bin are packed into sixteen longs, shown as 256 hex digits.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import partitions

BINS, BITS, SIZE = 256, 4, 5
#: Affine probes h(bin) = (a * bin + b) mod BINS tried before the full order of filled bins.
_draw = random.Random(20240607)
PROBES = [(_draw.randrange(1, BINS, 2), _draw.randrange(BINS)) for _ in range(12)]
_LOW = (1 << 56) - 1
_SPACE = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, size: int = SIZE) -> Column:
    """One hash per word shingle of the lower-cased text; a shorter text is one shingle, a blank one none."""
    words = F.array_remove(F.split(F.lower(text), _SPACE), "")
    rolled = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))
    return let(words, lambda w: F.when(F.size(w) > 0, rolled(w)).otherwise(F.array().cast("array<long>")))


def _empty(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW)) == F.lit(_LOW)


def fingerprint(text: Column) -> Column:
    """Sixteen longs of packed bins; an empty array for a text without words."""
    tops = F.array(*[F.lit(((b - BINS // 2) << 56) | _LOW) for b in range(BINS)])
    top = lambda x: F.shiftrightunsigned(x, 56)
    minima = lambda s: F.filter(s, lambda x, i: (i == 0) | (top(x) != top(F.get(s, i - 1))))

    def fill(b: Column) -> Column:
        def borrowed(i: Column, filled: Column) -> Column:
            tries = [F.get(b, (i * a + c).bitwiseAND(F.lit(BINS - 1))) for a, c in PROBES]
            last = F.array_min(F.transform(filled, lambda y: F.struct(F.xxhash64(top(y), i).alias("o"), y.alias("v"))))["v"]
            return F.coalesce(*[F.when(~_empty(x), x) for x in tries], last)

        return let(F.filter(b, lambda x: ~_empty(x)), lambda filled: F.transform(b, lambda x, i: F.when(_empty(x), borrowed(i, filled)).otherwise(x)))

    per = 64 // BITS
    packed = lambda b: F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), lambda j: F.aggregate(F.slice(b, j * per + 1, per), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1)))))
    filled = lambda h: let(let(F.sort_array(F.concat(h, tops)), minima), lambda b: let(fill(b), packed))
    return let(shingle_hashes(text), lambda h: F.when(F.size(h) > 0, filled(h)).otherwise(F.array().cast("array<long>")))


def shown(packed: Column) -> Column:
    """The fingerprint as text: 256 hex digits, or empty for a text without words."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness, corrected for the bits that agree by chance; two blank texts are alike."""
    ones = F.lit(0x1111111111111111)

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(ones))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, x: acc + x)
    chance = 1.0 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), ((F.lit(float(BINS)) - unequal) / BINS - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(estimate)


def _bucket(ids: Column, bounds: list[int], step: int = 32) -> Column:
    """The number of the last bound that isn't over the id, found in two steps."""
    count = lambda xs: F.size(F.filter(xs, lambda b: b <= ids))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = count(F.array(*[F.lit(g[0]) for g in groups]))
    fine = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    return let(F.greatest(coarse, F.lit(1)), lambda c: (c - 1) * step + count(F.element_at(fine, c)) - 1)


def with_next(docs: DataFrame, ids: str, values: list[str]) -> DataFrame:
    """``docs`` with next_<value> columns of the row with the next larger id; after the last comes the first.

    Ids are cut into ranges of about equal size at ids that occur; each range is
    one window, and the first row of each is repeated at the end of the range
    before it, so no window holds more than a range.
    """
    n = 4 * partitions(docs.sparkSession)
    cuts = ", ".join(str(i / n) for i in range(n))
    row = docs.selectExpr(f"min({ids}) as least", f"percentile_approx({ids}, array({cuts}), 10000) as cuts").first()
    bounds = sorted({row["least"], *row["cuts"]}) if row["least"] is not None else [0]
    outside = -1 - F.pmod(F.xxhash64(*values), F.lit(n)).cast("int")
    own = F.when(F.col(ids).isNotNull(), _bucket(F.col(ids), bounds)).otherwise(outside).cast("int")
    first = F.col(ids).isin(bounds) if len(bounds) < 10 else F.array_contains(F.array(*[F.lit(x) for x in bounds]), F.col(ids))
    placed = docs.withColumn("__own", own).withColumn("__at", F.when(first, F.array(F.col("__own"), F.pmod(F.col("__own") - 1, F.lit(len(bounds))))).otherwise(F.array("__own")))
    spread = placed.select(*docs.columns, F.posexplode("__at").alias("__extra", "__bucket"))
    order = Window.partitionBy("__bucket").orderBy("__extra", ids, *values)
    out = spread.select("*", *[F.when(F.col(ids).isNotNull(), F.lead(v).over(order)).alias(f"next_{v}") for v in values])
    return out.where("__extra = 0").drop("__extra", "__bucket")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike the pairs look.

    The edited text has its last floor(n/4) code points replaced by the first as
    many of the next document by id. A null text counts as empty; texts without
    words have an empty fingerprint, alike to each other (1) and to no other (0).
    A null id has no next document (an empty one). Rows with equal ids follow
    each other by fingerprint and text. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("id", "text", fingerprint(F.col("text")).alias("print"))
    near = with_next(base, "id", ["print", "text"]).withColumn("n", F.char_length("text"))
    cut = F.floor(F.col("n") / 4).cast("int")
    near = near.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.col("n") - cut), F.coalesce(F.col("next_text").substr(F.lit(1), cut), F.lit(""))))
    near = near.select("id", "n", "print", F.coalesce("next_print", F.array().cast("array<long>")).alias("next_print"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("sha"), fingerprint(F.col("edited")).alias("edited_print"))
    return near.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"),
        shown(F.col("print")).alias("fingerprint"), shown(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
