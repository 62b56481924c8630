"""Order-sensitive operators: the total order, pages, pairs, sections, names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, partitions


def total_order() -> list[Column]:
    """Newest first, undated last, then by name and id."""
    return [F.col("taken_at").desc_nulls_last(), F.col("original_filename"), F.col("id")]


def page(images: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    out = images.orderBy(*total_order())
    return (out.offset(offset) if offset else out).limit(limit)


def pair_key() -> Column:
    """One value for both halves of a pair."""
    return F.least(F.col("id"), F.coalesce(F.col("paired_image_id"), F.col("id")))


def collapse_pairs(listed: DataFrame, position: str = "pos") -> DataFrame:
    """One row per pair, the half that isn't raw, at the place of the first half listed."""
    w = Window.partitionBy("__pair")
    out = listed.withColumn("__pair", pair_key())
    out = out.withColumn("__first", F.min(position).over(w)).withColumn("__rank", F.row_number().over(w.orderBy((F.col("file_type") == "raw").cast("int"), position)))
    return out.where("__rank = 1").withColumn(position, F.col("__first")).drop("__pair", "__first", "__rank")


def place() -> Column:
    """A row's place in the total order, as a value that compares like it."""
    return F.struct(F.col("taken_at").isNull().alias("undated"), (-F.unix_micros(F.col("taken_at").cast("timestamp"))).alias("at"), F.col("original_filename").alias("name"), F.col("id").alias("id"))


def collapse_in_order(images: DataFrame) -> DataFrame:
    """One row per pair, the half that isn't raw, with ``place``: that of its first half in the total order.

    The place is a minimum over the pair, so no row number over everything is needed.
    """
    raw = F.col("file_type") == "raw"
    best = F.min_by(F.struct(*images.columns), F.struct(raw.alias("raw"), place().alias("place")))
    both = images.groupBy(pair_key().alias("__pair")).agg(best.alias("__row"), F.min(place()).alias("place"))
    return both.select("__row.*", "place")


def map_pins(images: DataFrame) -> DataFrame:
    """Located rows, one of each pair: the first half in order of id."""
    located = images.where("gps_lat is not null and gps_lon is not null")
    return located.groupBy(pair_key().alias("__pair")).agg(F.min_by(F.struct(*images.columns), "id").alias("__row")).select("__row.*")


def effective_dates(files: DataFrame) -> DataFrame:
    """``files(id, paired_with, taken_at)`` with ``effective``: the own date, else the partner's."""
    other = files.select(F.col("id").alias("__id"), F.col("taken_at").alias("__at"))
    both = files.join(other, F.col("paired_with") == F.col("__id"), "left")
    return both.withColumn("effective", F.coalesce("taken_at", "__at")).drop("__id", "__at")


def review_order(files: DataFrame) -> DataFrame:
    """Staged files by effective date, undated last, then by ``seq``."""
    return effective_dates(files).orderBy(F.asc_nulls_last("effective"), "seq")


def day_sections(files: DataFrame) -> DataFrame:
    """(day, n, first): the days of an import in order; undated files come last, without a day. ``first`` is the least seq."""
    dated = effective_dates(files).groupBy(F.to_date("effective").alias("day")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return dated.orderBy(F.asc_nulls_last("day"))


def destinations(files: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, path): where each of ``files(id, seq, day, name)`` goes, ``YYYY/YYYY-MM-DD/name``.

    A name that is taken gets the first free ``_1``, ``_2``, and so on; in order
    of seq, earlier files take names too. ``taken(day, name)``. Names of one day
    that differ only in such numbers are settled together; others never meet.
    """
    stem, ext = F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""), F.regexp_extract("name", r"(?<=.)(\.[^.]*)$", 1)
    keyed = lambda df: df.withColumn("__family", F.concat_ws("/", F.col("day").cast("string"), F.regexp_replace(stem, r"(_\d+)+$", ""), ext)).withColumn("__stem", stem).withColumn("__ext", ext)

    def settle(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        used, last, out = set(old["name"]), {}, []
        for row in new.sort_values(["seq", "id"]).itertuples():
            # names are only ever taken, so the next file of a name need not try the numbers before
            name, n = row.name, last.get(row.name, 0)
            while (name if n == 0 else f"{row.stem}_{n}{row.ext}") in used:
                n += 1
            last[row.name] = n
            name = name if n == 0 else f"{row.stem}_{n}{row.ext}"
            used.add(name)
            out.append((row.id, row.day, name))
        return pd.DataFrame(out, columns=["id", "day", "name"])

    columns = [F.col("__family"), F.col("day").cast("string").alias("day"), "name"]
    new = keyed(files).select(*columns, "id", "seq", F.col("__stem").alias("stem"), F.col("__ext").alias("ext"))
    old = keyed(taken).select(*columns)
    # in a family of one name, taken or not, the numbers are row numbers; only others need settling
    seen = new.select("__family", "name", F.lit(False).alias("old")).unionByName(old.select("__family", "name", F.lit(True).alias("old")))
    families = seen.groupBy("__family").agg(F.coalesce(F.min("name") == F.max("name"), F.lit(True)).alias("plain"), F.max("old").cast("int").alias("gone"))
    numbered = new.join(families.where("plain"), "__family").withColumn("n", F.row_number().over(Window.partitionBy("__family").orderBy("seq", "id")) - 1 + F.col("gone"))
    plain = numbered.select("id", "day", F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat("stem", F.lit("_"), F.col("n").cast("string"), "ext")).alias("name"))
    mixed = families.where("not plain").select("__family")
    groups = new.join(mixed, "__family", "left_semi").groupBy("__family").cogroup(old.join(mixed, "__family", "left_semi").groupBy("__family"))
    settled = groups.applyInPandas(settle, f"id {dict(files.dtypes)['id']}, day string, name string").unionByName(plain)
    return settled.select("id", F.concat_ws("/", F.substring("day", 1, 4), "day", "name").alias("path"))


def pairs_adjacent(listed: DataFrame, position: str = "pos") -> DataFrame:
    """Both halves side by side at the first half's place, the one that isn't raw first: (place, half)."""
    out = listed.withColumn("place", F.min(position).over(Window.partitionBy(pair_key())))
    return out.withColumn("half", (F.col("file_type") == "raw").cast("int"))


def sections(rows: DataFrame, label: str, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """Runs of equal labels in order: ``section`` numbers them and ``section_key`` is label, or label#n for its n-th run."""
    w = Window.partitionBy(*(within or [])).orderBy(*order)
    out = rows.withColumn("__new", F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))) | F.lag(F.lit(1)).over(w).isNull(), F.lit(True)).cast("int"))
    out = out.withColumn("section", F.sum("__new").over(w))
    run = Window.partitionBy(*(within or []), label).orderBy("section")
    out = out.withColumn("__nth", F.dense_rank().over(run))
    return out.withColumn("section_key", F.when(F.col("__nth") == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit("#"), F.col("__nth").cast("string")))).drop("__new", "__nth")


def numbered_names(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """The n-th use of a name gets _n before its extension; the first stays."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return rows.withColumn("__n", n).withColumn("archive_name", F.when(F.col("__n") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("__n").cast("string"), ext))).drop("__n")


def ordered_union(stages: list[DataFrame], key: str = "id") -> DataFrame:
    """Stages one after another, each with a ``pos``; the first occurrence of a key wins."""
    tagged = [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)]
    out = tagged[0]
    for s in tagged[1:]:
        out = out.unionByName(s)
    return out.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("stage", "pos"))).where("__n = 1").drop("__n")


def boundary_safe(ranked: DataFrame, limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows, and one more if the cut would part a pair. ``rank`` counts from 1."""
    edge = ranked.where(F.col(rank).isin(limit, limit + 1)).groupBy(pair_key().alias("__pair")).count().where("count = 2")
    more = ranked.where(F.col(rank) == limit + 1).join(edge, pair_key() == F.col("__pair"), "left_semi")
    return ranked.where(F.col(rank) <= limit).unionByName(more)


def justified_rows(items: DataFrame, width: float, height: float, gap: float = 4.0) -> DataFrame:
    """Greedy rows per section: a row closes once its natural width fills ``width``; the last keeps its height.

    ``items(section, pos, aspect)``; sections are laid out apart from each other.
    """

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        row, start, total, rows, heights = 0, 0, 0.0, [0] * len(pdf), [height] * len(pdf)
        for i, aspect in enumerate(pdf["aspect"]):
            total += aspect
            rows[i] = row
            room = width - gap * (i - start)
            if total * height >= room:
                for j in range(start, i + 1):
                    heights[j] = room / total
                row, start, total = row + 1, i + 1, 0.0
        return pdf.assign(row=rows, row_height=heights)[["section", "pos", "row", "row_height"]]

    kind = dict(items.dtypes)
    return items.select("section", "pos", "aspect").groupBy("section").applyInPandas(lay, f"section {kind['section']}, pos {kind['pos']}, row int, row_height double")


def spaced_ticks(ticks: DataFrame, gap: float) -> DataFrame:
    """Per track, labels in order of position that keep ``gap`` from the one placed before."""

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        last, keep = None, []
        pdf = pdf.sort_values("at")
        for at in pdf["at"]:
            fits = last is None or at - last >= gap
            keep.append(fits)
            last = at if fits else last
        return pdf[keep]

    return ticks.groupBy("track").applyInPandas(place, ticks.schema)


def rolling_rate(done: DataFrame, partition: str, ts: str, window: int = 20) -> DataFrame:
    """Completions per second over the last ``window`` of each job; null until two differ in time."""
    w = Window.partitionBy(partition).orderBy(ts, "seq").rowsBetween(1 - window, 0)
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.min(ts).over(w).cast("timestamp"))) / F.lit(1e6)
    return done.withColumn("n", F.count("*").over(w)).withColumn("seconds", seconds).withColumn("rate", F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds")))


def ema(values: Column, keep: float = 0.6) -> Column:
    """0.6 of what was and 0.4 of what comes, from the first value of an ordered array."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(1))), F.element_at(values, 1).cast("double"), lambda acc, x: acc * keep + x * (1 - keep))


def numbered(rows: DataFrame, name: str, *order: Column, first: int = 1) -> DataFrame:
    """``rows`` with their place in the whole order as the column ``name``, counted from ``first``.

    Rows are dealt into ranges of the order, each range is sorted where it lies,
    and a range's first number is the count of rows in the ranges before it. So
    no task sees the whole table, and what reaches the driver is one count for
    each range. Equal rows of the order come as they happen to lie.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = materialise(dealt.withColumn(name, F.monotonically_increasing_id()))
    range_of = F.shiftright(name, 33)
    sizes = placed.groupBy(range_of.alias("range")).agg(F.max(name).alias("last")).orderBy("range").collect()
    if not sizes:
        return placed
    # from a place that counts on from its range's number to one that counts on from the rows before
    shifts, before = {}, first
    for r in sizes:
        shifts[r["range"]] = before - (r["range"] << 33)
        before += r["last"] - (r["range"] << 33) + 1
    table = F.broadcast(rows.sparkSession.createDataFrame(list(shifts.items()), "__range long, __shift long"))
    joined = placed.join(table, range_of == F.col("__range"))
    return joined.withColumn(name, F.col(name) + F.col("__shift")).select(*placed.columns)
