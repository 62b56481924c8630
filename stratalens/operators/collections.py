"""Derived collections: by time, place, tag and edit, and clusters of vectors."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import aggregates, filters
from .filters import edited
from .geo import ROMAN

MONTH_LEAST, DAY_LEAST, DAY_FACTOR, DAYS, SPLIT_LEAST, SPLITS = 5, 10, 3.0, 30, 3, 60
SIMILAR, CLUSTER_LEAST, NAME_LEAST, CLUSTERS = 0.76, 5, 0.17, 40
#: Vectors of a block; vectors looked through in a round, and centres of a chunk. The result doesn't hang on them.
BLOCK, CANDIDATES = 4096, 512


def years(images: DataFrame) -> DataFrame:
    return images.where("taken_at is not null").groupBy(F.year("taken_at").alias("year")).agg(F.count("*").alias("n"))


def months(images: DataFrame, least: int = MONTH_LEAST) -> DataFrame:
    """(key, name, n) of months with enough images."""
    key, name = F.date_format("taken_at", "yyyy-MM"), F.date_format("taken_at", "MMMM yyyy")
    return images.where("taken_at is not null").groupBy(key.alias("key"), name.alias("name")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def big_days(images: DataFrame, factor: float = DAY_FACTOR, least: int = DAY_LEAST, limit: int = DAYS) -> DataFrame:
    """The newest days with at least max(least, factor x median day) images."""
    days = images.where("taken_at is not null").groupBy(F.to_date("taken_at").alias("day")).agg(F.count("*").alias("n"))
    middle = days.agg(F.median("n").alias("middle"))
    return days.crossJoin(F.broadcast(middle)).where(F.col("n") >= F.greatest(F.lit(float(least)), F.col("middle") * factor)).orderBy(F.desc("day")).select("day", "n").limit(limit)


def countries(images: DataFrame) -> DataFrame:
    return images.where("gps_country is not null").groupBy("gps_country").agg(F.count("*").alias("n"))


def country_years(images: DataFrame, least: int = SPLIT_LEAST, limit: int = SPLITS) -> DataFrame:
    """Country and year with enough images: newest year first, then biggest."""
    out = images.where("gps_country is not null and taken_at is not null").groupBy("gps_country", F.year("taken_at").alias("year")).agg(F.count("*").alias("n"))
    return out.where(F.col("n") >= least).orderBy(F.desc("year"), F.desc("n"), "gps_country").limit(limit)


def tag_albums(images: DataFrame, links: DataFrame) -> DataFrame:
    """(name, n) of tags in use, the commonest first, then by name whatever its case."""
    joined = links.join(images.select("id"), links["image_id"] == images["id"])
    return joined.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.lower("name"), "name")


def edited_album(images: DataFrame, k: int = aggregates.COVERS) -> DataFrame:
    """One row (n, covers) of the edited images, none if there are none; covers are JPEGs if any is one, the newest first."""
    rows = images.where(edited(images.columns))
    jpeg = F.col("file_type") == "jpeg"
    top = rows.orderBy(jpeg.desc(), F.col("taken_at").desc_nulls_last(), "id").limit(k).select("id", "taken_at", jpeg.alias("jpeg"))
    ranked = F.array_sort(F.collect_list(F.struct((~F.col("jpeg")).alias("other"), F.col("taken_at").isNull().alias("undated"), (-F.unix_micros(F.col("taken_at").cast("timestamp"))).alias("at"), "id")))
    kept = F.transform(F.filter("ranked", lambda x: x["other"] == F.col("ranked")[0]["other"]), lambda x: x["id"])
    return rows.agg(F.count("*").alias("n")).where("n > 0").crossJoin(F.broadcast(top.agg(ranked.alias("ranked")))).select("n", kept.alias("covers"))


def time_albums(images: DataFrame, factor: float = DAY_FACTOR) -> DataFrame:
    """(kind, key, name, n, covers) of years, of months with enough images and of big days."""
    dated = images.where("taken_at is not null").withColumn("year", F.year("taken_at")).withColumn("key", F.date_format("taken_at", "yyyy-MM")).withColumn("day", F.to_date("taken_at"))
    text = lambda c: F.col(c).cast("string")
    y = years(images).join(aggregates.covers(dated, ["year"]), "year").select(F.lit("year").alias("kind"), text("year").alias("key"), text("year").alias("name"), "n", "covers")
    m = months(images).join(aggregates.covers(dated, ["key"]), "key").select(F.lit("month").alias("kind"), "key", "name", "n", "covers")
    days = big_days(images, factor)
    d = days.join(aggregates.covers(dated.join(F.broadcast(days.select("day")), "day", "left_semi"), ["day"]), "day").select(F.lit("day").alias("kind"), text("day").alias("key"), F.date_format("day", "d MMMM yyyy").alias("name"), "n", "covers")
    return y.unionByName(m).unionByName(d)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows, to twelve decimals, so that they don't hang on how many rows are multiplied at a time."""
    return np.round(_unit(a) @ _unit(b).T, 12)


def _stacked(pdf: pd.DataFrame, column: str = "vector") -> np.ndarray:
    return np.stack(pdf[column].to_numpy()).astype(np.float64)


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows dealt by a hash of the id into blocks of some ``block`` rows of a group; what is computed is per row."""
    sizes = rows.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return rows.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _spread(few: DataFrame, placed: DataFrame) -> DataFrame:
    """A copy of each of a group's few rows for every block of the group."""
    sizes = placed.select(F.col("group").alias("of"), F.col("blocks").alias("count")).distinct()
    joined = few.select(*[F.col(c).alias(c) for c in few.columns]).join(sizes, F.col("group") == F.col("of"))
    return joined.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).drop("of", "count")


def leaders(vectors: DataFrame, threshold: float, block: int = BLOCK, candidates: int = CANDIDATES) -> DataFrame:
    """(group, id, seq, vector): the vectors that no earlier leader of their group is like, earlier by seq, then id.

    Round after round, a group's first ``candidates`` vectors that no leader
    covers are looked through in order, which settles them, as no earlier
    vector is left; the leaders among them then take what they cover out of the
    rest. So a task holds the candidates of a group, or a block and the leaders
    of one round, and the result is that of one pass in order, whatever the
    sizes of blocks and rounds. Every round settles its candidates, so there
    are as many as the least settled group has leaders over those of a round.
    """
    kind, rest, found = dict(vectors.dtypes)["id"], materialise(vectors.select("group", "id", "seq", "vector")), []
    schema = f"group string, id {kind}, seq double, vector array<double>"

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "id"], ignore_index=True)
        alike = _likeness(_stacked(pdf), _stacked(pdf)) >= threshold
        covered, chosen = np.zeros(len(pdf), bool), []
        for i in range(len(pdf)):
            if not covered[i]:
                chosen.append(i)
                covered |= alike[i]
        return pdf.iloc[chosen][["group", "id", "seq", "vector"]]

    def uncovered(own: pd.DataFrame, few: pd.DataFrame) -> pd.DataFrame:
        if len(own) and len(few):
            own = own[~own["id"].isin(few["id"]) & ~(_likeness(_stacked(own), _stacked(few)) >= threshold).any(axis=1).astype(bool)]
        return own[["group", "id", "seq", "vector"]]

    while not rest.isEmpty():
        first = rest.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("seq", "id"))).where(F.col("place") <= candidates)
        chosen = materialise(first.groupBy("group").applyInPandas(choose, schema))
        found.append(chosen)
        placed = _blocks(rest, block)
        rest = materialise(placed.groupBy("group", "block").cogroup(_spread(chosen, placed).groupBy("group", "block")).applyInPandas(uncovered, schema))
    return reduce(DataFrame.unionByName, found) if found else rest


def _nearest_centre(placed: DataFrame, centres: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(group, id, centre): the centre most like each vector, of equal ones the smallest, if it is at the threshold.

    A group's centres come in chunks of a bounded number; each block meets each chunk.
    """

    def score(own: pd.DataFrame, few: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(few):
            return pd.DataFrame({"group": [], "id": [], "score": [], "centre": []})
        few = few.sort_values("centre")
        sim = _likeness(_stacked(own), _stacked(few))
        best = sim.argmax(axis=1)
        return pd.DataFrame({"group": own["group"], "id": own["id"], "score": sim.max(axis=1), "centre": few["centre"].to_numpy()[best]})

    chunks = F.floor((F.row_number().over(Window.partitionBy("group").orderBy("centre")) - 1) / CANDIDATES).cast("int")
    few = materialise(centres.withColumn("chunk", chunks))
    most = few.groupBy("group").agg(F.max("chunk").alias("last"))
    dealt = placed.join(most, "group").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("last"))))
    keys = ["group", "block", "chunk"]
    scored = dealt.groupBy(*keys).cogroup(_spread(few, placed).groupBy(*keys)).applyInPandas(score, f"group string, id {kind}, score double, centre long")
    best = scored.where(F.col("score") >= threshold).groupBy("group", "id").agg(F.max(F.struct("score", (-F.col("centre")).alias("back"))).alias("best"))
    return best.select("group", "id", (-F.col("best.back")).alias("centre"))


def greedy_clusters(vectors: DataFrame, group: str | None = None, threshold: float = SIMILAR, least: int = CLUSTER_LEAST, block: int = BLOCK) -> DataFrame:
    """(group, id, cluster): leader clustering in order of the number ``seq``, then each vector moves to its best centroid.

    ``vectors(id, seq, vector[, group])``, ids unique. A vector that is like no earlier leader,
    by a cosine at the threshold, is a leader; each vector joins the leader most
    like it, the earliest of equals; a cluster's centroid is the mean of its
    members' unit vectors; then each vector moves to the centroid most like it,
    if that is at the threshold, and else is in no cluster. Clusters under
    ``least`` members are dropped and the rest numbered from the largest, equal
    ones by their leaders. Cosines count to twelve decimals. A null vector, or
    one with a part that is null or not finite, is left out; one of zeros is
    like nothing.

    Leaders stay where they were founded until all are known, so the result is
    the same for any ``block``, partitioning and order of rows.
    """
    key, kind = F.col(group).cast("string") if group else F.lit(""), dict(vectors.dtypes)["id"]
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    keyed = vectors.select(F.coalesce(key, F.lit("")).alias("group"), key.isNull().alias("none"), "id", F.col("seq").cast("double").alias("seq"), F.col("vector").cast("array<double>").alias("vector"))
    keyed = materialise(keyed.withColumn("group", F.when(F.col("none"), "-").otherwise(F.concat(F.lit("="), "group"))).drop("none").where(F.col("vector").isNotNull() & (F.size("vector") > 0) & sound))
    founders = materialise(leaders(keyed, threshold, block))
    order = Window.partitionBy("group").orderBy("seq", "id")
    founders = founders.select("group", "vector", F.row_number().over(order).cast("long").alias("centre"))
    placed = _blocks(keyed, block)
    joined = _nearest_centre(placed, founders, threshold, kind)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x))
    parts = keyed.join(joined, ["group", "id"]).select("group", "centre", F.posexplode("vector").alias("at", "part"), length.alias("length"))
    means = parts.groupBy("group", "centre", "at").agg(F.avg(F.col("part") / F.col("length")).alias("part"))
    centroids = means.groupBy("group", "centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]).alias("vector"))
    assigned = materialise(_nearest_centre(placed, centroids, threshold, kind))
    kept = assigned.groupBy("group", "centre").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    numbered = kept.withColumn("cluster", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "centre")) - 1)  # a group's clusters
    back = F.when(F.col("group") != "-", F.substring("group", 2, 1 << 30))
    return assigned.join(numbered, ["group", "centre"]).select(back.alias("group"), "id", F.col("cluster").cast("int").alias("cluster"))


def name_clusters(centroids: DataFrame, labels: DataFrame, least: float = NAME_LEAST, other: str = "Moments") -> DataFrame:
    """(cluster, name): the label whose vector is nearest a centroid, or ``other``. ``labels`` is a fixed, small table."""
    dot = F.aggregate(F.zip_with("vector", "label_vector", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    scored = centroids.crossJoin(F.broadcast(labels)).select("cluster", "label", dot.alias("score"))
    best = scored.groupBy("cluster").agg(F.max(F.struct("score", "label")).alias("best"))
    return best.select("cluster", F.when(F.col("best.score") >= least, F.col("best.label")).otherwise(other).alias("name"), F.col("best.score").alias("score"))


def round_robin(clusters: DataFrame, limit: int = CLUSTERS) -> DataFrame:
    """``clusters(cluster, subject, size)``: the biggest of every subject before the second of any."""
    w = Window.partitionBy("subject").orderBy(F.desc("size"), "cluster")
    seen = F.min("cluster").over(Window.partitionBy("subject"))
    return clusters.withColumn("rank", F.row_number().over(w)).withColumn("__seen", seen).orderBy("rank", "__seen").limit(limit).drop("__seen")


def roman(n: int) -> str:
    return ROMAN[n - 1] if 1 <= n <= len(ROMAN) else str(n)


def sibling_names(named: DataFrame) -> DataFrame:
    """``named(cluster, base, qualifiers array<string>, country, year)``: clusters of one base name told apart.

    In order of cluster, first each takes the first of its qualifiers that none
    before took; then each without one its country, or else its year, if free;
    what is left is numbered: the first is the base itself, the next has II. A
    base used once stays as it is.
    """

    def tell_apart(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        base, used, names, left = pdf["base"].iloc[0], set(), [None] * len(pdf), 0
        rows = list(pdf.itertuples()) if len(pdf) > 1 else []
        tries = [[str(x) for x in row.qualifiers if x is not None] for row in rows], [[str(x) for x in (row.country, None if pd.isna(row.year) else int(row.year)) if x is not None and x == x and x != ""] for row in rows]
        for offered in tries:
            for k, own in enumerate(offered):
                title = None if names[k] else next((t for t in own if t not in used), None)
                if title:
                    used.add(title)
                    names[k] = f"{base} · {title}"
        for k, name in enumerate(names):
            if name is None:
                left += 1
                names[k] = base if left == 1 else f"{base} {roman(left)}"
        return pd.DataFrame({"cluster": pdf["cluster"], "name": names})

    kind = dict(named.dtypes)["cluster"]
    return named.groupBy("base").applyInPandas(tell_apart, f"cluster {kind}, name string")


def majority(rows: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """(by, value): the commonest value that isn't null, of equals the one seen first; null if there is none."""
    tally = rows.groupBy(*by, value).agg(F.count(value).alias("__n"), F.min(seq).alias("__s"))
    best = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct("__n", (-F.col("__s")).alias("s"))))
    return tally.groupBy(*by).agg(best.alias(value))


def cluster_covers(members: DataFrame, images: DataFrame, k: int = aggregates.COVERS) -> DataFrame:
    """(cluster, covers): the newest JPEGs of a cluster, undated last; without any, its cover and then its members in order.

    ``members(cluster, id, cover, pos)``. Deleted rows count, as a cluster keeps them until it is built anew.
    """
    rows = members.join(images.select("id", "file_type", "taken_at"), "id", "left")
    jpeg = F.coalesce(F.col("file_type") == "jpeg", F.lit(False))
    first = F.when(~jpeg & (F.col("id") != F.col("cover")), F.col("pos") + 1).when(~jpeg, F.lit(0))
    w = Window.partitionBy("cluster").orderBy(jpeg.desc(), first, F.col("taken_at").desc_nulls_last(), "id")
    top = rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k)
    ranked = F.array_sort(F.collect_list(F.struct("__rank", "id", jpeg.alias("jpeg"))))
    kept = F.filter("ranked", lambda x: x["jpeg"] == F.col("ranked")[0]["jpeg"])
    return top.groupBy("cluster").agg(ranked.alias("ranked")).select("cluster", F.transform(kept, lambda x: x["id"]).alias("covers"))


def album_covers(albums: DataFrame, rules: DataFrame, album_images: DataFrame, links: DataFrame, images: DataFrame, k: int = aggregates.COVERS) -> DataFrame:
    """(album_id, covers): visible rows added by hand in their order, then rows of the rule, the newest first; JPEGs if there is any.

    ``albums(album_id)``, ``rules(album_id, name)``. Rows of a rule are cut to
    the newest of each set of rule tags that occurs, then of each distinct rule,
    before albums meet them: as many as could be needed however many of them an
    album holds by hand already.
    """
    shown = images.select(F.col("id").alias("image_id"), "taken_at", (F.col("file_type") == "jpeg").alias("jpeg"))
    newest = [F.col("taken_at").desc_nulls_last(), F.col("image_id")]
    manual = filters.first_places(album_images).select("album_id", "image_id", "position").join(shown, "image_id")
    w = Window.partitionBy("album_id", "jpeg").orderBy("position", *newest)
    manual = manual.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).select("album_id", "image_id", "jpeg", F.lit(0).alias("__stage"), F.col("position").cast("long").alias("__a"), "taken_at")
    sets = rules.groupBy("album_id").agg(F.array_sort(F.collect_set("name")).alias("rule"))
    by_set = Window.partitionBy("names", "jpeg").orderBy(*newest)
    near = filters.tag_sets(links, rules).join(shown, "image_id").withColumn("__n", F.row_number().over(by_set)).where(F.col("__n") <= 2 * k).drop("__n")
    by_name = sets.select("rule").distinct().withColumn("name", F.explode("rule"))
    tagged = near.withColumn("name", F.explode("names")).join(by_name, "name").select("rule", "image_id", "taken_at", "jpeg").distinct()
    by_rule = Window.partitionBy("rule", "jpeg").orderBy(*newest)
    top = tagged.withColumn("__n", F.row_number().over(by_rule)).where(F.col("__n") <= 2 * k)
    more = sets.join(top, "rule").select("album_id", "image_id", "jpeg", F.lit(1).alias("__stage"), F.lit(0).cast("long").alias("__a"), "taken_at")
    # a row that comes by hand and by rule counts where it was put by hand
    both = manual.unionByName(more)
    one = both.groupBy("album_id", "image_id", "jpeg", "taken_at").agg(F.min(F.struct("__stage", "__a")).alias("__place")).join(albums.select("album_id"), "album_id", "left_semi")
    ranked = one.withColumn("__rank", F.row_number().over(Window.partitionBy("album_id").orderBy(F.desc("jpeg"), "__place", *newest))).where(F.col("__rank") <= k)
    listed = F.array_sort(F.collect_list(F.struct("__rank", "image_id", "jpeg")))
    kept = F.filter("listed", lambda x: x["jpeg"] == F.col("listed")[0]["jpeg"])
    return ranked.groupBy("album_id").agg(listed.alias("listed")).select("album_id", F.transform(kept, lambda x: x["image_id"]).alias("covers"))


def clusterable(images: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, vector, year, country) of what clusters are built from: visible rows with a vector, without the raw halves of pairs."""
    shown = images.where("not (file_type = 'raw' and paired_image_id is not null)").select("id", F.year("taken_at").alias("year"), F.col("gps_country").alias("country"))
    return vectors.select("id", "vector").join(shown, "id")


def repaired(clusters: DataFrame, live: DataFrame, least: int = CLUSTER_LEAST) -> DataFrame:
    """``clusters(cluster, name, group, image_ids, cover)`` without ids that are gone.

    Clusters left with too few members go; a cover that is gone gives way to the first member.
    """
    members = clusters.select("cluster", F.posexplode("image_ids").alias("pos", "id")).join(live.select("id"), "id", "left_semi")
    ids = F.array_sort(F.collect_list(F.struct("pos", "id")))
    left = members.groupBy("cluster").agg(F.transform(ids, lambda x: x["id"]).alias("__ids")).where(F.size("__ids") >= least)
    cover = F.when(F.array_contains("__ids", F.col("cover")), F.col("cover")).otherwise(F.col("__ids")[0])
    return clusters.join(left, "cluster").select("cluster", "name", F.coalesce(F.nullif("group", F.lit("")), "name").alias("group"), F.col("__ids").alias("image_ids"), cover.alias("cover"))


def group_totals(clusters: DataFrame) -> DataFrame:
    """(group, clusters, n): members of all clusters that share a group, a cluster without one by its name."""
    return clusters.groupBy(F.coalesce(F.nullif("group", F.lit("")), "name").alias("group")).agg(F.count("*").alias("clusters"), F.sum("size").alias("n"))


def tag_list(tags: DataFrame) -> DataFrame:
    """Tags by name."""
    return tags.orderBy("name")


def cluster_list(clusters: DataFrame) -> DataFrame:
    """Clusters by group and then by name, whatever their case; one without a group goes by its name."""
    return clusters.orderBy(F.lower(F.coalesce(F.nullif("group", F.lit("")), "name")), F.lower("name"))


def album_list(albums: DataFrame) -> DataFrame:
    """Albums, the newest first."""
    return albums.orderBy(F.desc("created_at"), "id")
