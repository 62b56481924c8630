"""Place names in queries: countries, localised names and qualified cities, by joins on normalised keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import normalised_name
from .geo import nearest


def country_of(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``queries(query, lang)`` with the country that each names: a general name wins over one in the query's language.

    ``names(name, lang, cc)``: a null lang is general, that is English. A query's
    language counts up to its first hyphen, in lower case. Of several countries
    of one name the smallest code counts.
    """
    keyed = names.select(normalised_name("name").alias("key"), F.col("lang").alias("__lang"), "cc").where("key <> ''")
    asked = queries.withColumn("key", normalised_name("query")).withColumn("__own", F.lower(F.split("lang", "-")[0]))
    best = keyed.groupBy("key", "__lang").agg(F.min("cc").alias("cc"))
    general = best.where("__lang is null").select("key", F.col("cc").alias("__general"))
    local = best.where("__lang is not null").select("key", F.col("__lang").alias("__own"), F.col("cc").alias("__local"))
    found = asked.join(general, "key", "left").join(local, ["key", "__own"], "left")
    return found.select("query", "lang", F.coalesce("__general", "__local").alias("cc"))


def country_name(codes: DataFrame, names: DataFrame, code: str = "cc") -> DataFrame:
    """``codes`` with ``country``: the name of its code by ``names(cc, name)``, the code itself if it has none."""
    one = names.groupBy(F.col("cc").alias("__cc")).agg(F.min("name").alias("__name"))
    joined = codes.join(one, F.col(code) == F.col("__cc"), "left")
    return joined.withColumn("country", F.coalesce("__name", F.nullif(code, F.lit("")))).drop("__cc", "__name")


def annotate_countries(images: DataFrame, cities: DataFrame, names: DataFrame) -> DataFrame:
    """``images`` with gps_country filled in from the nearest city where a position has none.

    ``cities(city, lat, lon)`` has a country code as its city.
    """
    pending = images.where("gps_lat is not null and gps_lon is not null and coalesce(gps_country, '') = ''")
    named = country_name(nearest(pending, cities).select(F.col("id").alias("__id"), "city"), names, "city").select("__id", "country")
    both = images.join(named, F.col("id") == F.col("__id"), "left")
    return both.select(*[F.coalesce(F.col("country"), F.col(c)).alias(c) if c == "gps_country" else F.col(c) for c in images.columns])


def spellings(queries: DataFrame, exonyms: DataFrame) -> DataFrame:
    """(query, key): the name, its local form by ``exonyms(exonym, name)``, and its reading of ae, oe, ue as umlauts."""
    own = queries.select("query", normalised_name("query").alias("key"))
    known = exonyms.select(normalised_name("exonym").alias("key"), normalised_name("name").alias("__local"))
    local = own.join(known, "key").select("query", F.col("__local").alias("key"))
    plain = own.select("query", F.regexp_replace("key", "([aou])e", "$1").alias("key"))
    return own.unionByName(local).unionByName(plain).distinct()


def splits(queries: DataFrame) -> DataFrame:
    """(query, turn, name, qualifier): the text before and after a comma, or every split of its words, the longest name first."""
    words = F.split(F.trim("query"), r"\s+")
    comma = F.array(F.struct(F.lit(0).alias("turn"), F.trim(F.split("query", ",", 2)[0]).alias("name"), F.trim(F.split("query", ",", 2)[1]).alias("qualifier")))
    peeled = F.transform(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda n: F.struct(n.alias("turn"), F.array_join(F.slice(words, 1, F.size(words) - n), " ").alias("name"), F.nullif(F.array_join(F.slice(words, F.size(words) - n + 1, F.greatest(n, F.lit(0))), " "), F.lit("")).alias("qualifier")),
    )
    return queries.select("query", F.explode(F.when(F.col("query").contains(","), comma).otherwise(peeled)).alias("x")).select("query", "x.*")


def candidates(queries: DataFrame, gazetteer: DataFrame, names: DataFrame) -> DataFrame:
    """(query, name, admin1, cc, lat, lon): cities of the first split of a query that has any.

    A qualifier must be the city's country code, its country or its first-level
    division. ``gazetteer(name, admin1, cc, lat, lon)``, ``names(name, lang, cc)``.
    """
    g = gazetteer.withColumn("key", normalised_name("name")).withColumn("division", normalised_name("admin1"))
    countries = names.select(normalised_name("name").alias("country"), F.col("cc").alias("country_cc")).distinct()
    asked = splits(queries).withColumn("key", normalised_name("name")).withColumn("wanted", normalised_name("qualifier")).select("query", "turn", "key", "wanted")
    found = asked.join(g, "key").join(countries, F.col("wanted") == F.col("country"), "left")
    fits = F.col("wanted").isNull() | (F.lower("cc") == F.col("wanted")) | (F.col("division") == F.col("wanted")) | (F.col("country_cc") == F.col("cc"))
    found = found.where(fits).select("query", "turn", "name", "admin1", "cc", "lat", "lon").distinct()
    first = found.groupBy("query").agg(F.min("turn").alias("turn"))
    return found.join(first, ["query", "turn"]).drop("turn")


#: Rows that a key's longer names may add, and the letters that a key needs for that.
PREFIX_ROWS, PREFIX_LETTERS = 20, 4


def _readings(asked: DataFrame, exonyms: DataFrame) -> DataFrame:
    """``asked(.., name, __own)`` by ``key``: the name; in German also its umlauts for ae, oe, ue, and what its exonym stands for."""
    own = asked.withColumn("key", normalised_name("name"))
    german = own.where("__own = 'de'")
    umlauts = german.withColumn("key", normalised_name(F.regexp_replace("name", "([aou])e", "$1")))
    known = exonyms.select(normalised_name("exonym").alias("key"), normalised_name("name").alias("__known")).distinct()
    meant = german.unionByName(umlauts).join(known, "key").withColumn("key", F.col("__known")).drop("__known")
    return own.unionByName(umlauts).unionByName(meant).where("key <> ''").distinct()


def located(queries: DataFrame, gazetteer: DataFrame, names: DataFrame, exonyms: DataFrame) -> DataFrame:
    """(query, lang, name, admin1, cc, lat, lon): the cities that each distinct query may mean.

    A name finds the cities of its key and up to :data:`PREFIX_ROWS` whose key
    goes on with another word, by (key, name, lat, lon), the latter only for
    keys of :data:`PREFIX_LETTERS` letters. A text after the first comma is a
    qualifier: the city's country code, country by ``names(name, lang, cc)`` in
    general or in the query's language, or first-level division. Without one,
    where the whole name finds nothing, trailing words are tried as one, the
    fewest first. Of rows with the same name and position the first by country
    and division counts. Null and empty queries find nothing.
    """
    spots = gazetteer.where("lat is not null and lon is not null").groupBy("name", "lat", "lon").agg(F.min(F.struct("cc", "admin1")).alias("x")).select("name", "lat", "lon", "x.*")
    spots = spots.withColumns({"key": normalised_name("name"), "__code": normalised_name("cc"), "__division": normalised_name("admin1")})
    words = F.split("key", " ")
    starts = spots.where(F.size(words) > 1).withColumn("__key", F.col("key")).withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, 1, n), " "))))
    parts = F.transform(F.split(F.lower(F.trim("query")), ","), lambda x: F.trim(x))
    asked = queries.select("query", "lang").distinct().withColumns({"__own": F.lower(F.coalesce(F.split("lang", "-")[0], F.lit(""))), "__parts": parts})
    asked = asked.withColumns({"name": F.col("__parts")[0], "qualifier": F.nullif(F.try_element_at("__parts", F.lit(2)), F.lit(""))}).where("name <> ''").drop("__parts")
    typed = F.split("name", r"\s+")
    peeled = asked.where(F.col("qualifier").isNull() & (F.size(typed) > 1)).withColumn("turn", F.explode(F.sequence(F.lit(1), F.size(typed) - 1)))
    left = F.size(typed) - F.col("turn")
    peeled = peeled.select("query", "lang", "__own", "turn", F.array_join(F.slice(typed, 1, left), " ").alias("name"), F.array_join(F.slice(typed, left + 1, F.col("turn")), " ").alias("qualifier"))
    split = asked.withColumn("turn", F.lit(0)).unionByName(peeled).withColumn("wanted", normalised_name("qualifier"))
    countries = names.select(normalised_name("name").alias("wanted"), F.lower(F.coalesce("lang", F.lit(""))).alias("__in"), "cc").where("wanted <> ''")
    codes = split.select("wanted", "__own").where("wanted is not null").distinct().join(countries, "wanted").where("__in = '' or __in = __own").groupBy("wanted", "__own").agg(F.collect_set("cc").alias("__ccs"))
    keyed = _readings(split.drop("qualifier"), exonyms).join(codes, ["wanted", "__own"], "left")
    asked_keys = keyed.select("key").distinct()
    first = Window.partitionBy("key").orderBy("__key", "name", "lat", "lon")
    more = starts.where(F.length("key") >= PREFIX_LETTERS).join(asked_keys, "key", "left_semi").withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= PREFIX_ROWS)
    fields = ["key", F.col("name").alias("city"), "admin1", "cc", "lat", "lon", "__code", "__division"]
    found = keyed.drop("name").join(spots.select(*fields).unionByName(more.select(*fields)), "key")
    fits = F.col("wanted").isNull() | (F.col("__code") == F.col("wanted")) | (F.col("__division") == F.col("wanted")) | F.array_contains("__ccs", F.col("cc"))
    found = found.where(fits).select("query", "lang", "turn", F.col("city").alias("name"), "admin1", "cc", "lat", "lon").distinct()
    turn = Window.partitionBy("query", "lang")  # what one query finds
    return found.withColumn("__first", F.min("turn").over(turn)).where("turn = __first").drop("turn", "__first")
