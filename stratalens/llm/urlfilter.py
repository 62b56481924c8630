"""URL filters in DataFrame operations only: path rules, then a listed-URL check.

Listed canonical URLs are folded into a blocked Bloom filter: one 512-bit block
per hash, one bit in each of its eight words. Only URLs that pass it go on to
the exact join with the list, which removes the filter's false positives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import ascii_lower, materialise

#: Verdict, host and path; the longest rule that fits decides.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BITS_PER_URL, WORDS = 16, 8
#: Bytes of a filter up to which it is broadcast.
BROADCAST = 64 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased."""
    return F.when(F.locate("://", url) > 0, ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.when(F.locate("://", url) > 0, F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One spelling of a page: no scheme, ``www.`` or ``m.``, query, fragment, ``.html`` or final slash."""
    return F.concat(F.regexp_replace(host, "^(www|m)\\.", ""), F.regexp_replace(path, "(\\.html|/)$", ""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _bit(url: Column, word: int) -> Column:
    """The bit of a URL in one word of its block."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(url, F.lit(word)), F.lit(64)).cast("int"))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(-1)), F.lit(blocks))


def bloom(listed: DataFrame) -> tuple[DataFrame, int]:
    """(block, w0..w7) of the distinct column ``canon``, and the number of blocks."""
    blocks = max(1, math.ceil(listed.count() * BITS_PER_URL / (64 * WORDS)))
    url = F.col("canon")
    return listed.groupBy(_block(url, blocks).alias("block")).agg(*[F.bit_or(_bit(url, k)).alias(f"w{k}") for k in range(WORDS)]), blocks


def listed_hits(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct values of ``urls.canon`` that are in the distinct ``listed.canon``.

    A filter of bounded size goes to all tasks, so only what passes it is
    shuffled; a larger one is joined by block.
    """
    table, blocks = bloom(listed)
    probes = urls.select("canon").where("canon is not null")
    small = blocks * WORDS * 8 <= BROADCAST
    passed = (probes if small else probes.distinct()).withColumn("block", _block(F.col("canon"), blocks)).join(F.broadcast(table) if small else table, "block")
    for k in range(WORDS):
        bit = _bit(F.col("canon"), k)
        passed = passed.where(F.col(f"w{k}").bitwiseAND(bit) == bit)
    return passed.select("canon").distinct().join(listed.select("canon"), "canon", "left_semi")


def crawler_traps(pages: DataFrame, url_col: str = "url", spellings: int = 2) -> DataFrame:
    """Canonical URLs that the pages spell in several ways: the list used when none is given."""
    url = F.col(url_col)
    own = pages.select(canonical(host_of(url), path_of(url)).alias("canon"), url.alias("url")).where("url is not null").distinct()
    return own.groupBy("canon").count().where(F.col("count") >= spellings).select("canon")


def judge_urls(pages: DataFrame, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    Where no rule fits, a URL is blocked if its canonical form is in
    ``listed.canon`` (as built by :func:`crawler_traps` if none is given) and
    allowed otherwise. A URL that is null or lacks ``://`` has an empty host and
    path, fits no rule and is allowed. Repeated rows each get a row; other
    columns are ignored.
    """
    url = F.col(url_col)
    listed = materialise(crawler_traps(pages, url_col) if listed is None else listed.select("canon").where("canon is not null").distinct())
    parts = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": name, "verdict": verdict, "canon": F.when(F.col("host") != "", canonical(F.col("host"), F.col("path")))})
    hits = listed_hits(parts.where("rule is null"), listed).withColumn("hit", F.lit(True))
    free = parts.where("rule is null and canon is not null").join(hits, "canon", "left").withColumn("verdict", F.when(F.col("hit"), "block").otherwise("allow"))
    rest = parts.where("rule is not null or canon is null").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    columns = [F.col("id").alias(id_col), "host", "path", "rule", "verdict"]
    return free.select(*columns).unionByName(rest.select(*columns))
