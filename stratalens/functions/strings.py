"""String and hash functions of the catalog, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File name endings of each kind.
EXTENSIONS = {
    "raw": ("cr2", "cr3", "nef", "arw", "dng", "raf", "orf", "rw2", "pef", "srw"),
    "jpeg": ("jpg", "jpeg"),
    "png": ("png",),
}
#: Texts that stand for no lens.
NO_LENS = ("undef", "none", "unknown", "n/a")
NAME_BYTES = 255


def file_type(path: Column) -> Column:
    """raw, jpeg, png or null, by the ending."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(*[F.when(ext.isin(*names), kind) for kind, names in EXTENSIONS.items()])


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    """Spark has no NFKD: only names beyond ASCII come here."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))
        return " ".join("".join(c if c.isalnum() else " " for c in plain).split())

    return names.map(one)


def normalised_name(name: Column | str) -> Column:
    """Lower case without marks; everything but letters and digits is one space."""
    name = F.col(name) if isinstance(name, str) else name
    plain = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    return F.when(name.rlike(r"^\p{ASCII}*$"), plain).otherwise(_folded(F.when(~name.rlike(r"^\p{ASCII}*$"), name)))


def renamed(typed: Column, suffix: Column) -> Column:
    """A safe new file name with the old ending, or null: no separators or control characters, not only dots, at most 255 bytes."""
    name = F.trim(typed)
    full = F.concat(name, suffix)
    bad = name.rlike(r'[\\/:*?"<>|\x00-\x1f]') | (name == "") | name.rlike(r"^\.+$") | (F.octet_length(full) > NAME_BYTES)
    return F.when(~bad, full)


def edit_stem(name: Column) -> Column:
    """The stem without a copy's suffix."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"_edit-\d+$", "")


def millimetres(x: Column) -> Column:
    """Whole numbers without a point."""
    return F.when(x == F.floor(x), F.format_string("%d", x.cast("long"))).otherwise(F.regexp_replace(F.format_string("%.4f", x), r"0+$", ""))


def once(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is computed once, however often the function names it."""
    return F.transform(F.array(value), function)[0]


def clean_lens(value: Column) -> Column:
    """A lens name: nothing for placeholders, ``8.8-25.7mm f/1.8-2.8`` for four numbers, else trimmed text.

    More than four numbers lose zeros at their start, then at their end, until
    four are left; other numbers alone name no lens. Each step names the one
    before several times, so each is computed once.
    """
    none = F.lit(None).cast("string")
    spread = lambda a, b: F.when(a == b, millimetres(a)).otherwise(F.concat(millimetres(a), F.lit("-"), millimetres(b)))
    spare = lambda xs: F.greatest(F.size(xs) - 4, F.lit(0))
    zeros = lambda xs: F.array_position(F.transform(xs, lambda x: x != 0), True).cast("int") - 1

    def made(core: Column) -> Column:
        at = lambda i: F.get(core, F.lit(i))
        name = F.concat(spread(at(0), at(1)), F.lit("mm"), F.when(at(2) > 0, F.concat(F.lit(" f/"), spread(at(2), at(3)))).otherwise(""))
        return F.when((F.size(core) == 4) & (at(0) > 0), name).otherwise(none)

    # all zeros lose as many as are to spare at the start
    head = lambda xs: once(zeros(xs), lambda z: F.when(z < 0, spare(xs)).otherwise(F.least(spare(xs), z)))
    cut = lambda xs: once(head(xs), lambda n: F.slice(xs, n + 1, F.size(xs) - n))
    core = lambda xs: F.slice(xs, 1, F.size(xs) - F.greatest(F.least(spare(xs), zeros(F.reverse(xs))), F.lit(0)))
    # what doesn't begin like a number is none, and is cheaper to tell so
    number = lambda x: F.when(x.rlike(r"^[\x00-\x20]*[-+.0-9iInN]"), x.try_cast("double"))
    numbered = lambda text, xs: F.when(F.exists(xs, lambda x: x.isNull()), text).otherwise(once(cut(xs), lambda c: once(core(c), made)))
    nothing = lambda text: text.isNull() | F.lower(text).isin("", *NO_LENS) | text.startswith("Unknown (") | text.startswith("0.0 mm")
    named = lambda text: F.when(nothing(text), none).otherwise(once(F.transform(F.split(text, r"\s+"), number), lambda xs: numbered(text, xs)))
    return once(F.trim(value), named)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit perceptual hashes in hex."""
    bits = lambda x: F.conv(x, 16, 10).cast("decimal(20,0)")
    signed = lambda x: F.when(bits(x) > 2**63 - 1, bits(x) - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(bits(x)).cast("long")
    return F.bit_count(signed(a).bitwiseXOR(signed(b)))


def library_path(taken_at: Column, name: Column) -> Column:
    """``YYYY/YYYY-MM-DD/name``."""
    return F.concat_ws("/", F.date_format(taken_at, "yyyy"), F.date_format(taken_at, "yyyy-MM-dd"), name)


def image_path(root: str, source_root_id: Column, file_path: Column) -> Column:
    """Paths of source roots are absolute, others lie in the library."""
    return F.when(source_root_id.isNull(), F.concat_ws("/", F.lit(root), file_path)).otherwise(file_path)


def split_name(name: Column) -> Column:
    """(stem, ext): ext is empty for a name without a dot or with a leading one only."""
    return F.struct(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"), F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1).alias("ext"))


def shutter(value: Column) -> Column:
    """Seconds as text to show: a dash for nothing, ``2.5s``, ``1/250``; what is no positive number stays."""
    seconds = value.try_cast("double")
    whole = F.regexp_replace(F.format_string("%.1f", F.round(seconds.cast("decimal(20,6)"), 1).cast("double")), r"\.0$", "")
    shown = F.when(seconds >= 1, F.concat(whole, F.lit("s"))).otherwise(F.concat(F.lit("1/"), F.floor(1 / seconds + 0.5).cast("string")))
    return F.when(value.isNull() | (value == ""), "—").when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0) | (seconds == float("inf")), value).otherwise(shown)


def whole_number(value: Column) -> Column:
    """A metadata value as a whole number, cut towards zero; null for ``undef`` and other text."""
    number = value.try_cast("double")
    return F.when(F.abs(number) < 2.0**63, number).cast("long")
