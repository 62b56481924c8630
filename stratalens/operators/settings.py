"""Key-value settings: typed reads with defaults, and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Defaults; the type of a default is the type of the setting.
DEFAULTS = {"sync_mode": "all", "sync_paused": False, "trash_days": 30, "place_radius_km": 25, "sections": "years,months,days,places,countries,tags,edits,moments"}
BOUNDS = {"trash_days": (0, 3650), "place_radius_km": (1, 500)}


def read(settings: DataFrame) -> dict:
    """All known settings of a table (key, value); unset or unreadable ones have their default, numbers are held to bounds."""
    given = {r["key"]: r["value"] for r in settings.where(F.col("key").isin(*DEFAULTS)).limit(len(DEFAULTS)).collect()}
    out = {}
    for key, default in DEFAULTS.items():
        text = given.get(key)
        if isinstance(default, bool):
            out[key] = default if text is None else text.lower() in ("1", "true", "yes")
        elif isinstance(default, int):
            low, high = BOUNDS[key]
            out[key] = min(high, max(low, int(text))) if text is not None and text.lstrip("-").isdigit() else default
        else:
            out[key] = default if text is None else text
    return out


def write(settings: DataFrame, values: dict) -> DataFrame:
    """The next snapshot with these values; an unknown key is refused."""
    if unknown := set(values) - set(DEFAULTS):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    new = settings.sparkSession.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in values.items()], "key string, value string")
    return settings.join(new.select("key"), "key", "left_anti").select("key", "value").unionByName(new)


def sections(settings: DataFrame) -> list[str]:
    """Enabled sections that are known; an empty text means none, unset means all."""
    known = DEFAULTS["sections"].split(",")
    return [s for s in known if s in read(settings)["sections"].split(",")]
