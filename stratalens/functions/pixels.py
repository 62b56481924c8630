"""Per-pixel operators on rows of (r, g, b) doubles, as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Luma weights of sRGB.
LUMA = (0.2126, 0.7152, 0.0722)


def to_linear(v: Column) -> Column:
    """sRGB to linear light."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(v: Column) -> Column:
    """Linear light to sRGB, held to 0..1."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def base_gain(median_luma: Column) -> Column:
    """The browsing gain of a frame: its median to a tenth, between 1 and 8."""
    return F.least(F.lit(8.0), F.greatest(F.lit(1.0), F.lit(0.10) / median_luma))


def reinhard_ratio(y: Column, white: float = 4.0) -> Column:
    """The factor that a shared shoulder leaves of a luminance."""
    return (1 + y / (white * white)) / (1 + y)


def hue(r: Column, g: Column, b: Column) -> Column:
    """Degrees; greys are 0."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    sector = F.when(high == r, F.pmod((g - b) / span, F.lit(6.0))).when(high == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return F.when(span == 0, 0.0).otherwise(sector * 60.0)


def hsl(r: Column, g: Column, b: Column) -> Column:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    light, span = (high + low) / 2, high - low
    sat = F.when(span == 0, 0.0).otherwise(span / (1 - F.abs(2 * light - 1)))
    return F.struct(hue(r, g, b).alias("h"), sat.alias("s"), light.alias("l"))


def from_hsl(x: Column) -> Column:
    chroma = (1 - F.abs(2 * x["l"] - 1)) * x["s"]

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + x["h"] / 30.0, F.lit(12.0))
        return x["l"] - chroma / 2 * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))

    return F.struct(channel(0).alias("r"), channel(8).alias("g"), channel(4).alias("b"))


def saturated(r: Column, g: Column, b: Column, amount: Column) -> Column:
    """Channels moved from or to the luma; the factor doesn't go under 0."""
    y, f = luma(r, g, b), F.greatest(F.lit(0.0), 1 + amount / 100.0)
    return F.struct(*[(y + (c - y) * f).alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))])


def vibrant(r: Column, g: Column, b: Column, amount: Column) -> Column:
    """Saturation that spares what is saturated already."""
    span = F.greatest(r, g, b) - F.least(r, g, b)
    return saturated(r, g, b, amount * (1 - F.least(F.lit(1.0), span)))


def tone(y: Column, exposure: Column, contrast: Column, highlights: Column, shadows: Column) -> Column:
    """A luminance after exposure in stops, contrast about middle grey, and shifts of the bright and dark ends."""
    lit = y * F.pow(F.lit(2.0), exposure)
    stops = F.log2(F.greatest(lit, F.lit(1e-6)) / 0.18)
    bright, dark = 1 / (1 + F.exp(-(stops - 1.5) * 2)), 1 / (1 + F.exp((stops + 1.5) * 2))
    moved = stops * (1 + contrast / 200.0) + bright * highlights / 100.0 + dark * shadows / 100.0
    return 0.18 * F.pow(F.lit(2.0), moved)


#: Middle grey; the regions of the tone sliders as (slider, part of its travel, stops at full travel, where the
#: region begins and is full in stops from middle grey, its side); gains of contrast up and down; width of the brightness bell.
GREY = 0.18
REGIONS = (
    ("shadows", "within", 2.2, -1.5, 4.5, -1),
    ("shadows", "above", 3.0, -0.5, 2.5, -1),
    ("shadows", "below", 3.0, -1.5, 3.0, -1),
    ("highlights", "whole", 2.2, -1.5, 4.5, 1),
    ("blacks", "positive", 1.5, 2.5, 6.0, -1),
    ("whites", "positive", 1.3, 2.0, 5.0, 1),
    ("whites", "negative", 1.6, 2.75, 6.0, 1),
)
CONTRAST_UP, CONTRAST_DOWN, BELL = 1.2, 0.85, 2.2
TONE_SLIDERS = ("highlights", "shadows", "whites", "blacks", "contrast", "brightness")
#: The grid of the guard in stops from middle grey.
GUARD_FROM, GUARD_TO, GUARD_STEPS = -20.0, 10.0, 4096


def _travel(v: Column, part: str) -> Column:
    """The part of a slider's travel, in units of 100, that drives a region."""
    zero, one = F.lit(0.0), F.lit(1.0)
    within = F.greatest(-one, F.least(one, v))
    return {"whole": v, "positive": F.greatest(v, zero), "negative": F.least(v, zero), "within": within, "above": F.greatest(v - within, zero), "below": F.least(v - within, zero)}[part]


def tone_stops(stops: Column, sliders: dict[str, Column]) -> Column:
    """Stops from middle grey after the tone sliders (-150 to 150; brightness -200 to 200), each a column of :data:`TONE_SLIDERS`.

    Regions shift by smooth steps, contrast turns the line about middle grey,
    brightness lifts a bell around it; all of it sums in stops.
    """
    at = {n: F.coalesce(sliders[n], F.lit(0)) / 100.0 for n in TONE_SLIDERS}
    out = stops
    for slider, part, most, start, full, side in REGIONS:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (stops * side - start) / (full - start)))
        out = out + _travel(at[slider], part) * most * t * t * (3 - 2 * t)
    out = out * (1 + F.when(at["contrast"] > 0, CONTRAST_UP).otherwise(CONTRAST_DOWN) * at["contrast"])
    seen = F.greatest(out, F.log2(F.lit(1e-6 / GREY)))
    return out + 0.5 * at["brightness"] * F.exp(-(seen * seen) / (2 * BELL * BELL))


def tone_guards(settings: DataFrame) -> DataFrame:
    """(sliders, step, low, high) of the settings whose curve would turn back: its running maximum at a grid step and at the next.

    ``settings`` has the columns :data:`TONE_SLIDERS`. Only those with a slider
    of the four regions beyond 100 are looked at. One window is one setting's
    4,096 steps.
    """
    keys = [F.coalesce(F.col(n), F.lit(0)).cast("double").alias(n) for n in TONE_SLIDERS]
    beyond = F.greatest(*[F.abs(F.col(n)) for n in TONE_SLIDERS[:4]]) > 100 + 1e-4
    steps = settings.select(*keys).distinct().where(beyond).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(GUARD_STEPS - 1))))
    at = GUARD_FROM + F.col("step") * ((GUARD_TO - GUARD_FROM) / (GUARD_STEPS - 1))
    curve = steps.withColumn("__v", F.greatest(tone_stops(at, {n: F.col(n) for n in TONE_SLIDERS}), F.log2(F.lit(1e-9 / GREY))))
    own = Window.partitionBy(*TONE_SLIDERS)
    along = own.orderBy("step")
    held = curve.withColumns({"low": F.max("__v").over(along), "__back": (F.col("__v") < F.lag("__v").over(along)).cast("int")})
    held = held.withColumns({"high": F.coalesce(F.lead("low").over(along), F.col("low")), "__turns": F.max("__back").over(own)})
    return held.where("__turns = 1").select(*TONE_SLIDERS, "step", "low", "high")


def tone_ratio(frame: DataFrame, y: str = "y") -> DataFrame:
    """``frame(.., y, sliders)`` with ``ratio``, the factor that the tone sliders ask of a linear luminance.

    Settings whose curve would turn back take the guard's, interpolated between
    its steps: they meet it by setting and step. A null slider is 0, and so is a
    null luminance.
    """
    frame = frame.withColumns({n: F.coalesce(F.col(n), F.lit(0)).cast("double") for n in TONE_SLIDERS})
    guards = tone_guards(frame.select(*TONE_SLIDERS)).select(*TONE_SLIDERS, *[F.col(c).alias(f"__{c}") for c in ("step", "low", "high")])
    stops = F.log2(F.greatest(F.coalesce(F.col(y), F.lit(0.0)), F.lit(1e-6)) / GREY)
    place = F.greatest(F.lit(0.0), F.least(F.lit(float(GUARD_STEPS - 1)), (stops - GUARD_FROM) / ((GUARD_TO - GUARD_FROM) / (GUARD_STEPS - 1))))
    rows = frame.withColumns({"__stops": stops, "__place": place}).withColumn("__step", F.floor("__place").cast("int"))
    met = rows.join(guards, [*TONE_SLIDERS, "__step"], "left")
    held = F.col("__low") + (F.col("__high") - F.col("__low")) * (F.col("__place") - F.col("__step"))
    after = F.coalesce(held, tone_stops(F.col("__stops"), {n: F.col(n) for n in TONE_SLIDERS}))
    return met.withColumn("ratio", F.pow(F.lit(2.0), after - F.col("__stops"))).select(*[c for c in frame.columns if c != "ratio"], "ratio")


def _near(h: Column, centre: float) -> Column:
    """A raised cosine over hue that ends a quarter turn from its centre."""
    d = F.abs(h - centre)
    d = F.least(d, 360.0 - d)
    return F.when(d < 90.0, 0.5 + 0.5 * F.cos(d * (3.141592653589793 / 90.0))).otherwise(0.0)


def chrome(r: Column, g: Column, b: Column, amount: Column, blue: Column) -> Column:
    """Colourful pixels made deeper by their chroma, and blue ones again by how near their hue is to 250 degrees."""
    weight = F.least(F.lit(1.0), (F.greatest(r, g, b) - F.least(r, g, b)) * 1.4)
    factor = (1 - 0.32 * amount / 100.0 * F.pow(weight, F.lit(1.5))) * (1 - 0.35 * blue / 100.0 * weight * _near(hue(r, g, b), 250.0))
    return F.struct(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), c * factor)).alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))])


#: The primaries' hues.
PRIMARIES = (("red", 0.0), ("green", 120.0), ("blue", 240.0))


def calibrated(frame: DataFrame, amounts: dict[str, float]) -> DataFrame:
    """``frame(.., r, g, b)``: primaries turned by up to 30 degrees and saturated by up to a half, then a green or magenta tint of the shadows.

    ``amounts`` has red_hue, red_saturation, .., shadows_tint, each -100 to 100; those that lack are 0.
    """
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rows = frame.withColumn("__x", hsl(F.col("r"), F.col("g"), F.col("b")))
    rows = rows.withColumns({f"__{name}": _near(F.col("__x.h"), centre) for name, centre in PRIMARIES})
    turn, scale = F.lit(0.0), F.lit(1.0)
    for name, _ in PRIMARIES:
        turn = turn + F.col(f"__{name}") * (0.3 * amounts.get(f"{name}_hue", 0))
        scale = scale * (1 + F.col(f"__{name}") * (0.005 * amounts.get(f"{name}_saturation", 0)))
    rows = rows.withColumn("__x", F.struct(F.pmod(F.col("__x.h") + turn, F.lit(360.0)).alias("h"), held(F.col("__x.s") * scale).alias("s"), F.col("__x.l").alias("l")))
    rows = rows.withColumns({"__y": from_hsl(F.col("__x")), "__t": held(1 - F.col("__x.l") * 2) * (0.0006 * amounts.get("shadows_tint", 0))})
    out = {n: held(held(F.col(f"__y.{n}")) + side * F.col("__t")) for n, side in (("r", 1), ("g", -1), ("b", 1))}
    return rows.withColumns(out).select(*frame.columns)


def band_weight(h: Column, centre: float, width: float = 45.0) -> Column:
    """A tent over hue; neighbouring tents at ``width`` apart sum to one."""
    d = F.abs(F.pmod(h - centre + 180.0, F.lit(360.0)) - 180.0)
    return F.greatest(F.lit(0.0), 1 - d / width)


def graded(r: Column, g: Column, b: Column, hue_deg: float, strength: float, zone: str) -> Column:
    """A tint laid over the shadows, midtones or highlights by luma."""
    y = luma(r, g, b)
    weight = {"shadows": F.pow(1 - y, F.lit(2.0)), "highlights": F.pow(y, F.lit(2.0)), "midtones": 4 * y * (1 - y)}[zone]
    tint = from_hsl(F.struct(F.lit(float(hue_deg)).alias("h"), F.lit(1.0).alias("s"), F.lit(0.5).alias("l")))
    return F.struct(*[(c + weight * strength * (tint[n] - 0.5)).alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))])


def vignette(x: Column, y: Column, width: int, height: int, amount: float) -> Column:
    """A radial factor of 1 in the middle."""
    d = F.pow((x - (width - 1) / 2) / (width / 2), F.lit(2.0)) + F.pow((y - (height - 1) / 2) / (height / 2), F.lit(2.0))
    return 1 + amount / 100.0 * d / 2


def radial_mask(x: Column, y: Column, cx: float, cy: float, rx: float, ry: float, feather: float) -> Column:
    d = F.sqrt(F.pow((x - cx) / rx, F.lit(2.0)) + F.pow((y - cy) / ry, F.lit(2.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - d) / max(feather, 1e-6) + 0.5))


def linear_mask(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    length = (x1 - x0) ** 2 + (y1 - y0) ** 2
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / length))


def luminance_mask(y: Column, low: float, high: float, feather: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - low) / feather + 1, (high - y) / feather + 1))


def composed(fields: list[tuple[str, Column]]) -> Column:
    """Mask fields joined in turn: the first is the base, then add, subtract or intersect."""
    out = fields[0][1]
    for mode, f in fields[1:]:
        out = {"additive": F.greatest(out, f), "subtractive": F.greatest(F.lit(0.0), out - f), "intersect": F.least(out, f)}[mode]
    return out


def developed(frame: DataFrame, adjustments: dict[str, float]) -> DataFrame:
    """``frame(.., r, g, b)`` in sRGB through the fixed order: linear tone, encode, vibrance, saturation."""
    get = lambda n: F.lit(float(adjustments.get(n, 0)))
    lin = frame.withColumns({c: to_linear(F.col(c)) for c in "rgb"}).withColumn("__y", luma(F.col("r"), F.col("g"), F.col("b")))
    ratio = tone(F.col("__y"), get("exposure"), get("contrast"), get("highlights"), get("shadows")) / F.greatest(F.col("__y"), F.lit(1e-6))
    out = lin.withColumn("__ratio", ratio).withColumns({c: to_srgb(F.col(c) * F.col("__ratio")) for c in "rgb"}).drop("__y", "__ratio")
    for step, name in ((vibrant, "vibrance"), (saturated, "saturation")):
        out = out.withColumn("__x", step(F.col("r"), F.col("g"), F.col("b"), get(name))).withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__x")[c])) for c in "rgb"}).drop("__x")
    return out
