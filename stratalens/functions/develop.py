"""Develop documents: nested adjustment objects, normalised, compared and blended as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .strings import once as _once

#: Scalar adjustments with their lowest, highest and neutral value; whole numbers but for exposure.
SCALARS = {
    "exposure": (-8.0, 8.0, 0.0),
    "brightness": (-200, 200, 0),
    "contrast": (-100, 100, 0),
    "highlights": (-200, 200, 0),
    "shadows": (-200, 200, 0),
    "whites": (-200, 200, 0),
    "blacks": (-200, 200, 0),
    "temperature": (-250, 250, 0),
    "tint": (-250, 250, 0),
    "vibrance": (-200, 200, 0),
    "saturation": (-200, 200, 0),
    "hue": (-180, 180, 0),
    "sharpness": (-100, 100, 0),
    "sharpness_threshold": (0, 80, 15),
    "clarity": (-100, 100, 0),
    "dehaze": (-100, 100, 0),
    "structure": (-100, 100, 0),
    "denoise": (0, 100, 0),
    "luma_noise_reduction": (0, 100, 0),
    "color_noise_reduction": (0, 100, 0),
    "chromatic_aberration_red_cyan": (-100, 100, 0),
    "chromatic_aberration_blue_yellow": (-100, 100, 0),
    "glow_amount": (0, 100, 0),
    "halation_amount": (0, 100, 0),
    "flare_amount": (0, 100, 0),
    "grain_amount": (0, 100, 0),
    "grain_size": (0, 100, 25),
    "grain_roughness": (0, 100, 50),
    "vignette_amount": (-100, 100, 0),
    "vignette_midpoint": (0, 100, 50),
    "vignette_roundness": (-100, 100, 0),
    "vignette_feather": (0, 100, 50),
    "lut_intensity": (0, 100, 100),
    "chrome_effect": (0, 100, 0),
    "chrome_blue": (0, 100, 0),
    "mist": (0, 100, 0),
    "frame_width": (0, 20, 0),
}
#: Named choices, the neutral one first.
ENUMS = {
    "tone_mapper": ("basic", "agx"),
    "curve_mode": ("point", "parametric"),
    "film_sim": ("none", "provia", "velvia", "astia", "classic_chrome", "classic_neg", "nostalgic_neg", "eterna", "acros", "acros_ye", "acros_r", "monochrome"),
}
#: Colour bands, curve channels, and the parts of curves, wheels and calibration with their neutral values.
BANDS = ("red", "orange", "yellow", "green", "aqua", "blue", "purple", "magenta")
CHANNELS = ("luma", "red", "green", "blue")
PARAMETRIC = {"highlights": 0, "lights": 0, "darks": 0, "shadows": 0, "white_level": 0, "black_level": 0, "split1": 25, "split2": 50, "split3": 75}
ZONES = ("shadows", "midtones", "highlights", "global")
WHEEL = {"hue": (0, 360, 0), "saturation": (0, 100, 0), "luminance": (-100, 100, 0)}
CALIBRATION = ("shadows_tint", "red_hue", "red_saturation", "green_hue", "green_saturation", "blue_hue", "blue_saturation")
#: The groups that a partial copy names.
GROUPS = {
    "tone": ("exposure", "brightness", "contrast", "highlights", "shadows", "whites", "blacks", "tone_mapper"),
    "white_balance": ("temperature", "tint"),
    "color": ("vibrance", "saturation", "hue", "chrome_effect", "chrome_blue", "film_sim", "hsl", "color_grading", "color_calibration"),
    "details": ("sharpness", "sharpness_threshold", "clarity", "dehaze", "structure", "denoise", "luma_noise_reduction", "color_noise_reduction", "chromatic_aberration_red_cyan", "chromatic_aberration_blue_yellow"),
    "curves": ("curve_mode", "point_curves", "parametric_curve"),
    "effects": ("glow_amount", "halation_amount", "flare_amount", "grain_amount", "grain_size", "grain_roughness", "vignette_amount", "vignette_midpoint", "vignette_roundness", "vignette_feather", "lut_intensity", "mist"),
}
#: Kinds and modes of a mask's parts; points of a curve at most; where blended curves are read.
MASK_TYPES = ("radial", "linear", "brush", "luminance", "color", "semantic", "all")
MASK_MODES = ("additive", "subtractive", "intersect")
CURVE_POINTS = 16
CURVE_XS = (0, 32, 64, 96, 128, 160, 192, 224, 255)


def clamp(value: Column, low: float, high: float, default: float) -> Column:
    """A number, or text of one, within bounds; no number, the default; whole bounds round half to even, and zero has no sign."""
    number = F.coalesce(F.nanvl(value.try_cast("double"), F.lit(float(default))), F.lit(float(default)))
    held = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), number))
    return held + F.lit(0.0) if isinstance(low, float) else F.bround(held).cast("int")


def parsed(doc: Column) -> Column:
    """The document as a variant, which tells nulls, truth values, numbers and text apart; malformed text, or an object that repeats a key, is null."""
    return F.try_parse_json(doc)


def _at(value: Column, path: str, kind: str) -> Column:
    """A part of a variant; one that is missing, or of a kind that doesn't turn into ``kind``, is null."""
    return F.try_variant_get(value, path, kind)


def _number(value: Column, path: str, low: float, high: float, default: float) -> Column:
    given = _at(value, path, "double")
    held = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.nanvl(given, F.lit(float(default)))))
    # most values are missing, and then nothing else is computed
    return F.when(given.isNull(), F.lit(default)).otherwise(held + F.lit(0.0) if isinstance(low, float) else F.bround(held).cast("int"))


def _section(value: Column, name: str, function: Callable[[Column], Column], neutral: Column) -> Column:
    """A part of the document by ``function`` of it, or ``neutral`` if it is missing."""
    return _once(_at(value, f"$.{name}", "variant"), lambda x: F.when(x.isNull(), neutral).otherwise(function(x)))


def _list(value: Column, path: str = "$") -> Column:
    return F.coalesce(_at(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _object(value: Column, path: str = "$") -> Column:
    return _at(value, path, "map<string,variant>")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def truth(value: Column, default: bool) -> Column:
    """Whether a JSON value holds: null, false, 0, and empty text, lists and objects don't; one that is missing is ``default``."""
    kind = _kind(value)
    held = (
        F.when(F.is_variant_null(value), False).when(kind == "BOOLEAN", _at(value, "$", "boolean")).when(kind == "STRING", _at(value, "$", "string") != "")
        .when(kind.startswith("ARRAY"), F.size(_list(value)) > 0).when(kind.startswith("OBJECT"), F.size(F.map_keys(_object(value))) > 0).otherwise(_at(value, "$", "double") != 0)
    )
    return F.when(value.isNull(), F.lit(default)).otherwise(held)


def _text(value: Column, default: str) -> Column:
    """A JSON value as text: of null None, of truth values True and False; one that is missing is ``default``."""
    flag = F.when(_at(value, "$", "boolean"), "True").otherwise("False")
    shown = F.when(F.is_variant_null(value), "None").when(_kind(value) == "BOOLEAN", flag).otherwise(F.coalesce(_at(value, "$", "string"), F.to_json(value)))
    return F.when(value.isNull(), F.lit(default)).otherwise(shown)


def _curve(value: Column, path: str) -> Column:
    """The first sixteen points in bounds; the straight line unless two or more come."""
    straight = F.array(F.array(F.lit(0), F.lit(0)), F.array(F.lit(255), F.lit(255)))

    def clean(points: Column) -> Column:
        pairs = F.filter(F.transform(F.slice(points, 1, CURVE_POINTS), lambda p: _list(p)), lambda p: F.size(p) >= 2)
        return F.transform(pairs, lambda p: F.array(_number(p[0], "$", 0, 255, 0), _number(p[1], "$", 0, 255, 0)))

    held = lambda points: _once(clean(points), lambda x: F.when(F.size(x) >= 2, x).otherwise(straight))
    return _once(_list(value, path), lambda points: F.when(F.size(points) >= 2, held(points)).otherwise(straight))


def _sparse(value: Column) -> Column:
    """Of a mask's adjustments those that are known and not neutral."""
    held = _object(value, "$.adjustments")
    spec = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"), F.lit(float(default)).alias("default"), F.lit(not isinstance(low, float)).alias("whole")) for n, (low, high, default) in SCALARS.items()])

    def one(s: Column) -> Column:
        number = _at(F.try_element_at(held, s["name"]), "$", "double")
        bound = F.greatest(s["low"], F.least(s["high"], number))
        now = F.when(number.isNull() | F.isnan(number), s["default"]).when(s["whole"], F.bround(bound)).otherwise(bound)
        return F.struct(s["name"].alias("name"), now.alias("now"), (now != s["default"]).alias("counts"))

    some = F.filter(F.transform(spec, one), lambda x: x["counts"])
    return F.map_from_entries(F.transform(some, lambda x: F.struct(x["name"], x["now"])))


def _masks(value: Column) -> Column:
    """Masks with the parts of a known type; what is no object is left out."""
    has = lambda m, name: F.try_element_at(m, F.lit(name))
    shown = lambda v: F.when(_kind(v) == "STRING", _at(v, "$", "string")).otherwise(F.to_json(v))
    given = lambda s: F.coalesce(F.transform_values(_object(has(s, "parameters")), lambda _, v: shown(v)), F.create_map().cast("map<string,string>"))
    word = lambda s, name: F.when(_kind(has(s, name)) == "STRING", _at(has(s, name), "$", "string"))
    part = lambda s: F.struct(
        _text(has(s, "id"), "").alias("id"), word(s, "type").alias("type"), F.when(word(s, "mode").isin(*MASK_MODES), word(s, "mode")).otherwise("additive").alias("mode"),
        truth(has(s, "visible"), True).alias("visible"), truth(has(s, "invert"), False).alias("invert"), given(s).alias("parameters"),
    )
    objects = lambda items: F.filter(F.transform(items, lambda x: _object(x)), lambda x: x.isNotNull())
    parts = lambda v: F.transform(F.filter(objects(_list(v, "$.sub_masks")), lambda s: F.coalesce(word(s, "type").isin(*MASK_TYPES), F.lit(False))), part)
    mask = lambda v: F.struct(
        _text(_at(v, "$.id", "variant"), "").alias("id"), _text(_at(v, "$.name", "variant"), "Mask").alias("name"), truth(_at(v, "$.visible", "variant"), True).alias("visible"),
        _number(v, "$.opacity", 0, 100, 100).alias("opacity"), truth(_at(v, "$.invert", "variant"), False).alias("invert"), parts(v).alias("sub_masks"), _sparse(v).alias("adjustments"),
    )
    return F.transform(F.filter(_list(value, "$.masks"), lambda v: _object(v).isNotNull()), mask)


def _scalar(value: Column, name: str) -> Column:
    return _number(value, f"$.{name}", *SCALARS[name])


def scalar(doc: Column, name: str) -> Column:
    """One adjustment of a document as :func:`normalised` has it, without the others."""
    return _scalar(parsed(doc), name)


def normalised(doc: Column, names: Iterable[str] | None = None) -> Column:
    """Every key present and in bounds, unknown keys dropped; of a caller that reads some keys only, those of ``names``.

    Kinds count as in JSON: true is the number 1 and false 0, text counts as the
    number that it spells, null and everything else as none. Masks' flags hold
    as in :func:`truth`. A null or malformed document is neutral. The text is
    parsed once a row: the lambda's variable stands for it, which no rule of the
    optimiser copies into each field.
    """
    wanted = None if names is None else set(names)
    return _once(parsed(doc), lambda raw: _normalised(raw, wanted))


def _normalised(raw: Column, wanted: set[str] | None) -> Column:
    hsl = lambda x: F.struct(*[F.array(*[_number(x, f"$.{b}[{i}]", -100, 100, 0) for i in range(3)]).alias(b) for b in BANDS])
    curves = lambda x: F.struct(*[_curve(x, f"$.{c}").alias(c) for c in CHANNELS])
    parametric = lambda x: F.struct(*[F.struct(*[_number(x, f"$.{c}.{k}", -100, 100, d).alias(k) for k, d in PARAMETRIC.items()]).alias(c) for c in CHANNELS])
    wheels = lambda x: [F.struct(*[_number(x, f"$.{z}.{k}", *spec).alias(k) for k, spec in WHEEL.items()]).alias(z) for z in ZONES]
    grading = lambda x: F.struct(*wheels(x), _number(x, "$.blending", 0, 100, 50).alias("blending"), _number(x, "$.balance", -100, 100, 0).alias("balance"))
    calibration = lambda x: F.struct(*[_number(x, f"$.{k}", -100, 100, 0).alias(k) for k in CALIBRATION])
    parts = {"hsl": hsl, "point_curves": curves, "parametric_curve": parametric, "color_grading": grading, "color_calibration": calibration}
    choice = lambda n, names: _once(_at(raw, f"$.{n}", "string"), lambda x: F.when(x.isin(*names), x).otherwise(names[0]))
    fields = {n: lambda n=n: _scalar(raw, n) for n in SCALARS} | {n: lambda n=n, names=names: choice(n, names) for n, names in ENUMS.items()}
    fields |= {n: lambda n=n, f=f: _section(raw, n, f, _neutral()[n]) for n, f in parts.items()} | {"masks": lambda: _masks(raw)}
    return F.struct(*[f().alias(n) for n, f in fields.items() if wanted is None or n in wanted])


def _literal(value) -> Column:
    if isinstance(value, dict):
        return F.struct(*[_literal(v).alias(k) for k, v in value.items()])
    return F.array(*map(_literal, value)) if isinstance(value, list) else F.lit(value)


def _neutral() -> dict[str, Column]:
    """The neutral value of each key but masks: literals once the optimiser has folded them."""
    line = [[0, 0], [255, 255]]
    out = {n: default for n, (_, _, default) in SCALARS.items()} | {n: names[0] for n, names in ENUMS.items()}
    out |= {"hsl": {b: [0, 0, 0] for b in BANDS}, "point_curves": {c: line for c in CHANNELS}, "parametric_curve": {c: PARAMETRIC for c in CHANNELS}}
    out["color_grading"] = {z: {k: default for k, (_, _, default) in WHEEL.items()} for z in ZONES} | {"blending": 50, "balance": 0}
    out["color_calibration"] = {k: 0 for k in CALIBRATION}
    return {k: _literal(v) for k, v in out.items()}


def is_neutral(adjustments: Column) -> Column:
    """Whether a normalised document changes nothing: all values neutral and no visible mask with a part and an adjustment."""
    plain = [(n, value) for n, value in _neutral().items()]
    acts = lambda m: m["visible"] & (F.size(m["sub_masks"]) > 0) & (F.size(F.map_keys(m["adjustments"])) > 0)
    return _once(adjustments, lambda a: (F.struct(*[a[n].alias(n) for n, _ in plain]) == F.struct(*[v.alias(n) for n, v in plain])) & ~F.exists(a["masks"], acts))


def dumped(adjustments: Column) -> Column:
    """JSON text; a neutral document is null."""
    return F.when(~is_neutral(adjustments), F.to_json(adjustments))


def only_groups(doc: Column, groups: list[str]) -> Column:
    """The fields of the enabled groups, as a map from name to JSON text."""
    names = [n for g in groups for n in GROUPS.get(g, ())]
    return F.map_filter(F.from_json(doc, "map<string,string>"), lambda k, _: k.isin(*names) if names else F.lit(False))


def merged(current: Column, partial: Column) -> Column:
    """A partial document laid over the current one, both maps from name to JSON text."""
    return F.map_concat(F.map_filter(current, lambda k, _: ~F.map_contains_key(partial, k)), partial)


def _polar(x: Column, y: Column) -> Column:
    return F.when((F.abs(x) < 1e-9) & (F.abs(y) < 1e-9), 0.0).otherwise(F.degrees(F.atan2(y, x)))


def blended(neighbours: DataFrame, by: str = "query") -> DataFrame:
    """``neighbours(query, weight, adj)``: one document of a query's few neighbours, without masks.

    Numbers are weighted means, rounded as clamped; the hue is a circular mean
    and wheels are averaged as vectors; choices are voted on, equal weights in
    order of name; curves are read at nine places, and one that stays within
    one of the straight line is that line.
    """
    adj, aggs = F.col("adj"), {}
    # one division at the end: sums of whole weights are exact, and so is a mean that lies halfway
    mean = lambda c: F.sum(F.col("weight") * c) / F.sum("weight")
    for name in SCALARS:
        aggs[name] = mean(adj[name])
    aggs["hue"] = _polar(mean(F.cos(F.radians(adj["hue"]))), mean(F.sin(F.radians(adj["hue"]))))
    for b in BANDS:
        for i in range(3):
            aggs[f"hsl_{b}_{i}"] = mean(adj["hsl"][b][i])
    for z in ZONES:
        wheel = adj["color_grading"][z]
        aggs[f"x_{z}"], aggs[f"y_{z}"] = (mean(wheel["saturation"] * f(F.radians(wheel["hue"]))) for f in (F.cos, F.sin))
        aggs[f"l_{z}"] = mean(wheel["luminance"])
    for k in ("blending", "balance"):
        aggs[k] = mean(adj["color_grading"][k])
    for k in CALIBRATION:
        aggs[f"cal_{k}"] = mean(adj["color_calibration"][k])
    for c in CHANNELS:
        for k in PARAMETRIC:
            aggs[f"par_{c}_{k}"] = mean(adj["parametric_curve"][c][k])
        points = F.array_sort(adj["point_curves"][c])
        for x in CURVE_XS:
            aggs[f"y_{c}_{x}"] = mean(interpolated(points, F.lit(x)))
    for name, names in ENUMS.items():
        for choice in names:
            aggs[f"vote_{name}_{choice}"] = mean((adj[name] == choice).cast("double"))
    means = neighbours.groupBy(by).agg(*[a.alias(n) for n, a in aggs.items()])
    held = lambda name, *spec: clamp(F.col(name).cast("string"), *spec)
    fields = [held(n, *spec).alias(n) for n, spec in SCALARS.items()]
    fields += [F.array_max(F.array(*[F.struct(F.col(f"vote_{n}_{c}").alias("w"), F.lit(c).alias("v")) for c in names]))["v"].alias(n) for n, names in ENUMS.items()]
    fields.append(F.struct(*[F.array(*[held(f"hsl_{b}_{i}", -100, 100, 0) for i in range(3)]).alias(b) for b in BANDS]).alias("hsl"))
    line = F.array(F.array(F.lit(0), F.lit(0)), F.array(F.lit(255), F.lit(255)))
    curve = lambda c: F.when(F.greatest(*[F.abs(F.col(f"y_{c}_{x}") - x) for x in CURVE_XS]) < 1, line).otherwise(F.array(*[F.array(F.lit(x), held(f"y_{c}_{x}", 0, 255, 0)) for x in CURVE_XS]))
    fields.append(F.struct(*[curve(c).alias(c) for c in CHANNELS]).alias("point_curves"))
    fields.append(F.struct(*[F.struct(*[held(f"par_{c}_{k}", -100, 100, d).alias(k) for k, d in PARAMETRIC.items()]).alias(c) for c in CHANNELS]).alias("parametric_curve"))
    wheels = [wheel_blend(F.col(f"x_{z}"), F.col(f"y_{z}"), F.col(f"l_{z}")).alias(z) for z in ZONES]
    fields.append(F.struct(*wheels, held("blending", 0, 100, 50).alias("blending"), held("balance", -100, 100, 0).alias("balance")).alias("color_grading"))
    fields.append(F.struct(*[held(f"cal_{k}", -100, 100, 0).alias(k) for k in CALIBRATION]).alias("color_calibration"))
    return means.select(by, *fields)


def wheel_blend(x: Column, y: Column, luminance: Column) -> Column:
    """A wheel from its mean vector: hue by the angle, saturation by the length."""
    reach = F.hypot(x, y)
    hue = F.when(reach > 1e-9, F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))).otherwise(0.0)
    parts = (("hue", hue), ("saturation", reach), ("luminance", luminance))
    return F.struct(*[clamp(c.cast("string"), *WHEEL[k]).alias(k) for k, c in parts])


def from_legacy(exposure: Column, hue: Column, saturation: Column) -> Column:
    """Old sliders to the new: exposure / 50, hue x 1.8, positive saturation as vibrance."""
    return F.struct((exposure / 50.0).alias("exposure"), F.bround(hue * 1.8).cast("int").alias("hue"), F.when(saturation > 0, saturation).otherwise(0).alias("vibrance"), F.when(saturation < 0, saturation).otherwise(0).alias("saturation"))


def interpolated(points: Column, x: Column) -> Column:
    """A curve through sorted points at x, straight between them and level beyond."""
    below, above = F.filter(points, lambda p: p[0] <= x), F.filter(points, lambda p: p[0] > x)
    last, first = F.element_at(below, -1), F.element_at(above, 1)
    inner = last[1] + (first[1] - last[1]) * (x - last[0]) / F.nullif(first[0] - last[0], F.lit(0))
    return F.when(F.size(below) == 0, first[1].cast("double")).when(F.size(above) == 0, last[1].cast("double")).otherwise(inner)
