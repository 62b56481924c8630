"""Tone guard, chrome and calibration against plain Python."""

import colorsys
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import pixels


def curve(stops, hi, sh, wh, bl, c, br):
    """The sliders in units of 100, one pixel or a ramp."""

    def step(x, a, b):
        t = np.clip((x - a) / (b - a), 0, 1)
        return t * t * (3 - 2 * t)

    inner = max(-1, min(1, sh))
    out = stops + inner * 2.2 * step(-stops, -1.5, 4.5) + max(sh - inner, 0) * 3 * step(-stops, -0.5, 2.5) + min(sh - inner, 0) * 3 * step(-stops, -1.5, 3)
    out = out + hi * 2.2 * step(stops, -1.5, 4.5) + max(bl, 0) * 1.5 * step(-stops, 2.5, 6) + max(wh, 0) * 1.3 * step(stops, 2, 5) + min(wh, 0) * 1.6 * step(stops, 2.75, 6)
    out = out * (1 + (1.2 if c > 0 else 0.85) * c)
    seen = np.maximum(out, math.log2(1e-6 / 0.18))
    return out + 0.5 * br * np.exp(-(seen**2) / (2 * 2.2**2))


@pytest.mark.parametrize("sliders", [(0, 0, 0, 0, 0, 0), (100, -100, 50, 50, 30, 150), (-150, 150, -150, 150, -80, 200), (-150, 120, 0, 0, 0, -200), (0, 150, 0, 0, 0, 0)])
def test_tone_is_monotone_and_equals_a_plain_maximum(spark, sliders):
    ys = np.concatenate([[0.0, 1e-7, 200.0], np.exp2(np.linspace(-17, 7, 900)) * 0.18])
    rows = spark.createDataFrame([(float(y), *sliders) for y in ys], "y double, highlights int, shadows int, whites int, blacks int, contrast int, brightness int")
    got = {r.y: r.ratio for r in pixels.tone_ratio(rows).collect()}
    y0 = np.maximum(ys, 1e-6)
    stops = np.log2(y0 / 0.18)
    part = [v / 100 for v in sliders]
    want = curve(stops, *part)
    grid = np.linspace(-20, 10, 4096)
    on_grid = np.maximum(curve(grid, *part), math.log2(1e-9 / 0.18))
    turns = max(abs(v) for v in part[:4]) > 1 and bool((np.diff(on_grid) < 0).any())
    if turns:
        want = np.interp(stops, grid, np.maximum.accumulate(on_grid))
    assert turns == (not pixels.tone_guards(rows).isEmpty())
    assert np.allclose([got[y] for y in ys], np.exp2(want - stops), rtol=1e-9)
    shown = [y * got[y] for y in sorted(ys) if y >= 1e-6]
    assert not turns or all(a <= b * (1 + 1e-12) for a, b in zip(shown, shown[1:]))


def test_tone_takes_nulls_for_zero(spark):
    rows = spark.createDataFrame([(None, None, None, None, None, None, None, "x", 1.0), (0.5, None, 150, None, None, None, None, "y", 2.0)], "y double, highlights int, shadows int, whites int, blacks int, contrast int, brightness int, step string, ratio double")
    got = {r.step: r.ratio for r in pixels.tone_ratio(rows).collect()}
    assert got["x"] == pytest.approx(1.0) and got["y"] > 0


def test_chrome_and_calibration(spark):
    pts = [(r / 4, g / 4, b / 4) for r in range(5) for g in range(5) for b in range(5)]
    c = [F.col(n) for n in "rgb"]
    cal = {"red_hue": 80, "blue_hue": -30, "green_saturation": -90, "shadows_tint": -70}
    rows = spark.createDataFrame(pts, "r double, g double, b double").select("*", pixels.chrome(*c, F.lit(60.0), F.lit(-40.0)).alias("x"), F.struct(*c).alias("was"))
    near = lambda h, m: 0.5 + 0.5 * math.cos(math.pi * min(abs(h - m), 360 - abs(h - m)) / 90) if min(abs(h - m), 360 - abs(h - m)) < 90 else 0.0
    for done in pixels.calibrated(rows, cal).collect():
        row, after = done.was, done[:3]
        h, l, s = colorsys.rgb_to_hls(*row)
        h *= 360
        w = min(1, (max(row) - min(row)) * 1.4)
        f = (1 - 0.32 * 0.6 * w**1.5) * (1 + 0.35 * 0.4 * w * near(h, 250))
        assert tuple(done.x) == pytest.approx([min(1, v * f) for v in row])
        turned = (h + near(h, 0) * 24 - near(h, 240) * 9) % 360
        back = colorsys.hls_to_rgb(turned / 360, l, min(1, max(0, s * (1 - near(h, 120) * 0.45))))
        t = max(0, 1 - 2 * l) * -0.7 * 0.06
        assert after == pytest.approx([min(1, max(0, v + d * t)) for v, d in zip(back, (1, -1, 1))], abs=1e-9)
