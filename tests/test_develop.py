"""Develop documents by the kinds of their JSON values."""

import pytest
from pyspark.sql import functions as F

from stratalens.functions import develop


def read(spark, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, doc string").select("k", develop.normalised(F.col("doc")).alias("n"))
    return rows.select("k", "n", develop.is_neutral(F.col("n")).alias("neutral")).orderBy("k").collect()


@pytest.mark.parametrize(("value", "holds", "opacity"), [("null", False, 100), ("true", True, 1), ("false", False, 0), ('"false"', True, 100), ('""', False, 100), ("0", False, 0), ("[]", False, 100), ("[null]", True, 100), ("{}", False, 100), ('{"a": null}', True, 100), ("2.5", True, 2), ('"70"', True, 70), ("1e9", True, 100)])
def test_flags_and_numbers_of_masks(spark, value, holds, opacity):
    doc = f'{{"masks": [{{"visible": {value}, "invert": {value}, "opacity": {value}, "sub_masks": [{{"type": "brush", "visible": {value}, "invert": {value}}}]}}]}}'
    mask = read(spark, doc)[0].n.masks[0]
    part = mask.sub_masks[0]
    assert (mask.visible, mask.invert, mask.opacity, part.visible, part.invert) == (holds, holds, opacity, holds, holds)


def test_masks_keep_what_is_known(spark):
    doc = '{"masks": [null, 3, [], {}, {"id": 5, "name": null, "sub_masks": {"type": "all"}, "adjustments": [1]}, {"id": true, "adjustments": {"exposure": "2.5", "contrast": 0, "hue": 999, "tint": null, "x": 1}, "sub_masks": [{"type": "linear", "mode": "subtractive", "id": 1.5, "parameters": {"a": "t", "b": [1, 2], "c": null}}, {"type": "nothing"}, {"type": 7}, {"mode": "additive"}, {"type": "all", "mode": 3, "parameters": []}]}]}'
    plain, first, last = read(spark, doc)[0].n.masks
    assert (plain.id, plain.name, plain.visible, plain.opacity, plain.invert, plain.sub_masks, plain.adjustments) == ("", "Mask", True, 100, False, [], {})
    assert (first.id, first.name, first.sub_masks, first.adjustments) == ("5", "None", [], {})
    assert last.id == "True" and last.adjustments == {"exposure": 2.5, "hue": 180.0}
    assert [(p.type, p.mode, p.id, p.parameters) for p in last.sub_masks] == [("linear", "subtractive", "1.5", {"a": "t", "b": "[1,2]", "c": "null"}), ("all", "additive", "", {})]


def test_values_outside_masks(spark):
    rows = read(spark, '{"contrast": true, "exposure": -0.0, "hue": "nan", "film_sim": 3, "hsl": {"red": [true, null, "5", 9], "blue": 4, "green": [-500]}}', '{"exposure": -0.0}', '[1]', "5", None, "broken {", '{"point_curves": {"luma": [[0, 9], 4, [300, "7", 1], [true]], "red": [[1, 1]], "blue": [[0, 0]]}, "parametric_curve": {"red": {"split1": null, "lights": 1e3}, "blue": 3}, "color_grading": {"global": {"hue": 361, "saturation": "x"}, "blending": null}, "color_calibration": []}')
    n = rows[0].n
    assert (n.contrast, n.hue, n.film_sim, n.hsl.red, n.hsl.blue, n.hsl.green) == (1, 0, "none", [1, 0, 5], [0, 0, 0], [-100, 0, 0])
    assert str(n.exposure) == "0.0" and not rows[0].neutral and [r.neutral for r in rows[1:6]] == [True] * 5
    n = rows[6].n
    assert n.point_curves.luma == [[0, 9], [255, 7]] and n.point_curves.red == n.point_curves.blue == [[0, 0], [255, 255]]
    assert (n.parametric_curve.red.split1, n.parametric_curve.red.lights, n.parametric_curve.blue.split3) == (25, 100, 75)
    assert (n.color_grading["global"].hue, n.color_grading["global"].saturation, n.color_grading.blending) == (360, 0, 50)


def test_text_is_parsed_once_a_row(spark, capsys):
    rows = spark.createDataFrame([("{}",)], "doc string").select(develop.normalised(F.col("doc")).alias("n"))
    rows.select("n.contrast", "n.hue", F.size("n.masks").alias("masks"), develop.is_neutral(F.col("n")).alias("neutral")).explain("extended")
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert plan.count("parse_json") + plan.count("parseJson") == 1


def test_blended_mean_halfway_rounds_to_even(spark):
    rows = spark.createDataFrame([(1, 3.0, '{"contrast": 0}'), (1, 2.0, '{"contrast": 1}'), (1, 1.0, '{"contrast": 7}')], "query int, weight double, doc string")
    out = develop.blended(rows.coalesce(1).select("query", "weight", develop.normalised(F.col("doc")).alias("adj"))).first()
    assert out.contrast == 2  # the mean is 1.5; by shares of the weight it was 1.4999999999999998
