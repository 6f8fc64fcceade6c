"""Settings kept as text: literal cases and round trips."""

from pyspark.sql import functions as F

from leafmill.functions import settings


def parsed(spark, parse, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["p"] for r in df.select("i", parse(F.col("t")).alias("p")).orderBy("i").collect()]


def test_curves(spark):
    good = ["top:1,2,3.5,4;bottom:5,6", "bottom:5,6;top:1,2,3.5,4;", "x;top:9,9;top:1,2,3.5,4;other:1;bottom:,5,6,"]
    for p in parsed(spark, settings.parse_curve, good):
        assert [(q["x"], q["y"]) for q in p["top"]] == [(1, 2), (3.5, 4)] and [(q["x"], q["y"]) for q in p["bottom"]] == [(5, 6)]
    bad = [None, "", "top:1,2", "top:1,2;bottom:1", "top:1,2;bottom:", "top:1,x;bottom:1,2", "top:1,2;bottom:1,2;other:x", "1,2;3,4"]
    assert parsed(spark, settings.parse_curve, bad) == [None] * len(bad)
    again = parsed(spark, lambda t: settings.format_curve(settings.parse_curve(t)), [good[0], bad[0]])
    assert again == ["top:1.0,2.0,3.5,4.0;bottom:5.0,6.0", None]
    assert parsed(spark, settings.parse_curve, again)[0] == parsed(spark, settings.parse_curve, good[:1])[0]


def test_calibrations(spark):
    good = "3000.25,3010,2000,0.1;0.1,-0.2,1e-7;4000,3000"
    p = parsed(spark, settings.parse_calibration, [good])[0]
    assert (p["fx"], p["fy"], p["cx"], p["cy"], p["distortion"], p["width"], p["height"]) == (3000.25, 3010, 2000, 0.1, [0.1, -0.2, 1e-7], 4000, 3000)
    text = parsed(spark, lambda t: settings.format_calibration(settings.parse_calibration(t)), [good])
    assert parsed(spark, settings.parse_calibration, text) == [p]
    bad = [None, "", "1,2,3;0;4,5", "1,2,3,4;0;4", "1,2,3,4;0;4,5;6", "1,2,3,4;x;4,5", "1,2,3,4;;4,5", "1,2,3,4;0;4,5.5", "1,2,3,4,5;0;4,5"]
    assert parsed(spark, settings.parse_calibration, bad) == [None] * len(bad)


def test_names(spark):
    names = ["plain", " a:b/c\\d ", '<>"|?*', "   ", "", None, "tab\there"]
    assert parsed(spark, settings.sanitize_name, names) == ["plain", "a_b_c_d", "______", "untitled", "untitled", "untitled", "tab_here"]
