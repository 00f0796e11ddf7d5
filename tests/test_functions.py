import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartwise.functions.columns import (clip, fround, list_literal_count, list_literal_elements,
                                         list_literal_first, right_closed_bin_index, right_closed_bins, uniform)
from chartwise.functions.stats import betainc_reg, chi2_1df_p, cohen_h, t_two_sided_p, wilson_bounds


def test_list_literal_cases(spark):
    rows = [("['a', 'b']",), ("[]",), ("a, b",), (None,), ("[\"O'Neil\", 'x']",), ("nan",)]
    df = spark.createDataFrame(rows, "s string")
    out = df.select("s", list_literal_first("s").alias("f"), list_literal_count("s").alias("n"),
                    list_literal_elements("s").alias("e")).collect()
    got = {r["s"]: (r["f"], r["n"], r["e"]) for r in out}
    assert got["['a', 'b']"] == ("a", 2, ["a", "b"])
    assert got["[]"] == (None, 0, [])
    assert got["a, b"] == (None, 1, [])          # comma text does not parse as a literal
    assert got[None][1] == 1 and got[None][0] is None
    assert got["[\"O'Neil\", 'x']"] == ("O'Neil", 2, ["O'Neil", "x"])
    assert got["nan"] == (None, 1, [])


def test_list_comma_mode(spark):
    df = spark.createDataFrame([("a, b",), (None,)], "s string")
    r = df.select(list_literal_first("s", "comma").alias("f"), list_literal_count("s", "comma").alias("n")).collect()
    assert (r[0]["f"], r[0]["n"]) == ("a", 2)
    assert r[1]["n"] == 1


def test_right_closed_bins_edges(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (2.0000001,), (100.0,), (100.5,), (None,)], "x double")
    edges = [0, 2, 2.5, 3, 3.5, 4, 5, 6, 100]
    r = df.select(right_closed_bin_index("x", edges).alias("i"),
                  right_closed_bins("x", edges, [str(i) for i in range(8)]).alias("l")).collect()
    assert [x["i"] for x in r] == [None, 0, 1, 7, None, None]
    assert [x["l"] for x in r] == [None, "0", "1", "7", None, None]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (1.5,), (-0.5,), (0.3,)], "x double")
    assert [r[0] for r in df.select(clip("x", 0.0, 1.0)).collect()] == [None, 1.0, 0.0, 0.3]


def test_fround_matches_numpy(spark):
    rng = np.random.default_rng(7)
    vals = list(rng.random(2000) * 3) + [0.0171875, 0.24025, 2.5e-05, 0.125, 1.00005]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = [r[0] for r in df.select(fround("x", 4)).collect()]
    assert got == [float(np.round(v, 4)) for v in vals]


def test_uniform_deterministic_and_in_range(spark):
    df = spark.range(1000).select(uniform(42, "id").alias("u"), uniform(42, "id").alias("v"))
    r = df.agg(F.min("u"), F.max("u"), F.sum((F.col("u") != F.col("v")).cast("int"))).first()
    assert 0.0 <= r[0] and r[1] < 1.0 and r[2] == 0


def test_pvalues_known():
    assert abs(chi2_1df_p(8.333333) - 0.003892) < 1e-5
    assert abs(t_two_sided_p(2.0, 10.0) - 0.073388) < 1e-5
    assert abs(t_two_sided_p(-2.0, 10.0) - 0.073388) < 1e-5
    assert abs(betainc_reg(2.0, 3.0, 0.4) - 0.5248) < 1e-4
    assert math.isnan(t_two_sided_p(float("nan"), 3.0))


def test_wilson_and_cohen(spark):
    df = spark.createDataFrame([(10, 100), (0, 0), (0, 50)], "s long, n long")
    lo, hi = wilson_bounds("s", "n")
    r = df.select(lo.alias("lo"), hi.alias("hi"), cohen_h(F.lit(0.5), F.lit(0.2)).alias("h")).collect()
    assert (r[0]["lo"], r[0]["hi"]) == (0.0552, 0.1744)
    assert (r[1]["lo"], r[1]["hi"]) == (0.0, 0.0)
    z = 1.96
    d = 1 + z ** 2 / 50
    c = (z ** 2 / 100) / d
    m = z * math.sqrt(z ** 2 / (4 * 50 ** 2)) / d
    assert r[2]["lo"] == 0.0 and r[2]["hi"] == float(np.round(min(1, c + m), 4))
    assert r[0]["h"] == pytest.approx(0.6435, abs=1e-4)
