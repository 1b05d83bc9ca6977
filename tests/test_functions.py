"""Half precision, levels, layers and colours against plain Python."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lucidframe.functions import color, half, layers, levels


def test_every_half_survives():
    bits = np.arange(65536).astype(np.uint16)
    wide = half.widen(bits)
    finite = ~np.isnan(wide)
    # subnormal halves are normal floats, so they come back too
    assert (half.narrow(wide[finite]) == bits[finite]).all()
    assert np.isnan(half.widen(half.narrow(wide[~finite]))).all()


@pytest.mark.parametrize(("value", "bits"), [(1.00048828125, 0x3C01), (0.0, 0), (-0.0, 0x8000), (65504.0, 0x7BFF), (65520.0, 0x7C00), (1e10, 0x7C00), (-1e10, 0xFC00), (1e-10, 0), (float("nan"), 0x7E00), (float("inf"), 0x7C00), (2.0**-24, 1), (2.0**-25, 1)])
def test_narrow(value, bits):
    assert half.narrow(np.array([value], np.float32))[0] == bits


@settings(max_examples=200, deadline=None)
@given(st.floats(width=32, allow_nan=False, allow_infinity=False))
def test_narrow_is_nearest(v):
    got = half.narrow(np.array([v], np.float32))
    near = np.float32(v).astype(np.float16)
    assert got[0] == near.view(np.uint16) or abs(float(half.widen(got)[0]) - v) == abs(float(near) - v) or abs(v) < 2.0**-24


def test_levels(spark):
    n = spark.range(0, 300).withColumn("x", F.col("id").cast("int"))
    rows = n.select("x", levels.floor_log2(F.col("x")).alias("f"), levels.ceil_log2(F.col("x")).alias("c")).collect()
    for r in rows:
        assert r.f == (0 if r.x <= 1 else int(math.floor(math.log2(r.x))))
        assert r.c == (0 if r.x <= 1 else (r.x - 1).bit_length())


def test_layers(spark):
    names = ["R", ".R", "R.", "L1.R", "L2.G", "a.b.R", "xL1.R", "..", "", "."]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "position int, name string")
    assert {r.layer for r in layers.list_layers(df).collect()} == {"L1", "L2", "a.b", "xL1"}
    inside = {r.name: r.c for r in df.select("name", layers.in_layer(F.col("name"), F.lit("L1")).alias("c")).collect()}
    assert inside["L1.R"] == "R" and inside["xL1.R"] == "xL1.R" and inside["R"] is None
    bare = {r.name: r.c for r in df.select("name", layers.in_layer(F.col("name"), F.lit("")).alias("c")).collect()}
    assert bare["R"] == "R" and bare[".R"] == "R" and bare["L1.R"] is None and bare["R."] is None


def test_colors_of_odd_values(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-1.0,), (0.5,), (2.0,)], "v double")
    rows = df.select(color.to_u8(F.col("v")).alias("u"), color.tonemap_u8(F.col("v")).alias("t"), color.clip(F.col("v").cast("float"), 0.0, 1.0).alias("c")).collect()
    assert [r.u for r in rows] == [0, 255, 0, 127, 255]
    assert rows[2].t == 0 and rows[1].t == 255
    assert [r.c for r in rows] == [1.0, 1.0, 0.0, 0.5, 1.0]
