"""Fixed values of geometry, orders and texts."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import curves as C
from tessera.functions import geometry as G
from tessera.functions import text as X


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def big(v):
    return F.lit(v).cast("bigint")


@pytest.mark.parametrize("w,h,level", [(1, 1, 0), (2, 2, 1), (256, 256, 8), (2220, 2967, 12), (32914, 27243, 16)])
def test_dzi_max_level(spark, w, h, level):
    assert one(spark, v=G.dzi_max_level(big(w), big(h))).v == level


def test_dzi_grid(spark):
    w, h = big(2220), big(2967)
    r = one(spark, c=G.ceil_div(w, 256), r=G.ceil_div(h, 256), cw=G.edge_extent(w, big(256), big(8)), ch=G.edge_extent(h, big(256), big(11)))
    assert (r.c, r.r, r.cw, r.ch) == (9, 12, 172, 151)


@pytest.mark.parametrize("name", ["hilbert", "morton", "row-major", "serpentine"])
@pytest.mark.parametrize("cols,rows", [(4, 4), (8, 8), (7, 11), (1, 1), (3, 5), (16, 16), (15, 17)])
def test_orders_are_bijective(spark, name, cols, rows):
    cells = spark.range(cols * rows).select((F.col("id") % cols).alias("c"), F.floor(F.col("id") / cols).alias("r"))
    keyed = cells.select("c", "r", C.order_key(name)(F.col("c"), F.col("r"), big(cols), big(rows)).alias("k")).collect()
    assert len({r.k for r in keyed}) == cols * rows
    if name == "hilbert" and cols == rows and cols & (cols - 1) == 0:
        path = sorted(keyed, key=lambda r: r.k)
        assert all(abs(a.c - b.c) + abs(a.r - b.r) == 1 for a, b in zip(path, path[1:]))


def test_unknown_order():
    with pytest.raises(ValueError, match="known: hilbert"):
        C.order_key("spiral")


def test_serpentine_inverse(spark):
    col, row = C.serpentine_cell(C.serpentine(F.col("c"), F.col("r"), big(3), big(5)), big(3), big(5))
    cells = spark.range(15).select((F.col("id") % 3).alias("c"), F.floor(F.col("id") / 3).alias("r"))
    assert all((r.c, r.r) == (r.x, r.y) for r in cells.select("c", "r", col.alias("x"), row.alias("y")).collect())


@pytest.mark.parametrize("mag,target,factor", [(40, 10, 4), (40, 20, 2), (40, 40, None), (40, 6, None), (0, 10, None), (20, 1.25, 16)])
def test_factor(spark, mag, target, factor):
    assert one(spark, v=G.factor_for_magnification(F.lit(float(mag)), F.lit(float(target)))).v == factor


@pytest.mark.parametrize("n,text", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1536, "1.5 KB"), (5 << 30, "5.0 GB")])
def test_format_bytes(spark, n, text):
    assert one(spark, v=X.format_bytes(big(n))).v == text


@pytest.mark.parametrize("text,q", [("85", 85), ("", 85), ("q=90,effort=3", 90), ("q=5,q=6", 6), ("lossless=true", 85), ("0", None), ("101", None), ("best", None), ("q=1,bad", None)])
def test_quality_knob(spark, text, q):
    assert one(spark, v=X.quality_knob(F.lit(text))).v == q


@pytest.mark.parametrize("text,n", [("1,2,3,4", [1, 2, 3, 4]), (" 1, 2 ,3,4 ", [1, 2, 3, 4]), ("1,2,3", None), ("1,2,0,4", None), ("a,2,3,4", None)])
def test_rect(spark, text, n):
    assert one(spark, v=X.rect_numbers(F.lit(text))).v == n


@pytest.mark.parametrize("text,n", [("off", 0), ("512", 512 << 20), ("2GB", 2 * 10**9), ("2 GiB", 2 << 30), ("1.5MiB", 3 << 19), ("much", None)])
def test_memory(spark, text, n):
    assert one(spark, v=X.memory_bytes(F.lit(text))).v == n


def test_aperio(spark):
    text = "Aperio Library v1\r\n46000x32914 [0,100 46000x32814] (240x240) JPEG/RGB Q=70|AppMag = 20|MPP = 0.499|note|AppMag = 40"
    parts = X.aperio_parts(F.lit(text))
    r = one(spark, **parts, q=X.jpeg_quality_token(parts["geometry"]))
    assert (r.banner, r.q, [(p.k, p.v) for p in r.pairs]) == ("Aperio Library v1", 70, [("AppMag", "40"), ("MPP", "0.499")])
    down = X.aperio_downsampled(parts, 2, big(23000), big(16457))
    assert one(spark, v=X.aperio_encoded(down["banner"], down["geometry"], down["pairs"])).v == "Aperio Library v1\r\n23000x16457 [0,100 46000x32814] (240x240) JPEG/RGB Q=70|AppMag = 20|MPP = 0.998"
    assert one(spark, **X.aperio_parts(F.lit("Other\nx"))).banner is None
