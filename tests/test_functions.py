"""Operators against plain loops, hand-made edge cases and properties."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import ctc, geometry, layout, tensors
from pagewright.operators import contours, raster
from pagewright.schemas import ITEMS

NAN = float("nan")


def loop_decode(rows, dictionary):
    last, text, p = -1, "", []
    for row in rows:
        k, top = 0, -np.inf
        for i, v in enumerate(row):
            if v > top:
                k, top = i, v
        if k != 0 and k != last and 0 <= k < len(dictionary):
            if k == len(dictionary) - 1:
                if dictionary[k] != "<unk>":
                    text += " "
                    p.append(top)
            else:
                text += dictionary[k]
                p.append(top)
        last = k
    total = 0.0
    for x in p:
        total += x
    return text, total / len(p) if p else 0.0


@pytest.mark.parametrize("dictionary", [("", "a", "b", "", "<unk>"), ("", "a", "b", "c", "x"), ("", "a", " ")])
def test_decoding_agrees_with_a_loop(spark, dictionary):
    rng = random.Random(len(dictionary))
    cases = [[]]
    for _ in range(300):
        cases.append([[rng.choice([NAN, 0.0, 0.25, 0.5, rng.random()]) for _ in range(5)] for _ in range(rng.randint(1, 9))])
    cases += [[[NAN] * 5, [0, 1.0, 0, 0, 0], [NAN] * 5, [0, 1.0, 0, 0, 0]], [[0.0, 1.0, 0, 0, 0]] * 3]
    rows = [(k, [float(v) for r in c for v in r], len(c)) for k, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "id long, x array<double>, t int")
    out = ctc.decode(df, "x", F.col("t"), F.lit(5), F.array(*[F.lit(w) for w in dictionary]))
    got = {r["id"]: (r["decoded"]["text"], r["decoded"]["confidence"]) for r in out.collect()}
    for k, c in enumerate(cases):
        assert got[k] == loop_decode(c, dictionary)
        assert raster.decode_steps(np.array(c, float).reshape(-1, 5), dictionary) == got[k]


def loop_lines(items):
    out, line, mean = [], [], 0.0
    for k, i in enumerate(items):
        if line and abs(i["box"]["y"] - items[k - 1]["box"]["y"]) <= 0.5 * mean:
            line.append(i)
        else:
            if line:
                out.append(line)
            line = [i]
        mean = sum(x["box"]["height"] for x in line) / len(line)
    return [*out, line] if line else out


def item(x, y, h, text="t"):
    return {"text": text, "box": {"x": x, "y": y, "width": 9, "height": h}, "confidence": 0.5}


def test_lines_agree_with_a_loop(spark):
    rng = random.Random(9)
    pages = [[], [item(0, 0, 10)], [item(0, 0, 10), item(5, 5, 10), item(9, 11, 10)]]
    for _ in range(300):
        y, page = 0, []
        for _ in range(rng.randint(1, 14)):
            y += rng.choice([0, 1, 3, 5, 8, 20])
            page.append(item(rng.randint(0, 99), y, rng.randint(4, 24), rng.choice(["", "w"])))
        pages.append(page)
    df = spark.createDataFrame([*enumerate(pages)], "id long, items array<struct<text:string,box:struct<x:int,y:int,width:int,height:int>,confidence:double>>")
    for r in layout.assemble(df).collect():
        want = loop_lines(pages[r["id"]])
        assert [[i.asDict(True) for i in line] for line in r["lines"]] == want
        assert r["text"] == "\n".join(" ".join(i["text"] for i in line) for line in want)
        assert r["confidence"] == (0.5 if pages[r["id"]] else 0.0)
    none = spark.createDataFrame([(1, None)], df.schema)
    row = layout.assemble(none, flat=True).first()
    assert (row["text"], row["results"], row["confidence"]) == ("", [], 0.0)


def test_reading_order_is_stable_and_never_fails(spark):
    rng = random.Random(1)
    wild = [item(rng.randint(0, 900), rng.randint(0, 900), rng.randint(1, 300), str(k)) for k in range(800)]
    page = [item(x, 40 * row + rng.randint(-3, 3), 28, f"{row}-{x}") for row in range(6) for x in (0, 50, 90)]
    mixed = page[:]
    rng.shuffle(mixed)
    same = [item(5, 5, 9, str(k)) for k in range(9)]
    df = spark.createDataFrame([(0, wild), (1, mixed), (2, same), (3, None)], f"id int, items {ITEMS.simpleString()}")
    got = {r["id"]: r["o"] for r in df.select("id", layout.reading_order()("items").alias("o")).collect()}
    assert sorted(i["text"] for i in got[0]) == sorted(i["text"] for i in wild)
    assert [i["text"] for i in got[1]] == [i["text"] for i in page]
    assert [i["text"] for i in got[2]] == [i["text"] for i in same] and got[3] is None


def flood(mask):
    h, w = mask.shape
    seen, out = set(), []
    for y in range(h):
        for x in range(w):
            if (x, y) in seen:
                continue
            fg, todo, region = mask[y, x], [(x, y)], {(x, y)}
            while todo:
                a, b = todo.pop()
                for dx in (-1, 0, 1):
                    for dy in (-1, 0, 1):
                        p = (a + dx, b + dy)
                        if (fg or not (dx and dy)) and 0 <= p[0] < w and 0 <= p[1] < h and p not in region and mask[p[1], p[0]] == fg:
                            region.add(p)
                            todo.append(p)
            seen |= region
            xs, ys = [p[0] for p in region], [p[1] for p in region]
            x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
            if fg:
                out.append((False, x0, y0, x1 - x0 + 1, y1 - y0 + 1))
            elif x0 > 0 and y0 > 0 and x1 < w - 1 and y1 < h - 1:
                out.append((True, x0 - 1, y0 - 1, x1 - x0 + 3, y1 - y0 + 3))
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 2**31), st.floats(0.1, 0.9))
def test_contours_agree_with_flood_fill(h, w, seed, share):
    mask = np.random.default_rng(seed).random((h, w)) < share
    assert sorted(map(tuple, contours.contour_boxes(mask).tolist())) == sorted(flood(mask))


def test_contour_cases():
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert sorted(contours.contour_boxes(ring).tolist()) == [[False, 0, 0, 5, 5], [True, 1, 1, 3, 3]]
    assert contours.contour_boxes(np.eye(4, dtype=bool)).tolist() == [[False, 0, 0, 4, 4]]
    assert len(contours.contour_boxes(np.zeros((3, 3), bool))) == 0


def test_gray_of_edge_values(spark):
    p = [None, NAN, 0.5 / 255, 0.49 / 255, -1.0, 2.0, 1.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(p)], "k int, p double")
    assert [r["g"] for r in df.orderBy("k").select(tensors.gray(F.col("p")).alias("g")).collect()] == [0, 0, 1, 0, 0, 255, 255]
    assert raster.gray_map(np.array(p[1:], float)).tolist() == [0, 1, 0, 0, 255, 255]


def test_sizes(spark):
    rows = [(960, 10), (961, 10), (32, 33), (10_000, 1), (640, 1500)]
    df = spark.createDataFrame(rows, "w int, h int").withColumn("s", geometry.resized(F.col("w"), F.col("h")))
    for r in df.collect():
        s = r["s"]
        assert (s["resize_w"], s["resize_h"], s["ratio"], s["model_w"], s["model_h"]) == raster.model_size(r["w"], r["h"], 960)
    with pytest.raises(ValueError):
        raster.detection_tensor(np.zeros((1, 10_000, 3), np.uint8), geometry_options())


def geometry_options():
    from pagewright.options import DetectionOptions

    return DetectionOptions()


def test_box_edges(spark):
    boxes = [(0, 0, 4, 5), (0, 0, 3, 7), (950, 90, 10, 6), (0, 0, 5, 6), (0, 0, 6, 6), (0, 0, 0, 3)]
    df = spark.createDataFrame(boxes, "x int, y int, w int, h int").withColumn("b", geometry.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    b = F.col("b")
    out = df.select("w", "h", geometry.large_enough(b).alias("large"), geometry.final(b).alias("final"), geometry.valid(b).alias("valid"), geometry.padded(b, F.lit(960), F.lit(96)).alias("p"), geometry.crop_width(b).alias("c")).collect()
    assert [r["large"] for r in out] == [False, True, True, True, True, False]
    assert [r["final"] for r in out] == [False, False, True, False, True, False]
    assert [r["valid"] for r in out] == [True] * 5 + [False]
    assert tuple(out[2]["p"]) == (946, 88, 14, 8) and out[5]["c"] is None and out[1]["c"] == 21
    halves = spark.createDataFrame([(-2.5,), (2.5,), (0.49999999999999994,), (-0.2,)], "v double")
    assert [r[0] for r in halves.select(geometry.half_up(F.col("v"))).collect()] == [-2, 3, 0, 0]
    assert [raster.round_half_up(v) for v in (-2.5, 2.5, 0.49999999999999994, -0.2)] == [-2, 3, 0, 0]


def test_tensors():
    px = np.zeros((10, 20, 3), np.uint8)
    px[:, :, 0] = 255
    x, ratio, W, H = raster.detection_tensor(px, geometry_options())
    assert x.shape == (1, 3, 32, 32) and (ratio, W, H) == (1.0, 32, 32)
    assert np.isclose(x[0, 0, 0, 0], (1 - 0.485) / 0.229) and np.isclose(x[0, 0, 31, 31], -0.485 / 0.229)
    r = raster.recognition_tensor(px, 48)
    assert r.shape == (1, 3, 48, 96) and (r == 1).all()
    assert raster.recognition_tensor(px[:, :1], 48).shape[3] == 8
    with pytest.raises(ValueError):
        raster.recognition_tensor(px[:0], 48)
    ramp = np.arange(8, dtype=np.uint8).reshape(1, 8, 1) * 30
    assert raster.resize(ramp, 4, 1).ravel().tolist() == [15, 75, 135, 195]
    bgra = {"height": 1, "width": 1, "nChannels": 4, "data": bytes([1, 2, 3, 4])}
    assert raster.rgb(bgra).ravel().tolist() == [3, 2, 1]


def test_last_test_of_boxes_stays_above_the_chain(spark):
    """The row number is a fence: without it the optimizer repeats the whole chain inside the filter."""
    from pagewright import queries

    plan = queries.box_pipeline(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x and "_row" in x]
    assert len(filters) == 1 and len(filters[0]) < 600
