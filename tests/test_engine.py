"""Images end to end, with stub models and a small ONNX model written by hand."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import raster
from pagewright.options import DetectionOptions, OcrOptions, merged
from pagewright.plans import engine as engines
from pagewright.plans.engine import OcrEngine, create, get_or_create
from pagewright.plans.sql import register
from pagewright.sources import sinks
from pagewright.sources.images import load_dictionary, read_images
from pagewright.streaming import stream_folder, stream_images

DICTIONARY = ("", "a", "b", "c", " ")


def red_is_text(tensor):
    """A map that is 1 where the normalised red plane is bright."""
    return (tensor[:, :1] > 1.0).astype(np.float32)


def width_is_letter(tensor):
    """Wide crops read "ab", narrow ones "c"; a blank between."""
    path = [1, 0, 2] if tensor.shape[3] > 120 else [0, 3, 3]
    out = np.zeros((1, len(path), len(DICTIONARY)), np.float32)
    out[0, range(len(path)), path] = 0.5
    return out


MODEL = {"detection": red_is_text, "recognition": width_is_letter, "dictionary": DICTIONARY}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    page = np.zeros((200, 300, 3), np.uint8)
    for x, y, w, h in ((20, 30, 90, 20), (170, 32, 30, 20), (20, 100, 90, 20)):
        page[y : y + h, x : x + w] = (255, 255, 255)
    (d / "page.png").write_bytes(raster.png(page))
    (d / "blank.png").write_bytes(raster.png(np.zeros((40, 50, 3), np.uint8)))
    (d / "gray.png").write_bytes(raster.png(page[:, :, 0]))
    (d / "broken.png").write_bytes(b"not an image")
    return d


@pytest.fixture(scope="module")
def ocr(spark):
    return create(spark, {"model": MODEL})


def by_name(df):
    return {r["image_id"].rsplit("/", 1)[-1]: r for r in df.collect()}


def test_pages_are_read_in_order(spark, ocr, folder):
    images = read_images(spark, str(folder))
    grouped, flat = by_name(ocr.recognize(images)), by_name(ocr.recognize(images, flatten=True))
    page = grouped["page.png"]
    assert page["text"] == "ab c\nab"
    assert [[i["text"] for i in line] for line in page["lines"]] == [["ab", "c"], ["ab"]]
    assert page["confidence"] == 0.5 and page["error"] is None
    assert grouped["gray.png"]["text"] == page["text"]
    assert (grouped["blank.png"]["text"], grouped["blank.png"]["lines"], grouped["blank.png"]["confidence"]) == ("", [], 0.0)
    assert grouped["broken.png"]["text"] == "" and grouped["broken.png"]["error"]
    for name, row in grouped.items():
        assert [i for line in row["lines"] for i in line] == flat[name]["results"]
        assert (row["text"], row["confidence"]) == (flat[name]["text"], flat[name]["confidence"])
        assert "results" not in row.asDict() and "lines" not in flat[name].asDict()
    for i in flat["page.png"]["results"]:
        b = i["box"]
        assert b["x"] >= 0 and b["y"] >= 0 and b["x"] + b["width"] <= 300 and b["y"] + b["height"] <= 200


def test_stages_alone_agree_with_the_whole(spark, ocr, folder):
    images = read_images(spark, str(folder), pattern="page.png")
    boxes = ocr.detect(images).select("image_id", "boxes")
    assert boxes.first()["boxes"]
    items = ocr.recognize_boxes(images.join(boxes, "image_id")).first()["items"]
    assert items == ocr.recognize(images, flatten=True).first()["results"]
    bad = images.withColumn("boxes", F.expr("array(struct(1 as x, 1 as y, 0 as width, 5 as height), struct(0 as x, 0 as y, 40 as width, 10 as height))"))
    row = ocr.recognize_boxes(bad).first()
    assert len(row["items"]) == 1 and "box 0" in row["error"]


def test_no_shuffle_and_one_python_stage(spark, ocr, folder):
    plan = ocr.recognize(read_images(spark, str(folder)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInPandas") == 1


def test_a_failing_box_and_a_failing_model(spark, folder):
    def picky(tensor):
        if tensor.shape[3] > 120:
            raise ValueError("too wide")
        return width_is_letter(tensor)

    row = by_name(create(spark, {"model": MODEL | {"recognition": picky}}).recognize(read_images(spark, str(folder))))["page.png"]
    assert row["text"] == "c" and "too wide" in row["error"]


def test_life_of_an_engine(spark, folder):
    one = OcrEngine(spark)
    assert not one.is_initialized
    with pytest.raises(RuntimeError):
        one.recognize(read_images(spark, str(folder)))
    with pytest.raises(ValueError, match="missing"):
        one.initialize()
    one.initialize({"model": MODEL, "detection": {"min_area": 30}})
    assert one.is_initialized and one.options.detection.min_area == 30
    other = one.change_model({"dictionary": ["", "x", "y", "z", " "]})
    images = read_images(spark, str(folder), pattern="page.png")
    assert other.recognize(images).first()["text"] == "xy z\nxy" and one.recognize(images).first()["text"] == "ab c\nab"
    one.destroy()
    assert not one.is_initialized and other.is_initialized
    engines._shared[0] = None
    a = get_or_create(spark, {"model": MODEL})
    assert get_or_create(spark) is a
    assert get_or_create(spark, {"model": MODEL}) is not a and not a.is_initialized


def test_options():
    with pytest.raises(ValueError, match="unknown"):
        merged(OcrOptions(), {"recoginition": {}})
    assert merged(OcrOptions(), {"detection": {"max_side": 640}}).detection.pad_vertical == 0.4
    assert DetectionOptions(min_area=0, pad_vertical=0).min_area == 20
    assert DetectionOptions(min_area=0, zero_is_default=False).min_area == 0
    with pytest.raises(ValueError):
        DetectionOptions(mean=(1, 2))


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("\na\nb\r\n\nc\n")
    assert load_dictionary(spark, str(tmp_path / "d.txt")) == ("", "a", "b\r", "", "c", "")
    (tmp_path / "empty.txt").write_text("")
    with pytest.raises(ValueError):
        load_dictionary(spark, str(tmp_path / "empty.txt"))


def test_sinks_and_debug(spark, ocr, folder, tmp_path):
    images = read_images(spark, str(folder), pattern="page.png")
    files = ocr.debug(images)
    for _ in range(2):  # a second run takes the place of the first
        sinks.write_debug(files, str(tmp_path / "debug"))
    rows = spark.read.parquet(str(tmp_path / "debug")).collect()
    assert sorted(r["name"] for r in rows) == ["boxes-debug.png", "crop_000.png", "crop_001.png", "crop_002.png", "detection-debug.png"]
    assert all(raster.read_png(r["png"])["width"] > 0 and r["elapsed_ms"] >= 0 for r in rows)
    out = ocr.recognize(images)
    sinks.write_json(out, str(tmp_path / "json"))
    sinks.write_parquet(out, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).first()["text"] == spark.read.json(str(tmp_path / "json")).first()["text"]
    text = out.select(sinks.as_json("text", "confidence").alias("j")).first()["j"]
    assert json.loads(text) == {"text": "ab c\nab", "confidence": 0.5} and "\n" in text


def test_stream_of_images(spark, ocr, folder, tmp_path):
    query = ocr.recognize(stream_images(spark, str(folder))).writeStream.format("memory").queryName("pages").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    query.awaitTermination(120)
    got = {r["image_id"].rsplit("/", 1)[-1]: r["text"] for r in spark.table("pages").collect()}
    assert got == {"page.png": "ab c\nab", "gray.png": "ab c\nab", "blank.png": "", "broken.png": ""}


def test_sql_functions(spark):
    register(spark, DICTIONARY)
    rows = spark.sql("SELECT * FROM contour_boxes(array(0.0f, 0.9f, 0.0f, 0.9f, 0.0f, 0.9f, 0.0f, 0.9f, 0.0f), 3, 3)").collect()
    assert sorted((r["hole"], r["x"], r["width"]) for r in rows) == [(False, 0, 3), (True, 0, 3)]
    got = spark.sql("SELECT ctc_decode(array(0f,1f,0f,0f,0f, 1f,0f,0f,0f,0f, 0f,0.5f,0f,0f,0f), 3, 5) AS d").first()["d"]
    assert (got["text"], got["confidence"]) == ("aa", 0.75)


def test_ctc_decode_in_sql_is_an_expression_and_null_safe(spark):
    register(spark, ("", "it's", "b\\", "<unk>"))
    df = spark.sql("""SELECT k, ctc_decode(v, t, c) AS d FROM VALUES
        (1, array(0f, 1f, 0f, 0f, 0f, 0f, 1f, 0f, 0f, 0f, 0f, 1f), 3, 4), (2, null, 1, 4), (3, array(1f), 1, 4), (4, array(1f), null, 4),
        (5, array(0f), 0, 4), (6, array(float('nan'), null, 0.5f, float('-inf')), 1, 4), (7, array(1f), 1, 0), (8, array(float('nan')), 1, 1) AS x(k, v, t, c)""")
    got = {r["k"]: None if r["d"] is None else tuple(r["d"]) for r in df.collect()}
    assert got == {1: ("it's" + "b\\", 1.0), 2: None, 3: None, 4: None, 5: ("", 0.0), 6: ("b\\", 0.5), 7: None, 8: ("", 0.0)}
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_ctc_decode_in_sql_agrees_with_numpy(spark):
    rng = np.random.default_rng(3)
    words = tuple("-abc ")
    register(spark, words)
    rows = [(k, [float(np.float32(x)) for x in rng.integers(0, 4, 30)], 6, 5) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, v array<float>, t int, c int").selectExpr("k", "ctc_decode(v, t, c) AS d")
    for r in df.collect():
        assert tuple(r["d"]) == raster.decode_steps(np.array(rows[r["k"]][1]).reshape(6, 5), words)


def test_detect_boxes_in_sql(spark, ocr, folder):
    register(spark, engine=ocr)
    images = read_images(spark, str(folder))
    images.createOrReplaceTempView("pages_in")
    got = {r["image_id"]: r["boxes"] for r in spark.sql("SELECT image_id, detect_boxes(image) AS boxes FROM pages_in").collect()}
    want = {r["image_id"]: r["boxes"] for r in ocr.detect(images).collect()}
    assert {k: v or [] for k, v in got.items()} == want and any(want.values())


def test_trace_and_counts(spark, folder):
    from pyspark.sql import Observation

    engine = create(spark, {"model": MODEL | {"dictionary": [*DICTIONARY, "more"]}, "debugging": {"verbose": True, "debug": True}})
    images = read_images(spark, str(folder))
    rows = [r for r in engine.trace(images).orderBy("image_id", "step").collect() if r["image_id"].endswith("/page.png")]
    said = [r["message"] for r in rows]
    assert said[0] == "Starting text detection process" and "Detected 3 text boxes in image" in said
    assert "(ratio: 1.0000)" in said[1] and sum("Warning: the model has 5 classes, the dictionary 6" in m for m in said) == 1
    boxes = [r for r in rows if r["message"].startswith("Box ")]
    assert len(boxes) == 3 and "Box 1/3: [x:" in boxes[0]["message"] and all(r["elapsed_ms"] >= 0 for r in boxes)
    seen = Observation()
    assert engine.recognize(images, observation=seen).count() == 4
    assert seen.get == {"images": 4, "boxes": 6, "items": 6, "errors": 1, "strange_dictionaries": 2}


def test_debug_files_are_written_where_options_ask(spark, folder, tmp_path):
    images = read_images(spark, str(folder), pattern="page.png")
    for debug in (False, True):
        create(spark, {"model": MODEL, "debugging": {"debug": debug, "folder": str(tmp_path / "out")}}).save_debug(images)
        assert (tmp_path / "out").exists() == debug


def test_models_are_found_and_paths_resolved(spark, folder, tmp_path, monkeypatch):
    from pagewright.sources import images as sources

    (tmp_path / "models").mkdir()
    (tmp_path / "models" / "detection.onnx").write_bytes(onnx_model("ReduceMax", 1))
    (tmp_path / "models" / "dictionary.txt").write_text("\n".join(DICTIONARY))
    monkeypatch.setattr(sources.resources, "files", lambda _: tmp_path)
    assert {*sources.default_models()} == {"detection", "dictionary"}
    engine = create(spark, {"model": {"recognition": width_is_letter}})
    assert engine.options.recognition.dictionary == DICTIONARY and engine.options.model.detection.endswith("detection.onnx")
    monkeypatch.chdir(tmp_path)
    create(spark, {"model": MODEL | {"detection": "models/detection.onnx"}}).destroy()


def test_stream_of_every_format(spark, ocr, folder, tmp_path):
    got = {}
    handle = lambda images, _: got.update({r["image_id"].rsplit("/", 1)[-1]: r["text"] for r in ocr.recognize(images).collect()})
    stream_folder(spark, str(folder), handle, str(tmp_path), files_per_trigger=2).trigger(availableNow=True).start().awaitTermination(120)
    assert got == {"page.png": "ab c\nab", "gray.png": "ab c\nab", "blank.png": "", "broken.png": ""}


def test_boxes_agree_with_column_expressions(spark):
    from pagewright.functions import geometry
    from pagewright.operators import boxes

    rng = np.random.default_rng(8)
    found = np.concatenate([rng.integers(0, 600, (300, 2)), rng.integers(1, 90, (300, 2))], axis=1)
    size, options = (1500, 1100), DetectionOptions()
    w, h, ratio, W, H = raster.model_size(*size, options.max_side)
    df = spark.createDataFrame(found.tolist(), "x int, y int, bw int, bh int").withColumn("b", geometry.box(*map(F.col, ("x", "y", "bw", "bh")))).where(geometry.large_enough(F.col("b")))
    df = geometry.settled(df, "b", geometry.padded(F.col("b"), F.lit(W), F.lit(H)))
    df = geometry.settled(df, "b", geometry.rescaled(F.col("b"), F.lit(ratio), F.lit(size[0]), F.lit(size[1])))
    want = sorted(tuple(r["b"]) for r in geometry.only_final(df, "b").collect())
    assert sorted(map(tuple, boxes.in_image(found, (W, H), ratio, size, options).tolist())) == want


def field(number, value):
    """A protobuf field: bytes, text, or a small number."""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def onnx_model(kind, axis):
    """One node that reduces x over an axis: ReduceMax keeps planes, and so makes a map."""
    attr = lambda name, value: field(5, field(1, name) + value)
    node = field(1, "x") + field(2, "y") + field(4, kind) + attr("axes", field(8, axis) + field(20, 7)) + attr("keepdims", field(3, 1) + field(20, 2))
    dims = b"".join(field(1, field(2, d)) for d in "nchw")
    value = lambda name: field(1, name) + field(2, field(1, field(1, 1) + field(2, dims)))
    graph = field(1, node) + field(2, "g") + field(11, value("x")) + field(12, value("y"))
    return field(1, 7) + field(7, graph) + field(8, field(1, "") + field(2, 12))


def test_onnx_model(spark, folder, tmp_path):
    (tmp_path / "det.onnx").write_bytes(onnx_model("ReduceMax", 1))
    engine = create(spark, {"model": MODEL | {"detection": str(tmp_path / "det.onnx")}})
    boxes = engine.detect(read_images(spark, str(folder), pattern="page.png")).first()
    assert boxes["error"] is None and boxes["boxes"]
    engine.destroy()


def test_png_filters():
    rng = np.random.default_rng(5)
    px = rng.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    import zlib

    raw, above = b"", np.zeros((7, 3), int)
    for y in range(9):
        kind = y % 5
        line = px[y].astype(int)
        left = np.vstack([np.zeros((1, 3), int), line[:-1]])
        corner = np.vstack([np.zeros((1, 3), int), above[:-1]])
        p = left + above - corner
        d = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        paeth = np.choose(d.argmin(axis=0), [left, above, corner])
        guess = [0 * line, left, above, (left + above) // 2, paeth][kind]
        raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    assert (raster.rgb(raster.read_png(data)) == px).all()
