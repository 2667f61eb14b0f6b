"""The engine's operators as queries over the tables, each with SQL that makes the same rows.

The tables hold no images: boxes, maps and logits are derived from their columns by the same
integer expressions on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import image_queries
from pagewright.functions import ctc, geometry, layout, tensors
from pagewright.options import DetectionOptions
from pagewright.schemas import BOX, ITEM
from pagewright.sources.images import dictionary_rows

WORDS = ("", "a", "b", "c", "d", "e", "f", " ")
_MEAN, _STD = DetectionOptions().mean, DetectionOptions().std


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round_sql(x: str) -> str:
    return f"CAST(CASE WHEN ({x}) < 0 THEN floor(({x}) + 0.5) ELSE round({x}) END AS INT)"


# --- sizes and boxes

_DIMS = "CAST(n_chars * 7 % 3000 + 1 AS INT) AS w, CAST(doc_id * 37 % 2500 + 1 AS INT) AS h"


def resize_dims(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").selectExpr("doc_id", *[x.strip() for x in _DIMS.split(", ")])
    s = geometry.resized(F.col("w"), F.col("h"))
    df = df.select("doc_id", s.alias("s")).select("doc_id", "s.*")
    return df.withColumn("ratio", F.round("ratio", 9))


_RESIZED = """SELECT *, CAST(ceil(resize_w / 32.0) * 32 AS INT) AS model_w, CAST(ceil(resize_h / 32.0) * 32 AS INT) AS model_h FROM (
  SELECT *, CASE WHEN m > 960 THEN CAST(round(w * r) AS INT) ELSE w END AS resize_w, CASE WHEN m > 960 THEN CAST(round(h * r) AS INT) ELSE h END AS resize_h FROM (
    SELECT *, CASE WHEN greatest(w, h) > 960 THEN CAST(960 AS DOUBLE) / greatest(w, h) ELSE CAST(1 AS DOUBLE) END AS r, greatest(w, h) AS m FROM ({}) AS a) AS b) AS c"""
RESIZE_SQL = f"SELECT doc_id, resize_w, resize_h, round(r, 9) AS ratio, model_w, model_h FROM ({_RESIZED.format(f'SELECT doc_id, {_DIMS} FROM documents')}) AS d"

#: A line item as a box: raw ones anywhere, and ones within the model's image.
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_RAW = "CAST(l_partkey % 800 AS INT) AS x, CAST(l_orderkey * 37 % 900 AS INT) AS y, CAST(l_quantity AS INT) AS bw, CAST(4 * l_linenumber AS INT) AS bh, CAST(1000 + 30 * l_suppkey AS INT) AS w, CAST(900 + l_partkey AS INT) AS h"


def _boxes(spark, sf_dir, inside: bool = False):
    """A box as wide or as high as the model's image has a null place, which padding and rescaling take as 0."""
    df = _table(spark, sf_dir, "lineitem").selectExpr(*_KEYS.split(", "), *[x.strip() for x in _RAW.split(", ")])
    df = df.withColumn("s", geometry.resized(F.col("w"), F.col("h"))).select("*", "s.*").drop("s")
    x, y = F.col("x"), F.col("y")
    if inside:
        x, y = F.try_mod(x, F.col("model_w") - F.col("bw")), F.try_mod(y, F.col("model_h") - F.col("bh"))
    return df.withColumn("b", geometry.box(x, y, F.col("bw"), F.col("bh")))


def _boxes_sql(inside: bool = False) -> str:
    at = "x % (model_w - bw) AS bx, y % (model_h - bh) AS b_y" if inside else "x AS bx, y AS b_y"
    return f"SELECT *, {at} FROM ({_RESIZED.format(f'SELECT {_KEYS}, {_RAW} FROM lineitem')}) AS d"


def _with_keys(df, column: str):
    return df.select(*_KEYS.split(", "), f"{column}.*")


def box_filter_area(spark, sf_dir):
    return _with_keys(_boxes(spark, sf_dir).where(geometry.large_enough(F.col("b"))), "b")


FILTER_SQL = f"SELECT {_KEYS}, bx AS x, b_y AS y, bw AS width, bh AS height FROM ({_boxes_sql()}) AS e WHERE bw * bh > 20"


def box_pad(spark, sf_dir):
    df = _boxes(spark, sf_dir, True)
    return _with_keys(df.withColumn("b", geometry.padded(F.col("b"), F.col("model_w"), F.col("model_h"))), "b")


def _pad_sql(source: str) -> str:
    return f"""SELECT *, greatest(0, bx - hp) AS px, greatest(0, b_y - vp) AS py,
  least(model_w, bx + bw + hp) - greatest(0, bx - hp) AS pw, least(model_h, b_y + bh + vp) - greatest(0, b_y - vp) AS ph
  FROM (SELECT *, CAST(round(bh * CAST(0.4 AS DOUBLE)) AS INT) AS vp, CAST(round(bh * CAST(0.6 AS DOUBLE)) AS INT) AS hp FROM ({source}) AS p1) AS p2"""


PAD_SQL = f"SELECT {_KEYS}, px AS x, py AS y, pw AS width, ph AS height FROM ({_pad_sql(_boxes_sql(True))}) AS e"


def box_rescale(spark, sf_dir):
    df = _boxes(spark, sf_dir, True)
    return _with_keys(df.withColumn("b", geometry.rescaled(F.col("b"), F.col("ratio"), F.col("w"), F.col("h"))), "b")


def _scale_sql(source: str, x: str, y: str, bw: str, bh: str) -> str:
    return f"""SELECT *, least(w - sx, {_round_sql(f'{bw} / r')}) AS sw, least(h - sy, {_round_sql(f'{bh} / r')}) AS sh FROM (
  SELECT *, greatest(0, {_round_sql(f'{x} / r')}) AS sx, greatest(0, {_round_sql(f'{y} / r')}) AS sy FROM ({source}) AS s1) AS s2"""


RESCALE_SQL = f"SELECT {_KEYS}, sx AS x, sy AS y, sw AS width, sh AS height FROM ({_scale_sql(_boxes_sql(True), 'bx', 'b_y', 'bw', 'bh')}) AS e"


def _loose(df):
    return df.withColumn("b", geometry.box(F.col("x"), F.col("y"), F.col("bw") - 9, F.col("bh") - 5))


def box_valid(spark, sf_dir):
    """Both predicates on boxes some of which are empty."""
    df = _loose(_boxes(spark, sf_dir)).where(geometry.valid(F.col("b")))
    return df.select(*_KEYS.split(", "), "b.width", "b.height", geometry.final(F.col("b")).alias("is_final"))


VALID_SQL = f"SELECT {_KEYS}, bw - 9 AS width, bh - 5 AS height, (bw - 9 > 5 AND bh - 5 > 5) AS is_final FROM ({_boxes_sql()}) AS e WHERE bw - 9 > 0 AND bh - 5 > 0"


def _pipeline(spark, sf_dir):
    df = _boxes(spark, sf_dir).where(geometry.large_enough(F.col("b")))
    df = geometry.settled(df, "b", geometry.padded(F.col("b"), F.col("model_w"), F.col("model_h")))
    df = geometry.settled(df, "b", geometry.rescaled(F.col("b"), F.col("ratio"), F.col("w"), F.col("h")))
    return geometry.only_final(df, "b")


def box_pipeline(spark, sf_dir):
    return _with_keys(_pipeline(spark, sf_dir), "b")


_PIPE = f"SELECT * FROM ({_scale_sql(_pad_sql(_boxes_sql() + ' WHERE bw * bh > 20'), 'px', 'py', 'pw', 'ph')}) AS e WHERE sw > 5 AND sh > 5"
PIPELINE_SQL = f"SELECT {_KEYS}, sx AS x, sy AS y, sw AS width, sh AS height FROM ({_PIPE}) AS f"


def crop_dims(spark, sf_dir):
    df = _loose(_boxes(spark, sf_dir))
    c = geometry.corners(F.col("b"))
    return df.select(*_KEYS.split(", "), c["x1"].alias("x1"), c["y1"].alias("y1"), geometry.crop_width(F.col("b")).alias("crop_w"), geometry.crop_name(F.col("l_linenumber")).alias("file"))


CROP_SQL = f"""SELECT {_KEYS}, x + bw - 9 AS x1, y + bh - 5 AS y1,
  CASE WHEN bw - 9 > 0 AND bh - 5 > 0 THEN greatest(8, CAST(round(CAST(48 AS DOUBLE) * (bw - 9) / (bh - 5)) AS INT)) END AS crop_w,
  'crop_' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '.png' AS file FROM ({_boxes_sql()}) AS e"""

# --- pixels


def _pixels(spark, sf_dir):
    df = _table(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return df.select("vec_id", "i", F.col("v").cast("double").alias("p"), (F.floor(F.abs(F.col("v").cast("double")) * F.lit(1000.0)) % 256).alias("px"))


_PX = """SELECT vec_id, i, CAST(v AS DOUBLE) AS p, CAST(floor(abs(CAST(v AS DOUBLE)) * CAST(1000 AS DOUBLE)) AS BIGINT) % 256 AS px
  FROM (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS i, unnest(embedding) AS v FROM embeddings WHERE len(embedding) = 64) AS a"""


def det_normalize(spark, sf_dir):
    value = F.coalesce(*[F.when(F.col("i") % 3 == c, tensors.normalize_channel(F.col("px"), _MEAN[c], _STD[c])) for c in range(3)])
    return _pixels(spark, sf_dir).select("vec_id", "i", F.round(value, 6).alias("value"))


DET_SQL = f"SELECT vec_id, i, round(CASE i % 3 {' '.join(f'WHEN {c} THEN (px / CAST(255 AS DOUBLE) - CAST({_MEAN[c]} AS DOUBLE)) / CAST({_STD[c]} AS DOUBLE)' for c in range(3))} END, 6) AS value FROM ({_PX}) AS b"


def rec_normalize(spark, sf_dir):
    return _pixels(spark, sf_dir).select("vec_id", "i", F.round(tensors.normalize_crop(F.col("px")), 6).alias("value"))


REC_SQL = f"SELECT vec_id, i, round((px / CAST(255 AS DOUBLE) - CAST(0.5 AS DOUBLE)) / CAST(0.5 AS DOUBLE), 6) AS value FROM ({_PX}) AS b"


def prob_to_gray(spark, sf_dir):
    return _pixels(spark, sf_dir).select("vec_id", "i", tensors.gray(F.col("p")).alias("gray"))


GRAY_SQL = f"SELECT vec_id, i, CAST(least(255, greatest(0, round(p * CAST(255 AS DOUBLE)))) AS INT) AS gray FROM ({_PX}) AS b"


def contour_boxes(spark, sf_dir):
    """An embedding as a map of 8 x 8 probabilities."""
    kind = _table(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", "embedding")

    def run(batches):
        import numpy as np

        from pagewright.operators import contours, raster

        for pdf in batches:
            rows = [(vec, bool(hole), *box) for vec, v in zip(pdf["vec_id"], pdf["embedding"], strict=True) for hole, *box in contours.contour_boxes(raster.gray_map(np.asarray(v, float)).reshape(8, 8) > 0).tolist()]
            yield pdf.__class__(rows, columns=["vec_id", "hole", "x", "y", "width", "height"])

    return kind.mapInPandas(run, "vec_id long, hole boolean, x int, y int, width int, height int")


CONTOUR_SQL = f"""WITH RECURSIVE m AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, i, round(p * CAST(255 AS DOUBLE)) >= 1 AS fg FROM ({_PX}) AS b),
r AS (
  SELECT vec_id, i AS root, i, x, y, fg FROM m
  UNION
  SELECT n.vec_id, r.root, n.i, n.x, n.y, n.fg FROM r JOIN m n ON n.vec_id = r.vec_id AND n.fg = r.fg
    AND abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1 AND (r.fg OR n.x = r.x OR n.y = r.y)),
c AS (SELECT vec_id, root, bool_and(fg) AS fg, min(i) AS least, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM r GROUP BY vec_id, root)
SELECT vec_id, NOT fg AS hole,
  CAST(CASE WHEN fg THEN x0 ELSE x0 - 1 END AS INT) AS x, CAST(CASE WHEN fg THEN y0 ELSE y0 - 1 END AS INT) AS y,
  CAST(x1 - x0 + CASE WHEN fg THEN 1 ELSE 3 END AS INT) AS width, CAST(y1 - y0 + CASE WHEN fg THEN 1 ELSE 3 END AS INT) AS height
FROM c WHERE root = least AND (fg OR (x0 > 0 AND y0 > 0 AND x1 < 7 AND y1 < 7))"""

# --- decoding


def _logits(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", "embedding")



def _decoded(spark, sf_dir):
    return ctc.decode(_logits(spark, sf_dir), "embedding", F.lit(8), F.lit(8), F.array(*[F.lit(w) for w in WORDS]))


def ctc_argmax(spark, sf_dir):
    df = _logits(spark, sf_dir).select("vec_id", F.posexplode(ctc.argmaxes(F.col("embedding"), F.lit(8), F.lit(8))).alias("t", "s"))
    return df.select("vec_id", "t", "s.k", F.round("s.p", 6).alias("p"))


_STEPS = f"""SELECT vec_id, CAST(i // 8 AS INT) AS t, CAST(min(CASE WHEN p = top THEN i % 8 END) AS INT) AS k, max(top) AS p
  FROM (SELECT *, max(p) OVER (PARTITION BY vec_id, i // 8) AS top FROM ({_PX}) AS b) AS c GROUP BY vec_id, i // 8"""
ARGMAX_SQL = f"SELECT vec_id, t, k, round(p, 6) AS p FROM ({_STEPS}) AS d"


def ctc_collapse(spark, sf_dir):
    df = _logits(spark, sf_dir).withColumn("path", ctc.argmaxes(F.col("embedding"), F.lit(8), F.lit(8)))
    kept = F.transform(ctc.collapse(F.col("path")), lambda s: s["k"].cast("string"))
    return df.select("vec_id", F.array_join(kept, ",").alias("classes"))


_KEPT = f"SELECT * FROM (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM ({_STEPS}) AS d) AS e WHERE k <> 0 AND k IS DISTINCT FROM before"
COLLAPSE_SQL = f"SELECT v.vec_id, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY t), '') AS classes FROM embeddings v LEFT JOIN ({_KEPT}) AS f ON f.vec_id = v.vec_id WHERE len(v.embedding) = 64 GROUP BY v.vec_id"


def ctc_decode(spark, sf_dir):
    return _decoded(spark, sf_dir).select("vec_id", "decoded.text", F.round("decoded.confidence", 6).alias("confidence"))


_WORD_CASE = "CASE k " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(WORDS)) + " END"
_DECODE = f"SELECT v.vec_id, coalesce(string_agg({_WORD_CASE}, '' ORDER BY t), '') AS text, coalesce(avg(p), 0) AS conf FROM embeddings v LEFT JOIN ({_KEPT}) AS f ON f.vec_id = v.vec_id WHERE len(v.embedding) = 64 GROUP BY v.vec_id"
DECODE_SQL = f"SELECT vec_id, text, round(conf, 6) AS confidence FROM ({_DECODE}) AS g"


def dict_load(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return dictionary_rows(df, "text").select("doc_id", "class_id", "ch")


DICT_SQL = "SELECT doc_id, CAST(unnest(range(len(a))) AS INT) AS class_id, unnest(a) AS ch FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL) AS t"

# --- layout


def _items(df, keys, y, x, height, text, confidence, order):
    """Items of each key, as an array in the given order."""
    item = F.struct(text.alias("text"), geometry.box(x, y, F.lit(10), height).alias("box"), confidence.cast("double").alias("confidence"))
    rows = df.select(*keys, F.struct(*order, item.alias("item")).alias("o"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["item"]).alias("items"))


_LINE_ORDER = ["y", "x", "hgt", "l_partkey", "l_suppkey"]
_LINE = "CAST(l_partkey * 13 % 120 AS INT) AS y, CAST(l_suppkey % 97 AS INT) AS x, CAST(8 + l_quantity AS INT) AS hgt"


def _order_items(spark, sf_dir, those=None):
    df = _table(spark, sf_dir, "lineitem")
    df = (df if those is None else df.where(those)).selectExpr("l_orderkey", "l_partkey", "l_suppkey", *[c.strip() for c in _LINE.split(", ")])
    c = F.col
    return _items(df, ["l_orderkey"], c("y"), c("x"), c("hgt"), F.concat(F.lit("p"), c("l_partkey").cast("string")), (c("l_suppkey") % 10) / F.lit(10.0), [c(n) for n in _LINE_ORDER])


def line_group(spark, sf_dir):
    df = _order_items(spark, sf_dir)
    found = layout.lines(F.col("items"), df.schema["items"].dataType.elementType.simpleString())
    rows = df.select("l_orderkey", F.posexplode(found).alias("line_no", "line"))
    heights = F.aggregate(F.transform("line", lambda i: i["box"]["height"]), F.lit(0), lambda a, h: a + h)
    return rows.select("l_orderkey", "line_no", F.size("line").alias("n_items"), F.round(heights / F.size("line"), 6).alias("mean_height"), F.get("line", 0)["box"]["y"].alias("first_y"))


def _fold_sql(rows: str, key: str) -> str:
    """rows: key, i (from 1), y, hgt. Adds line_no by a fold."""
    return f"""WITH RECURSIVE s AS ({rows}), f AS (
  SELECT {key}, i, y, hgt, 0 AS line_no, CAST(hgt AS DOUBLE) AS total, 1 AS n FROM s WHERE i = 1
  UNION ALL
  SELECT s.{key}, s.i, s.y, s.hgt,
    CASE WHEN abs(s.y - f.y) <= 0.5 * (f.total / f.n) THEN f.line_no ELSE f.line_no + 1 END,
    CASE WHEN abs(s.y - f.y) <= 0.5 * (f.total / f.n) THEN f.total + s.hgt ELSE CAST(s.hgt AS DOUBLE) END,
    CASE WHEN abs(s.y - f.y) <= 0.5 * (f.total / f.n) THEN f.n + 1 ELSE 1 END
  FROM f JOIN s ON s.{key} = f.{key} AND s.i = f.i + 1)"""


_LINE_ROWS = f"SELECT l_orderkey, l_partkey, l_suppkey, y, hgt, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) AS i FROM (SELECT l_orderkey, l_partkey, l_suppkey, {_LINE} FROM lineitem) AS a"
LINE_SQL = f"""{_fold_sql(_LINE_ROWS, 'l_orderkey')}
SELECT l_orderkey, line_no, CAST(count(*) AS INT) AS n_items, round(sum(hgt) / CAST(count(*) AS DOUBLE), 6) AS mean_height, min(y) AS first_y FROM f GROUP BY l_orderkey, line_no"""


def reading_order(spark, sf_dir):
    """Boxes on a grid of lines, where the rule is a total order."""
    df = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey", "CAST(l_suppkey % 7 * 40 AS INT) AS y", "CAST(l_partkey AS INT) AS x", "l_quantity")
    c = F.col
    items = _items(df.dropDuplicates(["l_orderkey", "y", "x"]), ["l_orderkey"], c("y"), c("x"), F.lit(20), c("l_partkey").cast("string"), F.lit(1), [F.hash("x", "y").alias("h"), c("x"), c("y")])
    out = items.select("l_orderkey", F.posexplode(layout.reading_order()("items")).alias("pos", "item"))
    return out.select("l_orderkey", "pos", "item.box.x", "item.box.y")


READING_SQL = """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY y, x) - 1 AS INT) AS pos, x, y
FROM (SELECT DISTINCT l_orderkey, CAST(l_suppkey % 7 * 40 AS INT) AS y, CAST(l_partkey AS INT) AS x FROM lineitem) AS a"""


def reading_order_raw(spark, sf_dir):
    """Boxes anywhere: the rule is no total order, so SQL has no like of it."""
    out = _order_items(spark, sf_dir).select("l_orderkey", F.posexplode(layout.reading_order()("items")).alias("pos", "item"))
    return out.select("l_orderkey", "pos", "item.text", "item.box.x", "item.box.y")


def _pages(spark, sf_dir):
    """A conversation as a page of two turns a line."""
    df = _table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "text", "CAST(turn DIV 2 * 50 AS INT) AS y", "CAST(turn % 2 * 30 AS INT) AS x")
    c = F.col
    conf = F.coalesce(F.length("text") % 100, F.lit(0)) / F.lit(100.0)
    return _items(df, ["conv_id"], c("y"), c("x"), F.lit(20), F.coalesce("text", F.lit("")), conf, [c("turn"), c("role"), c("text")])


_PAGE_ROWS = """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i, CAST(turn // 2 AS INT) AS l, coalesce(text, '') AS t,
  coalesce(length(text) % 100, 0) / CAST(100 AS DOUBLE) AS c FROM conversations"""


def page_text(spark, sf_dir):
    return layout.assemble(_pages(spark, sf_dir)).select("conv_id", "text", F.size("lines").alias("n_lines"))


PAGE_SQL = f"SELECT conv_id, string_agg(line, chr(10) ORDER BY l) AS text, CAST(count(*) AS INT) AS n_lines FROM (SELECT conv_id, l, string_agg(t, ' ' ORDER BY i) AS line FROM ({_PAGE_ROWS}) AS a GROUP BY conv_id, l) AS b GROUP BY conv_id"


def page_confidence(spark, sf_dir):
    return layout.assemble(_pages(spark, sf_dir)).select("conv_id", F.round("confidence", 6).alias("confidence"))


CONF_SQL = f"SELECT conv_id, round(avg(c), 6) AS confidence FROM ({_PAGE_ROWS}) AS a GROUP BY conv_id"


def flatten_results(spark, sf_dir):
    """Items of the flat result; whether the grouped result's lines, flattened, hold the same."""
    kind = ITEM.simpleString()
    df = _pages(spark, sf_dir)
    flat = layout.assemble(df, flat=True).withColumn("same", F.flatten(layout.lines(F.col("results"), kind)) == F.col("results"))
    rows = flat.select("conv_id", "same", F.posexplode("results").alias("pos", "item"))
    return rows.select("conv_id", "pos", "item.text", F.round("item.confidence", 6).alias("confidence"), "same")


FLAT_SQL = f"SELECT conv_id, CAST(i - 1 AS INT) AS pos, t AS text, round(c, 6) AS confidence, true AS same FROM ({_PAGE_ROWS}) AS a"


def empty_image(spark, sf_dir):
    """Orders as images, each item a box one pixel high: those that the area filter leaves without a box still have a row."""
    boxes = _order_items(spark, sf_dir, geometry.large_enough(geometry.box(F.lit(0), F.lit(0), F.col("l_quantity"), F.lit(1))))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    out = layout.assemble(orders.join(boxes, F.col("o_orderkey") == F.col("l_orderkey"), "left"))
    return out.select("o_orderkey", F.size(F.flatten("lines")).alias("n_items"), F.length("text").alias("text_length"), F.round("confidence", 6).alias("confidence"))


EMPTY_SQL = """SELECT o.o_orderkey, CAST(coalesce(n, 0) AS INT) AS n_items, CAST(coalesce(t, 0) AS INT) AS text_length, coalesce(c, 0) AS confidence
FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(length('p' || CAST(l_partkey AS VARCHAR))) + count(*) - 1 AS t, round(avg((l_suppkey % 10) / CAST(10 AS DOUBLE)), 6) AS c
  FROM lineitem WHERE CAST(l_quantity AS INT) > 20 GROUP BY l_orderkey) AS a ON a.l_orderkey = o.o_orderkey"""


def det_to_text(spark, sf_dir):
    """Boxes through the whole chain, labels by decoding, pages by assembly: ten crops a page."""
    found = _decoded(spark, sf_dir).select("vec_id", "decoded.*")
    i = F.col("vec_id") % 10
    raw = geometry.box(i % 5 * 90 + 20, F.floor(i / 5) * 120 + 40, 60 + F.col("vec_id") % 7, F.lit(24))
    df = found.withColumn("s", geometry.resized(F.lit(2000), F.lit(1500))).withColumn("b", raw).where(geometry.large_enough(F.col("b")))
    df = geometry.settled(df, "b", geometry.padded(F.col("b"), F.col("s.model_w"), F.col("s.model_h")))
    df = geometry.settled(df, "b", geometry.rescaled(F.col("b"), F.col("s.ratio"), F.lit(2000), F.lit(1500)))
    df = geometry.only_final(df, "b")
    item = F.struct("text", F.col("b").cast(BOX).alias("box"), "confidence")
    pages = df.groupBy(F.floor(F.col("vec_id") / 10).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("b.y", "b.x", item.alias("item")))).alias("o"))
    pages = pages.select("page_id", F.transform("o", lambda o: o["item"]).alias("items"))
    out = layout.assemble(pages)
    return out.select("page_id", "text", F.size("lines").alias("n_lines"), F.round("confidence", 6).alias("confidence"), F.get(F.get("lines", 0), 0)["box"]["width"].alias("first_width"))


FLAGSHIP_SQL = f"""WITH d AS ({_DECODE}),
b AS (SELECT vec_id, vec_id // 10 AS page_id, vec_id % 10 % 5 AS col, vec_id % 10 // 5 AS row, text, conf, 60 + vec_id % 7 AS bw FROM d),
l AS (SELECT page_id, row, string_agg(text, ' ' ORDER BY col) AS line FROM b GROUP BY page_id, row),
w AS (SELECT page_id, min(row * 5 + col) AS first FROM b GROUP BY page_id)
SELECT l.page_id, string_agg(line, chr(10) ORDER BY l.row) AS text, CAST(count(*) AS INT) AS n_lines,
  (SELECT round(avg(conf), 6) FROM b WHERE b.page_id = l.page_id) AS confidence,
  (SELECT CAST(round((bw + 14 + 14) / (CAST(960 AS DOUBLE) / 2000)) AS INT) FROM b JOIN w ON w.page_id = b.page_id WHERE b.page_id = l.page_id AND row * 5 + col = w.first) AS first_width
FROM l GROUP BY l.page_id"""

_ALL = {
    "resize_dims": (resize_dims, RESIZE_SQL),
    "box_filter_area": (box_filter_area, FILTER_SQL),
    "box_pad": (box_pad, PAD_SQL),
    "box_rescale": (box_rescale, RESCALE_SQL),
    "box_valid": (box_valid, VALID_SQL),
    "box_pipeline": (box_pipeline, PIPELINE_SQL),
    "crop_dims": (crop_dims, CROP_SQL),
    "det_normalize": (det_normalize, DET_SQL),
    "rec_normalize": (rec_normalize, REC_SQL),
    "prob_to_gray": (prob_to_gray, GRAY_SQL),
    "contour_boxes": (contour_boxes, CONTOUR_SQL),
    "ctc_argmax": (ctc_argmax, ARGMAX_SQL),
    "ctc_collapse": (ctc_collapse, COLLAPSE_SQL),
    "ctc_decode": (ctc_decode, DECODE_SQL),
    "dict_load": (dict_load, DICT_SQL),
    "line_group": (line_group, LINE_SQL),
    "reading_order": (reading_order, READING_SQL),
    "reading_order_raw": (reading_order_raw, None),
    "page_text": (page_text, PAGE_SQL),
    "page_confidence": (page_confidence, CONF_SQL),
    "flatten_results": (flatten_results, FLAT_SQL),
    "empty_image": (empty_image, EMPTY_SQL),
    "det_to_text": (det_to_text, FLAGSHIP_SQL),
    **image_queries.QUERIES,
}


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
