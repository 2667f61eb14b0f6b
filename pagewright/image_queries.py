"""The engine itself as queries: images made of table rows, stub models, and SQL that makes the same rows.

An embedding is a page of 8 x 8 cells of CELL pixels, ink where a component is above INK. The pages are a
little larger than the model's side, so they are shrunk by 2 / 3; a cell's border falls between pixels either way, so that SQL
can tell the map without a resize of its own. The detection model gives the red plane back as probabilities. The
recognition model spells two letters that tell a crop's width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import raster
from pagewright.options import DetectionOptions
from pagewright.plans.engine import create
from pagewright.schemas import IMAGE

CELL, SIDE, INK = 12, 64, 0.05
WORDS = ("", "a", "b", "c", "d", "e", "f", " ")
_D = DetectionOptions()


def red_plane(tensor):
    """The red plane before it was normalised, as probabilities."""
    return tensor[:, 0] * _D.std[0] + _D.mean[0]


def spelt_width(tensor):
    """Two letters with a blank between, and a logit, that follow from the width."""
    import numpy as np

    w = tensor.shape[3]
    out = np.full((1, 3, len(WORDS)), -1, np.float32)
    out[0, [0, 1, 2], [1 + w % 6, 0, 1 + w // 6 % 6]] = 0.25 + w % 4 / 8
    return out


def _image(data) -> F.Column:
    return F.struct(F.lit("").alias("origin"), F.lit(8 * CELL).alias("height"), F.lit(8 * CELL).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data")).cast(IMAGE)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, image``: gray, without Python. Ink has values from 100 on."""
    value = lambda x, i: F.lpad(F.hex(F.when(x > INK, 100 + i * 7 % 100).otherwise(0)), 2, "0")
    row = lambda y: F.repeat(F.array_join(F.transform(F.slice("v", y * 8 + 1, 8), lambda x: F.repeat(x, CELL)), ""), CELL)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("size(embedding) = 64")
    df = df.select("vec_id", F.transform("embedding", value).alias("v"))
    return df.select("vec_id", _image(F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), row), ""))).alias("image"))


def _engine(spark: SparkSession):
    return create(spark, {"model": {"detection": red_plane, "recognition": spelt_width, "dictionary": WORDS}, "detection": {"max_side": SIDE}})


def image_detect(spark, sf_dir):
    """detect() on every page."""
    out = _engine(spark).detect(pages(spark, sf_dir))
    return out.select("vec_id", F.explode("boxes").alias("b")).select("vec_id", "b.*")


_MAP = "SELECT vec_id, i % 8 AS x, i // 8 AS y, i, v > CAST(0.05 AS DOUBLE) AS fg FROM (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE len(embedding) = 64) AS a"
_HALF = "CAST(floor(({}) + CAST(0.5 AS DOUBLE)) AS INT)"
_SCALED = _HALF.format("({}) / (CAST(64 AS DOUBLE) / 96)")
_BOXES = f"""m AS ({_MAP}),
r AS (
  SELECT vec_id, i AS root, i, x, y, fg FROM m
  UNION
  SELECT n.vec_id, r.root, n.i, n.x, n.y, n.fg FROM r JOIN m n ON n.vec_id = r.vec_id AND n.fg = r.fg
    AND abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1 AND (r.fg OR n.x = r.x OR n.y = r.y)),
c AS (SELECT vec_id, root, bool_and(fg) AS fg, min(i) AS least, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM r GROUP BY vec_id, root),
b AS (
  SELECT vec_id, 8 * x0 - CASE WHEN fg THEN 0 ELSE 1 END AS x, 8 * y0 - CASE WHEN fg THEN 0 ELSE 1 END AS y,
    8 * (x1 - x0 + 1) + CASE WHEN fg THEN 0 ELSE 2 END AS w, 8 * (y1 - y0 + 1) + CASE WHEN fg THEN 0 ELSE 2 END AS h
  FROM c WHERE root = least AND (fg OR (x0 > 0 AND y0 > 0 AND x1 < 7 AND y1 < 7))),
p AS (
  SELECT vec_id, greatest(0, x - s) AS x0, greatest(0, y - v) AS y0, least(64, x + w + s) AS x1, least(64, y + h + v) AS y1
  FROM (SELECT *, {_HALF.format("h * CAST(0.4 AS DOUBLE)")} AS v, {_HALF.format("h * CAST(0.6 AS DOUBLE)")} AS s FROM b WHERE w * h > 20) AS q),
o AS (
  SELECT vec_id, x, y, least(96 - x, {_SCALED.format("x1 - x0")}) AS width, least(96 - y, {_SCALED.format("y1 - y0")}) AS height
  FROM (SELECT *, {_SCALED.format("x0")} AS x, {_SCALED.format("y0")} AS y FROM p) AS q),
f AS (SELECT * FROM o WHERE width > 5 AND height > 5)"""
DETECT_SQL = f"WITH RECURSIVE {_BOXES} SELECT vec_id, x, y, width, height FROM f"


def image_to_text(spark, sf_dir):
    """recognize() on every page: each item, with the page's confidence and the length of its text."""
    out = _engine(spark).recognize(pages(spark, sf_dir), flatten=True)
    rows = out.select("vec_id", F.length("text").alias("n_chars"), F.col("confidence").alias("page_confidence"), F.col("error").isNull().alias("whole"), F.explode("results").alias("r"))
    return rows.select("vec_id", "n_chars", F.round("page_confidence", 6).alias("page_confidence"), "whole", "r.text", "r.box.*", F.round("r.confidence", 6).alias("confidence"))


TEXT_SQL = f"""WITH RECURSIVE {_BOXES},
t AS (SELECT *, greatest(8, {_HALF.format("CAST(48 AS DOUBLE) * width / height")}) AS w FROM f)
SELECT vec_id, CAST(3 * count(*) OVER (PARTITION BY vec_id) - 1 AS INT) AS n_chars, round(avg(CAST(0.25 AS DOUBLE) + w % 4 / CAST(8 AS DOUBLE)) OVER (PARTITION BY vec_id), 6) AS page_confidence,
  true AS whole, substr('abcdef', 1 + w % 6, 1) || substr('abcdef', 1 + w // 6 % 6, 1) AS text, x, y, width, height, round(CAST(0.25 AS DOUBLE) + w % 4 / CAST(8 AS DOUBLE), 6) AS confidence
FROM t"""


def image_tensors(spark, sf_dir):
    """What the models are given and what detection makes of it, for a page of one pixel a cell: both normalisations and the gray map."""
    value = lambda x: F.lpad(F.hex(F.floor(F.abs(x.cast("double")) * 1000) % 256), 2, "0")
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("size(embedding) = 64")
    df = df.select("vec_id", F.unhex(F.array_join(F.transform("embedding", value), "")).alias("data"), F.col("embedding").cast("array<double>").alias("p"))

    def run(batches):
        import numpy as np

        for pdf in batches:
            for vec, data, p in zip(pdf["vec_id"], pdf["data"], pdf["p"], strict=True):
                px = raster.rgb({"height": 8, "width": 8, "nChannels": 1, "data": data})
                tensor, _, width, height = raster.detection_tensor(px, _D)
                crop = raster.recognition_tensor(raster.crop(px, {"x": 0, "y": 0, "width": 8, "height": 8}), 8)
                own = {f"detection_{c}": tensor[0, c, :8, :8].ravel().astype(float) for c in range(3)}
                yield pdf.__class__({"vec_id": vec, "i": np.arange(64), **own, "recognition": crop[0, 1].ravel().astype(float), "gray": raster.gray_map(np.asarray(p)), "width": width, "height": height})

    kind = "vec_id long, i int, detection_0 double, detection_1 double, detection_2 double, recognition double, gray int, width int, height int"
    out = df.mapInPandas(run, kind)
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c[:3] in ("det", "rec")})


TENSOR_SQL = f"""SELECT vec_id, i, {', '.join(f'round((px / CAST(255 AS DOUBLE) - CAST({_D.mean[c]} AS DOUBLE)) / CAST({_D.std[c]} AS DOUBLE), 4) AS detection_{c}' for c in range(3))},
  round((px / CAST(255 AS DOUBLE) - CAST(0.5 AS DOUBLE)) / CAST(0.5 AS DOUBLE), 4) AS recognition, CAST(least(255, greatest(0, round(p * CAST(255 AS DOUBLE)))) AS INT) AS gray, 32 AS width, 32 AS height
FROM (SELECT vec_id, i, CAST(v AS DOUBLE) AS p, CAST(floor(abs(CAST(v AS DOUBLE)) * CAST(1000 AS DOUBLE)) AS BIGINT) % 256 AS px
  FROM (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS i, unnest(embedding) AS v FROM embeddings WHERE len(embedding) = 64) AS a) AS b"""


QUERIES = {"image_detect": (image_detect, DETECT_SQL), "image_to_text": (image_to_text, TEXT_SQL), "image_tensors": (image_tensors, TENSOR_SQL)}
