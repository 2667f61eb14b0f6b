"""Functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from pagewright.functions.layout import reading_order_udf
from pagewright.schemas import BOX


def contour_udtf():
    """``contour_boxes(p array<float>, w int, h int)``: a row for each border of a probability map."""

    @udtf(returnType="hole boolean, x int, y int, width int, height int")
    class ContourBoxes:
        def eval(self, p, w, h):
            import numpy as np

            from pagewright.operators.contours import contour_boxes
            from pagewright.operators.raster import gray_map

            if p is not None and w and h and len(p) == w * h:
                values = np.array([np.nan if v is None else v for v in p], float)
                for hole, *box in contour_boxes(gray_map(values).reshape(h, w) > 0).tolist():
                    yield bool(hole), *box

    return ContourBoxes


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def decode_sql(dictionary) -> str:
    """The statement that makes ``ctc_decode(logits array<float>, t int, c int)``: ``struct<text, confidence>``.

    All of it is an expression of the JVM's. Null where an argument is null, c is below 1, t is below 0, or logits are fewer than t * c.
    The words' array is a literal; the one-element arrays name a value once.
    """
    words, last = f"array({', '.join(map(_quoted, dictionary)) or _quoted('')})", len(dictionary) - 1
    low = "double('-inf')"
    path = f"""transform(if(t > 0, sequence(0, t - 1), array()), k ->
      transform(array(transform(slice(logits, k * c + 1, c), x -> if(x IS NULL OR isnan(x), {low}, double(x)))), row ->
        named_struct('k', int(array_position(row, array_max(row)) - 1), 'p', array_max(row)))[0])"""
    known = f"s.k != 0 AND s.k <= {last} AND (i = 0 OR s.k != get(path, i - 1).k) AND NOT (s.k = {last} AND get({words}, s.k) = '<unk>')"
    result = f"""named_struct(
        'text', array_join(transform(kept, s -> if(s.k = {last}, ' ', get({words}, s.k))), ''),
        'confidence', if(size(kept) > 0, aggregate(kept, double(0), (a, s) -> a + s.p) / size(kept), double(0)))"""
    return f"""CREATE OR REPLACE TEMPORARY FUNCTION ctc_decode(logits ARRAY<FLOAT>, t INT, c INT) RETURNS STRUCT<text: STRING, confidence: DOUBLE> RETURN
      CASE WHEN t >= 0 AND c > 0 AND size(logits) >= bigint(t) * c THEN
        transform(array({path}), path -> transform(array(filter(path, (s, i) -> {known})), kept -> {result})[0])[0] END"""


def detect_udf(engine):
    """``detect_boxes(image)``: the boxes of an image struct, as an engine's detect() finds them; null for one that fails."""
    from pagewright.plans.engine import found_boxes

    model, options = engine._ready()[0], engine.options.detection

    def run(batches):
        import pandas as pd

        for images in batches:
            out = []
            for image in images.to_dict("records"):
                try:
                    out.append(found_boxes(image, model, options)[0])
                except Exception:
                    out.append(None)
            yield pd.Series(out)

    from collections.abc import Iterator

    import pandas as pd

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return pandas_udf(run, f"array<{BOX.simpleString()}>").asNondeterministic()


def register(spark: SparkSession, dictionary=(), engine=None) -> None:
    """With an engine, its dictionary holds and ``detect_boxes`` is there too."""
    spark.udtf.register("contour_boxes", contour_udtf())
    spark.udf.register("reading_order", reading_order_udf())
    spark.sql(decode_sql(dictionary or (engine.options.recognition.dictionary if engine else ())))
    if engine:
        spark.udf.register("detect_boxes", detect_udf(engine))
