"""The engine: images to ordered text.

Detection and recognition of an image are one Python stage, so pixels cross to Python once
and tensors never become columns. Lines, text and confidence are expressions on the
row that comes back. Nothing is shuffled: partitions of images are the parallelism.
"""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import geometry, layout
from pagewright.operators.backends import backend
from pagewright.options import OcrOptions, merged
from pagewright.schemas import BOX, ITEM
from pagewright.sources.images import default_models, load_dictionary
from pagewright.sources.sinks import write_debug

log = logging.getLogger("pagewright")
_shared: list = [None]


def found_boxes(image, model, options, tell=None) -> tuple[list[dict], object]:
    """Boxes on one image, in its own pixels, and the gray map they come from."""
    from pagewright.operators import boxes, raster
    from pagewright.operators.contours import contour_boxes

    tell = tell or (lambda *_: None)
    tell("detection", "Starting text detection process")
    px = raster.rgb(image)
    tensor, ratio, W, H = raster.detection_tensor(px, options)
    tell("detection", f"Image of {px.shape[1]}x{px.shape[0]} as {W}x{H} (ratio: {ratio:.4f})")
    gray = raster.gray_map(model(tensor).ravel()[: H * W].reshape(H, W))
    found = boxes.in_image(contour_boxes(gray > 0)[:, 1:], (W, H), ratio, px.shape[1::-1], options)
    tell("detection", f"Detected {len(found)} text boxes in image")
    return [dict(zip(("x", "y", "width", "height"), b, strict=True)) for b in found.tolist()], gray


def read_items(image, boxes, model, options, tell=None, strange=None) -> tuple[list[dict], list[str]]:
    """Items of the boxes that can be read, in reading order, and what went wrong with others.

    tell: gets a line for each box; strange: gets the number of a model's classes where the dictionary has another.
    """
    from pagewright.operators import raster

    tell = tell or (lambda *_: None)
    px, items, errors, warned = raster.rgb(image), [], [], False
    for k, b in enumerate(boxes):
        start = time.perf_counter()
        b = {n: int(b[n]) for n in ("x", "y", "width", "height")}
        if b["width"] <= 0 or b["height"] <= 0:
            errors.append(f"box {k} has no pixels")
            continue
        try:
            out = model(raster.recognition_tensor(raster.crop(px, b), options.image_height))
            if out.shape[-1] != len(options.dictionary) and not warned:
                warned = True
                log.warning("the model has %d classes, the dictionary %d", out.shape[-1], len(options.dictionary))
                if strange:
                    strange(out.shape[-1])
            text, confidence = raster.decode_steps(out.reshape(out.shape[-2:]), options.dictionary)
            items.append({"text": text, "box": b, "confidence": confidence})
            ms = (time.perf_counter() - start) * 1000
            tell("recognition", f"Box {k + 1}/{len(boxes)}: [x:{b['x']}, y:{b['y']}, w:{b['width']}, h:{b['height']}] -> \"{text}\" (processed in {ms:.0f} ms)", ms)
        except Exception as e:  # one box does not end the others
            errors.append(f"box {k}: {e}")
    return layout.in_reading_order(items), errors


def logged(debugging, image_id):
    """What writes lines to the worker's log, where options ask for it: boxes only with debug and verbose."""

    def tell(service, text, ms=None):
        if ms is None or debugging.debug:
            log.info("[%s] %s: %s", service, image_id, text)

    return tell if debugging.verbose else None


class OcrEngine:
    """Built from options or dicts of options; use create(), or get_or_create() for one that is shared."""

    def __init__(self, spark: SparkSession, options: OcrOptions | dict | None = None):
        self.spark = spark
        self.options = options if isinstance(options, OcrOptions) else merged(OcrOptions(), options)
        self._models = None

    def initialize(self, changes: dict | None = None) -> OcrEngine:
        """Check and load the models and the dictionary, on the driver; changes may touch any option."""
        self.options = merged(self.options, changes)
        known = default_models()
        self.options = merged(self.options, {"model": {n: p for n, p in known.items() if getattr(self.options.model, n) is None and not (n == "dictionary" and self.options.recognition.dictionary)}})
        m = self.options.model
        missing = [n for n in ("detection", "recognition") if getattr(m, n) is None]
        if missing or (m.dictionary is None and not self.options.recognition.dictionary):
            raise ValueError(f"models are missing: {', '.join(missing) or 'dictionary'}")
        words = self.options.recognition.dictionary
        if m.dictionary is not None:
            words = load_dictionary(self.spark, m.dictionary) if isinstance(m.dictionary, str) else tuple(m.dictionary)
        self.options = merged(self.options, {"recognition": {"dictionary": words}})
        self._models = backend(self.spark, m.detection), backend(self.spark, m.recognition)
        log.info("models are ready; the dictionary has %d entries", len(words))
        return self

    @property
    def is_initialized(self) -> bool:
        return self._models is not None

    def destroy(self) -> None:
        for m in self._models or ():
            getattr(m, "release", lambda: None)()
        self._models = None

    def change_model(self, model: dict) -> OcrEngine:
        """Another engine with other models; this one goes on to work."""
        return OcrEngine(self.spark, merged(self.options, {"model": model})).initialize()

    def _ready(self):
        if not self._models:
            raise RuntimeError("the engine has not been initialized")
        return self._models

    def _map(self, df: DataFrame, run, fields: list) -> DataFrame:
        """Rows without their pixels, with fields added by run(row) -> dict; an error empties them."""
        keep = [f for f in df.schema if f.name not in ("image", *[x.name for x in fields])]
        names = [f.name for f in fields]

        def each(batches):
            for pdf in batches:
                rows = []
                for row in pdf.to_dict("records"):
                    try:
                        rows.append(run(row))
                    except Exception as e:
                        rows.append({f.name: [] if isinstance(f.dataType, T.ArrayType) else 0 for f in fields[:-1]} | {"error": str(e)})
                out = pdf[[f.name for f in keep]].copy()
                for n in names:
                    out[n] = [r.get(n) for r in rows]
                yield out

        return df.mapInPandas(each, T.StructType([*keep, *fields]))

    def detect(self, df: DataFrame) -> DataFrame:
        """Add ``boxes`` and ``error`` to image rows, in place of the pixels."""
        model, options = self._ready()[0], self.options.detection
        run = lambda row: {"boxes": found_boxes(row["image"], model, options)[0]}
        return self._map(df, run, [T.StructField("boxes", T.ArrayType(BOX)), T.StructField("error", T.StringType())])

    def recognize_boxes(self, df: DataFrame) -> DataFrame:
        """Rows with ``image`` and ``boxes``, from anywhere, to ``items`` in reading order."""
        model, options = self._ready()[1], self.options.recognition

        def run(row):
            items, errors = read_items(row["image"], row["boxes"] if row["boxes"] is not None else [], model, options)
            return {"items": items, "error": "; ".join(errors) or None}

        return self._map(df, run, [T.StructField("items", T.ArrayType(ITEM)), T.StructField("error", T.StringType())]).drop("boxes")

    def recognize(self, df: DataFrame, flatten: bool = False, observation: Observation | None = None) -> DataFrame:
        """``text, lines`` (or ``results``), ``confidence, error`` of each image; an image that fails is empty.

        observation: gets the counts of images, boxes, items, of images with an error, and of those
        where the model's classes are not as many as the dictionary's entries.
        """
        (find, read), options = self._ready(), self.options

        def run(row):
            tell, strange = logged(options.debugging, row.get("image_id")), []
            boxes, _ = found_boxes(row["image"], find, options.detection, tell)
            items, errors = read_items(row["image"], boxes, read, options.recognition, tell, strange.append)
            return {"items": items, "n_boxes": len(boxes), "n_strange": len(strange), "error": "; ".join(errors) or None}

        counts = [T.StructField("n_boxes", T.LongType()), T.StructField("n_strange", T.LongType())]
        items = self._map(df, run, [T.StructField("items", T.ArrayType(ITEM)), *counts, T.StructField("error", T.StringType())])
        if observation is not None:
            total = lambda c: F.coalesce(F.sum(c), F.lit(0))
            items = items.observe(observation, F.count("*").alias("images"), total("n_boxes").alias("boxes"), total(F.size("items")).alias("items"), F.count("error").alias("errors"), total("n_strange").alias("strange_dictionaries"))
        return layout.assemble(items.drop("n_boxes", "n_strange"), flat=flatten)

    def trace(self, df: DataFrame) -> DataFrame:
        """What verbose logging says, as rows: ``step, service, message, elapsed_ms`` (of boxes) of each image."""
        (find, read), options = self._ready(), self.options
        line = T.StructType([T.StructField("service", T.StringType()), T.StructField("message", T.StringType()), T.StructField("elapsed_ms", T.DoubleType())])

        def run(row):
            said = []
            tell = lambda service, text, ms=None: said.append({"service": service, "message": text, "elapsed_ms": ms})
            try:
                boxes, _ = found_boxes(row["image"], find, options.detection, tell)
                errors = read_items(row["image"], boxes, read, options.recognition, tell, lambda n: tell("recognition", f"Warning: the model has {n} classes, the dictionary {len(options.recognition.dictionary)}"))[1]
            except Exception as e:
                errors = [f"Error during text detection: {e}"]
            for e in errors:
                tell("recognition", e)
            return {"lines": said}

        out = self._map(df, run, [T.StructField("lines", T.ArrayType(line)), T.StructField("error", T.StringType())])
        keep = [c for c in out.columns if c not in ("lines", "error")]
        return out.select(*keep, F.posexplode("lines").alias("step", "l")).select(*keep, "step", "l.*")

    def save_debug(self, df: DataFrame) -> None:
        """Write debug() to the options' folder, where options ask for it."""
        if self.options.debugging.debug:
            write_debug(self.debug(df), self.options.debugging.folder)

    def debug(self, df: DataFrame) -> DataFrame:
        """PNG files of the gray map, the boxes and the crops of each image, and the time each image took."""
        model, options = self._ready()[0], self.options.detection
        file = T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("png", T.BinaryType()), T.StructField("elapsed_ms", T.DoubleType())])

        def run(row):
            from pagewright.operators import raster

            start = time.perf_counter()
            boxes, gray = found_boxes(row["image"], model, options)
            px = raster.rgb(row["image"])
            files = [("detection-debug", "detection-debug.png", gray), ("boxes-debug", "boxes-debug.png", raster.outlined(px, boxes))]
            files += [("crops", f"crop_{k:03d}.png", raster.crop(px, b)) for k, b in enumerate(boxes)]
            ms = (time.perf_counter() - start) * 1000
            return {"files": [{"kind": k, "name": n, "png": raster.png(p), "elapsed_ms": ms} for k, n, p in files]}

        out = self._map(df, run, [T.StructField("files", T.ArrayType(file)), T.StructField("error", T.StringType())])
        return out.select(*[c for c in out.columns if c not in ("files", "error")], F.explode("files").alias("f")).select("*", "f.*").drop("f")


def create(spark: SparkSession, options=None) -> OcrEngine:
    return OcrEngine(spark, options).initialize()


def get_or_create(spark: SparkSession, options=None) -> OcrEngine:
    """The shared engine; with options, or after destroy(), it is built anew."""
    if _shared[0] is None or options is not None or not _shared[0].is_initialized:
        if _shared[0] is not None:
            _shared[0].destroy()
        _shared[0] = create(spark, options)
    return _shared[0]
