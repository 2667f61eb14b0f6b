"""Images as rows with an ``image`` struct, and dictionaries as arrays."""

from __future__ import annotations

import os
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.schemas import IMAGE


def read_images(spark: SparkSession, path, pattern: str | None = None, drop_invalid: bool = False) -> DataFrame:
    """Decoded in the JVM: jpg, png, bmp, gif, tiff, wbmp. A file that can't be decoded has sides of -1."""
    reader = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("image.origin").alias("image_id"), "image")


def decoded(files: DataFrame) -> DataFrame:
    """``path, content`` rows of PNG files to image rows, for streams; a bad file gets sides of -1."""

    def run(batches):
        from pagewright.operators.raster import read_png

        for pdf in batches:
            images = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    images.append(read_png(content) | {"origin": path})
                except Exception:
                    images.append({"origin": path, "height": -1, "width": -1, "nChannels": -1, "mode": -1, "data": b""})
            yield pdf.__class__({"image_id": pdf["path"], "image": images})

    return files.select("path", "content").mapInPandas(run, f"image_id string, image {IMAGE.simpleString()}")


def resolve(path: str) -> str:
    """A local path made absolute; one with a scheme stays."""
    return path if "://" in path else os.path.abspath(path)


def default_models() -> dict[str, str]:
    """Model files that lie in the package's own ``models`` folder: detection.onnx, recognition.onnx, dictionary.txt."""
    folder = resources.files("pagewright") / "models"
    names = {"detection": "detection.onnx", "recognition": "recognition.onnx", "dictionary": "dictionary.txt"}
    return {k: str(folder / name) for k, name in names.items() if (folder / name).is_file()}


def dictionary_rows(df: DataFrame, text: str) -> DataFrame:
    """``class_id, ch`` and the other columns, one row a line of text; a last empty line counts."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "\n", -1)).alias("class_id", "ch"))


def load_dictionary(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The lines of a file, as they are, by class id; an empty file is an error."""
    rows = dictionary_rows(spark.read.text(resolve(path), wholetext=True), "value").orderBy("class_id").collect()
    if not rows or [r["ch"] for r in rows] == [""]:
        raise ValueError(f"the dictionary {path} is empty")
    return tuple(r["ch"] for r in rows)
