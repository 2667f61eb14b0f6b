"""Images that arrive in a folder. Each is read by itself, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.sources.images import decoded, read_images

FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_folder(spark: SparkSession, path: str, handle, checkpoint: str, pattern: str = "*", files_per_trigger: int = 1000):
    """Start a stream that gives each new batch of files to ``handle(images, batch)`` as batch reading has them: every format of the JVM's decoder.

    Names of at most files_per_trigger files come to the driver.
    """
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(path)

    def each(batch: DataFrame, number: int) -> None:
        if paths := [r["path"] for r in batch.select("path").collect()]:
            handle(read_images(batch.sparkSession, paths), number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def stream_images(spark: SparkSession, path: str, pattern: str = "*.png", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of image rows for OcrEngine.recognize."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger)
    return decoded(files.load(path))
