"""The fixed schemas of the engine."""

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "width", "height")])
ITEM = T.StructType([T.StructField("text", T.StringType()), T.StructField("box", BOX), T.StructField("confidence", T.DoubleType())])
ITEMS = T.ArrayType(ITEM)
LINES = T.ArrayType(ITEMS)
IMAGE = T.StructType(
    [T.StructField("origin", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("height", "width", "nChannels", "mode")], T.StructField("data", T.BinaryType())]
)
DICTIONARY = T.StructType([T.StructField("class_id", T.IntegerType()), T.StructField("ch", T.StringType())])
