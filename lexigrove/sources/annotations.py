"""Picture annotations: polygon files and COCO in, normalised label lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import flat_normal, flat_valid, polygon_valid
from ..functions.text import basename

POLYGON_FILE = T.StructType(
    [
        T.StructField("imagePath", T.StringType()), T.StructField("imageWidth", T.IntegerType()), T.StructField("imageHeight", T.IntegerType()),
        T.StructField("shapes", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("shape_type", T.StringType()), T.StructField("points", T.ArrayType(T.ArrayType(T.DoubleType())))]))),
    ]
)
COCO = T.StructType(
    [
        T.StructField("images", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))),
        T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("category_id", T.IntegerType()), T.StructField("segmentation", T.ArrayType(T.ArrayType(T.DoubleType())))]))),
        T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())]))),
    ]
)


def polygons(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shape: stem, label, xs, ys, valid."""
    rows = spark.read.schema(POLYGON_FILE).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder).withColumn("path", F.input_file_name())
    shapes = rows.select(F.regexp_replace(basename(F.col("path")), r"\.json$", "").alias("stem"), F.col("imageWidth").alias("width"), F.col("imageHeight").alias("height"), F.posexplode_outer("shapes").alias("n", "s"))
    axis = lambda i: F.transform("s.points", lambda p: p[i])
    return shapes.select("stem", "width", "height", "n", F.col("s.label").alias("label"), F.col("s.shape_type").alias("shape_type"), axis(0).alias("xs"), axis(1).alias("ys")).withColumn("valid", F.coalesce(polygon_valid(F.col("xs"), F.col("ys")), F.lit(False)))


def pair_stems(pictures: DataFrame, shapes: DataFrame) -> DataFrame:
    """Stems with their side: both, missing_json or missing_image."""
    a = pictures.select(F.regexp_replace("name", r"\.[^.]+$", "").alias("stem")).distinct().withColumn("i", F.lit(True))
    b = shapes.select("stem").distinct().withColumn("j", F.lit(True))
    return a.join(b, "stem", "fullouter").select("stem", F.when(F.col("i") & F.col("j"), "both").when(F.col("i"), "missing_json").otherwise("missing_image").alias("side"))


def label_lines(shapes: DataFrame, classes: DataFrame) -> DataFrame:
    """(stem, lines): class id and normalised points of each valid polygon; ``classes``: label, class_id."""
    flat = F.flatten(F.transform(F.arrays_zip("xs", "ys"), lambda p: F.array(p["xs"], p["ys"])))
    rows = shapes.where("valid").join(classes, "label").withColumn("coords", flat_normal(flat, F.col("width"), F.col("height")))
    line = F.concat_ws(" ", F.col("class_id").cast("string"), F.array_join(F.transform("coords", lambda v: F.format_number(v, 6)), " "))
    return rows.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l")).select("stem", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"))


def coco_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, lines) for every picture of a COCO file, without lines if it has no valid polygon.

    Category ids become class numbers in ascending id order; lists with an odd number or
    fewer than six coordinates are left out.
    """
    doc = spark.read.schema(COCO).option("multiLine", "true").json(path)
    ids = F.array_sort(F.transform("categories", lambda c: c["id"]))
    pictures = doc.select(ids.alias("ids"), F.explode("images").alias("i")).select("ids", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    marks = doc.select(F.explode("annotations").alias("a")).select(F.col("a.id").alias("ann_id"), "a.image_id", "a.category_id", F.posexplode("a.segmentation").alias("n", "coords")).where(flat_valid(F.col("coords")))
    rows = pictures.join(marks, "image_id", "left")
    line = F.concat_ws(" ", (F.array_position("ids", F.col("category_id")) - 1).cast("string"), F.array_join(F.transform(flat_normal(F.col("coords"), F.col("width"), F.col("height")), lambda v: F.format_number(v, 6)), " "))
    rows = rows.withColumn("line", F.when(F.col("ann_id").isNotNull(), line))
    return rows.groupBy("file_name").agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("ann_id", "n", "line")))).alias("l")).select("file_name", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"))


def dataset_yaml(root: str, names: list[str]) -> str:
    """Dataset description with split folders and class names."""
    return "\n".join([f"path: {root}", "train: images/train", "val: images/val", "test: images/test", "names:", *[f"  {i}: {n}" for i, n in enumerate(names)], ""])


def audit(shapes: DataFrame) -> DataFrame:
    """Counts by label and shape kind, with invalid ones and points."""
    return shapes.groupBy("label", "shape_type").agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("n_invalid"), F.sum(F.size("xs")).alias("n_points")).orderBy(F.col("n").desc(), "label")
