"""Readers for surveys, votes, GeoJSON, graphs, score maps, results and annotations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

GEOJSON = (
    "type string, features array<struct<geometry:struct<type:string,coordinates:array<double>>,"
    "properties:struct<label_id:bigint,label_type:string,osm_way_id:bigint,pano_id:string,gsv_panorama_id:string,heading:double,pitch:double,severity:double,agree_count:int>>>"
)
AID_FIELDS = "walking_cane:double,walker:double,mobility_scooter:double,manual_wheelchair:double,motorized_wheelchair:double"
EDGE = f"struct<{AID_FIELDS},n_labels:int,label_types:array<string>,source:string,n_images:int,dist:map<string,array<double>>>"
VOTES = "PId string, MobilityAid string, ImageSet int, ImageID bigint, ImageType string, Selection string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, doc): every line that is JSON, as VARIANT; blank and malformed lines are left out.

    ``ordinal`` follows file name and place in the file, so "first" has a meaning.
    """
    lines = spark.read.text(path).select(
        F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("ordinal"), "value"
    )
    return lines.where(F.trim("value") != "").select("ordinal", F.try_parse_json("value").alias("doc")).where("doc is not null")


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """Votes from CSV with a header, with explicit types and our column names."""
    raw = spark.read.schema(VOTES).csv(path, header=True)
    return raw.toDF("pid", "aid", "image_set", "image_id", "image_type", "selection")


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False)


def read_json_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def read_label_geojson(spark: SparkSession, path: str, label_types: list[str] | None = None, need_severity: bool = False) -> DataFrame:
    """Label points of a FeatureCollection; GeoJSON order is longitude, latitude."""
    f = spark.read.schema(GEOJSON).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.geometry.coordinates", "f.properties.*")
    out = f.select(
        "label_id", "label_type", F.col("osm_way_id").alias("way_id"), F.coalesce("pano_id", "gsv_panorama_id").alias("pano_id"), "heading", "pitch", "severity", "agree_count",
        F.get("coordinates", F.lit(1)).alias("lat"), F.get("coordinates", F.lit(0)).alias("lon"),
    )
    if label_types is not None:
        out = out.where(F.col("label_type").isin(label_types))
    return out.where("severity is not null") if need_severity else out


def read_edge_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score maps {"u_v_k": {...}}, alone or under "edges", in long form: u, v, k, aid, p_yes, dist, n_labels, label_types, source."""
    text = spark.read.text(path, wholetext=True).select("value")
    maps = text.select(F.from_json("value", f"struct<edges:map<string,{EDGE}>>")["edges"].alias("nested"), F.from_json("value", f"map<string,{EDGE}>").alias("flat"))
    rows = maps.select(F.explode(F.coalesce("nested", "flat")).alias("key", "e")).where("key rlike '^-?[0-9]+_-?[0-9]+_[0-9]+$'")
    part = F.split("key", "_")
    aids = [x.split(":")[0] for x in AID_FIELDS.split(",")]
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("aid"), F.col(f"e.{a}").alias("p_yes"), F.element_at("e.dist", F.lit(a)).alias("dist")) for a in aids)))
    long = rows.select(part[0].cast("long").alias("u"), part[1].cast("long").alias("v"), part[2].cast("int").alias("k"), each.alias("x"), "e.n_labels", "e.label_types", "e.source")
    return long.select("u", "v", "k", "x.*", "n_labels", "label_types", "source").where("p_yes is not null or dist is not null")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file; edges undirected, each pair and key once."""
    data = "array<struct<_VALUE:string,_key:string>>"
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string, _for string").load(path)
    names = {(r["_for"], r["_attr.name"]): r["_id"] for r in keys.collect()}  # the file's few declarations
    at = lambda kind, name: F.filter("data", lambda d: d["_key"] == F.lit(names.get((kind, name), "")))[0]["_VALUE"]
    node = spark.read.format("xml").option("rowTag", "node").schema(f"_id long, data {data}").load(path)
    nodes = node.select(F.col("_id").alias("node"), at("node", "y").cast("double").alias("lat"), at("node", "x").cast("double").alias("lon"))
    edge = spark.read.format("xml").option("rowTag", "edge").schema(f"_source long, _target long, _id int, data {data}").load(path)
    ways = F.transform(F.regexp_extract_all(F.coalesce(at("edge", "osmid"), F.lit("")), F.lit("([0-9]+)")), lambda x: x.cast("long"))
    edges = edge.select(F.col("_source").alias("u"), F.col("_target").alias("v"), F.coalesce("_id", F.lit(0)).alias("k"), at("edge", "length").cast("double").alias("length"), ways.alias("way_ids"))
    return nodes, undirected(edges)


def undirected(edges: DataFrame) -> DataFrame:
    """Ends in ascending order; of equal (u, v, k) the shortest stays."""
    rest = [c for c in edges.columns if c not in ("u", "v", "k", "length")]
    return edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "k").agg(F.min(F.struct("length", *rest)).alias("e")).select("u", "v", "k", "e.*")


def read_partitioned_results(spark: SparkSession, glob: str, pattern: str, names: list[str], schema: str | None = None) -> DataFrame:
    """JSON results with columns taken from their paths by a regular expression's groups."""
    reader = spark.read.schema(schema) if schema else spark.read
    raw = reader.json(glob, multiLine=True).select("*", F.col("_metadata.file_path").alias("_path"))
    return raw.select("*", *(F.regexp_extract("_path", pattern, i + 1).alias(n) for i, n in enumerate(names))).drop("_path")


def read_submissions(spark: SparkSession, path: str, schema: str, deny: list[str] = ()) -> DataFrame:
    """Submission files of a folder but for the named ones."""
    raw = spark.read.schema(schema).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("_file"))
    return (raw.where(~F.col("_file").isin(list(deny))) if deny else raw).drop("_file")


def read_yolo(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """(file, class, polygon in pixels) of label lines; lines with fewer than seven fields are left out."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.split(F.trim("value"), r"\s+").alias("t")).where(F.size("t") >= 7)
    flat = F.transform(F.slice("t", F.lit(2), F.size("t") - 1), lambda x, i: x.cast("double") * F.when(i % 2 == 0, width).otherwise(height))
    return rows.select("file", F.col("t")[0].cast("int").alias("class"), flat.alias("polygon"))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of an annotation file; each first polygon as a flat array."""
    schema = (
        "images array<struct<id:bigint,file_name:string,width:int,height:int>>,"
        "annotations array<struct<id:bigint,image_id:bigint,category_id:int,segmentation:array<array<double>>,bbox:array<double>,area:double>>"
    )
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return doc.select(F.inline("images")), doc.select(F.inline("annotations")).withColumn("polygon", F.get("segmentation", F.lit(0)))


def read_images(spark: SparkSession, path: str, least_bytes: int = 5000) -> DataFrame:
    """Files that are large enough to be pictures: path, name, content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.where(F.col("length") >= least_bytes).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def match_images(ids: DataFrame, files: DataFrame, id_col: str = "image_id", order: tuple[str, ...] = ("png", "jpg", "jpeg")) -> DataFrame:
    """The first file, by extension then path, whose name holds the id as a whole number between other characters."""
    numbered = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("name", F.lit("([0-9]+)")))).alias("_n"), F.lower(F.element_at(F.split("name", r"\."), -1)).alias("ext"))
    place = F.array_position(F.array(*(F.lit(e) for e in order)), F.col("ext"))
    ranked = numbered.where(place > 0).groupBy("_n").agg(F.min(F.struct(place.alias("rank"), "path"))["path"].alias("path"))
    return ids.join(ranked, F.col(id_col).cast("string") == F.col("_n")).drop("_n")


def lookup_features(items: DataFrame, features: DataFrame, key: str = "key") -> DataFrame:
    """Items with their vectors; an error if any key is missing.  Runs one job."""
    missing = items.join(features.select(key), key, "left_anti").limit(1).count()
    if missing:
        raise KeyError("items without features")
    return items.join(features, key)


def normalised_counts(counts: DataFrame, column: str = "counts") -> DataFrame:
    total = F.aggregate(column, F.lit(0.0), lambda a, x: a + x)
    return counts.withColumn("y", F.transform(column, lambda x: F.try_divide(x.cast("double"), total)))


def zip_responses(rows: DataFrame, responses: DataFrame, group: str, order: str, array: str = "responses") -> DataFrame:
    """Responses by position onto the ordered rows of a group; groups of other length are left out."""
    from pyspark.sql import Window

    numbered = rows.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    each = responses.select(group, F.size(array).alias("_m"), F.posexplode(array).alias("pos", "response"))
    return numbered.join(each, [group, "pos"]).where("_n = _m").drop("_n", "_m")


def featurise(images: DataFrame, encode, dim: int, content: str = "content") -> DataFrame:
    """Vectors of unit length by a user's ``encode(list of bytes) -> array (n, dim)``, a batch at a time."""
    import numpy as np

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def apply(batch: pa.Array) -> pa.Array:
        x = np.asarray(encode(batch.to_pylist()), float).reshape(len(batch), dim)
        return pa.array((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32).tolist(), pa.list_(pa.float32()))

    return images.withColumn("vec", apply(F.col(content)))
