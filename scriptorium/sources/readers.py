"""Reading texts, lexicons, page segmentations, page XML, images and tokenizer files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from scriptorium.functions.imaging import gray

IMAGES, EVALUATED = r"(?i)\.(jpe?g|png|tiff?)$", r"(?i)\.(jpe?g|png|bmp)$"

POINTS = "array<array<double>>"
SEGMENTS = (
    "type string, imagename string, text_direction string, script_detection boolean, "
    f"lines array<struct<id:string,baseline:{POINTS},boundary:{POINTS},text:string,base_dir:string,type:string,imagename:string,tags:map<string,string>,split:string,regions:array<string>>>, "
    f"regions map<string,array<struct<id:string,boundary:{POINTS},imagename:string,tags:map<string,string>>>>"
)
TRACKING = "folder string, stem string, density double, size long, height int, width int, reasons string, was_removed boolean"


def _name() -> Column:
    return F.col("_metadata.file_name")


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def text_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(name, stem, text) of the .txt files of a folder, whole files."""
    rows = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    return rows.select(_name().alias("name"), _stem(_name()).alias("stem"), F.col("value").alias("text"))


def packed_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, stem, text) of all files of a pack, as :func:`sinks.write_pack` writes it. Unlike a folder's, empty ones have a row."""
    rows = spark.read.schema("name string, content binary").parquet(path)
    return rows.select("name", _stem(F.col("name")).alias("stem"), F.col("content").cast("string").alias("text"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(stem, line_no, text) of the lines of all .txt files; line ends are no part of them."""
    return lines_of(text_files(spark, path))


def lines_of(files: DataFrame) -> DataFrame:
    """(stem, line_no, text) of the lines of files (stem, text)."""
    return files.select("stem", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("line_no", "text"))


def whole_folder(spark: SparkSession, path: str) -> DataFrame:
    """One row, text: the files of a folder joined in the order of their names; null where they are empty. One task reads them one after the other into
    one piece of memory; the text is a single value, so that 2 GB of it are the most there can be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        files = sorted((f for f in where.get_file_info(fs.FileSelector(root)) if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)
        for _ in batches:
            whole, at = pa.allocate_buffer(sum(f.size for f in files)), 0
            into = memoryview(whole).cast("B")
            for f in files:
                with where.open_input_stream(f.path) as x:
                    while part := x.read(1 << 20):
                        into[at : at + len(part)] = part
                        at += len(part)
            if at >= 1 << 31:
                raise ValueError(f"{path} has {at} bytes: more than one value holds")
            text = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, at], dtype=np.int32)), whole) if at else pa.nulls(1, pa.string())
            yield pa.RecordBatch.from_arrays([text], ["text"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "text string")


def lexicon_file(spark: SparkSession, path: str) -> DataFrame:
    """(position, headword, variants) of a JSON object, in the file's order; null variants stay null. A lexicon is one document."""
    v = F.from_json("value", "map<string,array<string>>")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(v)).alias("position", "e"))
    return rows.select(F.col("position").cast("long").alias("position"), F.col("e.key").alias("headword"), F.col("e.value").alias("variants"))


def segmentations(spark: SparkSession, path: str) -> DataFrame:
    """Page segmentations (JSON, one page a file) with the file's stem; files without lines have an empty list."""
    rows = spark.read.schema(SEGMENTS).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("lines", F.coalesce("lines", F.array().cast(rows.schema["lines"].dataType))).withColumn("stem", _stem(_name()))


def tracking_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows that the tracking sink wrote, reasons as an array again."""
    rows = spark.read.schema(TRACKING).option("header", True).csv(path)
    return rows.withColumn("reasons", F.filter(F.split("reasons", r"\|"), lambda x: x != ""))


def page_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(stem, page_width, page_height, pos, id, x1, y1, x2, y2, points) of all text blocks of page XML files, with or without a name space;
    pos is the block's place in its page. Pages without blocks have no row: see :func:`annotated_pages`."""
    rows = spark.read.format("xml").option("rowTag", "Page").option("pathGlobFilter", "*.xml").option("ignoreNamespace", True).schema(_PAGE).load(path)
    return _blocks(rows.withColumn("stem", _stem(_name())))


_BLOCKS = S.ArrayType(S.StructType([*(S.StructField(f"_{c}", S.DoubleType()) for c in ("HPOS", "VPOS", "WIDTH", "HEIGHT")), S.StructField("_ID", S.StringType()), S.StructField("Shape", S.StructType([S.StructField("Polygon", S.StructType([S.StructField("_POINTS", S.StringType())]))]))]))
_PAGE = S.StructType([S.StructField("_WIDTH", S.DoubleType()), S.StructField("_HEIGHT", S.DoubleType()), S.StructField("PrintSpace", S.StructType([S.StructField("TextBlock", _BLOCKS)])), S.StructField("TextBlock", _BLOCKS)])
_ALTO = S.StructType([S.StructField("Layout", S.StructType([S.StructField("Page", S.ArrayType(_PAGE))]))])


def _blocks(pages: DataFrame) -> DataFrame:
    some = F.concat(F.coalesce("PrintSpace.TextBlock", F.array().cast(_BLOCKS)), F.coalesce("TextBlock", F.array().cast(_BLOCKS)))
    each = pages.select("stem", F.coalesce("_WIDTH", F.lit(1.0)).alias("page_width"), F.coalesce("_HEIGHT", F.lit(1.0)).alias("page_height"), F.posexplode(some).alias("pos", "b"))
    x, y = F.col("b._HPOS"), F.col("b._VPOS")
    return each.select("stem", "page_width", "page_height", F.col("pos").cast("long").alias("pos"), F.col("b._ID").alias("id"), x.alias("x1"), y.alias("y1"), (x + F.col("b._WIDTH")).alias("x2"), (y + F.col("b._HEIGHT")).alias("y2"), F.col("b.Shape.Polygon._POINTS").alias("points"))


def blocks_of(files: DataFrame) -> DataFrame:
    """:func:`page_blocks` of page XML files (stem, text) that are rows."""
    found = F.from_xml("text", _ALTO, {"ignoreNamespace": "true"})
    return _blocks(files.select("stem", F.explode(found["Layout"]["Page"]).alias("p")).select("stem", "p.*"))


def annotated_pages(spark: SparkSession, path: str) -> DataFrame:
    """(image): the stems of all page XML files, also of those without any block. No content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path).select(_stem(F.element_at(F.split("path", "/"), -1)).alias("image"))


def image_files(spark: SparkSession, path: str, names: str = IMAGES, recursive: bool = True) -> DataFrame:
    """(folder, stem, path, length, content) of image files by their suffix. Images right under ``path`` have the folder "root" and are
    left out where there are subfolders with images."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).filter(F.col("path").rlike(names))
    inner = F.regexp_replace("path", r"^file:/+", "/")
    base = path.removeprefix("file://").rstrip("/")
    rel = F.substring(inner, F.lit(len(base) + 2), F.length(inner))
    parts = F.split(rel, "/")
    out = rows.select(F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit("root")).alias("folder"), _stem(F.element_at(parts, -1)).alias("stem"), "path", "length", "content")
    nested = out.filter("folder <> 'root'").limit(1).count() > 0
    return out.filter("folder <> 'root'") if nested else out


def gray_images(spark: SparkSession, path: str) -> DataFrame:
    """(folder, stem, height, width, pixels) of images that Spark's own decoder reads; colours become gray."""
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(path)

    @F.arrow_udf("binary")
    def flat(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in parts:
            out = []
            for d, a, b, c in zip(*(x.to_pylist() for x in columns), strict=True):
                x = np.frombuffer(d, dtype=np.uint8).reshape(a, b, c)
                out.append(x.tobytes() if c == 1 else gray(x[..., 2::-1]).tobytes())
            yield pa.array(out, pa.binary())

    i = F.col("image")
    parts = F.split(i["origin"], "/")
    return rows.select(F.element_at(parts, -2).alias("folder"), _stem(F.element_at(parts, -1)).alias("stem"), i["height"].alias("height"), i["width"].alias("width"), flat(i["data"], i["height"], i["width"], i["nChannels"]).alias("pixels"))


def tokenizer_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of tokenizer JSON files."""
    return spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(_stem(_name()).alias("name"), "value")
