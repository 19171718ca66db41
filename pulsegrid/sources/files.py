"""Feature tables, region maps, documents and artefacts."""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.config import FEATURES, META
from pulsegrid.functions.columns import stem

_ROI = ("roi_x1", "roi_y1", "roi_x2", "roi_y2")


def feature_schema(features: Sequence[str] = FEATURES, meta: Sequence[str] = META, extra: bool = False) -> T.StructType:
    kinds = {"file": T.StringType(), **{c: T.IntegerType() for c in _ROI}}
    names = [*meta, *features, *["_extra"] * extra]
    return T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in names])


def read_features(spark: SparkSession, path: str, extra: bool = False, features: Sequence[str] = FEATURES, meta: Sequence[str] = META) -> DataFrame:
    """A feature CSV; every feature is DOUBLE, whatever its values look like. extra: its header ends in an unnamed column, which is left out."""
    df = spark.read.schema(feature_schema(features, meta, extra)).option("header", True).option("enforceSchema", True).csv(path)
    return df.drop("_extra")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_optional(spark: SparkSession, path: str, **how: object) -> DataFrame | None:
    return read_features(spark, path, **how) if exists(spark, path) else None


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {name.jpg: [x, y, w, h]} as key (the name without extension), roi_x1, roi_y1, roi_x2, roi_y2."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<int>>")).alias("file", "box"))
    box = F.col("box")
    return pairs.select(stem(F.col("file")).alias("key"), box[0].alias("roi_x1"), box[1].alias("roi_y1"), (box[0] + box[2]).alias("roi_x2"), (box[1] + box[3]).alias("roi_y2"))


def list_clips(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    """Files of a folder in order of their paths, without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length").orderBy("path")


def read_clips(spark: SparkSession, folder: str, pattern: str = "*.y4m") -> DataFrame:
    """Uncompressed YUV4MPEG2 clips as file, fps, h, w, pixels (the luma planes, gray frames after each other). A file is a row; what is no such clip has no frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                fps, h, w, pixels = parse_y4m(content.as_py())
                name = urllib.parse.unquote(path.rpartition("/")[2])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([fps]), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([pixels], pa.binary())], ["file", "fps", "h", "w", "pixels"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(run, "file string, fps double, h int, w int, pixels binary")


#: Bytes of a frame's two colour planes as parts of its luma plane.
_CHROMA = {"420": 0.5, "422": 1.0, "444": 2.0, "mono": 0.0}


def parse_y4m(data: bytes) -> tuple[float, int, int, bytes]:
    """Frames a second, height, width and luma planes; a frame that is cut off is left out."""
    head, _, rest = data.partition(b"\n")
    fields = head.decode("latin-1").split(" ")
    if fields[0] != "YUV4MPEG2":
        return 0.0, 1, 1, b""
    named = {f[0]: f[1:] for f in fields[1:] if f}
    w, h = int(named["W"]), int(named["H"])
    over, _, under = named.get("F", "0:1").partition(":")
    chroma = next((v for k, v in _CHROMA.items() if named.get("C", "420").startswith(k)), 0.5)
    halves = ((w + 1) // 2) * (((h + 1) // 2) if chroma == 0.5 else h) * 2
    more = halves if chroma in (0.5, 1.0) else int(chroma * w * h)
    out, at = [], 0
    while rest.startswith(b"FRAME", at) and (begin := rest.find(b"\n", at) + 1) and begin + w * h + more <= len(rest):
        out.append(rest[begin : begin + w * h])
        at = begin + w * h + more
    return int(over) / max(int(under or 1), 1), h, w, b"".join(out)


def append_log(df: DataFrame, path: str, digits: int = 3) -> None:
    """Appends rows to a CSV log; every part has its header, and numbers are rounded as a log shows them."""
    df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]).write.option("header", True).mode("append").csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def save_artefact(spark: SparkSession, path: str, name: str, content: dict) -> None:
    """A model's parameters (a few numbers for each feature) as a row of JSON."""
    spark.createDataFrame([(name, json.dumps(content))], "name string, content string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_artefact(spark: SparkSession, path: str, name: str) -> dict | None:
    """None if there is no such artefact: callers go on without that model."""
    if not exists(spark, f"{path}/{name}"):
        return None
    return json.loads(spark.read.parquet(f"{path}/{name}").first()["content"])


def with_regions(clips: DataFrame, regions: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Clips with their region, and those that have none. Left to Catalyst, which broadcasts the regions if they are small."""
    return clips.join(regions, key), clips.join(regions, key, "left_anti")
