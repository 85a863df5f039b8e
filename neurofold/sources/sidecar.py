"""Acquisition sidecar files as expressions over their text, and batch lists."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingFile(FileNotFoundError):
    """A required sidecar is not there."""


class BadFormat(ValueError):
    """A sidecar does not hold what it must."""


class AmbiguousMode(UserWarning):
    """One stack file, but an anatomy of several pages: the dataset is taken as volumetric."""


class NoMotionWarning(UserWarning):
    """Motion filtering is asked for, but motion was not estimated."""


class MissingDirectoryWarning(UserWarning):
    """A directory of a batch list is not there."""


def frame_rate(text: Column) -> list[Column]:
    """Stack rate and volume count: the first and third number; null where there are fewer."""
    numbers = F.filter(F.split(F.trim(text), r"[\s,]+"), lambda w: w != "")
    value = lambda k: F.get(numbers, k).cast("double")
    return [value(0).alias("frame_rate"), value(2).cast("long").alias("n_volumes")]


def xml_dimensions(text: Column) -> list[Column]:
    """h, w, z of dimensions="HxWxZ"."""
    part = lambda k: F.regexp_extract(text, r'dimensions="(\d+)x(\d+)x(\d+)"', k)
    return [F.when(part(k) != "", part(k).cast("long")).alias(n) for k, n in ((1, "h"), (2, "w"), (3, "z"))]


def z_step(text: Column) -> Column:
    """Plane distance in micrometres; null unless positive."""
    found = F.regexp_extract(text, r'<info\s+z_step="([^"]+)"', 1)
    value = found.try_cast("double")
    return F.when(value > 0, value).alias("z_step_um")


def frame_range(text: Column, total: Column) -> list[Column]:
    """First and last frame (1-based) of minframe= and maxframe= (0-based); the whole recording where they are missing."""
    value = lambda name: F.regexp_extract(text, rf"{name}\s*=\s*(\d+)", 1)
    one = lambda name, other: F.when(value(name) != "", value(name).cast("long") + 1).otherwise(other.cast("long"))
    return [one("minframe", F.lit(1)).alias("frame_start"), one("maxframe", total).alias("frame_end")]


def read_text(spark: SparkSession, path: str, required: bool = True) -> str | None:
    """One small sidecar's text by Spark's reader, whatever store it is in."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect() if _exists(spark, path) else []
    if not rows:
        if required:
            raise MissingFile(path)
        return None
    return bytes(rows[0]["content"]).decode("latin-1")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def files(spark: SparkSession, directory: str, include: str = ".*", exclude: str = "$^", indices: list[int] | None = None) -> DataFrame:
    """(path, name, length, k): files of a directory in name order, by patterns without regard to case, optionally by position."""
    from pyspark.sql import Window

    name = F.element_at(F.split("path", "/"), -1)
    found = spark.read.format("binaryFile").load(directory).select("path", "length").withColumn("name", name)
    found = found.where(F.col("name").rlike(f"(?i){include}") & ~F.col("name").rlike(f"(?i){exclude}"))
    found = found.withColumn("k", F.row_number().over(Window.orderBy("name")))
    return found.where(F.col("k").isin(indices)) if indices else found


def leica_order(name: Column) -> Column:
    """Sort key of names with _tNNN_ch: three digits are padded to four."""
    return F.regexp_replace(name, r"_t(\d{3})_ch", "_t0$1_ch")


def leica_name(name: str) -> str:
    """``leica_order`` of one name, for planning on the driver."""
    return re.sub(r"_t(\d{3})_ch", r"_t0\1_ch", name)


def join_path(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("/", *(F.regexp_replace(p, "/+$", "") for p in parts)), "/+$", "")


def agreed_threshold() -> Column:
    """Over mask file names (name): the brightness threshold that they agree on; null if they name none or several."""
    value = F.regexp_extract("name", r"^cellmask_(\d+(?:\.\d+)?)(?:_\d+(?:\.\d+)?_\d+(?:\.\d+)?)?\.tif$", 1)
    found = F.when(value != "", value.cast("double"))
    return F.when(F.min(found) == F.max(found), F.min(found))


def infer_threshold(names: DataFrame) -> DataFrame:
    """``agreed_threshold`` of all names."""
    return names.agg(agreed_threshold().alias("threshold"))


def is_single_plane(names: DataFrame, pages: int) -> DataFrame:
    """(stacks, single_plane, ambiguous): one stack file and a one-page anatomy make a single plane; one stack with more pages is odd."""
    stacks = F.count_if(F.col("name").rlike(r"^Plane\d+\.stack$"))
    return names.agg(stacks.alias("stacks"), ((stacks == 1) & F.lit(pages == 1)).alias("single_plane"), ((stacks == 1) & F.lit(pages > 1)).alias("ambiguous"))


def batch_list(spark: SparkSession, path: str) -> DataFrame:
    """Directories of a batch file, in order: trimmed, without blanks and # comments."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("directory"), F.monotonically_increasing_id().alias("k"))
    return rows.where((F.col("directory") != "") & ~F.col("directory").startswith("#")).orderBy("k").select("directory")


def camera_xml(spark: SparkSession, directory: str, names: DataFrame) -> str | None:
    """Text of ch0_cam1.xml, or else of the first ch0_cam*.xml by name."""
    found = [r["name"] for r in names.where(F.col("name").rlike(r"^ch0_cam.*\.xml$")).orderBy("name").limit(1).collect()]
    chosen = "ch0_cam1.xml" if _exists(spark, f"{directory}/ch0_cam1.xml") else (found or ["ch0_cam1.xml"])[0]
    return read_text(spark, f"{directory}/{chosen}", required=False)


def acquisition(spark: SparkSession, directory: str, pages: int) -> dict:
    """All acquisition metadata of a dataset directory: rates, sizes, mode, plane distance, frame range."""
    import struct

    d = directory.rstrip("/")
    text = read_text(spark, f"{d}/Stack_frequency.txt")
    names = files(spark, d).select("name")
    xml = camera_xml(spark, d, names)
    rate, volumes = spark.range(1).select(*frame_rate(F.lit(text))).first()
    if rate is None or volumes is None:
        raise BadFormat(f"{d}/Stack_frequency.txt must hold three numbers")
    if _exists(spark, f"{d}/Stack dimensions.log"):
        h, w, z = struct.unpack("<3I", spark.read.format("binaryFile").load(f"{d}/Stack dimensions.log").first()["content"][:12])
    elif xml and _exists(spark, f"{d}/ch0_cam1.xml"):
        h, w, z = spark.range(1).select(*xml_dimensions(F.lit(xml))).first()
    else:
        raise MissingFile(f"{d}/Stack dimensions.log")
    mode = is_single_plane(names, pages).first()
    if mode["ambiguous"]:
        warnings.warn(f"{d}: one plane stack, but an anatomy of {pages} planes; taken as volumetric", AmbiguousMode, stacklevel=2)
    step = spark.range(1).select(z_step(F.lit(xml or ""))).first()[0]
    if step is None and not mode["single_plane"]:
        raise BadFormat(f"{d}: a positive z_step is required")
    extra = read_text(spark, f"{d}/minANDmax.txt", required=False)
    first, last = spark.range(1).select(*frame_range(F.lit(extra or ""), F.lit(volumes))).first()
    single = bool(mode["single_plane"])
    return {"frame_rate": rate * z if single else rate, "n_total_frames": volumes, "stack_height": h, "stack_width": w, "n_zplanes": 1 if single else z, "z_step_um": step, "frame_start": first, "frame_end": last, "is_single_plane": single}
