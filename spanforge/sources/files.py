"""Readers of the event files: explicit schemas, casts that don't fail, rejects kept beside the rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spans import problem
from ..functions.taxonomy import CLASSES, NORMAL
from ..functions.text import stem

MANIFEST = "schema_version string, videos array<struct<video_id:string,level:int,domain:string,duration_sec:double>>"
EVENT = "struct<class_name:string,start:double,end:double,start_time_sec:double,end_time_sec:double,confidence:double,explanation:string,window:array<double>>"
RUNTIME = "struct<frames_processed:bigint,chunks_processed:bigint,end_to_end_internal_time_ms:double,model_runtimes:array<struct<model_name:string,call_count:bigint,total_time_ms:double,average_time_ms:double,p50_time_ms:double,p95_time_ms:double,max_time_ms:double>>>"
EVENTS = f"video_id string, duration double, level int, events array<{EVENT}>, runtime {RUNTIME}, failed string"
WINDOWS = f"video_id string, duration double, level int, windows array<{EVENT}>, empty_window_raw array<struct<window:array<double>,raw:string>>, runtime {RUNTIME}, failed string"
SUBMISSION = f"schema_version string, submission_id string, model_name string, predictions array<struct<video_id:string,events:array<{EVENT}>,runtime_metadata:{RUNTIME}>>"
FEATURES = "video_id string, level int, duration double, width int, height int, series array<struct<t:int,residual:double,outlier_frac:double,spread:double,blobs:double,ego:double,n:int>>, failed string"


def number(c: str) -> Column:
    """A cell as a double: blank is NULL, and so is what is no number."""
    return F.expr(f"try_cast(nullif(trim({c}), '') AS double)")


def garbled(c: str) -> Column:
    return (F.coalesce(F.trim(c), F.lit("")) != "") & number(c).isNull()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """video_id, level, duration, manifest_ord; of a repeated id the last entry counts."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("videos").alias("manifest_ord", "v")).select("manifest_ord", "v.video_id", "v.level", F.col("v.duration_sec").alias("duration"))
    last = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("manifest_ord")))
    return rows.withColumn("_k", last).where("_k = 1").drop("_k")


def truth_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every row of truth CSVs with its reason for rejection, if any; with or without a level column, which is not read."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    t0, t1 = number("start_time_sec"), number("end_time_sec")
    name = F.trim("class_name")
    why = F.when(garbled("start_time_sec") | garbled("end_time_sec"), "not a number").when(name != NORMAL, problem(name, t0, t1, CLASSES))
    return raw.select(F.trim("video_id").alias("video_id"), name.alias("class_name"), t0.alias("t0"), t1.alias("t1"), why.alias("reason"), F.col("_metadata.file_path").alias("file"))


def truth(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, videos, rejects). A normal row makes a video without events. strict: a reject fails the read."""
    rows = truth_rows(spark, path)
    rejects = rows.where("reason IS NOT NULL")
    if strict:
        rows = rows.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.col("video_id"), F.lit(": "), F.col("reason"))).cast("string")))
    good = rows.where("reason IS NULL")
    return good.where(F.col("class_name") != NORMAL).select("video_id", "class_name", "t0", "t1"), good.select("video_id").distinct(), rejects


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """line, file, n of text files, blank lines left out; n orders the lines of a file."""
    df = spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    return df.where(F.trim("line") != "")


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of JSON-lines files; of a video that comes again, the last line of the last path that has it stays and the others are a problem."""
    order = [paths] if isinstance(paths, str) else list(paths)
    df = lines(spark, paths).withColumn("r", F.from_json("line", schema)).withColumn("ok", F.try_parse_json("line").isNotNull())
    given = F.lit(0)
    for i, p in enumerate(order[1:], 1):
        given = F.when(F.col("file").endswith(p.rsplit(":", 1)[-1].rstrip("/")), i).otherwise(given)
    w = Window.partitionBy("r.video_id").orderBy(given.desc(), F.desc("file"), F.desc("n"))
    df = df.withColumn("k", F.when(F.col("ok") & F.col("r.video_id").isNotNull(), F.row_number().over(w)))
    why = F.when(~F.col("ok"), "not JSON").when(F.col("r.video_id").isNull(), "no video_id").when(F.col("k") > 1, "already seen, keeping the last")
    return df.where("k = 1").select("r.*"), df.select("file", "n", why.alias("problem")).where("problem IS NOT NULL")


def exploded(rows: DataFrame, column: str = "events") -> DataFrame:
    """One row per event of events or windows files: video_id, ord, class_name, t0, t1, confidence, explanation; failed videos are left out."""
    e = rows.where("failed IS NULL") if "failed" in rows.columns else rows
    e = e.select("video_id", F.posexplode(column).alias("ord", "e"))
    return e.select("video_id", "ord", "e.class_name", F.coalesce("e.start", "e.start_time_sec").alias("t0"), F.coalesce("e.end", "e.end_time_sec").alias("t1"), "e.confidence", "e.explanation")


def submission(spark: SparkSession, path: str) -> DataFrame:
    """Events of a submission document."""
    raw = spark.read.schema(SUBMISSION).option("multiLine", True).json(path)
    return exploded(raw.select(F.explode("predictions").alias("p")).select("p.video_id", "p.events"))


def by_class_folder(spark: SparkSession, root: str) -> DataFrame:
    """Truth of class folders; the label is the row's class, the folder only a column to audit."""
    return truth_rows(spark, f"{root}/*/ground_truth.csv").withColumn("folder", F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1))


def impure(rows: DataFrame) -> DataFrame:
    """Folders with labels other than their own or normal."""
    t = rows.groupBy("folder").agg(F.collect_set("class_name").alias("found"))
    return t.select("folder", F.array_sort(F.array_except("found", F.array("folder", F.lit(NORMAL)))).alias("others")).where("size(others) > 0")


def durations(spark: SparkSession, path: str) -> DataFrame:
    """video_id, duration of a TSV with a header, whatever the order of its columns; rows without a number are left out. A missing file, or one without the two columns, gives no rows."""
    none = spark.createDataFrame([], "video_id string, duration double")
    try:
        raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return none
    if not {"video_id", "duration"} <= set(raw.columns):
        return none
    return raw.select(F.trim("video_id").alias("video_id"), number("duration").alias("duration")).where("duration IS NOT NULL")


def features(spark: SparkSession, path: str) -> DataFrame:
    """video_id, t, residual ... of per-second series, failed videos left out."""
    rows = spark.read.schema(FEATURES).json(path).where("failed IS NULL")
    return rows.select("video_id", "level", F.explode("series").alias("s")).select("video_id", "level", "s.*")


def listing(spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
    """video_id, path, level (1 if unknown), duration of the .mp4 files of a folder, from the manifest's rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").load(folder).select("path", stem("path").alias("video_id"))
    return files.join(known.select("video_id", "level", "duration"), "video_id", "left").withColumn("level", F.coalesce("level", F.lit(1)))
