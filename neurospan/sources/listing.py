"""File listings as tables: entities from names, format priority, runs, and scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Legacy task names as (pattern, task group, run group); the first that matches wins.
LEGACY_TASKS = (
    r"(?i)^(saiit)2afcblock(\d+)$",
    r"(?i)^(surrsupp)blockblock(\d+)$",
    r"(?i)^(.+)block(\d+)$",
    r"(?i)^(.+)run(\d+)$",
)
#: Raw formats, most wanted first.
FORMATS = ("fif", "vhdr", "edf", "bdf", "set", "cnt", "cdt")

#: Parts of a behavioural file's name and the paradigm it belongs to, the first that fits wins.
PARADIGMS = (
    ("SAIIT_2AFC", "SAIIT_2AFC"),
    ("SurroundSupp", "SurrSupp_Block"),
    ("SurrSupp", "SurrSupp_Block"),
    ("vis_learn", "vis_learn"),
    ("WISC_ProcSpeed", "WISC_ProcSpeed"),
    ("Video", "Video"),
)
#: What names a block, in the order of search.
BLOCKS = ("_Block1", "_Block2", "_Block3", "_Block4", "1", "2", "3", "4")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size and time of files below a folder; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.col("length").alias("size"), "modificationTime")


def _entity(name: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(name, rf"{key}-([a-zA-Z0-9]+)", 1), F.lit(""))


def parse_names(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds subject, session, task, run, suffix, extension; rows without subject or task fall out."""
    file = F.element_at(F.split(path, "/"), -1)
    has_ext = F.contains(file, F.lit("."))
    name = F.when(has_ext, F.regexp_extract(file, r"^(.*)\.[^.]*$", 1)).otherwise(file)
    out = df.withColumns({
        "subject": _entity(name, "sub"), "session": _entity(name, "ses"), "task": _entity(name, "task"), "run": _entity(name, "run"),
        "suffix": F.element_at(F.split(name, "_"), -1),
        "extension": F.when(has_ext, F.concat(F.lit("."), F.element_at(F.split(file, r"\."), -1))).otherwise(""),
    })
    return out.filter("subject is not null and task is not null")


def legacy_task(name: Column) -> tuple[Column, Column]:
    """Task and two-digit run of a legacy name; run 01 where no pattern matches."""
    task, run = name, F.lit("01")
    for pattern in reversed(LEGACY_TASKS):
        hit = F.rlike(name, F.lit(pattern))
        number = F.regexp_extract(name, pattern, 2)
        padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
        task, run = F.when(hit, F.regexp_extract(name, pattern, 1)).otherwise(task), F.when(hit, padded).otherwise(run)
    return task, run


def best_format(files: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's files those of the first format that has any."""
    order = F.array_position(F.array(*map(F.lit, FORMATS)), F.lower(F.ltrim("extension", F.lit("."))))
    ranked = files.withColumn("_p", order).filter("_p > 0")
    best = F.min("_p").over(W.partitionBy(*keys))
    return ranked.withColumn("_best", best).filter("_p = _best").drop("_p", "_best")


def runs_by_task(files: DataFrame, default: str = "01") -> DataFrame:
    """subject, session, task with the number and the sorted list of distinct runs."""
    run = F.coalesce("run", F.lit(default))
    return files.groupBy("subject", "session", "task").agg(F.count_distinct(run).alias("n_runs"), F.sort_array(F.collect_set(run)).alias("runs"))


def subject_task_matrix(runs: DataFrame, tasks: list[str]) -> DataFrame:
    """Runs by subject and task, 0 where there are none; a later session overwrites an earlier one."""
    return runs.groupBy("subject").pivot("task", tasks).agg(F.max_by("n_runs", F.coalesce("session", F.lit("")))).na.fill(0)


def dataset_info(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("n_files"), F.count_distinct("subject").alias("n_subjects"), F.count_distinct("session").alias("n_sessions"), F.count_distinct("task").alias("n_tasks"),
        F.sort_array(F.collect_set("task")).alias("tasks"),
    )


def find_files(files: DataFrame, **wanted: str | None) -> DataFrame:
    """Files that agree with the entities given, in the order of subject, session, task and run."""
    for key, value in wanted.items():
        if value is not None:
            files = files.filter(F.col(key) == value)
    return files.orderBy("subject", F.coalesce("session", F.lit("")), "task", F.coalesce("run", F.lit("")))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated events with a header; n/a is missing."""
    return spark.read.csv(path, sep="\t", header=True, nullValue="n/a")


def read_phenotype(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """First column is the subject id, with the prefix sub- added where it lacks."""
    df = spark.read.csv(path, sep=sep, header=True)
    key = df.columns[0]
    return df.withColumn(key, F.when(F.startswith(key, F.lit("sub-")), F.col(key)).otherwise(F.concat(F.lit("sub-"), key)))


def read_records(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """JSON records in the files below a folder that fit pattern, with their path; malformed files are skipped."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    if "_corrupt_record" in df.columns:
        df = df.filter("_corrupt_record is null").drop("_corrupt_record")
    return df.withColumn("_json_path", F.col("_metadata.file_path"))


def read_quality_json(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The state of every run below a folder."""
    return read_records(spark, path, "processing_state.json")


def read_csv_signal(spark: SparkSession, path: str) -> DataFrame:
    """file, sample_idx, channel, value of signals with a column for each channel and a row for each sample.

    Rows are numbered inside their file, in the order of its blocks.
    """
    df = spark.read.csv(path, header=True, inferSchema=True)
    names = df.columns
    rows = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("sample_idx", F.row_number().over(W.partitionBy("file").orderBy("_block", "_row")) - 1)
    channels = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"`{c}`").cast("double").alias("value")) for c in names]))
    return rows.select("file", "sample_idx", channels.alias("_x")).select("file", "sample_idx", "_x.channel", "_x.value")


def read_csv_events(spark: SparkSession, path: str) -> DataFrame:
    """file (that of the signal beside it), sample, type of event files with the columns latency and type."""
    df = spark.read.csv(path, header=True)
    return df.select(F.regexp_replace("_metadata.file_path", "_event[.]csv$", "_data.csv").alias("file"), F.col("latency").cast("double").cast("long").alias("sample"), F.col("type").cast("long").alias("type"))


def behaviour_files(files: DataFrame, subject: str = "subject") -> DataFrame:
    """Adds paradigm and block of behavioural files by parts of their names; others fall out.

    The subject's id is cut off the name first. block is null where nothing names one.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    name = F.replace(stem, F.concat(F.col(subject), F.lit("_")), F.lit(""))
    paradigm, block = F.lit(None).cast("string"), F.lit(None).cast("string")
    for part, of in reversed(PARADIGMS):
        paradigm = F.when(F.contains(name, F.lit(part)), F.lit(of)).otherwise(paradigm)
    for part in reversed(BLOCKS):
        block = F.when(F.contains(name, F.lit(part)), F.lit(part.strip("_"))).otherwise(block)
    return files.withColumn("paradigm", paradigm).withColumn("block", block).filter("paradigm is not null")


def report_files(files: DataFrame) -> DataFrame:
    """Quality reports (*_qc.html) with subject, task, run, pipeline and type from their paths."""
    parts = F.split("path", "/")
    file = F.element_at(parts, -1)
    of = lambda key, last: F.try_element_at(F.filter(parts, lambda x: F.startswith(x, F.lit(key))), F.lit(-1 if last else 1))
    entity = lambda key, last=True: F.substring(of(key, last), len(key) + 1, 1 << 20)
    at = F.array_position(parts, "derivatives")
    variant = F.get(parts, at + 1)
    pipeline = F.when((at > 0) & variant.isNotNull() & ~F.startswith(variant, F.lit("sub-")), F.concat_ws("/", F.get(parts, at), variant))
    kind = F.when(F.contains(file, F.lit("preprocessed_qc")), "Preprocessed").when(F.contains(file, F.lit("combined_qc")), "Combined").when(F.contains(file, F.lit("raw_qc")), "Raw Data").otherwise("Other")
    return files.filter(F.endswith(file, F.lit("_qc.html"))).select(
        "*", F.coalesce(entity("sub-", False), F.lit("Unknown")).alias("subject"), F.coalesce(entity("task-"), F.lit("Unknown")).alias("task"), F.coalesce(entity("run-"), F.lit("N/A")).alias("run"),
        F.coalesce(pipeline, F.lit("Unknown")).alias("pipeline"), kind.alias("type"))


#: Fixed value: the name of a quality record.
QUALITY_NAME = r"^(.+)_ses-([0-9]+)_task-([^_]+)_run-([0-9]+)_qc_metrics\.json$"


def quality_names(files: DataFrame) -> DataFrame:
    """Adds subject, session, task and run of quality records by their names; others fall out."""
    file = F.element_at(F.split("path", "/"), -1)
    return files.filter(F.rlike(file, F.lit(QUALITY_NAME))).withColumns({name: F.regexp_extract(file, QUALITY_NAME, i + 1) for i, name in enumerate(("subject", "session", "task", "run"))})


def read_texts(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """path and content of the text files below a folder that fit pattern, each file whole, malformed or not."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def newest(reports: DataFrame, by: list[str], time: str = "modificationTime") -> DataFrame:
    """Adds place: 1 for the newest report of each value of by; of equal times the path that comes first."""
    return reports.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc_nulls_last(time), "path")))


#: What names of recordings begin with, by paradigm, the most wanted first.
RECORDED = {
    "SurrSupp_Block": ("SurrSupp_Block", "SurroundSupp", "SurrSupp"),
    "SAIIT_2AFC": ("SAIIT_2AFC", "SAIIT"),
    "Video": ("Video",),
    "RestingState": ("RestingState", "Resting"),
    "vis_learn": ("vis_learn", "VisLearn", "vislearn"),
    "WISC_ProcSpeed": ("WISC_ProcSpeed", "WISC"),
}
#: Below a subject's folder, where recordings of a format lie and how their names end.
SOURCES = {"mat": (r"/EEG/raw/mat_format/([^/]*)\.mat$", ""), "csv": (r"/EEG/raw/csv_format/([^/]*)_data\.csv$", "_data")}


def source_subjects(files: DataFrame) -> DataFrame:
    """subject of every folder NDAR* that has recordings, each once."""
    return files.select(F.nullif(F.regexp_extract("path", r"/(NDAR[^/]*)/EEG/raw/", 1), F.lit("")).alias("subject")).dropna().distinct()


def paradigm_files(files: DataFrame, prefer: str = "mat") -> DataFrame:
    """subject, paradigm, path, format, variant of recordings as they were delivered, one format for each subject and paradigm.

    files: path. A name belongs to a paradigm where it begins with one of its beginnings; the first of those
    that fits gives the variant: itself for the bare name, else itself and what follows. A subject has the preferred
    format where there is any file of it, else the other one. Of CSV files of one variant the first by path counts.
    """
    name, kind, tail = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("")
    for format_, (pattern, ending) in SOURCES.items():
        hit = F.rlike("path", F.lit(pattern))
        name, kind, tail = F.when(hit, F.regexp_extract("path", pattern, 1)).otherwise(name), F.when(hit, format_).otherwise(kind), F.when(hit, ending).otherwise(tail)
    rows = files.select("path", F.regexp_extract("path", r"/(NDAR[^/]*)/EEG/raw/", 1).alias("subject"), name.alias("_name"), kind.alias("format"), tail.alias("_tail")).filter("format IS NOT NULL AND subject <> ''")
    choice = [F.struct(F.lit(p).alias("paradigm"), F.get(F.filter(F.array(*map(F.lit, starts)), lambda s: F.startswith(F.col("_name"), s)), F.lit(0)).alias("start")) for p, starts in RECORDED.items()]
    rows = rows.select("*", F.inline(F.filter(F.array(*choice), lambda x: x["start"].isNotNull())))
    rest = F.btrim(F.replace(F.concat("_name", "_tail"), F.col("start"), F.lit("")), F.lit("_-"))
    variant = F.when((F.col("_name") == F.col("start")) | (rest == ""), F.col("start")).otherwise(F.concat("start", F.lit("_"), rest))
    rows = rows.withColumn("variant", variant)
    has = F.bool_or(F.col("format") == prefer).over(W.partitionBy("subject", "paradigm"))
    first = F.row_number().over(W.partitionBy("subject", "paradigm", "format", "variant").orderBy("path"))
    kept = rows.withColumn("_has", has).withColumn("_first", first).filter((F.col("format") == prefer) | ~F.col("_has"))
    return kept.filter("format <> 'csv' OR _first = 1").select("subject", "paradigm", "path", "format", "variant")
