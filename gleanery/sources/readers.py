"""Scans: folders of files, strict and lax line-delimited JSON, manifests, sidecars, suites, histories, configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators.history import ordinals

BAD = "_bad"
#: Names of files that are no data: hidden ones and the marks of Spark's writers.
UNSEEN = r"^(\.|_SUCCESS$|_committed_|_started_|_temporary|_metadata$|_common_metadata$)"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def scan_files(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True, content: bool = False) -> DataFrame:
    """path, name, suffix, length of the files under a folder, without dotfiles and what writers leave; the content only if asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).filter(~F.col("name").rlike(UNSEEN))
    return files.select("path", "name", suffix(F.col("path")).alias("suffix"), "length", *(["content", F.sha2("content", 256).alias("sha256")] if content else []))


def flat_files(spark: SparkSession, folder: str, allowed: Sequence[str]) -> DataFrame:
    """The files of a folder, not of those in it, of an allowed suffix and no name that begins with a line: in order of
    their names, with their place from 0."""
    plain = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(//)?", "")  # noqa: E731  without a scheme
    # Spark takes folders in a folder for partitions, unless it looks into all
    here = F.regexp_replace(plain(F.col("path")), "/[^/]*$", "") == plain(F.lit(folder.rstrip("/")))
    files = scan_files(spark, folder, content=True).filter(here & ~F.col("name").startswith("_") & F.col("suffix").isin([s.lower() for s in allowed]))
    return ordinals(files, [F.col("name")], "place")


def split_by_suffix(files: DataFrame, allowed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Files of an allowed suffix, and issues for the others."""
    good = F.col("suffix").isin([s.lower() for s in allowed])
    bad = files.filter(~good).select(F.lit("warning").alias("severity"), F.lit("unsupported_format").alias("category"), "path", F.col("suffix").alias("message"))
    return files.filter(good), bad


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1) and line of text files, without the line's end.

    Large files are read in splits by many tasks. A line's number is its place in its split and the lines of the file's
    splits before, whose counts are one small table: a row for each split.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), "value")
    # a split's lines lie together in its task, so ids rise by one
    splits = lines.groupBy("path", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_start")) - F.col("_n")
    placed = splits.select("path", "_start", "_first", before.alias("_before"))
    return lines.join(placed, ["path", "_start"]).select("path", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), F.regexp_replace("value", r"\r\z", "").alias("line"))


def read_jsonl_strict(spark: SparkSession, path: str, schema: str, required: str) -> tuple[DataFrame, DataFrame]:
    """Rows and issues of the files of a path. One bad line, or one without the required field, rejects its whole file:
    that has no rows then, and each bad line is an issue with its file and number. Blank lines are skipped, but count.
    """
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    parsed = lines.select("path", F.col("line_no").cast("int").alias("line_no"), F.from_json("line", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
    wrong = F.col("r").isNull() | F.col(f"r.{BAD}").isNotNull() | F.col(f"r.{required}").isNull()
    issues = parsed.filter(wrong).select(F.lit("error").alias("severity"), F.lit("invalid_metadata").alias("category"), "path", F.concat(F.lit("line "), F.col("line_no").cast("string")).alias("message"))
    rows = parsed.filter(~wrong).select("path", "line_no", "r.*").drop(BAD)
    return rows.join(issues.select("path").distinct(), "path", "left_anti").drop("path"), issues


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_jsonl_lax(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file; a missing file has none."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_manifest(spark: SparkSession, path: str, schema: str, fallback: str | None = None) -> DataFrame:
    """Known fields of a manifest, or of the file that stands in for it; an error if neither is there."""
    for place in (path, fallback):
        if place and exists(spark, place):
            return spark.read.schema(schema).json(place)
    raise FileNotFoundError(path)


def with_found_paths(rows: DataFrame, files: DataFrame, path_col: str, folder: str) -> DataFrame:
    """Rows of a manifest that may have been moved together with its files: a path of no file becomes that of the file
    of its name in the manifest's folder, if that is there; others stay as they are. files: path, as scans give it."""
    plain = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(//)?", "")  # noqa: E731  without a scheme
    place = folder.rstrip("/")
    there = files.select(plain(F.col("path")).alias("_path")).distinct()
    beside = there.filter(F.regexp_replace("_path", "/[^/]*$", "") == plain(F.lit(place))).select(F.regexp_extract("_path", r"([^/]+)$", 1).alias("_name"), F.lit(True).alias("_beside"))
    held = rows.withColumns({"_at": plain(F.col(path_col)), "_name": F.regexp_extract(path_col, r"([^/]+)$", 1)})
    held = held.join(there.select(F.col("_path").alias("_at"), F.lit(True).alias("_there")), "_at", "left").join(beside, "_name", "left")
    moved = F.col("_there").isNull() & F.col("_beside").isNotNull()
    return held.withColumn(path_col, F.when(moved, F.concat(F.lit(f"{place}/"), F.col("_name"))).otherwise(F.col(path_col))).select(*rows.columns)


def read_sidecars(spark: SparkSession, root: str, schema: str, glob: str = "*.json") -> DataFrame:
    """One JSON object per file, with the file's stem; what is corrupt has nulls."""
    held = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", glob).json(root)
    return held.select(stem(F.col("_metadata.file_path")).alias("stem"), *held.columns)


def with_sidecars(rows: DataFrame, sidecars: DataFrame, path_col: str) -> DataFrame:
    """Rows with the sidecar of their stem, where there is one."""
    return rows.withColumn("stem", stem(F.col(path_col))).join(sidecars, "stem", "left")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("step int, loss double, lr double").option("header", "true").csv(path)


SUITE = "id string, prompt string, width int, height int, negative_prompt string"


def read_suite(spark: SparkSession, entries: Sequence[dict]) -> DataFrame:
    """id, prompt, width, height, negative_prompt of a prompt suite; ids default to their place, prompts must be there."""
    for k, entry in enumerate(entries):
        if not entry.get("prompt"):
            raise ValueError(f"entry {k} has no prompt")
    fields = ("id", "prompt", "width", "height", "negative_prompt")
    rows = [(k, *[e.get(f) for f in fields]) for k, e in enumerate(entries)]
    table = spark.createDataFrame(rows, f"pos int, {SUITE}")
    return table.withColumn("id", F.coalesce("id", F.format_string("prompt%02d", "pos"))).drop("pos")


def read_suites(spark: SparkSession, path: str) -> DataFrame:
    """The entries of suite files, each a JSON array, with their file: ids default to the place in the file. An entry
    without a prompt is an error, as is a file that holds no array."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"array<struct<{SUITE.replace(' ', ':').replace(',:', ',')}>>").alias("entries"))
    listed = files.select("file", F.posexplode_outer("entries").alias("pos", "e"))
    complaint = F.when(F.col("pos").isNull(), F.concat(F.col("file"), F.lit(" holds no entries"))).when(F.coalesce(F.trim("e.prompt"), F.lit("")) == "", F.concat(F.lit("entry "), F.col("pos").cast("string"), F.lit(" has no prompt in "), F.col("file")))
    checked = listed.withColumn("_ok", F.when(complaint.isNotNull(), F.raise_error(complaint)).otherwise(F.lit(True))).filter("_ok")
    return checked.select("file", F.coalesce("e.id", F.format_string("prompt%02d", "pos")).alias("id"), "e.prompt", "e.width", "e.height", "e.negative_prompt")


def load_config(source: str | dict) -> dict:
    """A mapping from a YAML or JSON file, or the mapping itself."""
    if isinstance(source, dict):
        return source
    with open(source, encoding="utf-8") as f:
        text = f.read()
    if source.endswith(".json"):
        import json

        found = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("reading YAML needs pyyaml; JSON and mappings do not") from missing
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{source} is no mapping")
    return found


def missing_only(records: DataFrame, files: DataFrame, name_col: str) -> DataFrame:
    """Records whose file is not there yet."""
    return records.join(files.select(F.col("name").alias(name_col)), name_col, "left_anti")
