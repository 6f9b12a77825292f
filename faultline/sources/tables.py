"""Reading and writing snapshot tables, logs, results, annotations and reports."""

from pyspark.sql import functions as F

from faultline.functions.files import IGNORED_FOLDERS
from faultline.functions.text import strip

MERGED_NAMES = ["all_repos_merged.parquet", "all_java_merged.parquet"]

RESULT_SCHEMA = "regime string, model string, feature_group string, key string, pr_auc double, roc_auc double, f1 double, brier_score double"
ANNOTATION_SCHEMA = (
    "id long, commit_hash string, repository string, message string, score double, stratum string, heuristic_label boolean, "
    "human_label boolean, annotator_confidence string, annotator_notes string"
)
MODEL_SCHEMA = "engine string, features array<string>, training_rows long, training_repos array<string>, quantile_reference_tables map<string, array<double>>"


def scan_snapshots(spark, folder, name_glob="*.parquet", skip=tuple(MERGED_NAMES)):
    """All per-repository files of a folder but the merged ones, with their file name."""
    df = spark.read.option("mergeSchema", "true").option("pathGlobFilter", name_glob).option("recursiveFileLookup", "true").parquet(folder)
    name = F.col("_metadata.file_name")
    return df.select("*", name.alias("source_file")).where(~F.col("source_file").isin(list(skip)))


def scan_column(spark, path, column):
    """Rows and sum of one column; only that column is read."""
    return spark.read.parquet(path).select(column).agg(F.count(F.lit(1)).alias("rows"), F.sum(column).alias("total"))


def write_snapshots(df, folder):
    """Parquet split by repository.

    Rows go out by ranges of (repo, file): files of a repository stay together and a
    large repository is spread over several tasks and files.
    """
    df.repartitionByRange("repo", "file_path").write.mode("overwrite").partitionBy("repo").parquet(folder)


def replace_table(df, path):
    """Drop and create as select, as one overwrite."""
    df.write.mode("overwrite").parquet(path)


def scan_source_tree(spark, folder, suffix=".py", max_files=None, ignored=tuple(IGNORED_FOLDERS)):
    """Rows (file_path, source), one per text file below a folder, ignored folders left out.

    max_files keeps the first files in path order; the paths are listed before any
    text is read.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").format("text").option(
        "wholetext", "true"
    ).load(folder)
    named = files.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("source"))
    parts = F.split(F.regexp_replace("file_path", "^" + _pattern(folder), ""), "/")
    kept = named.where(~F.arrays_overlap(parts, F.array(*[F.lit(i) for i in ignored])))
    if max_files is None:
        return kept
    first = kept.select("file_path").orderBy("file_path").limit(max_files)
    return kept.join(F.broadcast(first), "file_path", "left_semi")


def _pattern(folder):
    import re

    return r"[a-z]*:/*" + re.escape(folder.split("://")[-1].lstrip("/").removeprefix("file:"))


def parse_log_lines(lines, column="value"):
    """`id|author|date|subject` lines as columns; the subject keeps its bars, bad rows are dropped."""
    parts = F.split(F.col(column), r"\|", 4)
    when = F.try_to_timestamp(strip(parts[2]))
    return lines.where(F.size(parts) == 4).select(
        strip(parts[0]).alias("commit_id"), strip(parts[1]).alias("author"), when.alias("commit_date"), strip(parts[3]).alias("message")
    ).where(F.col("commit_date").isNotNull())


def write_csv(df, folder):
    df.write.mode("overwrite").option("header", "true").csv(folder)


def read_results(spark, folder):
    return spark.read.option("header", "true").schema(RESULT_SCHEMA).csv(folder)


def write_json(df, folder):
    df.write.mode("overwrite").json(folder)


def read_annotations(spark, folder):
    return spark.read.schema(ANNOTATION_SCHEMA).json(folder)


def annotation_documents(sample):
    """Sampled commits in the shape annotators fill in."""
    return sample.select(
        F.xxhash64("repo", "commit_id").alias("id"), F.col("commit_id").cast("string").alias("commit_hash"), F.col("repo").alias("repository"),
        "message", "score", "stratum", F.col("is_bug_fix").alias("heuristic_label"), F.lit(None).cast("boolean").alias("human_label"),
        F.lit(None).cast("string").alias("annotator_confidence"), F.lit(None).cast("string").alias("annotator_notes"),
    )


def read_quantile_tables(spark, path):
    """Rows (feature, idx, value) from model metadata documents holding name -> quantiles."""
    meta = spark.read.schema(MODEL_SCHEMA).option("multiLine", "true").json(path)
    tables = meta.select(F.explode("quantile_reference_tables").alias("feature", "values"))
    return tables.select("feature", F.posexplode("values").alias("idx", "value"))


def write_quantile_tables(table, folder, engine):
    """One metadata document; a table has 101 rows per feature."""
    arrays = table.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda r: r["value"]).alias("values"))
    doc = arrays.agg(F.map_from_entries(F.collect_list(F.struct("feature", "values"))).alias("quantile_reference_tables"))
    doc.select(F.lit(engine).alias("engine"), "quantile_reference_tables").write.mode("overwrite").json(folder)


def write_lines(lines, folder, by="repo"):
    """Text documents from ordered lines (by, section, ordinal, line), one folder per `by`.

    Lines are range-partitioned by document and position: files of a folder read in
    name order give the document, and a large document is written by many tasks. Files are gzipped, as readers of text take them.
    """
    placed = lines.repartitionByRange(by, "section", "ordinal").sortWithinPartitions(by, "section", "ordinal")
    placed.select(by, F.col("line").alias("value")).write.mode("overwrite").partitionBy(by).option("compression", "gzip").text(folder)
