"""Registered queries on sources and sinks: what is written is read back and returned."""

from pyspark.sql import functions as F

from faultline.operators import evaluation, features, reporting
from faultline.operators.commits import stratified_sample
from faultline.functions.text import STRATA
from faultline.plans.evaluation import RES, results_of, rounded
from faultline.plans.features import QUANTILES, TABLED
from faultline.plans.registry import query, query_on_dir
from faultline.plans.sources import RISKY, _findings_sql, risky
from faultline.session import work_folder
from faultline.sources import tables as io

ROW = ["repo", "file_path", "commit_id"]


@query_on_dir(
    "scan_snapshots", "",
    """SELECT 'orders.parquet' AS source_file, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem.parquet', count(*) FROM lineitem
UNION ALL SELECT 'part.parquet', count(*) FROM part UNION ALL SELECT 'supplier.parquet', count(*) FROM supplier""",
)
def scan_snapshots(spark, sf_dir):
    found = io.scan_snapshots(spark, sf_dir, "{orders,lineitem,part,supplier,customer}.parquet", skip=["customer.parquet"])
    return found.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))


@query_on_dir("scan_pruned", "", "SELECT count(*) AS rows, sum(l_linenumber)::BIGINT AS total FROM lineitem")
def scan_pruned(spark, sf_dir):
    return io.scan_column(spark, f"{sf_dir}/lineitem.parquet", "l_linenumber")


@query_on_dir(
    "write_snapshots", "SN",
    "SELECT repo, file_path, commit_id, code_loc, total_smells FROM sn_snapshots",
)
def write_snapshots(spark, sf_dir, sn):
    folder = work_folder(spark, "snapshots")
    io.write_snapshots(sn.select(*ROW, "code_loc", "total_smells"), folder)
    return spark.read.parquet(folder).select("repo", "file_path", "commit_id", "code_loc", "total_smells")


@query_on_dir("snapshot_replace", "SN", "SELECT repo, file_path, commit_id FROM sn_snapshots WHERE total_smells > 1")
def snapshot_replace(spark, sf_dir, sn):
    folder = work_folder(spark, "replace")
    io.replace_table(sn.select(*ROW).where("total_smells <= 1"), folder)
    io.replace_table(sn.select(*ROW).where("total_smells > 1"), folder)
    return spark.read.parquet(folder)


@query_on_dir(
    "source_tree_scan", "SRC",
    "SELECT count(*) AS files, sum(strlen(source))::BIGINT AS bytes FROM src_sources",
)
def source_tree_scan(spark, sf_dir, src):
    """Source texts are written as one tree of text files, some in an ignored folder, and scanned."""
    folder = work_folder(spark, "tree")
    texts = src.select(F.concat_ws("/", "repo", "file_path").alias("path"), F.col("source").alias("value"))
    bucketed = texts.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(16)))
    bucketed.select("bucket", "value").write.mode("overwrite").partitionBy("bucket").option("lineSep", "\u0001").text(folder)
    texts.select("value").where("path LIKE '%f1%'").write.mode("overwrite").text(f"{folder}/build")
    scanned = io.scan_source_tree(spark, folder, suffix=".txt")
    pieces = scanned.select(F.explode(F.filter(F.split("source", "\u0001"), lambda x: x != "")).alias("text"))
    return pieces.agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query(
    "parse_log_lines", "C",
    """SELECT commit_id::VARCHAR AS commit_id, author, strftime(commit_date, '%Y-%m-%d') AS day, concat(message, ' | x') AS message FROM c_commits WHERE commit_id % 11 > 1""",
)
def parse_log_lines(c):
    day = F.date_format("commit_date", "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(F.col("commit_id") % 11 == 0, "no date").otherwise(day)
    full = F.concat_ws("|", F.col("commit_id").cast("string"), "author", stamp, F.concat("message", F.lit(" | x")))
    lines = c.select(F.when(F.col("commit_id") % 11 == 1, F.lit("broken|line")).otherwise(full).alias("value"))
    parsed = io.parse_log_lines(lines)
    return parsed.select("commit_id", "author", F.date_format("commit_date", "yyyy-MM-dd").alias("day"), "message")


@query_on_dir(
    "csv_results", "PR",
    f"WITH {RES} SELECT regime, model, feature_group, key, round(pr_auc, 8) AS pr_auc FROM res",
)
def csv_results(spark, sf_dir, pr):
    folder = work_folder(spark, "results")
    io.write_csv(results_of(pr).select("regime", "model", "feature_group", "key", "pr_auc", "roc_auc", "f1", "brier_score"), folder)
    return rounded(io.read_results(spark, folder).select("regime", "model", "feature_group", "key", "pr_auc"))


@query_on_dir("json_annotations", "C")
def json_annotations(spark, sf_dir, c):
    """The stratified sample as annotation documents, written and read back."""
    folder = work_folder(spark, "annotations")
    io.write_json(io.annotation_documents(stratified_sample(c, {s: 125 for s in STRATA})), folder)
    return io.read_annotations(spark, folder)


@query_on_dir(
    "json_quantile_tables", "SN",
    f"WITH {QUANTILES} SELECT feature, idx, round(value, 8) AS value FROM q",
)
def json_quantile_tables(spark, sf_dir, sn):
    folder = work_folder(spark, "metadata")
    io.write_quantile_tables(features.quantile_reference(sn, TABLED), folder, "static")
    return io.read_quantile_tables(spark, folder).withColumn("value", F.round("value", 8))


@query_on_dir(
    "findings_sink", "SN PR",
    f"WITH {RISKY}, f AS ({_findings_sql()}) SELECT repo, count(*) + 2 AS lines, count(*) FILTER (level = 'error') AS errors FROM f GROUP BY repo",
)
def findings_sink(spark, sf_dir, sn, pr):
    """One SARIF document per repository, written as text; returned are its lines and error results."""
    folder = work_folder(spark, "sarif")
    io.write_lines(reporting.sarif_lines(reporting.findings(risky(sn, pr))), folder)
    return spark.read.text(folder).groupBy("repo").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("value").contains('"level":"error"')).alias("errors")
    )
