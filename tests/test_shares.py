"""What a task works on does not grow with the tables."""

import os
from datetime import datetime

from faultline.plans import inputs


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part-{name}")
    (part,) = [x for x in os.listdir(f"{folder}/part-{name}") if x.endswith(".parquet")]
    os.rename(f"{folder}/part-{name}/{part}", f"{folder}/{name}.parquet")


def test_changes_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    table(spark, tmp_path, "orders", [(k, k, datetime(2024, 1, 1)) for k in range(100)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    table(spark, tmp_path, "lineitem", [(k % 100, k, 1.0) for k in range(1000)] + [(None, 1, 1.0)], "l_orderkey long, l_partkey long, l_quantity double")
    monkeypatch.setattr(inputs, "ROWS_A_TASK", 50)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changes = inputs.read(spark, str(tmp_path), "FC")
        assert changes.rdd.getNumPartitions() == 21
        assert changes.groupBy().sum("lines").first()[0] == 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sources_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    table(spark, tmp_path, "part", [(k, k % 50) for k in range(100)] + [(None, 1)], "p_partkey long, p_size int")
    monkeypatch.setattr(inputs, "SOURCES_A_TASK", 10)
    sources = inputs.read(spark, str(tmp_path), "SRC")
    assert sources.rdd.getNumPartitions() == 11
    assert sources.count() == 101
