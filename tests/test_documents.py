"""Documents are written compressed and read back whole."""

import gzip
import os

from faultline.sources.tables import write_lines


def test_documents_are_compressed(spark, tmp_path):
    lines = spark.createDataFrame([("a", 1, str(i), f"line {i}") for i in range(9)], "repo string, section int, ordinal string, line string")
    write_lines(lines, f"{tmp_path}/out")
    names = sorted(n for n in os.listdir(f"{tmp_path}/out/repo=a") if not n.startswith((".", "_")))
    assert all(n.endswith(".gz") for n in names)
    text = "".join(gzip.open(f"{tmp_path}/out/repo=a/{n}", "rt").read() for n in names)
    assert text.splitlines() == [f"line {i}" for i in range(9)]
