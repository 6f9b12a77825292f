from pyspark.sql import functions as F

from faultline.operators import source_metrics as op
from faultline.sources import tables as io

PYTHON = '''import os
from a import b

# note
def outer(a, b, c, d, e, f):
    if a:
        for i in b:
            while c:
                try:
                    x = d and e
                except ValueError:
                    pass

    def inner():
        return 1
    return None

class Big:
    """Doc."""
    pass
'''
JAVA = '''import java.util.List;
/* block
 } */
public class A {
  // line {
  public int run(int a, String b) {
    if (a > 0 && b != null) {
      return "} \\" {".length();
    }
    return 0;
  }
  void stop() { }
}
'''


def metrics(spark, path, text):
    df = spark.createDataFrame([("r", path, text)], "repo string, file_path string, source string")
    return op.code_metrics(df).first()


def test_python(spark):
    m = metrics(spark, "a.py", PYTHON)
    assert m["loc"] == len(PYTHON.splitlines())
    assert sorted(m["function_sizes"]) == [2, 12]
    assert m["class_sizes"] == [3]
    assert sorted(m["param_counts"]) == [0, 6]
    assert m["max_nesting_depth"] == 5 and m["import_count"] == 2 and m["class_count"] == 1


def test_python_depths_follow_the_tree(spark):
    text = "if a:\n    pass\nelif b:\n    pass\nelif c:\n    for x in y:\n        pass\nelse:\n    while z:\n        pass\n"
    m = metrics(spark, "a.py", text)
    assert m["max_nesting_depth"] == 4
    assert m["cognitive_complexity"] == 1 + 2 + 3 + 4 + 4


def test_java(spark):
    m = metrics(spark, "A.java", JAVA)
    assert m["function_sizes"] == [6, 1]
    assert m["param_counts"] == [2, 0]
    assert m["max_nesting_depth"] == 2
    assert m["class_count"] == 1 and m["import_count"] == 1
    assert m["max_cyclomatic_complexity"] == 3


def test_smells_follow_their_rule_set(spark):
    df = spark.createDataFrame([("r", "a.py", PYTHON)], "repo string, file_path string, source string")
    m = op.code_metrics(df)
    python = op.smell_flags(m, "python").first()
    assert python["has_long_param_list"] == 1 and python["has_deep_nesting"] == 1 and python["has_long_method"] == 0
    assert python["total_smells"] == sum(python[c] for c in op.SMELL_COUNTS)
    assert op.smell_flags(m, "python", {"long_method": 10}).first()["has_long_method"] == 1


def test_empty_and_long_texts(spark):
    assert metrics(spark, "a.py", "")["loc"] == 0
    m = metrics(spark, "A.java", 'class A { String s = "' + "x\\n" * 20000 + '"; }\n')
    assert m["max_nesting_depth"] == 0


def test_other_languages(spark):
    go = metrics(spark, "m.go", "func (s *T) Add(a int, b int) int {\n  if a > b {\n    return a\n  }\n}\n")
    assert go["function_count"] == 1 and go["max_param_count"] == 2
    rb = metrics(spark, "m.rb", "=begin\ndoc\n=end\ndef go(a, b)\n  x if a\nend\n")
    assert rb["comment_lines"] == 3 and rb["function_count"] == 1


def test_log_lines(spark):
    df = spark.createDataFrame([("a|b|2020-01-02T03:04:05|x|y",), ("a|b|never|x",), ("short|line",)], "value string")
    rows = io.parse_log_lines(df).collect()
    assert len(rows) == 1 and rows[0]["message"] == "x|y"


def test_source_tree(spark, tmp_path):
    for p in ("a.py", "sub/b.py", "build/c.py", "d.txt"):
        f = tmp_path / p
        f.parent.mkdir(exist_ok=True)
        f.write_text("x = 1\n")
    names = lambda df: sorted(r["file_path"].rsplit("/", 1)[1] for r in df.collect())
    assert names(io.scan_source_tree(spark, str(tmp_path))) == ["a.py", "b.py"]
    assert names(io.scan_source_tree(spark, str(tmp_path), max_files=1)) == ["a.py"]


def test_sarif_documents_are_valid_json(spark, tmp_path):
    import json

    from faultline.operators import reporting

    files = spark.createDataFrame(
        [("r1", "a.py", 1, 0.9, 1), ("r1", "b.py", 1, 0.7, 0), ("r2", "c.py", 2, 0.1, 1)],
        "repo string, file_path string, commit_id long, risk_probability double, has_deep_nesting int",
    )
    lines = reporting.sarif_lines(reporting.findings(files))
    for repo, count in (("r1", 3), ("r2", 1)):
        text = "".join(r["line"] for r in lines.where(F.col("repo") == repo).orderBy("section", "ordinal").collect())
        assert len(json.loads(text)["runs"][0]["results"]) == count


def test_comment_walk_by_hand(spark):
    go = "\t \n/* TODO a\nif x {\n\n// FIXME inside\nend */\nif a&& b { // HACK\n// TODO if\nx()\n"
    rows = [("r", "a.go", go), ("r", "b.go", ""), ("r", "c.go", None)]
    got = {r["file_path"]: r for r in op.comment_profile(spark.createDataFrame(rows, "repo string, file_path string, source string")).collect()}
    a = got["a.go"]
    assert (a["loc"], a["blank_lines"], a["comment_lines"], a["todo_count"], a["sloc"]) == (9, 2, 5, 2, 2)
    assert a["cyclomatic_complexity"] == 3
    assert (got["b.go"]["loc"], got["b.go"]["cyclomatic_complexity"]) == (0, 1)
    assert got["c.go"]["cyclomatic_complexity"] is None
