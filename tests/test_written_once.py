"""What is dear is worked out once, however many steps use it."""

from datetime import datetime, timedelta

import pytest

from faultline.operators import modelling, snapshot_table


def counting(spark, read):
    def count(df):
        def run(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    return count


def test_permuted_rows_are_scored_once(spark):
    read = spark.sparkContext.accumulator(0)
    count = counting(spark, read)

    class Counted(modelling.LinearScore):
        def score(self, df, out="p"):
            return super().score(count(df), out)

    rows = [(i, i % 3 % 2, float(i % 17), float(i % 5)) for i in range(120)]
    df = spark.createDataFrame(rows, "commit_id long, future_bug_fix int, a double, b double")
    got = modelling.permutation_importance(Counted({"a": 1e-6, "b": 2e-6}), df, ["commit_id"]).collect()
    assert {r["feature"] for r in got} == {"a", "b"}
    assert read.value == 3 * 120


def test_crowded_scores_rank_as_spread_ones(spark):
    rows = [(i, i * 7 % 11 % 2, float(i * 31 % 101), float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "commit_id long, future_bug_fix int, a double, b double")
    # powers of two, so that the crowded scores order the rows just as the spread ones do
    wide, crowded = ({r["feature"]: r["importance"] for r in modelling.permutation_importance(modelling.LinearScore({"a": 8 * s, "b": s}), df, ["commit_id"]).collect()} for s in (1.0, 2.0**-40))
    assert set(wide) == {"a", "b"} and wide == pytest.approx(crowded, abs=1e-12)


def test_changes_are_read_once_for_a_snapshot_table(spark):
    read = spark.sparkContext.accumulator(0)
    rows = [("r", f"f{i % 3}.py", i, f"d{i % 2}", datetime(2024, 1, 1) + timedelta(days=i), "fix crash" if i % 4 == 0 else "add", i) for i in range(30)]
    changes = spark.createDataFrame(rows, "repo string, file_path string, commit_id long, author string, commit_date timestamp, message string, lines int")
    sources = spark.createDataFrame([("r", f"f{i}.py", "def f(a):\n    return a\n") for i in range(3)], "repo string, file_path string, source string")
    got = snapshot_table.snapshot_table(counting(spark, read)(changes), sources, min_rows=1).collect()
    assert len(got) == 30 and sum(r["previous_file_commits"] for r in got) == 3 * sum(range(10))
    assert read.value == 30
