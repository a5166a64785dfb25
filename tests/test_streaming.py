"""The review stream over several batches and restarts, with late and repeated rows."""

from respondex.streaming.reviews import current, keep_latest

KIND = "feature string, edit_id string, edited_at timestamp_ntz, status string"


def add(spark, folder, rows):
    spark.createDataFrame(rows, "feature string, edit_id string, edited_at string, status string").selectExpr("feature", "edit_id", "to_timestamp_ntz(edited_at) AS edited_at", "status").coalesce(1).write.mode("append").parquet(f"file://{folder}/in")


def run(spark, folder):
    """A new query each time, going on from the checkpoint."""
    keep_latest(spark.readStream.schema(KIND).parquet(f"file://{folder}/in"), ["feature"], f"file://{folder}/cp").awaitTermination()
    return {r["feature"]: r["status"] for r in current(spark, f"file://{folder}/cp").collect()}


def test_latest_over_restarts(spark, tmp_path):
    add(spark, tmp_path, [("a", "1", "2024-01-09 00:00:00", "new"), ("b", "2", "2024-01-01 00:00:00", "x"), ("c", "1", None, "no time"), ("d", None, "2024-01-01 00:00:00", "no id")])
    assert run(spark, tmp_path) == {"a": "new", "b": "x"}
    add(spark, tmp_path, [("a", "3", "2024-01-09 00:10:00", "newer"), ("b", "0", "2023-12-31 23:50:00", "late"), ("a", "1", "2024-01-09 00:00:00", "new")])
    assert run(spark, tmp_path) == {"a": "newer", "b": "x"}
    assert run(spark, tmp_path) == {"a": "newer", "b": "x"}  # nothing new
    add(spark, tmp_path, [("b", "3", "2024-01-02 00:00:00", "late but newest"), ("a", "4", "2024-01-09 00:10:00", "tie by id"), ("a", "0", "2024-01-01 00:00:00", "older"), ("e", "9", "2024-01-03 00:00:00", "first")])
    assert run(spark, tmp_path) == {"a": "tie by id", "b": "late but newest", "e": "first"}


def test_state_grows_with_entities_only(spark, tmp_path):
    for k in range(3):
        add(spark, tmp_path, [(f"e{i % 5}", f"{k}-{i}", f"2024-01-0{k + 1} 00:{i:02d}:00", str(i)) for i in range(40)])
        assert run(spark, tmp_path) == {f"e{i}": str(35 + i) for i in range(5)}
    assert current(spark, f"file://{tmp_path}/cp").count() == 5
