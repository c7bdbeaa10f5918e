"""Votes of one time (finding F14 of round 3)."""

from datetime import datetime

from terrafuse.plans import catalogue


def test_the_first_of_a_cases_last_votes_counts(spark, tmp_path):
    at = datetime(2024, 1, 1)
    # one case; all at one time, of voters who force nothing
    rows = [(1, 3, "signup", at), (2, 4, "error", at), (3, 5, "view", at), (0, 6, "error", at)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    assert [r.resolution for r in catalogue.QUERIES["force_resolution"](spark, str(tmp_path)).collect()] == ["unknown"]
