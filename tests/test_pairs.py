"""Landed files: late, lone and corrected ones."""

import glob
import time

import pytest
from pyspark.sql import functions as F

from pursuit.sources import landing
from pursuit.sources import tracking as files
from pursuit.streaming import pairs
from tests.conftest import IN, rating_rows
from tests.test_site import write_raw


def eventually(query, condition, seconds=240):
    """Wait until the condition holds; tables that are not there yet, or are being replaced, count as not yet."""
    until = time.time() + seconds
    while time.time() < until:
        if query.exception():
            raise query.exception()
        try:
            if condition():
                return True
        except Exception:  # noqa: BLE001
            pass
        time.sleep(0.5)
    return False


def test_weeks_wait_for_their_pair_and_run_again_when_a_file_changes(spark, tmp_path):
    rows, out, _ = rating_rows()
    raw, processed = tmp_path / "raw", str(tmp_path / "processed")

    def week(number, n=None):
        return [(number, *r[1:]) for r in rows], [(number, *r[1:]) for r in out[:n]]

    def stored():
        inp, air = files.load_weeks(spark, processed)
        return {r.week: r.n for r in inp.groupBy("week").agg(F.count("*").alias("n")).collect()}, air.agg(F.max("x")).first()[0]

    write_raw(raw, 1, *week(1))
    write_raw(raw, 2, week(2)[0], None)
    query = pairs.stream_pairs(spark, str(raw), processed, str(tmp_path / "checkpoint"), 2000, processingTime="500 milliseconds")
    try:
        assert eventually(query, lambda: stored()[0] == {1: 4 * IN})
        assert eventually(query, lambda: [(r.week, r.status, r.output_version) for r in spark.read.parquet(f"{processed}/alone").collect()] == [(2, "alone", None)])
        write_raw(raw, 2, *week(2))  # the late file
        assert eventually(query, lambda: stored()[0] == {1: 4 * IN, 2: 4 * IN})
        before = stored()[1]
        moved = [(*r[:4], r[4] + 1000.0, r[5]) for r in week(1)[1]]
        write_raw(raw, 1, week(1)[0], moved)  # a corrected file of the same name
        assert eventually(query, lambda: stored()[1] > before + 500)
        assert stored()[0] == {1: 4 * IN, 2: 4 * IN}
    finally:
        query.stop()


def test_a_listing_passes_over_what_is_not_ready_and_refuses_other_names(tmp_path):
    assert landing.listing(str(tmp_path / "none")) == {}
    (tmp_path / "input_2023_w01.csv").write_text("a")
    (tmp_path / "_input_2023_w02.csv").write_text("b")
    folder = tmp_path / "output_2023_w01.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text("cd")
    assert set(landing.listing(str(tmp_path))) == {"input_2023_w01.csv"}  # the folder has no _SUCCESS yet
    (folder / "_SUCCESS").write_text("")
    found = landing.listing(str(tmp_path))
    assert found["output_2023_w01.csv"][0] == 2 and found["input_2023_w01.csv"][0] == 1
    reader = landing.LandingReader(str(tmp_path))
    rows, end = reader.read(reader.initialOffset())
    assert [r[:3] for r in rows] == [(2023, 1, "input"), (2023, 1, "output")] and list(reader.read(end)[0]) == []
    (tmp_path / "input_2023_w01.csv").write_text("longer")
    (row,), after = (list(x) if i == 0 else x for i, x in enumerate(reader.read(end)))
    assert row[2] == "input" and row[4] == 6 and [r[:3] for r in reader.readBetweenOffsets(end, after)] == [(2023, 1, "input")]
    (tmp_path / "other.csv").write_text("")
    with pytest.raises(ValueError, match="no season and week"):
        landing.listing(str(tmp_path))


def test_a_batch_of_requests_is_staged_and_not_cached(spark, tmp_path, monkeypatch):
    from pursuit import staging
    from pursuit.streaming.requests import write_batch

    def refuse(*_):
        raise AssertionError("a parsed batch was cached")

    monkeypatch.setattr(type(spark.range(1)), "persist", refuse)
    batch = spark.createDataFrame([("a", "{not json"), ("b", '{"rows":[]}'), ("b", '{"rows":[]}')], "request_id string, body string")
    write_batch(batch, 0, str(tmp_path / "good"), str(tmp_path / "bad"))
    bad = spark.read.parquet(str(tmp_path / "bad")).select("request_id", "body").collect()
    assert sorted((r.request_id, r.body) for r in bad) == [("a", "{not json"), ("b", '{"rows":[]}'), ("b", '{"rows":[]}')]
    assert not glob.glob(f"{staging.application_dir(spark).removeprefix('file:')}/parsed-*")


def test_a_folder_is_given_another_path(spark, tmp_path):
    from pursuit.staging import rename

    spark.range(3).write.parquet(str(tmp_path / "one"))
    rename(spark, str(tmp_path / "one"), str(tmp_path / "deep" / "two"))
    rename(spark, str(tmp_path / "none"), str(tmp_path / "deep" / "three"))
    assert spark.read.parquet(str(tmp_path / "deep" / "two")).count() == 3 and not (tmp_path / "one").exists()
    assert (tmp_path / "deep" / "three").is_dir()
