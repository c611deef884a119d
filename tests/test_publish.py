"""Builds that replace one another as a whole, the profile store, and requests put to a remote parser."""

import time
import urllib.error

import pytest
from pyspark.sql import functions as F

from almanac.operators import query
from almanac.sources import ingest


def table(spark, value):
    return spark.createDataFrame([(value,)], "v string")


def stored(spark, folder, name):
    return [r["v"] for r in spark.read.schema("v string").json(f"{folder}/{name}").collect()]


def test_a_build_that_ends_early_leaves_the_old_one(spark, tmp_path):
    folder = str(tmp_path / "tables")
    ingest.publish(spark, {"a": table(spark, "old"), "b": table(spark, "old")}, folder)
    broken = table(spark, "new").withColumn("v", F.raise_error(F.lit("ends here")).cast("string"))
    with pytest.raises(Exception, match="ends here"):
        ingest.publish(spark, {"a": table(spark, "new"), "b": broken}, folder)
    assert stored(spark, folder, "a") == stored(spark, folder, "b") == ["old"]
    ingest.publish(spark, {"a": table(spark, "third")}, folder)
    assert stored(spark, folder, "a") == ["third"] and not (tmp_path / "tables" / "b").exists()
    assert [p.name for p in tmp_path.iterdir()] == ["tables"]


def test_a_build_lost_between_its_renames_is_taken_up(spark, tmp_path):
    folder = str(tmp_path / "tables")
    ingest.publish(spark, {"a": table(spark, "old")}, folder)
    (tmp_path / "tables").rename(tmp_path / "tables.old")
    broken = table(spark, "new").withColumn("v", F.raise_error(F.lit("ends here")).cast("string"))
    with pytest.raises(Exception, match="ends here"):
        ingest.publish(spark, {"a": broken}, folder)
    assert stored(spark, folder, "a") == ["old"]


def test_profile_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert ingest.load_profile(spark, path, "v string").count() == 0
    for value in ("first", "second"):
        ingest.save_profile(table(spark, value), path)
        assert [r["v"] for r in ingest.load_profile(spark, path, "v string").collect()] == [value]


def test_one_call_for_each_distinct_query(spark, tmp_path):
    folder = str(tmp_path)

    def remote(text):  # counts its calls in a folder, as executors are other processes
        with open(f"{folder}/{time.time_ns()}-{len(text)}-{text}", "w") as f:
            f.write(text)
        if text in ("busy", "wrong"):
            raise urllib.error.HTTPError("http://x", 503 if text == "busy" else 400, text, None, None)
        return "{}"

    rows = [(i, q) for i, q in enumerate(["a", "b", "a", None, "busy", "wrong", "a", ""])]
    got = query.asked(spark.createDataFrame(rows, "id long, query string"), remote, tries=2, pause=0.0).orderBy("id").collect()
    assert [(r["reply"], r["warning"]) for r in got] == [("{}", None)] * 3 + [(None, None), (None, "remote parser failed: HTTP Error 503: busy"), (None, "remote parser failed: HTTP Error 400: wrong"), ("{}", None), ("{}", None)]
    calls = sorted(p.read_text() for p in tmp_path.iterdir())
    assert calls == ["", "a", "b", "busy", "busy", "wrong"]  # only what may pass is tried again
