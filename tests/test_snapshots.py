import pytest
from pyspark.sql import functions as F

from docwarden.operators import search as se
from docwarden.sources import snapshots as sn


def lengths(text):
    return F.array(F.char_length(text).cast("float"))


def words(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sn.latest(spark, path) == (0, {})
    assert sn.publish(spark, path, 0, {"a": 1}) == 1
    with pytest.raises(sn.Conflict):
        sn.publish(spark, path, 0, {"a": 2})
    assert sn.latest(spark, path) == (1, {"a": 1})
    assert [p.name for p in (tmp_path / "t" / "_versions").iterdir() if p.suffix != ".crc"] == ["00000001.json"]
    assert sn.change(spark, path, lambda v, c: None) == 1
    for i in range(10):
        sn.change(spark, path, lambda v, c: {"a": c["a"] + 1})
    assert sn.latest(spark, path) == (11, {"a": 11})


def test_a_writer_that_was_overtaken_starts_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    sn.publish(spark, path, 0, {"parts": []})
    seen = []

    def make(version, content):
        seen.append(version)
        if len(seen) < 3:
            sn.publish(spark, path, version, {"parts": [*content["parts"], f"other{version}"]})
        return {"parts": [*content["parts"], "mine"]}

    assert sn.change(spark, path, make) == 4 and seen == [1, 2, 3]
    assert sn.latest(spark, path)[1] == {"parts": ["other1", "other2", "mine"]}


def test_two_writers_of_a_cache_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert se.update_cache(words(spark, "a", "bb"), path, lengths).count() == 2
    raced = []

    def slow(text):
        if not raced:  # another writer finishes while this one computes
            raced.append(1)
            se.update_cache(words(spark, "bb", "ccc", "dddd"), path, lengths)
        return lengths(text)

    both = se.update_cache(words(spark, "ccc", "eeeee", "a"), path, slow)
    assert sorted(r["embedding"][0] for r in both.collect()) == [1, 2, 3, 4, 5]
    version, content = sn.latest(spark, path)
    stored = spark.read.parquet(*[f"{path}/{p}" for p in content["parts"]])
    assert version == 3 and stored.count() == 5


def test_a_failed_job_leaves_the_last_version(spark, tmp_path):
    path = str(tmp_path / "cache")
    before = se.update_cache(words(spark, "a", "bb"), path, lengths)
    with pytest.raises(Exception, match="no service"):
        se.update_cache(words(spark, "ccc"), path, lambda t: F.array(F.raise_error(F.lit("no service")).cast("float")))
    assert sn.latest(spark, path)[0] == 1
    assert before.count() == se.cache_table(spark, path).count() == 2


def test_plain_tables_and_many_parts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    spark.createDataFrame([("k", [1.0]), ("k", [1.0]), ("l", [2.0])], se._CACHE).write.parquet(path)
    assert se.cache_table(spark, path).count() == 2
    monkeypatch.setattr(se, "MAX_CACHE_PARTS", 3)
    for i in range(5):
        assert se.update_cache(words(spark, "x" * (i + 1)), path, lengths).count() == 3 + i
    assert len(sn.latest(spark, path)[1]["parts"]) <= 4
