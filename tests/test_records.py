"""Record rules, sources and models against hand values."""

import io
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audits as D
from tidemark.operators import models as L
from tidemark.operators import sequences as S
from tidemark.sources import audio, readers


def test_wav_kinds_ranges_and_errors(spark):
    def pcm(width, data, channels=1):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(width)
            w.setframerate(100)
            w.writeframes(data)
        return out.getvalue()

    stereo = np.array([[16384, -16384], [32767, 32767]], "<i2").tobytes()
    rows = spark.createDataFrame([("a", pcm(1, bytes([128, 192, 0]))), ("b", pcm(2, stereo, 2)), ("c", b"RIFFxxxx"), ("d", None), ("e", pcm(3, bytes(6)))], "path string, content binary")
    got = {r.path: r for r in audio.read_wav(rows).collect()}
    assert got["a"].samples == [0.0, 0.5, -1.0] and got["b"].samples == pytest.approx([0.0, 32767 / 32768]) and got["b"].channels == 2
    assert all(got[x].error and got[x].samples is None for x in "cde")
    assert audio.decoded(audio.encoded(np.arange(100), 100), 0.25, 0.5)[2].tolist() == pytest.approx([i / 32768 for i in range(25, 50)])


def test_members_are_checked(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x.txt", "abc")
    members = readers.zip_members(spark.createDataFrame([("a.zip", bytearray(buffer.getvalue()))], "path string, content binary"))
    good = members.select("member", "size", "crc")
    assert readers.checked_members(members, good).first().content == b"abc"
    for bad in (good.withColumn("crc", F.lit(1)), good.withColumn("member", F.lit("y.txt"))):
        with pytest.raises(Exception, match="not as expected"):
            readers.checked_members(members, bad).collect()


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert readers.retried(flaky, sleep=waits.append) == "ok" and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        readers.retried(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)


def test_reading_stops_early(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = readers.until(spark.range(0, 1000, 1, 1), lambda b: b.column(0)[-1].as_py() >= 25, "id bigint")
        assert rows.count() == 30
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shortages_and_leaks_fail(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert S.fixed_count(df.where("k = 'a'"), "k", ["v"], 1).count() == 1
    with pytest.raises(ValueError, match="too few"):
        S.fixed_count(df, "k", ["v"], 2)
    with pytest.raises(ValueError, match="held-out"):
        D.assert_disjoint(df, df.where("k = 'b'"), "k")


def test_models_separate_two_clouds(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=4) + (4 if i % 2 else -4)).tolist(), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "i bigint, x array<double>, y int")
    for name in L.MODELS:
        got = L.scored(df.where("i < 80"), df.where("i >= 80"), name, "x", "y").collect()
        assert all((r.score > 0.5) == (r.y == 1) for r in got), name
    assert L.cluster_count(df, "x", 4) == 2 and L.cluster_count(df.limit(2), "x", 4) == 1


def test_folds_are_disjoint_and_found_behind_a_dead_end():
    from tidemark.operators.splits import disjoint_folds

    # the best set {b, c} leaves no two others
    good = {("b", "c"): 0, ("a", "b"): 1, ("c", "d"): 2}
    assert disjoint_folds(list("abcd"), 2, 2, good.get) == [("a", "b"), ("c", "d")]
    with pytest.raises(ValueError):
        disjoint_folds(list("abcd"), 2, 2, {("b", "c"): 0}.get)


def test_a_design_needs_its_rows(spark):
    with pytest.raises(ValueError, match="more rows"):
        S.registered(spark.createDataFrame([("a", 1)], "k string, v int"), "k", ["v"], {"a": 1, "b": 1})


def test_pools_are_suppressed_then_capped(spark):
    from tidemark.operators.proposals import pooled

    rows = [(1, "a", 0.0, 10.0, 0.9, 1), (1, "a", 1.0, 10.0, 0.8, 2), (1, "a", 20.0, 30.0, 0.7, 3), (1, "a", 40.0, 50.0, 0.6, 4), (1, "b", 0.0, 10.0, 0.5, 5), (2, "a", 0.0, 1.0, 0.1, 6)]
    df = spark.createDataFrame(rows, "scene int, label string, onset double, off double, conf double, event_id int")
    got = {(r.event_id, r.rank) for r in pooled([df.where("event_id % 2 = 0"), df.where("event_id % 2 = 1")], ["scene"], 0.5, 2, 2).collect()}
    assert got == {(1, 1), (3, 2), (6, 1)}


def test_strict_scans_need_newlines_and_files_that_stay(spark, tmp_path):
    at = tmp_path / "rows"
    at.mkdir()
    (at / "a.json").write_text('{"k": 1}\n{"k": 2}\n')
    total = lambda df: df.agg(F.sum("k")).first()[0]
    assert readers.scanned_strictly(spark, str(at), "k int", total) == 3

    def meanwhile(df):
        (at / "a.json").write_text('{"k": 1}\n{"k": 22}\n')
        return total(df)

    with pytest.raises(ValueError, match="changed"):
        readers.scanned_strictly(spark, str(at), "k int", meanwhile)
    for bad in ('{"k": 1}', ""):
        (at / "b.json").write_text(bad)
        with pytest.raises(ValueError, match="newline"):
            readers.scanned_strictly(spark, str(at), "k int", total)
    (at / "b.json").write_text('{"k": 1}\n\n')
    with pytest.raises(Exception, match="blank line"):
        readers.scanned_strictly(spark, str(at), "k int", total)


def test_prohibited_names_at_any_depth():
    from tidemark.functions.text import prohibited_in

    assert prohibited_in('{"a": [{"Oracle-x": 1}, [{"sdr": {}}]], "b": "oracle", "c": {"best_ORACLE": {"sdr": 1}}}') == ["a[].Oracle-x", "a[][].sdr", "c.best_ORACLE", "c.best_ORACLE.sdr"]
    assert prohibited_in("{") is None and prohibited_in(None) is None and prohibited_in("[1, null]") == []
