"""The last rows that a stream keeps, sound of known features, and copies that can be cut off."""

import datetime
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.operators import audio
from lexigraph.sources import copying
from lexigraph.streaming import recent


@pytest.mark.parametrize("order", ["in order", "late"])
def test_stream_keeps_the_last_rows(spark, tmp_path, order):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(f"k{i % 3}" if i % 11 else None, t0 + datetime.timedelta(seconds=(i * 7919) % 600), i, float(i)) for i in range(600)] + [("k1", None, 900, 1.0), ("k1", t0, 901, None), ("once", t0, 902, 2.0)]
    schema = "k string, ts timestamp, i long, v double"
    dealt = sorted(rows, key=lambda r: (r[1] is None, r[1] or t0)) if order == "in order" else rows
    for n in range(4):
        spark.createDataFrame(dealt[n::4] if order == "late" else dealt[n * 151 : (n + 1) * 151], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    make = lambda: recent.last_rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"), "k", "ts", "i", "v", most=20, parts=3)
    got = {r["key"]: (r["seen"], [(x["id"], x["value"]) for x in r["rows"]]) for r in recent.merged(recent.states(spark, make), 20).collect()}
    want = {}
    for k in ("k0", "k1", "k2", "", "once"):
        mine = sorted((r[1], r[2], r[3]) for r in rows if (r[0] or "") == k and r[1] is not None and r[3] is not None)
        want[k] = len(mine), [(i, v) for _, i, v in mine[-20:]]
    assert got == want


def test_drift_by_hand(spark):
    reference = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", 1.0)], "key string, value double")
    rows = spark.createDataFrame([("a", [(i, float(v)) for i, v in enumerate([5, 15, 99, 99])]), ("c", [(1, 1.0)])], "key string, rows array<struct<id: long, value: double>>")
    got = {r["key"]: (r["n"], r["psi"]) for r in recent.drift(rows, reference).collect()}
    shares = [2 / 4, 0.5 / 4, 0.5 / 4, 0.5 / 4, 2 / 4]
    assert got == {"a": (4, pytest.approx(sum((o - 0.2) * math.log(o / 0.2) for o in shares)))}


RATE = 22050


def test_sines_have_known_features():
    t = np.arange(4 * RATE) / RATE
    for hz in (440.0, 3000.0):
        duration, _, rms, centroid, roll, zcr, width = audio.features(0.5 * np.sin(2 * np.pi * hz * t), RATE)
        assert duration == 4.0 and abs(rms - 0.5 / math.sqrt(2)) < 0.01
        assert abs(centroid - hz) < 0.05 * hz + 40 and abs(roll - hz) < 40 and abs(zcr - 2 * hz / RATE) < 0.01 * (1 + hz / RATE)
        assert width < 0.25 * hz + 200


def test_noise_and_silence():
    y = np.random.default_rng(1).normal(0, 0.1, 3 * RATE)
    _, _, rms, centroid, roll, zcr, width = audio.features(y, RATE)
    half = RATE / 2
    assert abs(rms - 0.1) < 0.005 and abs(centroid - half / 2) < 0.03 * half and abs(roll - 0.85 * half) < 0.03 * half and abs(zcr - 0.5) < 0.02
    assert abs(width - half / math.sqrt(12)) < 0.03 * half
    assert audio.features(np.zeros(RATE), RATE) == (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) == (1.0, *audio.features(np.zeros(0), RATE)[1:])


def test_clicks_give_their_tempo_and_blocks_change_nothing(monkeypatch):
    y = np.zeros(12 * RATE)
    for k in range(24):
        at = int(k * RATE / 2)
        y[at : at + 600] = np.random.default_rng(2).normal(0, 0.5, 600)
    whole = audio.features(y, RATE)
    assert abs(whole[1] - 120) < 3
    monkeypatch.setattr(audio, "STEP", 7)
    assert np.allclose(audio.features(y, RATE), whole)


def test_scan_of_a_column(spark):
    t = np.arange(RATE) / RATE
    y = 0.5 * np.sin(2 * np.pi * 440 * t)
    pcm = {8: ((y * 128) + 128).astype("u1"), 16: (y * 32768).astype("<i2"), 32: (y * 2147483648).astype("<i4")}
    for bits, raw in pcm.items():
        df = spark.createDataFrame([(1, bytearray(raw.tobytes()), "x"), (2, None, "x"), (None, bytearray(b""), "x")], "n long, pcm binary, zcr string")
        got = {r["n"]: r for r in audio.scan(df, "n", "pcm", RATE, bits).collect()}
        assert abs(got[1]["rms_energy"] - 0.5 / math.sqrt(2)) < 0.02 and got[1]["duration_s"] == 1.0 and got[2]["duration_s"] == got[None]["rms_energy"] == 0.0
    assert audio.scan(df.where("false"), "n", "pcm").count() == 0


def test_copies_are_whole_and_go_on(spark, tmp_path):
    source, target = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    df = spark.range(1000).withColumn("part", F.col("id") % 3)
    df.repartition(2).write.partitionBy("part").parquet(source)
    first = {r["file"]: r for r in copying.copy_table(spark, source, target, step=1000).collect()}
    assert len(first) == 6 and all(r["copied"] for r in first.values()) and all("part=" in f for f in first)
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == sorted(map(tuple, spark.read.parquet(source).collect()))
    # what was cut off, lost or changed is copied again, and nothing else
    names = sorted(first)
    raw = (tmp_path / "b" / names[0]).read_bytes()
    (tmp_path / "b" / names[0]).write_bytes(raw[:-1] + bytes([raw[-1] ^ 1]))
    os.remove(tmp_path / "b" / names[1])
    (tmp_path / "b" / names[1]).with_name("_copying-" + os.path.basename(names[1])).write_bytes(b"part")
    manifest = spark.createDataFrame([(r["file"], r["n_bytes"], r["sha256"], True) for r in first.values()], copying.MANIFEST)
    assert [r["file"] for r in copying.differing(spark, manifest, target).collect()] == names[:2]
    again = {r["file"]: r["copied"] for r in copying.copy_table(spark, source, target).collect()}
    assert {f for f, c in again.items() if c} == set(names[:2]) and copying.differing(spark, manifest, target).count() == 0
    os.mkdir(tmp_path / "none")
    assert copying.copy_table(spark, f"file://{tmp_path}/none", target).count() == 0
    one = copying.copy_table(spark, f"{source}/{names[0]}", f"file://{tmp_path}/c/one.parquet").collect()
    assert (tmp_path / "c" / "one.parquet").read_bytes() == (tmp_path / "a" / names[0]).read_bytes() and one[0]["copied"]
