"""Sources, stages, streaming and scalar functions."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsieve.functions import scalar
from clipsieve.sources import lerobot, stages
from clipsieve.streaming import ensemble


@pytest.fixture
def dataset(spark, tmp_path):
    rows = [(e, k, k / 10, e % 2, [float(k), 1.0], [float(e)]) for e, n in ((0, 3), (1, 2), (2, 4)) for k in range(n)]
    frames = spark.createDataFrame(rows, "episode_id long, frame_index long, timestamp double, task_index long, state array<double>, action array<double>")
    episodes = spark.createDataFrame([(0, 3, "push"), (1, 2, "pull"), (2, 4, "push")], "episode_id long, length long, task_name string")
    tasks = spark.createDataFrame([(0, "push"), (1, "pull")], "task_index long, task string")
    lerobot.write(frames, episodes, tasks, str(tmp_path / "d"))
    return str(tmp_path / "d")


def test_round_trip(spark, dataset):
    episodes = lerobot.episodes(spark, dataset)
    assert {r["episode_id"]: (r["length"], r["task_index"]) for r in episodes.collect()} == {0: (3, 0), 1: (2, 1), 2: (4, 0)}
    frames = lerobot.frames(spark, dataset)
    assert frames.count() == 9 and lerobot.frames(spark, dataset, most=2).count() == 5 and lerobot.subset(frames, [2]).count() == 4
    assert lerobot.violations(frames, episodes).count() == 0
    with pytest.raises(ValueError):
        lerobot.subset(frames, [1, 1])


def test_violations_are_named(spark, dataset):
    frames, episodes = lerobot.frames(spark, dataset), lerobot.episodes(spark, dataset)
    bad = frames.filter("NOT (episode_id = 0 AND frame_index = 1)").withColumn("action", F.when(F.col("episode_id") == 1, F.array(F.lit(float("nan")))).otherwise(F.col("action")))
    found = {(r["episode_id"], r["rule"]) for r in lerobot.violations(bad, episodes.filter("episode_id != 2")).collect()}
    assert found == {(0, "wrong_length"), (0, "frames_not_contiguous"), (1, "not_finite"), (2, "unknown_episode")}


def test_empty_and_unknown_tasks(spark, tmp_path):
    meta = tmp_path / "meta"
    meta.mkdir()
    (meta / "tasks.jsonl").write_text('{"task_index": 0, "task": "push"}\n')
    (meta / "episodes.jsonl").write_text('{"episode_index": 0, "tasks": ["push"], "length": 3}\n\n{"episode_index": 1, "tasks": [" "], "length": 3}\n')
    with pytest.raises(lerobot.InvalidDataset, match="empty task"):
        lerobot.episodes(spark, str(tmp_path))
    assert lerobot.episodes(spark, str(tmp_path), "exclude").count() == 1
    (meta / "episodes.jsonl").write_text('{"episode_index": 0, "tasks": ["fly"], "length": 3}\n')
    with pytest.raises(lerobot.InvalidDataset, match="unknown task"):
        lerobot.episodes(spark, str(tmp_path))


def test_publish_keeps_the_old_stage_on_errors(tmp_path):
    def build(text):
        def write(folder):
            (folder / "out.txt").write_text(text)
            return {"rows": 1}
        return write

    def fail(folder):
        raise RuntimeError("no")

    target = tmp_path / "stage"
    assert stages.publish(target, "a", build("1"), ["out.txt"]) and not stages.publish(target, "a", build("2"), ["out.txt"])
    with pytest.raises(RuntimeError):
        stages.publish(target, "b", fail)
    with pytest.raises(FileNotFoundError):
        stages.publish(target, "b", build("3"), ["other.txt"])
    assert (target / "out.txt").read_text() == "1" and stages.is_current(target, "a", ["out.txt"]) and not stages.is_current(target, "b")
    assert stages.publish(target, "b", build("4"), ["out.txt"], force=True) and (target / "out.txt").read_text() == "4"
    assert [p.name for p in tmp_path.iterdir()] == ["stage"]


def test_ordered_digest(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 3), ("c", 1)], "sample_id string, place long")
    assert stages.ordered_digest(rows, "sample_id", "place").first()[0] == hashlib.sha256(b"c\0b\0a\0").hexdigest()
    assert stages.stable_hash({"b": 1, "a": [1.5]}) == hashlib.sha256(json.dumps({"a": [1.5], "b": 1}, separators=(",", ":")).encode()).hexdigest()


def test_differences(spark):
    a, b = spark.createDataFrame([(1, 0.1), (2, 0.2)], "k long, x double"), spark.createDataFrame([(1, 0.1 + 1e-9), (2, 0.3)], "k long, x double")
    assert sorted(r["side"] for r in stages.differences(a, b).collect()) == ["a", "b"]


def test_rotations(spark):
    half = math.sqrt(0.5)
    row = spark.createDataFrame([([0.0, 0.0, half, half], [0.0, 0.0, -half, -half], [0.0, 0.0, 0.0, 1.0], 4.0)], "q array<double>, m array<double>, i array<double>, a double").select(
        scalar.quaternion_axis_angle(F.col("q")).alias("v"), scalar.quaternion_axis_angle(F.col("i")).alias("z"), scalar.quaternion_angle(F.col("q"), F.col("i")).alias("d"),
        scalar.quaternion_angle(F.col("q"), F.col("m")).alias("s"), scalar.wrapped_angle(F.col("a")).alias("w")).first()
    assert row["v"] == pytest.approx([0, 0, math.pi / 2]) and row["z"] == [0, 0, 0] and row["d"] == pytest.approx(math.pi / 2) and row["s"] == pytest.approx(0) and row["w"] == pytest.approx(4 - 2 * math.pi)


def test_text_functions(spark):
    rows = spark.createDataFrame([("KITCHEN_SCENE3_Turn_on_the_stove_demo.hdf5", " ", ["", "do it"], 3)], "name string, task string, own array<string>, episode long")
    row = rows.select(scalar.instruction_from_name(F.col("name")).alias("a"), scalar.instruction(F.col("task"), F.col("own"), "go").alias("b"), scalar.is_validation(F.lit(7), "episode", F.lit(50)).alias("c")).first()
    assert row["a"] == "turn on the stove" and row["b"] == "do it"
    assert row["c"] == (int.from_bytes(hashlib.blake2b(b"7:3", digest_size=8).digest(), "big") % 100 < 50)


def test_stream_ensemble(spark, tmp_path):
    rows = [(e, k, float(e * 10 + k)) for e in range(2) for k in range(6)]
    spark.createDataFrame(rows, "episode_id long, frame_index long, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("episode_id long, frame_index long, value double").parquet(str(tmp_path / "in"))
    query = ensemble.ensemble(stream).writeStream.format("memory").queryName("ensembled").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["episode_id"], r["frame_index"]): r["ensembled"] for r in spark.table("ensembled").collect()}
    w = np.exp(-0.1 * np.arange(4))
    assert len(got) == 12 and got[0, 0] == pytest.approx(0) and got[1, 5] == pytest.approx(np.dot(w, [12, 13, 14, 15]) / w.sum())


def test_chunk_ensemble(spark, tmp_path):
    """The stream gives what the batch form gives, and both the plain mean of aligned predictions."""
    chunks = {(e, k): [[float(e + 10 * k + j), float(-j)] for j in range(4)] for e in range(2) for k in range(6)}
    rows = spark.createDataFrame([(e, k, c) for (e, k), c in chunks.items()], ensemble.CHUNK_INPUT)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ensemble.CHUNK_INPUT).parquet(str(tmp_path / "in"))
    query = ensemble.chunk_ensemble(stream, 4, 0.3).writeStream.format("memory").queryName("aligned").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    for table in (spark.table("aligned"), ensemble.aligned_chunks(rows, 2, 4, 0.3)):
        got = {(r["episode_id"], r["frame_index"]): list(r["ensembled"]) for r in table.collect()}
        assert len(got) == 12
        for (e, k), action in got.items():
            back = list(range(min(k, 3), -1, -1))
            w = np.exp(-0.3 * np.arange(len(back)))
            assert action == pytest.approx(list(w / w.sum() @ np.array([chunks[e, k - b][b] for b in back])))
