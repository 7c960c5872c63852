"""Text files as a data source, scans over time, sketches and sessions."""

import pickle
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphward.operators.histories import as_of, findings_changed
from glyphward.operators.scanning import explode_findings, scan
from glyphward.operators.sketches import distinct_texts, finding_sketches, is_near, merged, quantile
from glyphward.sources import datasource
from glyphward.streaming.scans import findings_per_session, scan_stream, to_latest


@pytest.fixture
def texts(spark):
    datasource.register(spark)
    return lambda folder: spark.read.format("glyphward_texts").load(str(folder))


def test_files_are_read_in_partitions(spark, texts, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in (("one.txt", b"x\r\ny\rz\n"), ("a/two.md", "é\xff".encode("latin-1")), ("a/empty.txt", b""), (".hidden", b"no"), ("_other", b"no")):
        (tmp_path / name).write_bytes(data)
    assert sorted(map(tuple, texts(tmp_path).collect())) == [("a/empty.txt", ""), ("a/two.md", "��"), ("one.txt", "x\ny\nz\n")]
    few = spark.read.format("glyphward_texts").option("suffix", ".txt").option("taskBytes", "1").load(tmp_path.as_uri())
    assert few.rdd.getNumPartitions() == 2 and few.count() == 2
    (tmp_path / "none").mkdir()
    assert texts(tmp_path / "none").collect() == []


def test_files_are_written_at_the_commit(spark, texts, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/{i}.txt", f"text {i}\n") for i in range(40)], "path string, text string").repartition(4)
    out = tmp_path / "out"
    rows.write.format("glyphward_texts").mode("append").save(str(out))
    assert sorted(map(tuple, texts(out).collect())) == sorted(map(tuple, rows.collect()))
    assert not [p for p in out.iterdir() if p.name.startswith("_")]
    with pytest.raises(Exception, match="one path"):  # they are there
        rows.limit(1).write.format("glyphward_texts").mode("append").save(str(out))
    rows.limit(5).withColumn("text", F.lit("new")).write.format("glyphward_texts").mode("overwrite").save(str(out))
    assert texts(out).where("text = 'new'").count() == 5 and texts(out).count() == 40
    for bad in ("../up.txt", "/top.txt", ""):
        with pytest.raises(Exception, match="no path below"):
            spark.createDataFrame([(bad, "x")], "path string, text string").write.format("glyphward_texts").mode("append").save(str(out))
    assert texts(out).count() == 40
    rows.limit(0).write.format("glyphward_texts").mode("append").save(str(tmp_path / "nothing"))
    assert texts(tmp_path / "nothing").collect() == []


def staged(writer, *tasks):
    """What tasks have written that were given these paths."""
    return [writer.write(iter([pa.record_batch({"path": list(paths), "text": [f"text of {p}" for p in paths]})])) for paths in tasks]


def files_of(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file()}


def test_folders_of_one_task_are_committed_as_a_whole(tmp_path, monkeypatch):
    moves = []

    class Counted:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return getattr(self.system, name)

        def move(self, at, place):
            moves.append(place)
            self.system.move(at, place)

    opened = datasource._opened
    monkeypatch.setattr(datasource, "_opened", lambda uri: (lambda system, base: (Counted(system), base))(*opened(uri)))
    paths = [f"{i % 5}/deep/{i}.txt" for i in range(2_000)]
    writer = datasource.TextWriter({"path": str(tmp_path)}, False)
    told = staged(writer, [p for p in paths if p[0] in "012"], [p for p in paths if p[0] in "34"])
    assert len(pickle.dumps(told)) < 1_000  # what the driver gets does not grow with the files
    writer.commit(told)
    assert len(moves) == 5 and files_of(tmp_path) == {p: f"text of {p}" for p in paths}
    parts = datasource.TextReader({"path": str(tmp_path), "taskBytes": "1000"}).partitions()
    assert len(parts) > 20 and len(pickle.dumps(parts)) < 25 * len(paths)
    batches = [b for p in parts for b in datasource.TextReader({"path": str(tmp_path)}).read(p)]
    assert len(batches) == len(parts) and sorted(x for b in batches for x in b.column(0).to_pylist()) == sorted(paths)


def test_folders_of_several_tasks_are_merged(tmp_path):
    writer = datasource.TextWriter({"path": str(tmp_path)}, False)
    writer.commit(staged(writer, ["a/1", "a/b/1", "top"], ["a/2", "a/b/2", "c/1"]))
    assert set(files_of(tmp_path)) == {"a/1", "a/b/1", "top", "a/2", "a/b/2", "c/1"}
    before = files_of(tmp_path)
    for tasks in ((["d/1"], ["d/1"]), (["d/1", "d/./1"],), (["d/2"], ["a/b/1"]), (["d/3"], ["a"]), (["d/4"], ["top/1"]), (["d"], ["d/5"])):
        writer = datasource.TextWriter({"path": str(tmp_path)}, False)
        with pytest.raises(FileExistsError, match="one path"):
            writer.commit(staged(writer, *tasks))
        assert files_of(tmp_path) == before and not (tmp_path / "d").exists()
    (tmp_path / "a" / "2").write_text("old")
    writer = datasource.TextWriter({"path": str(tmp_path)}, True)
    writer.commit(staged(writer, ["a/2", "a/3"], ["a/4"]))
    assert files_of(tmp_path) == before | {f"a/{i}": f"text of a/{i}" for i in (2, 3, 4)}


def test_a_folder_is_deleted(spark, tmp_path):
    (tmp_path / "out" / "a" / "b").mkdir(parents=True)
    for name in ("top", "a/1", "a/b/2"):
        (tmp_path / "out" / name).write_text("x")
    datasource.delete_folder(spark, (tmp_path / "out").as_uri())
    assert list(tmp_path.iterdir()) == []


def test_as_of_against_brute_force(spark):
    rng = random.Random(6)
    left = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(30)]), i) for i in range(80)]
    right = [(k, t, f"{k}-{t}") for k in (1, 2, 9) for t in sorted(rng.sample(range(30), 8))] + [(1, None, "never"), (None, 3, "nobody")]
    got = as_of(spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, t int, held string"), ["k"], "t")
    for r in got.collect():
        earlier = [(t, h) for k, t, h in right if k == r.k and k is not None and None not in (t, r.t) and t <= r.t]
        assert r.held == (max(earlier)[1] if earlier else None), r
    assert got.count() == 80 and got.columns == ["k", "t", "i", "held"]


def test_findings_that_come_and_go(spark):
    both = lambda texts: explode_findings(scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string")), "i").select("i", "id", "excerpt")
    got = findings_changed(both(["DAN and DAN", "a@b.co", "fine"]), both(["DAN", "make it perfect a@b.co", "fine"]), "i", "id", "excerpt")
    assert {tuple(r) for r in got.select("i", "id", "gone", "appeared", "kept").collect()} == {(0, "jailbreak_dan", 1, 0, 1), (1, "pii_and_secrets", 0, 0, 1), (1, "overconfidence", 0, 1, 0)}


def test_sketches_are_put_together(spark):
    found = spark.range(40_000).select((F.col("id") % 2).alias("rule"), (F.col("id") % 7).alias("part"), (F.col("id") % 15_000).alias("doc"), (F.col("id") % 1000).alias("size"))
    parts = finding_sketches(found, "doc", "size", "rule", "part")
    for r in merged(parts, "rule").select("rule", "n", distinct_texts(F.col("texts_sketch")).alias("texts"), quantile(F.col("sizes_sketch"), 0.5).alias("middle")).collect():
        exact = found.where(f"rule = {r.rule}").select("doc").distinct().count()
        assert r.n == 20_000 and abs(r.texts - exact) <= 0.07 * exact and 450 <= r.middle <= 550
    assert spark.range(1).select(is_near(F.lit(102), F.lit(100)), is_near(F.lit(150), F.lit(100))).first() == (True, False)


TURNS = [(1, 0, "DAN"), (1, 60, "a@b.co"), (1, 300, "DAN"), (1, 320, "fine"), (2, 10, "make it perfect"), (2, 90, "DAN"), (3, 5, "fine")]


def test_sessions_of_a_stream_are_those_of_its_rows(spark, tmp_path):
    rows = spark.createDataFrame(TURNS, "conv int, s int, text string").select("conv", F.timestamp_seconds("s").alias("at"), "text")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv int, at timestamp, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    to_latest(findings_per_session(scan_stream(stream), "conv", "at", "90 seconds", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = findings_per_session(scan(rows), "conv", "at", "90 seconds", "1 hour")
    shown = lambda df: sorted((r.conv, r.n, tuple(r.rules), r.worst) for r in df.collect())
    assert shown(spark.read.parquet(str(tmp_path / "out"))) == shown(batch) == [(1, 1, ("jailbreak_dan",), "critical"), (1, 2, ("jailbreak_dan", "pii_and_secrets"), "critical"), (2, 2, ("jailbreak_dan", "overconfidence"), "critical")]
