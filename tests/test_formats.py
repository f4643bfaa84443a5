"""The formats of their own: a mixed folder in batch and as a stream, and the sink that appends."""

import json
import pickle
import tracemalloc

import pytest
from pyspark.sql import functions as F
from test_sources import docx

from tessella.plans.files import _pdf
from tessella.sources import files, formats


def mixed(folder):
    (folder / "deep").mkdir()
    (folder / "a.txt").write_bytes("hello\xff world".encode("latin-1"))
    (folder / "b.VTT").write_bytes(b"WEBVTT\r\n\r\nNOTE x\ny\n\n00:01 --> 00:02\n<b>Hi</b>\nHi\n\n12\n STYLE\x85no\n\n\nBye\xff\xe2\x80\xa8Bye \xc2\xa0\n<i></i>")
    (folder / "c.html").write_text('<html><head><meta name="description" content="About"></head><body><p hidden>no</p><p>Yes &amp; more</p></body></html>')
    (folder / "deep" / "d.docx").write_bytes(docx())
    (folder / "e.docx").write_bytes(b"broken")
    (folder / "f.exe").write_bytes(b"no")
    (folder / "_g.txt").write_text("a draft")
    (folder / "empty.md").write_text("")
    (folder / "h.pdf").write_bytes(b"%PDF")
    for name in ("12", "13"):
        (folder / f"{name}.pdf").write_bytes(_pdf(name, "\n".join(f"line {k} x" if k % 7 else "" for k in range(130))))


def rows(frame, below):
    return {r.path.rsplit(below, 1)[1]: ([(s.location, s.text) for s in r.sections], r.error.split(":")[0]) for r in frame.collect()}


@pytest.mark.parametrize("split", [1, 1 << 30])
def test_a_mixed_folder_gives_the_rows_of_the_native_way(spark, tmp_path, split):
    mixed(tmp_path)
    formats.register(spark)
    read = spark.read.format("tessella_files").option("splitBytes", split).load(f"file://{tmp_path}")
    assert read.rdd.getNumPartitions() == (9 if split == 1 else 1)
    found = rows(read, str(tmp_path))
    native = rows(files.sections(files.scan(spark, str(tmp_path)).where("path not like '%/_g.txt'")), str(tmp_path))
    # Spark's own format leaves out files without a byte.
    assert found == native | {"/empty.md": ([], "")} and len(found) == 9
    assert found["/b.VTT"][0] == [("transcript", "Hi\nBye�\nBye")] and len(found["/12.pdf"][0]) > 10
    some = rows(spark.read.format("tessella_files").option("suffixes", ".txt, .md").load(str(tmp_path)), str(tmp_path))
    assert set(some) == {"/a.txt", "/empty.md"}


def test_an_empty_or_missing_folder_gives_no_rows(spark, tmp_path):
    formats.register(spark)
    for path in (tmp_path, tmp_path / "none"):
        assert spark.read.format("tessella_files").load(str(path)).count() == 0
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("tessella_files").load().count()


def run(spark, source, out, checkpoint, log):
    stream = spark.readStream.format("tessella_files").option("log", str(log)).load(str(source))
    query = stream.writeStream.format("tessella_append").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out))
    assert query.awaitTermination(120)


def test_a_stream_sees_each_file_once_across_restarts(spark, tmp_path):
    formats.register(spark)
    source, out, checkpoint, log = (tmp_path / n for n in ("in", "out", "checkpoint", "log"))
    source.mkdir()
    seen = lambda: sorted(r.sections[0].text for r in formats.appended(spark, str(out), formats.SCHEMA).collect())
    run(spark, source, out, checkpoint, log)
    assert seen() == []
    (source / "a.txt").write_text("a")
    (source / "b.txt").write_text("b")
    run(spark, source, out, checkpoint, log)
    assert seen() == ["a", "b"]
    run(spark, source, out, checkpoint, log)
    (source / "c.txt").write_text("c")
    run(spark, source, out, checkpoint, log)
    assert seen() == ["a", "b", "c"]
    # A batch whose commit Spark forgot is run again and adds nothing.
    last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (checkpoint / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    run(spark, source, out, checkpoint, log)
    assert seen() == ["a", "b", "c"]
    assert len(list((out / "data").rglob("*.parquet"))) == len({r.f for r in formats.appended(spark, str(out), formats.SCHEMA).select(F.input_file_name().alias("f")).collect()})


def test_a_log_entry_that_spark_never_heard_of_is_read(tmp_path):
    """The driver may die after an entry is put up and before its number is kept."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a")
    options = {"path": str(tmp_path / "in"), "log": str(tmp_path / "log")}
    assert formats.FolderStream(options).latestOffset() == {"entry": 0}
    (tmp_path / "in" / "b.txt").write_text("b")
    again = formats.FolderStream(options)
    assert again.latestOffset() == {"entry": 1}
    names = [[p.rsplit("/", 1)[1] for s in again.partitions({"entry": k - 1}, {"entry": k}) for p in s.paths] for k in (0, 1)]
    assert names == [["a.txt"], ["b.txt"]] and again.partitions({"entry": 1}, {"entry": 1}) == []


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    formats.register(spark)
    out = f"file://{tmp_path}/out"
    good = spark.range(100).select("id", F.lit("x").alias("text")).repartition(3)
    bad = good.withColumn("text", F.when(F.col("id") == 50, F.raise_error(F.lit("dies")).cast("string")).otherwise("y"))
    good.write.format("tessella_append").mode("append").save(out)
    before = sorted(tmp_path.rglob("*.parquet"))
    with pytest.raises(Exception, match="dies"):
        bad.write.format("tessella_append").mode("append").save(out)
    assert sorted(tmp_path.rglob("*.parquet")) == before and len(before) == 3
    good.limit(0).write.format("tessella_append").mode("append").save(out)
    with pytest.raises(Exception, match="only appends"):
        good.write.format("tessella_append").mode("overwrite").save(out)
    found = formats.appended(spark, out, good.schema)
    assert found.count() == 100 and found.where("text = 'y'").count() == 0
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in found.where("id > 5")._jdf.queryExecution().toString()


def many(folder, n, folders=20):
    for k in range(folders):
        (folder / f"{k}").mkdir(parents=True)
    for k in range(n):
        (folder / f"{k % folders}" / f"{k}.txt").write_text("x")


def test_the_driver_holds_little_of_many_files(tmp_path):
    """Of each file a path, its size, a log entry and a split were held, several times over."""
    many(tmp_path / "in", 20_000)
    options = {"path": f"file://{tmp_path}/in", "log": f"file://{tmp_path}/log"}
    stream = formats.FolderStream(options)
    tracemalloc.start()
    try:
        assert stream.latestOffset() == stream.latestOffset() == {"entry": 0}
        dealt = stream.partitions({"entry": -1}, {"entry": 0})
        again = formats.FolderStream(options)
        assert again.latestOffset() == {"entry": 0}
        listed = formats.FolderReader(options).partitions()
        assert tracemalloc.get_traced_memory()[1] < 2_500_000
    finally:
        tracemalloc.stop()
    want = sorted(f"file://{p}" for p in (tmp_path / "in").glob("*/*.txt"))
    for splits in (dealt, listed):
        assert sorted(p for s in splits for p in s.paths) == want
        assert sum(len(pickle.dumps(s)) for s in splits) < 20 * len(want)
    (tmp_path / "in" / "3" / "0.txt").touch()
    (tmp_path / "in" / "x").mkdir()
    (tmp_path / "in" / "x" / "y.txt").touch()
    assert again.latestOffset() == {"entry": 1}
    assert [p.rsplit("/in/")[1] for s in again.partitions({"entry": 0}, {"entry": 1}) for p in s.paths] == ["3/0.txt", "x/y.txt"]


def test_many_small_files_share_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "MANY_TASKS", 4)
    many(tmp_path, 3_256, 3)
    sizes = [len(s.paths) for s in formats.FolderReader({"path": str(tmp_path)}).partitions()]
    assert sizes == [64] * 4 + [1_024, 1_024, 952]


def test_a_log_of_one_line_is_read(tmp_path):
    """So entries were written once."""
    many(tmp_path / "in", 6, 2)
    (tmp_path / "log").mkdir()
    old = [(f"{tmp_path}/in/{k % 2}/{k}.txt", 0) for k in (0, 1, 3)]
    (tmp_path / "log" / f"{0:020d}").write_text(json.dumps(old))
    stream = formats.FolderStream({"path": str(tmp_path / "in"), "log": str(tmp_path / "log")})
    assert stream.latestOffset() == {"entry": 1}
    names = [[p.rsplit("/", 1)[1] for s in stream.partitions({"entry": k - 1}, {"entry": k}) for p in s.paths] for k in (0, 1)]
    assert names == [["0.txt", "1.txt", "3.txt"], ["2.txt", "4.txt", "5.txt"]]
