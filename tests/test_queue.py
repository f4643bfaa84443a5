"""The queue as a stream: claims, attempts, timeouts by timer, restarts."""

from tessella.streaming import queue

EVENTS = "job_id long, seq long, at double, kind string, error string"


def read(spark, path):
    return sorted((r.job_id, r.at, r.status, r.attempts, r.cause) for r in spark.read.parquet(path).collect())


def test_life_of_jobs(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))

    def feed(rows):
        spark.createDataFrame(rows, EVENTS).repartition(1).write.mode("append").parquet(source)
        queue.run_queue(spark.readStream.schema(EVENTS).parquet(source), out, mark)
        return read(spark, out)

    first = feed([(1, 1, 10.0, "request", None), (1, 2, 20.0, "claim", None), (1, 3, 21.0, "claim", None), (2, 4, 30.0, "request", None), (2, 5, 40.0, "claim", None), (2, 6, 50.0, "fail", "x" * 600), (None, 7, 60.0, "claim", None)])
    assert first == [(1, 10.0, "queued", 0, "request"), (1, 20.0, "running", 1, "claim"), (2, 30.0, "queued", 0, "request"), (2, 40.0, "running", 1, "claim"), (2, 50.0, "queued", 1, "fail")]
    # Another job's event moves the time on: job 1 comes back by its timer, without an event of its own.
    second = feed([(3, 8, 1_900.0, "request", None)])
    assert [r for r in second if r not in first] == [(1, 1_820.001, "queued", 1, "timeout"), (3, 1_900.0, "queued", 0, "request")]
    # Two more attempts and it fails for good; the same events again change nothing.
    more = [(1, 9, 1_950.0, "claim", None), (1, 10, 1_960.0, "fail", "boom"), (1, 11, 1_970.0, "claim", None), (1, 12, 1_980.0, "fail", "boom"), (1, 13, 1_990.0, "claim", None)]
    third = feed(more)
    assert third[-2:] == feed(more)[-2:] and len(read(spark, out)) == len(third)
    got = {r.job_id: (r.status, r.attempts, r.error) for r in queue.states(spark.read.parquet(out)).collect()}
    assert got == {1: ("failed", 3, "boom"), 2: ("queued", 1, "x" * 500), 3: ("queued", 0, "")}
    # A run without anything new repeats nothing.
    queue.run_queue(spark.readStream.schema(EVENTS).parquet(source), out, mark)
    assert read(spark, out) == read(spark, out) and len(read(spark, out)) == len(third)


def test_rules():
    assert queue.advance(None, 1.0, "claim", "") is None and queue.advance(None, 1.0, "done", "") is None
    assert queue.advance(("done", 2, None, ""), 1.0, "request", "") == ("queued", 0, None, "")
    assert queue.advance(("running", 3, 1.0, ""), 2.0, "fail", "e") == ("failed", 3, None, "e")
    assert queue.timed_out(("running", 1, 0.0, ""), 1_800.0) is None
    assert queue.timed_out(("running", 3, 0.0, ""), 1_801.0) == ("failed", 3, None, "worker lost")
