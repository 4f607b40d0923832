"""Job tags and cancelling, events that are published once, numbers in a global order, job order."""

import random
import threading
import time

from pyspark.sql import functions as F

from focalframe import streaming
from focalframe.jobs import Job
from focalframe.operators import catalog, dense, geometry
from focalframe.operators.ordinal import numbered


def slow(spark):
    """A fusion whose kernel would take minutes."""

    def sleepy(batches):
        for batch in batches:
            time.sleep(60)
            yield batch

    frames = spark.createDataFrame([(k, y, [k + y] * 8, 8) for k in range(3) for y in range(8)], "frame int, y int, row array<bigint>, height int")
    late = frames.mapInArrow(sleepy, frames.schema)
    return dense.fused_by("weighted", late, sharpness_radius=2)


def test_a_running_fusion_stops(spark):
    events, begun = [], threading.Event()

    def work(progress):
        progress("fusing", 0.1)
        begun.set()
        return slow(spark).collect()

    job = Job(spark, "job-1", work, events.append).start()
    assert begun.wait(30)
    running = lambda: spark.sparkContext._jsc.sc().statusTracker().getActiveJobIds()
    while not len(running()):
        time.sleep(0.2)
    started = time.time()
    assert job.cancel() and job.wait(30) == "cancelled" and time.time() - started < 25
    assert [e["status"] for e in events] == ["running", "running", "cancelled"] and [e["seq"] for e in events] == [0, 1, 2]
    assert not job.cancel() and spark.range(5).count() == 5


def test_only_the_tagged_work_is_stopped(spark):
    def work(progress):
        return sum(r["id"] for r in spark.range(100).collect())

    other = Job(spark, "job-a", work).start()
    waiting = Job(spark, "job-b", work)
    assert waiting.cancel() and waiting.status == "cancelled" and waiting.start().wait() == "cancelled"
    assert other.wait(60) == "done" and other.result == 4950 and other.percent == 1.0 and not other.cancel()


def test_errors_and_cancels_between_jobs(spark):
    events = []

    def broken(progress):
        raise ValueError("no frames")

    assert Job(spark, "job-e", broken, events.append).start().wait(30) == "error" and events[-1]["error"] == "no frames"
    gate = threading.Event()

    def stepping(progress):
        gate.wait(30)
        progress("next", 0.5)

    job = Job(spark, "job-s", stepping).start()
    job.cancel()
    gate.set()
    assert job.wait(30) == "cancelled"


def test_a_restarted_stream_publishes_no_event_twice(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "job_id long, seq long, status string"

    def more(n):
        spark.createDataFrame([(n, k, "running") for k in range(4)], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        streaming.publish(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), target, checkpoint).awaitTermination()

    more(1)
    more(2)
    run()
    first = spark.read.parquet(target)
    assert first.count() == 8 and first.select("batch").distinct().count() == 2
    # The driver died after a batch was written and before its commit was noted: the batch comes again.
    last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    more(3)
    run()
    rows = [tuple(r) for r in spark.read.parquet(target).select("job_id", "seq").collect()]
    assert sorted(rows) == [(n, k) for n in (1, 2, 3) for k in range(4)]


def test_numbers_follow_the_order(spark):
    rnd = random.Random(1)
    values = [(rnd.choice([None, 1, 2, 3]), k) for k in range(500)]
    df = spark.createDataFrame(values, "a int, b int").repartition(7)
    got = {(r["a"], r["b"]): r["position"] for r in numbered(df, F.col("a").desc_nulls_last(), "b").collect()}
    want = sorted(values, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [got[v] for v in want] == list(range(500))
    assert numbered(df.where("false"), "b").count() == 0
    pairs = geometry.consecutive_pairs(spark.createDataFrame([(5,), (2,), (9,)], "frame int")).collect()
    assert sorted(map(tuple, pairs)) == [(0, 2, 5), (1, 5, 9)]


def ordered(jobs, wanted):
    """As a list is reordered: the first of the others stays in front."""
    status = dict(jobs)
    moved = [j for j in wanted if status.get(j) == "pending"]
    rest = [j for j, _ in jobs if j not in moved]
    return rest[:1] + moved + rest[1:]


def test_job_order(spark):
    rnd = random.Random(3)
    for n in (0, 1, 5, 9):
        for _ in range(2):
            jobs = [(k, rnd.choice(["pending", "pending", "running", "done"])) for k in range(n)]
            wanted = rnd.sample(range(n + 2), min(n, 4))
            have = spark.createDataFrame([(j, s, k) for k, (j, s) in enumerate(jobs)], "job_id int, status string, seq int")
            order = spark.createDataFrame([(j, k) for k, j in enumerate(wanted)], "job_id int, wanted int")
            got = {r["job_id"]: r["position"] for r in catalog.job_order(have, order).collect()}
            assert sorted(got, key=got.get) == ordered(jobs, wanted) and sorted(got.values()) == list(range(n))
