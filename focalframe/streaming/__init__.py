"""Incremental forms: the folds are associative and break ties by frame, so a streaming aggregation keeps them up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import catalog, fuse, projects


def follow_winners(energy: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps (y, x, winner, energy) of a stream of ``energy(frame, y, x, v)`` in the memory table ``name``."""
    return fuse.winners(energy).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_jobs(events: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last status of each job of a stream of ``events(job_id, status, seq)`` in the memory table ``name``."""
    return catalog.latest_jobs(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_states(events: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps the state of each job of a stream of ``events(job_id, seq, kind)`` in the memory table ``name``."""
    return projects.job_states(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of job events to a table partitioned by batch. A batch that a restarted stream brings again replaces its own partition, so no event is there twice."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number).cast("long"))
        if rows.isEmpty():
            return
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grouped_by_gaps(frames: DataFrame, max_seconds: float = 10.0) -> DataFrame:
    """(stack, frame, grp) of a stream of ``frames(stack, frame, captured TIMESTAMP)`` that comes in order of time: a pause of more than ``max_seconds`` begins a new group.

    A list's state is its last time and group, whatever the length of the stream. Frames without a time join the group before them.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, grp = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values(["captured", "frame"], na_position="last")
        groups = []
        for captured in rows["captured"]:
            if not pd.isna(captured):
                now = captured.timestamp()
                grp += last is not None and abs(now - last) > max_seconds
                last = now
            groups.append(grp)
        state.update((last, grp))
        yield pd.DataFrame({"stack": key[0], "frame": rows["frame"].to_numpy(), "grp": groups})

    return frames.groupBy("stack").applyInPandasWithState(run, "stack string, frame long, grp int", "last double, grp int", "append", GroupStateTimeout.NoTimeout)


def stroke_history(log: DataFrame) -> DataFrame:
    """(session, seq, n, last) of a stream of ``log(session, seq, action, stroke)`` in order of seq: after each entry the number of live strokes and the last of them.

    A session's state is its live strokes and those undone, as ``retouch.live_strokes`` keeps them.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, undone = (list(x) for x in state.get) if state.exists else ([], [])
        rows, out = pd.concat(list(parts)).sort_values("seq"), []
        for seq, action, stroke in zip(rows["seq"], rows["action"], rows["stroke"]):
            if action == "apply":
                done.append(int(stroke))
                undone.clear()
            elif action == "undo" and done:
                undone.append(done.pop())
            elif action == "redo" and undone:
                done.append(undone.pop())
            out.append((key[0], seq, len(done), done[-1] if done else None))
        state.update((done, undone))
        yield pd.DataFrame(out, columns=["session", "seq", "n", "last"]).astype({"last": "Int64"})

    return log.groupBy("session").applyInPandasWithState(run, "session long, seq long, n int, last long", "done array<long>, undone array<long>", "append", GroupStateTimeout.NoTimeout)
