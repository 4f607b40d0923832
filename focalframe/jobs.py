"""Work under a job tag: it reports its states as events, and a cancel from another thread stops its running tasks."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

#: States that a job does not leave.
ENDED = ("done", "error", "cancelled")


class Job:
    """One piece of work of a session, in a thread of its own, whose Spark jobs carry the tag ``job_id``.

    ``work(progress)`` may call ``progress(message, share)``. ``on_event`` gets a dict (job_id, seq, status, stage, percent, error) for each change.
    """

    def __init__(self, spark: SparkSession, job_id: str, work: Callable[[Callable[[str, float], None]], Any], on_event: Callable[[dict], None] = lambda e: None) -> None:
        self.spark, self.job_id, self.work, self.on_event = spark, job_id, work, on_event
        self.status, self.stage, self.percent, self.error, self.result = "pending", "", 0.0, None, None
        self._lock, self._seq, self._asked = threading.RLock(), 0, False
        self._thread: InheritableThread | None = None

    def _tell(self, **changes: Any) -> None:
        with self._lock:
            for name, value in changes.items():
                setattr(self, name, value)
            self.on_event({"job_id": self.job_id, "seq": self._seq, "status": self.status, "stage": self.stage, "percent": self.percent, "error": self.error})
            self._seq += 1

    def start(self) -> Job:
        """Begins the work, unless the job was cancelled before."""
        with self._lock:
            if self.status == "pending":
                self._tell(status="running")
                self._thread = InheritableThread(target=self._run, session=self.spark)
                self._thread.start()
        return self

    def _run(self) -> None:
        self.spark.sparkContext.addJobTag(self.job_id)
        try:
            self.result = self.work(self._progress)
            # A cancel that came after the last Spark job has nothing left to stop.
            self._tell(status="done", percent=1.0)
        except Exception as e:  # noqa: BLE001
            if self._asked:
                self._tell(status="cancelled")
            else:
                self._tell(status="error", error=str(e))
        finally:
            self.spark.sparkContext.removeJobTag(self.job_id)

    def _progress(self, message: str, share: float) -> None:
        """Between Spark jobs a cancel takes effect here."""
        if self._asked:
            raise InterruptedError(self.job_id)
        self._tell(stage=message, percent=float(share))

    def cancel(self) -> bool:
        """Stops the job: one that waits is cancelled at once, of one that runs the Spark jobs are interrupted. False if it has ended already."""
        with self._lock:
            if self.status in ENDED:
                return False
            self._asked = True
            if self.status == "pending":
                self._tell(status="cancelled")
                return True
        threading.Thread(target=self._stop, daemon=True).start()
        return True

    def _stop(self) -> None:
        """Work may be between two Spark jobs when the cancel comes, so those that it still begins are stopped too."""
        while self.status not in ENDED:
            self.spark.sparkContext.cancelJobsWithTag(self.job_id)
            time.sleep(0.2)

    def wait(self, seconds: float | None = None) -> str:
        """The state when the work has ended, or after ``seconds``."""
        if self._thread is not None:
            self._thread.join(seconds)
        return self.status
