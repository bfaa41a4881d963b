"""Streams of state (W2-W5) and their batch twins; W1 is ``plenum.streaming.ingest``."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Status names of rendering services.
STATUS_NAMES = {"pending": "queued", "queued": "queued", "processing": "rendering", "running": "rendering", "rendering": "rendering", "completed": "completed", "success": "completed", "failed": "failed", "error": "failed"}


def attempt_outcomes(attempts: DataFrame, *, date: str = "date", most: int = 2) -> DataFrame:
    """W2, batch: the latest outcome of each date from (date, attempt, result, at), result ``ok``, ``server_error`` or ``error``.

    done after ok; no_session after a server error; an error is retried until the attempts are used up, then no_session.
    Of an attempt that is delivered again the first delivery (by ``at``, then result) counts; the latest attempt wins.
    """
    once = attempts.groupBy(date, "attempt").agg(F.min(F.struct("at", "result")).alias("d")).select(date, "attempt", "d.at", "d.result")
    last = once.groupBy(date).agg(F.max_by(F.struct("attempt", "result", "at"), "attempt").alias("l"), F.count(F.lit(1)).alias("attempts"))
    status = F.when(F.col("l.result") == "ok", "done").when(F.col("l.result") == "server_error", "no_session").when(F.col("attempts") < most, "retry").otherwise("no_session")
    return last.select(date, status.alias("status"), "attempts", F.col("l.at").alias("last_checked"))


def stream_attempts(stream: DataFrame, *, date: str = "date", at: str = "at", horizon: str = "14 days", most: int = 2) -> DataFrame:
    """W2, stream: the outcome of a date after each batch that brings attempts of it; update mode, as the batch twin for all that came so far.

    State: a map of each date's attempts to their first delivery by ``at``, in whatever order they come. Attempts later than
    the horizon behind the latest are dropped. A date is forgotten, and told no more, when the stream has passed its latest
    attempt by the horizon and the watermark's delay of the same length; an attempt after that begins it anew. The state
    lives in RocksDB, which the session is set to.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    kept = int(pd.Timedelta(horizon).total_seconds() * 1000)

    class Attempts(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.seen = handle.getMapState("seen", "attempt long", "at timestamp, result string")
            self.due = handle.getValueState("due", "due long")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            for frame in rows:
                for row in frame.itertuples():
                    attempt, told = (int(row.attempt),), (row.at.to_pydatetime(), row.result)
                    if not self.seen.containsKey(attempt) or told < tuple(self.seen.getValue(attempt)):
                        self.seen.updateValue(attempt, told)
            found = {k[0]: tuple(v) for k, v in self.seen.iterator()}
            when, result = found[max(found)]
            status = "done" if result == "ok" else "no_session" if result == "server_error" or len(found) >= most else "retry"
            latest = max(pd.Timestamp(v[0]).value // 1_000_000 for v in found.values()) + kept
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            self.handle.registerTimer(latest)
            self.due.update((latest,))
            yield pd.DataFrame({"date": [key[0]], "status": [status], "attempts": [len(found)], "last_checked": [when]})

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.seen.clear()
            self.due.clear()
            yield pd.DataFrame({"date": pd.Series([], dtype=str), "status": pd.Series([], dtype=str), "attempts": pd.Series([], dtype="int64"), "last_checked": pd.Series([], dtype="datetime64[ns]")})

        def close(self) -> None:
            pass

    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.withWatermark(at, horizon).select(F.col(date).cast("string").alias("date"), F.col("attempt").cast("long").alias("attempt"), "result", F.col(at).alias("at"))
    return rows.groupBy("date").transformWithStateInPandas(Attempts(), "date string, status string, attempts long, last_checked timestamp", "update", "EventTime")


def job_states(events: DataFrame, *, job: str = "job_id", order: str = "at", tie: str | None = None, as_of: str | None = None, timeout_seconds: int = 3600) -> DataFrame:
    """W3, batch: current state of each job from (job, at, event, progress, detail), events ``progress``, ``complete``, ``fail``.

    The last event counts, of those at one time the greatest ``tie`` (a column that orders them), else the greatest event
    name, progress and detail, nulls first: progress is clamped to 0-100 and 100 completes; complete and fail are final states
    of their events; any other event is a sign of life without a progress. With ``as_of``, a job that renders for longer than
    the timeout without an event has failed.
    """
    row = F.struct("event", "progress", "detail", F.col(order).alias("at"))
    place = F.struct(order, tie) if tie else F.struct(order, "event", "progress", "detail")
    last = events.groupBy(job).agg(F.max_by(row, place).alias("l"), F.count(F.lit(1)).alias("n_events"))
    progress = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("l.progress")))
    status = F.when(F.col("l.event") == "fail", "failed").when((F.col("l.event") == "complete") | (F.col("l.progress") == 100), "completed").otherwise("rendering")
    error = F.when(F.col("l.event") == "fail", F.col("l.detail"))
    if as_of:
        late = (status == "rendering") & (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("l.at").cast("timestamp")) > timeout_seconds)
        status, error = F.when(late, "failed").otherwise(status), F.when(late, "timeout").otherwise(error)
    return last.select(job, status.alias("status"), F.when(F.col("l.event") == "complete", 100.0).when(F.col("l.event") == "progress", progress).alias("progress"), error.alias("error"), F.col("l.at").alias("updated_at"), "n_events")


def map_status(status) -> "F.Column":
    """A service's status name as ours; unknown ones count as queued."""
    names = F.create_map(*(F.lit(x) for pair in STATUS_NAMES.items() for x in pair))
    return F.coalesce(F.element_at(names, F.lower(status)), F.lit("queued"))


def stream_jobs(stream: DataFrame, *, job: str = "job_id", order: str = "at", tie: str | None = None, timeout: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """W3, stream: the state of a job after each batch that brings events of it, or its failure when the timeout passes in event time; update mode.

    Events up to ``late`` behind the latest count as in the batch twin, in whatever order they come; later ones are dropped.
    The timeout is told when the stream is past it by as much.
    """
    import pandas as pd

    milliseconds = int(pd.Timedelta(timeout).total_seconds() * 1000)
    low = lambda x: (0, 0) if pd.isna(x) else (1, x)

    def place(row) -> tuple:
        return (row.at, low(row.tie)) if tie else (row.at, low(row.event), low(row.progress), low(row.detail))

    def told(row) -> tuple:
        """(progress, status, error) after an event."""
        if row.event == "progress":
            return min(100.0, max(0.0, row.progress)), "completed" if row.progress == 100 else "rendering", None
        if row.event == "complete":
            return 100.0, "completed", None
        if row.event == "fail":
            return None, "failed", row.detail
        return None, "completed" if row.progress == 100 else "rendering", None

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, seen = None, 0
        if state.exists:
            *held, seen = state.get
            last = SimpleNamespace(**dict(zip(("at", "event", "progress", "detail", "tie"), held, strict=True)))
            last.at = pd.Timestamp(last.at)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "status": ["failed"], "progress": [told(last)[0]], "error": ["timeout"], "n_events": [seen]})
            return
        for frame in frames:
            for row in frame.itertuples():
                seen += 1
                if last is None or place(row) >= place(last):
                    last = row
        plain = lambda x: None if pd.isna(x) else x
        state.update((pd.Timestamp(last.at).to_pydatetime(), plain(last.event), plain(last.progress), plain(last.detail), plain(last.tie), seen))
        progress, status, error = told(last)
        if status == "rendering":
            due = int(pd.Timestamp(last.at).timestamp() * 1000) + milliseconds
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [progress], "error": [error], "n_events": [seen]})

    other = (F.col(tie).cast("long") if tie else F.lit(None).cast("long")).alias("tie")
    rows = stream.withWatermark(order, late).select(F.col(job).cast("string").alias("job_id"), F.col(order).alias("at"), "event", "progress", "detail", other)
    return rows.groupBy("job_id").applyInPandasWithState(fold, "job_id string, status string, progress double, error string, n_events long", "at timestamp, event string, progress double, detail string, tie long, n_events long", "update", "EventTimeTimeout")


def running_stats(stream: DataFrame, *, by: str, score: str) -> DataFrame:
    """Extraction statistics as the stream grows; complete or update mode."""
    return stream.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))


def caption_windows(stream: DataFrame, *, session: str, at: str, text: str, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Captions of fixed windows on a live feed, closed when the watermark has passed."""
    return stream.withWatermark(at, late).groupBy(session, F.window(at, length)).agg(F.count(F.lit(1)).alias("caption_count"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def caption_runs(stream: DataFrame, *, session: str, at: str, gap: str = "3 seconds", late: str = "1 hour") -> DataFrame:
    """Runs of captions between pauses."""
    return stream.withWatermark(at, late).groupBy(session, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("caption_count"))


def runs_twin(rows: DataFrame, *, session: str, at: str, gap_seconds: float) -> DataFrame:
    """W5, batch: runs by a running count of pauses."""
    w = Window.partitionBy(session).orderBy(at)
    t = F.unix_micros(F.col(at).cast("timestamp"))
    opens = F.coalesce(t - F.lag(t).over(w) >= int(gap_seconds * 1_000_000), F.lit(True)).cast("int")
    marked = rows.withColumn("_o", opens).withColumn("_r", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(session, "_r").agg(F.count(F.lit(1)).alias("caption_count"), F.min(at).alias("first_at")).drop("_r")
