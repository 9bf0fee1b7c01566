"""Stateful and windowed operators over event tables; each works on batches and on streams alike.

Defined results: events without a time are dropped; late ones beyond the watermark are dropped by streams only; equal
times are ordered by id.
"""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, WINDOW_SECONDS = 5, 300


def tumbling(events: DataFrame, time: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """(window_start, by, n, total) per window."""
    e = events.withWatermark(time, late) if late and events.isStreaming else events
    g = e.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sliding(events: DataFrame, time: str, width: str, step: str, by: list[str], late: str | None = None) -> DataFrame:
    e = events.withWatermark(time, late) if late and events.isStreaming else events
    g = e.groupBy(F.window(time, width, step).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """(by, session_start, session_end, n): runs of events less than ``gap`` apart."""
    e = events.withWatermark(time, late) if late and events.isStreaming else events
    g = e.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def failure_count(events: DataFrame, key: str, time: str, order: str, failed, seconds: int) -> DataFrame:
    """The events with ``n_failures``: failures of the same key in the ``seconds`` before, without resets."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(-(seconds * 1_000_000 - 1), -1)
    return events.withColumn("_t", micros).withColumn("n_failures", F.coalesce(F.sum(failed.cast("int")).over(w), F.lit(0)).cast("int")).drop("_t")


class Throttle:
    """Sliding-window throttle of one key: blocked while ``LIMIT`` recorded failures are younger than the window.

    A success clears the key; a blocked attempt isn't recorded.
    """

    def __init__(self, recent: list[int] | None = None, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> None:
        self.recent, self.limit, self.span = list(recent or []), limit, seconds * 1_000_000

    def step(self, at: int, failed: bool, succeeded: bool) -> bool:
        """Whether the attempt at ``at`` (microseconds) is blocked; takes it in if it isn't."""
        self.recent = [t for t in self.recent if at - t < self.span]
        if len(self.recent) >= self.limit:
            return True
        if succeeded:
            self.recent = []
        elif failed:
            self.recent.append(at)
        return False


def failure_throttle(events: DataFrame, key: str, time: str, order: str, kind: str, failure: str, success: str, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(key, order, blocked): the exact fold of each key's events in their order.

    A key's attempts are those of one client; they are folded in one task in Arrow batches, so a busy key needs no more
    memory than its recent failures (rows are sorted by Spark, which spills).
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    e = events.where(F.col(time).isNotNull()).select(key, order, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), F.col(kind).alias("_k"))
    e = e.repartition(key).sortWithinPartitions(key, "_t", order)

    def run(batches):
        state: dict = {}
        for pdf in batches:
            out = []
            for k, at, what in zip(pdf[key], pdf["_t"], pdf["_k"]):
                # sorted by key: only the present key's state is kept
                if k not in state:
                    state.clear()
                    state[k] = Throttle(limit=limit, seconds=seconds)
                out.append(state[k].step(at, what == failure, what == success))
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "blocked": out})

    return e.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, blocked boolean")


def failure_throttle_stream(events: DataFrame, key: str, order: str, failure: str, success: str, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The same over a stream with columns key, order, t (microseconds), kind; state is each key's recent failures."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, blocked boolean"

    def step(k, frames, state):
        throttle = Throttle(list(state.get[0]) if state.exists else [], limit, seconds)
        for pdf in frames:
            pdf = pdf.sort_values(["t", order])
            blocked = [throttle.step(int(t), x == failure, x == success) for t, x in zip(pdf["t"], pdf["kind"])]
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "blocked": blocked})
        state.update((throttle.recent,))

    return events.groupBy(key).applyInPandasWithState(step, schema, "recent array<bigint>", "append", "NoTimeout")


def run_states(steps: DataFrame, run: str, order: str) -> DataFrame:
    """(run, state, attempts): a generation run's state after its steps.

    ``steps``: run, order, attempt, ok. Attempts 0 generate, 1 repair, 2 regenerate, 3 repair; a failed fourth rejects.
    A step counts only if it is the one that is due; stale ones are passed over.
    """
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        due, state = 0, "running"
        for attempt, ok in zip(*pdf.sort_values(order)[["attempt", "ok"]].to_numpy().T):
            if state != "running" or attempt != due:
                continue
            due += 1
            state = "complete" if ok else "rejected" if due > 3 else "running"
        return pd.DataFrame({run: [pdf[run].iloc[0]], "state": [state], "attempts": [due]})

    return steps.select(run, order, "attempt", "ok").groupBy(run).applyInPandas(fold, f"{run} {kinds[run]}, state string, attempts int")


def kind_totals(events: DataFrame, kind: str) -> DataFrame:
    """(kind, n, total): running totals; a stream in complete mode ends with what a batch gives."""
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """A stream run over all that is there now, into a table in memory."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
