"""Traces of growing transcripts, kept as state: a batch reads its new lines and no history."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sessionloom.operators.traces import line_facts, named_by_file

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Facts of which the last line that has one holds.
LAST = ["session_id", "thread_source", "parent_thread_id", "agent_role", "agent_nickname"]
#: Facts that name a project, strongest first, with their rank and source.
NAMES = [("named", 5, "transcript_project"), ("cwd", 4, "transcript_cwd"), ("stored", 3, "transcript_path")]
TRACE = "path string, tool string, " + ", ".join(f"{c} string" for c in LAST) + ", role_hint_source string, independently_run boolean, events long, first_us long, last_us long, project string, project_source string"
STATE = ", ".join(f"{c}_line long, {c} string" for c in LAST) + ", rank int, name_line long, name string, source string, hint_line long, hint string, independently_run boolean, events long, first_us long, last_us long"
EMPTY = (*[None] * (2 * len(LAST)), 0, -1, None, None, None, None, True, 0, None, None)


NAME, HINT, ALONE = 2 * len(LAST), 2 * len(LAST) + 4, 2 * len(LAST) + 6
TOLD = STATE[: STATE.index(", events long")]  # what lines say besides their times
TraceRow = Row(*[c.split()[0] for c in TRACE.split(", ")])


def merge(state: list, told) -> None:
    """What some lines say, into the state: the later line's facts, the strongest and then latest name, the earliest hint."""
    for i in range(0, NAME, 2):
        if told[i] is not None and (state[i] is None or told[i] >= state[i]):
            state[i : i + 2] = told[i : i + 2]
    if told[NAME] and (told[NAME], told[NAME + 1]) >= (state[NAME], state[NAME + 1]):
        state[NAME:HINT] = told[NAME:HINT]
    if told[HINT] is not None and (state[HINT] is None or told[HINT] < state[HINT]):
        state[HINT:ALONE] = told[HINT:ALONE]
    state[ALONE] = state[ALONE] and told[ALONE]


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each batch folded to a row a path, so that state is read and written with few rows."""
    for batch in batches:
        held: dict[tuple, tuple[list, set]] = {}
        for path, tool, fresh, line, said, event_us, *last, named, cwd, stored, hint, alone in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            state, times = held.setdefault((path, tool, fresh), (list(EMPTY[: ALONE + 1]), set()))
            if not said:
                continue
            if event_us is not None:
                times.add(event_us)
            told = [x for value in last for x in (None if value is None else line, value)]
            name = next(((rank, line, name, source) for name, (_, rank, source) in zip((named, cwd, stored), NAMES, strict=True) if name is not None), EMPTY[NAME:HINT])
            merge(state, [*told, *name, None if hint is None else line, hint, alone])
        rows = [(*key, *state, sorted(times)) for key, (state, times) in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), FOLDED_KINDS, strict=True)], FOLDED_NAMES)


FOLDED = f"path string, tool string, fresh boolean, {TOLD}, times array<long>"
KINDS = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
FOLDED_NAMES, FOLDED_KINDS = [c.split()[0] for c in FOLDED.split(", ")], [KINDS[c.split()[1]] for c in FOLDED.split(", ")]


class TraceState(StatefulProcessor):
    """One value a path: for each fact the line that gave it, so that any order of lines gives the same; beside it the list of event times."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.trace = handle.getValueState("trace", STATE)
        self.times = handle.getListState("times", "ts_us long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.trace.get()
        state, times, anew = list(known or EMPTY), set(), False
        for _, _, fresh, *told, new in rows:
            if fresh and not anew:  # the file is read anew: what was known of it goes
                state, times, anew = list(EMPTY), set(), True
            if fresh == anew:
                merge(state, told)
                times.update(new)
        if anew:
            if known:  # each call of the state costs as much as folding many lines
                self.times.clear()
        elif times and state[-1] is not None and min(times) <= state[-1]:  # only then may a time be known already
            times -= {t for (t,) in self.times.get()}
        if times:
            self.times.appendList([(t,) for t in sorted(times)])
            state[-3:] = [state[-3] + len(times), min(times | {state[-2]} - {None}), max(times | {state[-1]} - {None})]
        self.trace.update(tuple(state))
        own = [state[2 * i + 1] for i in range(len(LAST))]
        yield TraceRow(key[0], key[1], *own, state[HINT + 1], *state[ALONE:], state[NAME + 2], state[NAME + 3])


def trace_updates(lines: DataFrame) -> DataFrame:
    """For each path of a batch its trace so far, the columns of ``fold_traces``; one with 0 events is no trace any more.

    ``lines`` has path, tool, line_no, value, and may have ``fresh``: lines of a file that is read anew, which
    replace all earlier ones of it. line_no orders a file's lines and may have gaps, as byte positions do; lines may come in any order and again. The
    state store has to be RocksDB's.
    """
    fresh = F.col("fresh") if "fresh" in lines.columns else F.lit(False)
    facts = line_facts(lines.withColumn("fresh", fresh), "fresh", F.col("value").isNotNull().alias("said"))
    hint = F.when(F.col("thread_source").isNotNull(), "thread_source").when(F.col("parent_thread_id").isNotNull(), "parent_thread_id")
    alone = F.coalesce((F.coalesce("thread_source", F.lit("")) != "subagent") & F.col("parent_thread_id").isNull(), F.lit(True))
    facts = facts.withColumns({"hint": hint, "independent": alone})
    facts = facts.select("path", "tool", "fresh", "line_no", "said", F.when(F.col("is_event"), F.col("ts_us")).alias("event_us"), *LAST, "named", "cwd", "stored", "hint", "independent")
    facts = facts.mapInArrow(folded, FOLDED)
    found = facts.groupBy("path", "tool").transformWithState(TraceState(), TRACE, "Update", "None")
    return found.withColumn("session_id", F.when(F.col("events") > 0, named_by_file()))


def traces_by_state(lines: DataFrame, root: str) -> DataFrame:
    """The traces of all that a stream of lines has now, by way of the state; the session's state store is RocksDB's meanwhile."""
    from sessionloom.streaming.jobs import latest_traces

    spark = lines.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        keep_trace_state(lines, f"{root}/traces", f"{root}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return latest_traces(spark, f"{root}/traces")


def keep_trace_state(lines: DataFrame, traces: str, checkpoint: str, every_s: int | None = None):
    """Write the traces that each batch changes, a folder a batch; ``latest_traces`` reads them. A batch that is repeated replaces its own."""
    from sessionloom.streaming.jobs import tick

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{traces}/batch={number}")

    return trace_updates(lines).writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint).trigger(**tick(every_s)).start()
