"""Session state: one pure step, replayed in batch or run as a stream.

``step`` takes the state of a session and a turn and gives the new state and a result.  The batch
replay folds it over a session's turns in order; the stream keeps the state between batches.  Both
use the same function, so they agree.  Rules (packs of words) are arguments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


KEPT_TURNS = 3
VALID_TURNS = 3
LEAST_CONFIDENCE = 0.6


@dataclass
class State:
    topic: str = ""
    confidence: float = 0.0
    turns: int = 0  # since the topic was set
    total: int = 0
    history: list[str] = field(default_factory=list)


def coerce(raw: dict | None) -> State:
    """A state from stored values: confidence into [0, 1], counters not negative."""
    s = State(**{k: v for k, v in (raw or {}).items() if k in State.__dataclass_fields__ and v is not None})
    s.confidence = min(1.0, max(0.0, float(s.confidence)))
    s.turns, s.total, s.history = max(0, int(s.turns)), max(0, int(s.total)), list(s.history)[-KEPT_TURNS:]
    return s


def step(state: State, text: str | None, topics: list[tuple[str, list[str]]], follow: list[str], reset: list[str]) -> tuple[State, dict]:
    """One turn: a reset word clears the topic; a topic word sets it; a follow-up without one takes
    the last topic while it is fresh and sure enough; small talk lowers the confidence."""
    t = text or ""
    named = next((name for name, words in topics if any(w in t for w in words)), "")
    inherited = False
    n = State(state.topic, state.confidence, state.turns, state.total + 1, [*state.history, t][-KEPT_TURNS:])
    if any(w in t for w in reset):
        n.topic, n.confidence, n.turns = "", 0.0, 0
    elif named:
        n.topic, n.confidence, n.turns = named, 0.95, 0
    elif state.topic and state.confidence >= LEAST_CONFIDENCE and state.turns < VALID_TURNS and any(w in t for w in follow):
        inherited, n.turns, n.confidence = True, state.turns + 1, min(1.0, max(0.85, state.confidence + 0.05))
    else:
        n.turns, n.confidence = state.turns + 1, max(0.0, state.confidence - 0.2)
    shown = n.topic if named or inherited else ""
    return n, {"topic": shown, "inherited": inherited, "confidence": round(n.confidence, 4), "turn": n.total}


RESULT = "turn int, topic string, inherited boolean, confidence double"


def replay(df: DataFrame, session: str, order: list[str], content: str, rules: dict, slices: int | None = None) -> DataFrame:
    """(session, turn, topic, inherited, confidence): the fold over each session's turns.

    Rows are partitioned by session and sorted, and each task streams over its rows with one state,
    so a session is never gathered, however long it is.
    """
    d = df.where(F.col(session).isNotNull())
    d = (d.repartition(session) if slices is None else d.repartition(slices, session)).sortWithinPartitions(session, *order).select(session, content)
    kind = df.schema[session].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, State()
        for pdf in batches:
            out = []
            for s, t in zip(pdf[session], pdf[content]):
                if s != key:
                    key, state = s, State()
                state, r = step(state, t, **rules)
                out.append((s, r["turn"], r["topic"], r["inherited"], r["confidence"]))
            yield pd.DataFrame(out, columns=[session, "turn", "topic", "inherited", "confidence"])

    return d.mapInPandas(work, f"{session} {kind}, {RESULT}")


def stream(df: DataFrame, session: str, order: list[str], content: str, rules: dict, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream: state by session, rows of a micro-batch in order.

    A session without rows for ``idle_ms`` of processing time is forgotten, so that state stays as
    small as the sessions that are open; a later row starts it anew.  None keeps all state.
    """
    kind = df.schema[session].dataType.simpleString()
    state_schema = "topic string, confidence double, turns int, total int, history array<string>"

    def work(key, batches, held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        names = list(State.__dataclass_fields__)
        state = coerce(dict(zip(names, held.get)) if held.exists else None)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for t in rows[content]:
            state, r = step(state, t, **rules)
            out.append((key[0], r["turn"], r["topic"], r["inherited"], r["confidence"]))
        held.update(tuple(asdict(state).values()))
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[session, "turn", "topic", "inherited", "confidence"])

    return df.groupBy(session).applyInPandasWithState(work, f"{session} {kind}, {RESULT}", state_schema, "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")


def windowed_counts(df: DataFrame, at: str, kind: str, late: str = "1 hour", size: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, end, kind, n) over event time, with a watermark for late rows; batch or stream."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return df.withWatermark(at, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def session_windows(df: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, n): runs of a user's rows without a longer gap."""
    return df.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def write_once(df: DataFrame, path: str, keys: list[str], checkpoint: str, merge: Callable | None = None):
    """A stream into a folder, each micro-batch's rows once by key: a repeated batch adds nothing."""

    def each(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(keys) if merge is None else merge(batch)
        new.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


__all__ = ["State", "coerce", "replay", "session_windows", "step", "stream", "windowed_counts", "write_once"]
