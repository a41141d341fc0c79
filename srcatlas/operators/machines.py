"""State machines over event logs: every event with the state before and after it, and a verdict.

A log has id, event, ts and seq; events of an id count in the order of (ts,
seq, event).  In a batch the log is cut by ranges of (id, ts, seq), so an id of
any number of events is spread over tasks: each task composes the moves of its
range, the compositions of an id's ranges (at most two for each range) give the
state in which every range begins, and a second pass over the ranges fills the
states in.  As a stream, an id's state is kept between micro-batches.

Verdicts: ``done``; ``ignored``, allowed and without effect; ``forbidden``;
``unknown`` for events that the machine does not know, null ones too.  The last
two leave the state as it is.  A null id is an id of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import written

OUT = "id string, event string, ts timestamp, seq long, before string, after string, verdict string"
VERDICTS = ("done", "ignored", "forbidden", "unknown")


@dataclass(frozen=True)
class Machine:
    """States, the first of which is where an id begins, and what an event does in a state: the next state and a verdict."""

    states: tuple[str, ...]
    moves: dict[tuple[str, str], tuple[str, str]]

    @property
    def events(self) -> list[str]:
        return sorted({event for _, event in self.moves})

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Next state and verdict by event (one more for unknown ones) and state."""
        names = self.events
        after = np.tile(np.arange(len(self.states), dtype=np.int32), (len(names) + 1, 1))
        verdict = np.full(after.shape, VERDICTS.index("forbidden"), np.int8)
        verdict[-1] = VERDICTS.index("unknown")
        for (state, event), (to, said) in self.moves.items():
            at = names.index(event), self.states.index(state)
            after[at], verdict[at] = self.states.index(to), VERDICTS.index(said)
        return after, verdict

    def coded(self, events: pd.Series) -> np.ndarray:
        return pd.Index([*self.events]).get_indexer(events)  # -1, the last row, is an unknown event


def running(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row the composition of all maps from its segment's first row on, by doubling the span composed."""
    at, span = np.arange(len(maps)), 1
    longest = int((at - first).max(initial=0))
    while span <= longest:
        late = at[at - span >= first]
        made = maps.copy()
        made[late] = np.take_along_axis(maps[late], maps[late - span], axis=1)
        maps, span = made, span * 2
    return maps


def _segments(batch: pd.DataFrame, last: tuple | None) -> tuple[np.ndarray, bool]:
    """Where runs of one (part, id) begin, and whether the first of them goes on from the last batch."""
    part, who = batch["part"].to_numpy(), pd.factorize(batch["id"], use_na_sentinel=False)[0]
    begins = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (who[1:] != who[:-1]))))
    return begins, last == (int(part[0]), _id(batch["id"].iloc[0]))


def _id(value) -> str | None:
    return None if value is None or value != value else value


def _first_rows(begins: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(begins, np.diff(np.append(begins, n)))


def run(events: DataFrame, machine: Machine) -> DataFrame:
    """id, event, ts, seq, before, after and verdict of every event."""
    after, verdict = machine.tables()
    states, coded = np.array(machine.states, object), machine.coded
    log = events.select(F.col("id").cast("string").alias("id"), F.col("event").cast("string").alias("event"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"))
    cut = written(log.repartitionByRange("id", "ts", "seq", "event").withColumn("part", F.spark_partition_id()))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The composed moves of each part's first and last id."""
        last, held, leads = None, None, False
        for batch in batches:
            if batch.empty:
                continue
            begins, goes_on = _segments(batch, last)
            made = running(after[coded(batch["event"])], _first_rows(begins, len(batch)))
            stops = np.append(begins[1:], len(batch)) - 1
            part = batch["part"].to_numpy()[begins]
            found = []
            if last is not None and not goes_on and (leads or last[0] != part[0]):
                found.append((*last, held.tolist()))
            for i in np.flatnonzero(np.r_[True, part[1:] != part[:-1]] | np.r_[part[1:] != part[:-1], True]):
                move = made[stops[i]]
                starts = (goes_on and leads) or (not goes_on and (last is None or last[0] != part[0])) if i == 0 else part[i] != part[i - 1]
                if i == 0 and goes_on:
                    move = move[held]
                if i == len(begins) - 1:
                    continue
                if starts or part[i + 1] != part[i]:
                    found.append((int(part[i]), _id(batch["id"].iloc[begins[i]]), move.tolist()))
            at = len(begins) - 1
            if at or not goes_on:
                leads = last is None or last[0] != part[0] if at == 0 else bool(part[at] != part[at - 1])
                held = made[stops[at]]
            else:
                held = made[stops[at]][held]
            last = (int(part[at]), _id(batch["id"].iloc[begins[at]]))
            yield pd.DataFrame(found, columns=["part", "id", "move"])
        if last is not None:
            yield pd.DataFrame([(*last, held.tolist())], columns=["part", "id", "move"])

    def begins_in(rows: pd.DataFrame) -> pd.DataFrame:
        """The state in which an id begins each of its parts."""
        rows, state, found = rows.sort_values("part"), 0, []
        for part, who, move in zip(rows["part"], rows["id"], rows["move"], strict=True):
            found.append((part, who, state))
            state = move[state]
        return pd.DataFrame(found, columns=["part", "id", "start"])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, 0
        for batch in batches:
            if batch.empty:
                continue
            begins, goes_on = _segments(batch, last)
            first, codes = _first_rows(begins, len(batch)), coded(batch["event"])
            start = batch["start"].fillna(0).to_numpy(np.int64)[begins]
            if goes_on:
                start[0] = state
            start = np.repeat(start, np.diff(np.append(begins, len(batch))))
            to = running(after[codes], first)[np.arange(len(batch)), start]
            before = np.where(np.arange(len(batch)) == first, start, np.r_[0, to[:-1]])
            last, state = (int(batch["part"].iloc[-1]), _id(batch["id"].iloc[-1])), int(to[-1])
            yield batch[["id", "event", "ts", "seq"]].assign(before=states[before], after=states[to], verdict=np.array(VERDICTS, object)[verdict[codes, before]])

    order = ["part", "id", "ts", "seq", "event"]
    edges = cut.repartition("part").sortWithinPartitions(*order).mapInPandas(ends, "part int, id string, move array<int>")
    starts = written(edges.groupBy("id").applyInPandas(begins_in, "part int, id string, start int"))
    c, s = cut.alias("c"), F.broadcast(starts.alias("s"))  # at most two rows for each range
    placed = c.join(s, (F.col("c.part") == F.col("s.part")) & F.col("c.id").eqNullSafe(F.col("s.id")), "left").select("c.*", "s.start")
    return placed.repartition("part").sortWithinPartitions(*order).mapInPandas(fill, OUT)


def stream(events: DataFrame, machine: Machine) -> DataFrame:
    """The same of a stream; an id's events of a micro-batch count in order, and after those of earlier ones."""
    after, verdict = machine.tables()
    states, coded = np.array(machine.states, object), machine.coded

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "seq", "event"])
        start, codes = (state.get[0] if state.exists else 0), coded(rows["event"])
        to = running(after[codes], np.zeros(len(rows), np.int64))[:, start]
        before = np.r_[start, to[:-1]]
        state.update((int(to[-1]),))
        yield rows[["id", "event", "ts", "seq"]].assign(before=states[before], after=states[to], verdict=np.array(VERDICTS, object)[verdict[codes, before]])

    log = events.select(F.col("id").cast("string").alias("id"), F.col("event").cast("string").alias("event"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"))
    return log.groupBy("id").applyInPandasWithState(step, OUT, "state int", "append", GroupStateTimeout.NoTimeout)
