"""The state of conversations as their messages stream in: a summary, how many messages it covers, and the rest.

After each message, once there are more than ``threshold``, all but the last ``keep`` that the summary doesn't cover yet
are summarised. What is kept of a conversation is bounded by these numbers, however long it is. A message that comes
again under its number (as a batch does after a failure of its source) changes nothing. `replayed` makes the same of a
table, so a stream can be checked against what it has read.

Messages of a conversation come in order of their numbers; one that comes late is put where it belongs while its place
isn't summarised, and is dropped after that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.formats import prepare_workers

Message = tuple[int, str, str]
Summarise = Callable[[str, list[Message]], str]
RECENT = "array<struct<turn:bigint,role:string,text:string>>"
SCHEMA = f"conv_id bigint, messages bigint, summary_message_count bigint, summary string, recent {RECENT}"
STATE = "summary string, covered bigint, last bigint, turns array<bigint>, roles array<string>, texts array<string>"


class Conversation:
    """A summary, the number of messages that it covers, the last of these, and the messages after it."""

    def __init__(self, summary: str = "", covered: int = 0, last: int | None = None, rest: list[Message] | None = None):
        self.summary, self.covered, self.last, self.rest = summary, covered, last, rest or []

    def add(self, message: Message, summarise: Summarise, threshold: int, keep: int) -> None:
        turn = message[0]
        if self.last is not None and turn <= self.last or any(turn == t for t, _, _ in self.rest):
            return
        self.rest.append(message)
        if len(self.rest) > 1 and self.rest[-2][0] > turn:
            self.rest.sort(key=lambda m: m[0])
        if self.covered + len(self.rest) > threshold and len(self.rest) > keep:
            cut = len(self.rest) - keep
            self.summary = summarise(self.summary, self.rest[:cut])
            self.covered, self.last = self.covered + cut, self.rest[cut - 1][0]
            self.rest = self.rest[cut:]

    def row(self, conv_id: int) -> dict:
        recent = [{"turn": t, "role": r, "text": x} for t, r, x in self.rest]
        return {"conv_id": conv_id, "messages": self.covered + len(self.rest), "summary_message_count": self.covered, "summary": self.summary, "recent": recent}


def _messages(batch: pd.DataFrame) -> Iterator[Message]:
    rows = batch.sort_values("turn", kind="stable")
    yield from ((int(t), r or "", x or "") for t, r, x in zip(rows["turn"], rows["role"], rows["text"]))


def replayed(turns: DataFrame, summarise: Summarise, threshold: int = 20, keep: int = 6) -> DataFrame:
    """The state of each conversation of a table (conv_id, turn, role, text) after all its messages; rows without a conversation or number are left out."""
    prepare_workers(turns.sparkSession)

    def run(batches):
        conv_id, state = None, Conversation()
        for batch in batches:
            out = []
            for c, t, r, x in zip(batch["conv_id"], batch["turn"], batch["role"], batch["text"]):
                if c != conv_id:
                    if conv_id is not None:
                        out.append(state.row(conv_id))
                    conv_id, state = c, Conversation()
                state.add((int(t), r or "", x or ""), summarise, threshold, keep)
            if out:
                yield pd.DataFrame(out)
        if conv_id is not None:
            yield pd.DataFrame([state.row(conv_id)])

    rows = turns.where("conv_id is not null and turn is not null").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(run, SCHEMA)


def followed(turns: DataFrame, summarise: Summarise, threshold: int = 20, keep: int = 6) -> DataFrame:
    """The same of a stream, in update mode: a row for each conversation of a batch, as it stands then."""
    prepare_workers(turns.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState):
        state = Conversation()
        if held.exists:
            summary, covered, last, numbers, roles, texts = held.get
            state = Conversation(summary, covered, last, list(zip(numbers, roles, texts)))
        for message in _messages(pd.concat(batches)):
            state.add(message, summarise, threshold, keep)
        columns = [list(c) for c in zip(*state.rest)] or [[], [], []]
        held.update((state.summary, state.covered, state.last, *columns))
        yield pd.DataFrame([state.row(key[0])])

    rows = turns.where("conv_id is not null and turn is not null").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    return rows.groupBy("conv_id").applyInPandasWithState(run, SCHEMA, STATE, "update", GroupStateTimeout.NoTimeout)
