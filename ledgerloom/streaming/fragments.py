"""Turns that arrive as fragments, folded as they come by keyed state.

A fragment is (conv_id, turn, seq, kind, slot, id, name, text, n, ts): `seq` is its place in the turn,
kind is `text`, `call` or `end`. Text is joined in order of seq. Call fragments with one slot are one
call: its id is the last one given that isn't empty, its name and arguments are joined. `end` says in n how many
fragments the turn has, itself included, in whatever order they arrive.

State of a turn: a map of fragments by seq, so repeated ones count once and late ones find their
place, and a value, how many are expected. The turn is emitted when all are there, and its fragments
forgotten; that it went out is known for as long again as a timer waits, so fragments repeated until then are dropped. The
timer runs from the first fragment; a turn that hasn't ended by then is emitted as it is, marked incomplete.
State lives in the checkpoint, so a restart goes on where the stream stopped."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

FRAGMENT = "conv_id long, turn long, seq int, kind string, slot int, id string, name string, text string, n int, ts timestamp"
TURN = "conv_id long, turn long, text string, calls array<struct<slot: int, id: string, name: string, arguments: string>>, n_fragments int, complete boolean"
#: State stores that transformWithState needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folded(fragments: dict[int, tuple]) -> tuple[str, list[tuple]]:
    """Text and calls (slot, id, name, arguments) of fragments (kind, slot, id, name, text) by seq."""
    text, calls = [], {}
    for _, (kind, slot, id_, name, said) in sorted(fragments.items()):
        if kind == "text":
            text.append(said or "")
        elif kind == "call":
            call = calls.setdefault(slot, ["", "", ""])
            call[:] = id_ or call[0], call[1] + (name or ""), call[2] + (said or "")
    return "".join(text), [(slot, *call) for slot, call in sorted(calls.items())]


class TurnFold(StatefulProcessor):
    """Folds the fragments of each (conv_id, turn)."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        whole = lambda name: StructType([StructField(name, IntegerType())])  # noqa: E731  no session here that could parse a schema
        part = StructType([StructField(c, IntegerType() if c == "slot" else StringType()) for c in ("kind", "slot", "id", "name", "text")])
        self.parts = handle.getMapState("parts", whole("seq"), part)
        self.expected = handle.getValueState("expected", whole("n"))
        self.done = handle.getValueState("done", whole("n"), ttlDurationMs=self.wait_ms)

    def turn(self, key: tuple, complete: bool) -> Row:
        held = {seq[0]: tuple(part) for seq, part in self.parts.iterator()}
        text, calls = folded(held)
        self.parts.clear()
        self.expected.clear()
        self.done.update((len(held),))
        return Row(conv_id=key[0], turn=key[1], text=text, calls=[Row(slot=s, id=i, name=n, arguments=a) for s, i, n, a in calls], n_fragments=len(held), complete=complete)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.done.exists():
            return  # repeated fragments of a turn that has gone out
        if not self.parts.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        for r in rows:
            self.parts.updateValue((r.seq,), (r.kind, r.slot, r.id, r.name, r.text))
            if r.kind == "end":
                self.expected.update((r.n,))
        if self.expected.exists() and sum(1 for _ in self.parts.keys()) >= self.expected.get()[0]:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            yield self.turn(key, True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.parts.exists():
            yield self.turn(key, False)

    def close(self) -> None:
        pass


def fold_stream(fragments: DataFrame, wait_ms: int = 600_000) -> DataFrame:
    """A row for each turn, once it is whole, or wait_ms after its first fragment."""
    fragments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return fragments.groupBy("conv_id", "turn").transformWithState(statefulProcessor=TurnFold(wait_ms), outputStructType=StructType.fromDDL(TURN), outputMode="Append", timeMode="ProcessingTime")


def fold_all(fragments: DataFrame) -> DataFrame:
    """The same of a whole table, for turns that have ended or not, by grouping."""
    one = fragments.groupBy("conv_id", "turn", "seq").agg(F.max(F.struct("kind", "slot", "id", "name", "text", "n")).alias("f")).select("conv_id", "turn", "seq", "f.*")
    inside = F.array_sort(F.collect_list(F.struct("seq", "kind", "slot", "id", "name", "text")))
    turns = one.groupBy("conv_id", "turn").agg(inside.alias("parts"), F.count("*").cast("int").alias("n_fragments"), F.max("n").alias("expected"))
    said = lambda kind: F.filter("parts", lambda p: p["kind"] == kind)
    joined = lambda parts, c="text": F.array_join(F.transform(parts, lambda p: F.coalesce(p[c], F.lit(""))), "")
    last = lambda parts, c: F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(parts, lambda p: F.coalesce(p[c], F.lit("")) != ""), lambda p: p[c])), -1)
    slots = F.array_sort(F.array_distinct(F.transform(said("call"), lambda p: p["slot"])))

    def call(slot):
        mine = F.filter(said("call"), lambda p: p["slot"] == slot)
        return F.struct(slot.alias("slot"), last(mine, "id").alias("id"), joined(mine, "name").alias("name"), joined(mine).alias("arguments"))

    return turns.select("conv_id", "turn", joined(said("text")).alias("text"), F.transform(slots, call).alias("calls"), "n_fragments", F.coalesce(F.col("n_fragments") >= F.col("expected"), F.lit(False)).alias("complete"))
