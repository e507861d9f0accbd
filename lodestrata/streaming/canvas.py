"""Canvases folded from streams of operations: one state a thread, operations in order, others in parallel."""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.ids import UUID_PATTERN


class Rejected(Exception):
    """An operation names a card, component or end of an edge that isn't there."""


def empty() -> dict:
    return {"version": 1, "viewport": {"x": 0, "y": 0, "zoom": 1}, "cards": [], "edges": []}


def _card(state: dict, card_id, lenient: bool) -> dict | None:
    for c in state["cards"]:
        if c["id"] == card_id:
            return c
    if lenient:
        return None
    raise Rejected(f"card {card_id}")


def _add_card(state, op, lenient, inner):
    state["cards"] += op["cards"]


def _remove_card(state, op, lenient, inner):
    if _card(state, op["cardId"], lenient):
        state["cards"] = [c for c in state["cards"] if c["id"] != op["cardId"]]
        state["edges"] = [e for e in state["edges"] if op["cardId"] not in (e["source"], e["target"])]


def _move_card(state, op, lenient, inner):
    if card := _card(state, op["cardId"], lenient):
        card.update({k: op[k] for k in ("position", "width", "height") if op.get(k) is not None})
        if not inner:
            card.update({"zIndex": op["zIndex"]} if op.get("zIndex") is not None else {})
            if op.get("title") is not None:
                card["title"] = op["title"] or None


def _update_component(state, op, lenient, inner):
    if card := _card(state, op["cardId"], lenient):
        if card["component"]["id"] == op["componentId"]:
            card["component"]["data"] = {**card["component"].get("data", {}), **op["data"]}
        elif not lenient:
            raise Rejected(f"component {op['componentId']}")


def _add_edge(state, op, lenient, inner):
    ends = {op["edge"]["source"], op["edge"]["target"]}
    if not lenient and not ends <= {c["id"] for c in state["cards"]}:
        raise Rejected("edge without its cards")
    if not any({e["source"], e["target"]} == ends for e in state["edges"]):  # an edge has no direction here
        state["edges"].append(op["edge"])


def _drop_edge(state, op, lenient, inner):
    state["edges"] = [e for e in state["edges"] if e["id"] != op["edgeId"]]


def _update_edges(state, op, lenient, inner):
    state["edges"] = op["edges"]


def _batch(state, op, lenient, inner):
    for x in op["operations"]:
        INNER[x["op"]](state, x, lenient, True)


INNER = {"add_card": _add_card, "remove_card": _remove_card, "move_card": _move_card, "update_component": _update_component, "add_edge": _add_edge, "remove_edge": _drop_edge}
OUTER = {k: v for k, v in INNER.items() if k != "remove_edge"} | {"delete_edge": _drop_edge, "update_edges": _update_edges, "batch": _batch}


def step(state: dict | None, op_json: str, lenient: bool = False) -> tuple[dict, str | None]:
    """(state after an operation, error): a rejected operation leaves all as it was, a batch as a whole.

    Single operations are refused before they change anything, so only a batch works on a copy.
    """
    state = empty() if state is None else state
    op = json.loads(op_json)
    work = copy.deepcopy(state) if op["type"] == "batch" and not lenient else state
    try:
        OUTER[op["type"]](work, op, lenient, False)
    except Rejected as e:
        return state, str(e)
    return work, None


def applied(state_json: str | None, op_json: str, lenient: bool = False) -> tuple[str, str | None]:
    """The same for a state kept as text."""
    state, error = step(json.loads(state_json) if state_json else None, op_json, lenient)
    return json.dumps(state), error


ID = re.compile(UUID_PATTERN)


def resolved(operations: list[dict], fresh) -> list[dict]:
    """Operations of a batch with placeholder ids replaced, each by an id that fresh() gives where a card or edge is added.

    A later operation may name an earlier one's placeholder; otherwise it has to name an id of the service's own form.
    The first name that is neither refuses the batch.
    """
    names: dict[str, str] = {}

    def of(value, new: bool = False):
        if new:
            names[value] = fresh()
        if value not in names and not (isinstance(value, str) and ID.match(value)):
            raise Rejected(f"{value} is neither a placeholder of this batch nor an id")
        return names.get(value, value)

    out = []
    for x in operations:
        x = json.loads(json.dumps(x))
        for card in x.get("cards", ()):
            card["id"] = of(card["id"], True)
            if "component" in card:
                card["component"]["id"] = of(card["component"]["id"], True)
        if "edge" in x:
            x["edge"] = {**x["edge"], "source": of(x["edge"]["source"]), "target": of(x["edge"]["target"]), "id": of(x["edge"]["id"], True)}
        for field in ("cardId", "componentId", "edgeId"):
            if field in x:
                x[field] = of(x[field])
        out.append(x)
    return out


STATES = StructType([StructField(n, StringType()) for n in ("thread_id", "state", "errors")])


def fold(ops: DataFrame, lenient: bool = False) -> DataFrame:
    """(thread_id, state, errors) from (thread_id, seq, op): the final canvas of each thread.

    Operations are sorted by Spark and streamed, so a task keeps one canvas and not a thread's history.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        thread, state, errors = None, None, []
        for batch in batches:
            done = []
            for t, op in zip(batch["thread_id"], batch["op"]):
                if t != thread:
                    if thread is not None:
                        done.append((thread, json.dumps(state), json.dumps(errors)))
                    thread, state, errors = t, None, []
                state, error = step(state, op, lenient)
                errors += [error] if error else []
            yield pd.DataFrame(done, columns=STATES.names)
        if thread is not None:
            yield pd.DataFrame([(thread, json.dumps(state), json.dumps(errors))], columns=STATES.names)

    ordered = ops.select("thread_id", "seq", "op").repartition("thread_id").sortWithinPartitions("thread_id", "seq")
    return ordered.mapInPandas(run, STATES)


class CanvasProcessor(StatefulProcessor):
    """Keeps a thread's canvas between micro-batches and sends it on after each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("canvas", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        ops = pd.concat(list(rows)).sort_values("seq", kind="stable")["op"]
        errors = []
        for op in ops:
            state, error = step(state, op)
            errors += [error] if error else []
        now = json.dumps(state)
        self.state.update((now,))
        yield pd.DataFrame([(key[0], now, json.dumps(errors))], columns=STATES.names)

    def close(self) -> None:
        pass


def canvas_stream(ops: DataFrame) -> DataFrame:
    """The same over a stream; needs the RocksDB state store."""
    return ops.groupBy("thread_id").transformWithStateInPandas(CanvasProcessor(), STATES, "Update", "None")
