"""State machines over inputs: one step function for the batch fold and for the stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.operators.folds import folded

OUT = "instance long, seq long, input string, from_state string, to_state string, outcome string"
STATE = "state string, seq long, spent int"

#: An order's life: state -> input -> (next state, who may send it; empty: anyone).
ORDER_LIFE = {
    "new": {"signup": ("open", ()), "view": ("new", ())},
    "open": {"view": ("open", ()), "click": ("active", ()), "error": ("failed", ())},
    "active": {"purchase": ("done", ("buyer",)), "click": ("active", ()), "error": ("open", ())},
}


def reachable(machine: dict, start: str = "new") -> set[str]:
    """States that some inputs lead to; a state of the machine outside is an orphan."""
    met, new = {start}, [start]
    while new:
        for target, _ in machine.get(new.pop(), {}).values():
            if target not in met:
                met.add(target)
                new.append(target)
    return met


def step(machine: dict, state: str, spent: int, given: str, actor: str, budget: int) -> tuple[str, str]:
    """The next state and the outcome: applied, no_transition, actor_refused or budget_spent."""
    rule = machine.get(state, {}).get(given)
    if rule is None:
        return state, "no_transition"
    if rule[1] and actor not in rule[1]:
        return state, "actor_refused"
    if spent >= budget:
        return state, "budget_spent"
    return rule[0], "applied"


def _advance(machine: dict, budget: int, held: tuple[str, int, int], rows: pd.DataFrame) -> tuple[tuple[str, int, int], pd.DataFrame]:
    state, last, spent = held
    out = []
    for r in rows.sort_values("seq").itertuples():
        if r.seq <= last:
            continue
        after, outcome = step(machine, state, spent, r.input, r.actor, budget)
        out.append((r.instance, r.seq, r.input, state, after, outcome))
        state, last, spent = after, r.seq, spent + (outcome == "applied")
    return (state, last, spent), pd.DataFrame(out, columns=["instance", "seq", "input", "from_state", "to_state", "outcome"])


def replay(inputs: DataFrame, machine: dict, budget: int = 1000, start: str = "new") -> DataFrame:
    """inputs: instance, seq, input, actor -> what each did. What an input does depends on the state left by those before it, so each
    instance is folded in order; an input whose seq is not above the last one is a repeat and does nothing."""

    def one(held: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        state, last, spent = held
        if row["seq"] <= last:
            return held, []
        after, outcome = step(machine, state, spent, row["input"], row["actor"], budget)
        return (after, row["seq"], spent + (outcome == "applied")), [(row["instance"], row["seq"], row["input"], state, after, outcome)]

    return folded(inputs.select("instance", "seq", "input", "actor"), "instance", ["seq"], lambda _: (start, -1, 0), one, lambda _: (), OUT)


def replay_stream(inputs: DataFrame, machine: dict, budget: int = 1000, start: str = "new") -> DataFrame:
    """The same on a streaming source, with an instance's state, last seq and transitions kept between batches."""

    def fold(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        left, out = _advance(machine, budget, held.get if held.exists else (start, -1, 0), pd.concat(frames))
        held.update(left)
        yield out

    return inputs.groupBy("instance").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def breaker(calls: DataFrame, failures: int = 3, rest_s: float = 60.0) -> DataFrame:
    """calls: engine, seq, ts, ok -> engine, seq, state: closed, open (not tried until ``rest_s`` seconds after the last of
    ``failures`` failures in a row) or trial (the first call after the rest, whose failure opens it again)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        bad, until, out = 0, None, []
        for t, ok in zip(pdf.ts, pdf.ok, strict=True):
            if until is not None and t < until:
                out.append("open")
                continue
            out.append("trial" if until is not None else "closed")
            bad = 0 if ok else bad + 1
            until = t + pd.Timedelta(seconds=rest_s) if bad >= failures else None
        return pd.DataFrame({"engine": pdf.engine, "seq": pdf.seq, "state": out})

    return calls.groupBy("engine").applyInPandas(fold, "engine long, seq long, state string")
