"""Bulk-synchronous iteration over a graph held in DataFrames.

A superstep joins edges with the state of their vertices, combines messages per target with a partial aggregate, and
derives the next state. Every step reads only the step before it, so results do not depend on any order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.graph import reverse

from .store import Steps, stored


def messages(edges: DataFrame, state: DataFrame, send: Column, combine: Callable[[Column], Column] = F.sum, alias: str = "message") -> DataFrame:
    """id and the combined messages that reach it along its in-edges.

    send is an expression over the edge's and its source's columns; combine an aggregate, such as F.sum or F.max.
    """
    sent = edges.join(state.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), send.alias("sent"))
    return sent.groupBy("id").agg(combine(F.col("sent")).alias(alias))


def exchange(edges: DataFrame, state: DataFrame, send: Column, combine: Callable[[Column], Column], direction: str = "in", alias: str = "message") -> DataFrame:
    """messages() along in-edges, out-edges ("out") or both ("all")."""
    ways = {"in": edges, "out": reverse(edges), "all": edges.unionByName(reverse(edges))}
    return messages(ways[direction], state, send, combine, alias)


def active(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """The frontier: ids that have an in-edge from a changed vertex."""
    return edges.join(changed.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


@dataclass
class Context:
    """What a step knows: its number from 0, and how to end the loop after it. log has an entry for each step that is over: iteration, seconds and, if iterate() was given a measure, delta."""

    iteration: int = 0
    most: int = 0
    stopped: bool = False
    log: list[dict] = field(default_factory=list)

    def stop(self) -> None:
        self.stopped = True


def iterate(
    state: DataFrame,
    step: Callable[[DataFrame, Context], DataFrame],
    most: int,
    until: Callable[[DataFrame, DataFrame], bool] | None = None,
    every: int = 3,
    before: Callable[[DataFrame, Context], None] | None = None,
    after: Callable[[DataFrame, Context], None] | None = None,
    measure: Callable[[DataFrame, DataFrame], float] | None = None,
    log: list[dict] | None = None,
) -> DataFrame:
    """Applies step at most `most` times, or until until(old, new) holds or the context is stopped.

    The state is stored every `every` steps, or every step if it is compared or measured, so plans stay short; of the
    stored states the last two are kept. measure(old, new) gives a step's delta (see sum_of_changes); log, a list, gets
    the context's entries.
    """
    context, steps = Context(most=most, log=log if log is not None else []), Steps()
    for k in range(most):
        context.iteration = k
        began = time.monotonic()
        if before:
            before(state, context)
        new = step(state, context)
        if until or measure or (k + 1) % every == 0:
            new = steps.keep(new, "state")
        entry = {"iteration": k, "delta": measure(state, new) if measure else None}
        context.log.append(entry | {"seconds": time.monotonic() - began})
        if after:
            after(new, context)
        ended = context.stopped or (until is not None and until(state, new))
        state = new
        if ended:
            break
    return state


def unchanged(*columns: str) -> Callable[[DataFrame, DataFrame], bool]:
    """A test for iterate(): no vertex differs in these columns."""

    def test(old: DataFrame, new: DataFrame) -> bool:
        both = new.join(old.select("id", *[F.col(c).alias(f"old_{c}") for c in columns]), "id", "left")
        differs = [~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in columns]
        any_differs = differs[0]
        for d in differs[1:]:
            any_differs = any_differs | d
        return both.where(any_differs).limit(1).count() == 0

    return test


def sum_of_changes(column: str) -> Callable[[DataFrame, DataFrame], float]:
    """A measure for iterate(): the sum of the absolute changes of a column over all vertices."""

    def measure(old: DataFrame, new: DataFrame) -> float:
        both = new.select("id", F.col(column).alias("now")).join(old.select("id", F.col(column).alias("was")), "id")
        return float(both.agg(F.sum(F.abs(F.col("now") - F.col("was")))).first()[0] or 0.0)

    return measure


@dataclass(frozen=True)
class Kernel:
    """A functional vertex program: reset value, what a neighbour sends, how messages combine, what a vertex becomes.

    lift is over the neighbour's `value` and `out_degree`; combine an aggregate; finish over `message` and `n`.
    """

    start: Column
    lift: Column
    combine: Callable[[Column], Column]
    finish: Column


def run_kernel(edges: DataFrame, kernel: Kernel, supersteps: int, vertices: DataFrame | None = None) -> DataFrame:
    """id and value after so many synchronous supersteps."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    ids = vertices.select("id") if vertices is not None else edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    base = stored(ids.join(out, "id", "left").withColumn("n", F.lit(ids.count())), "base")
    state = base.withColumn("value", kernel.start)

    def step(now: DataFrame, _: Context) -> DataFrame:
        got = messages(edges, now.select("id", "value", "out_degree"), kernel.lift, kernel.combine)
        return base.join(got, "id", "left").withColumn("value", kernel.finish).drop("message")

    return iterate(state, step, supersteps).select("id", "value")


@dataclass(frozen=True)
class GasProgram:
    """Gather, apply, scatter.

    gather: expression over edge columns and the neighbour's state, prefixed `nbr_`; combine: aggregate of it.
    apply: state column name -> expression over the old state, `gathered` and `iteration`.
    scatter: condition over the new state and the old one, prefixed `old_`, under which a vertex signals its neighbours.
    gather_from / scatter_to: "in", "out", "all" or "none".
    """

    gather: Column
    combine: Callable[[Column], Column]
    apply: dict[str, Column]
    scatter: Column | None = None
    gather_from: str = "in"
    scatter_to: str = "out"


def run_gas(edges: DataFrame, vertices: DataFrame, program: GasProgram, supersteps: int) -> DataFrame:
    """Runs the program on signalled vertices (all at first) until none is signalled or supersteps are over."""
    columns = [c for c in vertices.columns if c != "id"]
    state = stored(vertices.withColumn("signalled", F.lit(True)), "gas")
    back = reverse(edges)
    ways = {"in": edges, "out": back, "all": edges.unionByName(back)}
    for k in range(supersteps):
        awake = state.where("signalled").select("id")
        near = state.select(F.col("id").alias("src"), *[F.col(c).alias(f"nbr_{c}") for c in columns])
        if program.gather_from == "none":
            gathered = awake.withColumn("gathered", F.lit(None).cast("double"))
        else:
            asked = ways[program.gather_from].join(awake.withColumnRenamed("id", "dst"), "dst", "left_semi")
            gathered = asked.join(near, "src").select(F.col("dst").alias("id"), program.gather.alias("g")).groupBy("id").agg(program.combine(F.col("g")).alias("gathered"))
        old = state.select("id", "signalled", *columns, *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(k).alias("iteration"))
        new = old.join(gathered, "id", "left")
        for c in columns:
            if c in program.apply:
                new = new.withColumn(f"new_{c}", F.when(F.col("signalled"), program.apply[c]).otherwise(F.col(c)))
            else:
                new = new.withColumn(f"new_{c}", F.col(c))
        new = stored(new.select("id", "signalled", *[F.col(f"new_{c}").alias(c) for c in columns], *[f"old_{c}" for c in columns]), "gas")
        if program.scatter is None or program.scatter_to == "none":
            state = new.select("id", F.lit(False).alias("signalled"), *columns)
            break
        senders = new.where(F.col("signalled") & program.scatter).select(F.col("id").alias("src"))
        # signals run against the direction in which they are gathered
        targets = ways[{"out": "in", "in": "out", "all": "all"}[program.scatter_to]].join(senders, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        state = stored(new.select("id", *columns).join(targets.withColumn("signalled", F.lit(True)), "id", "left").withColumn("signalled", F.coalesce("signalled", F.lit(False))), "gas")
        if state.where("signalled").limit(1).count() == 0:
            break
    return state.select("id", *columns)
