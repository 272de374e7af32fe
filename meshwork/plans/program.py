"""Frontier programs: a graph algorithm as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.operators.graph import Graph
from meshwork.plans.loop import Rounds, iterate

COMBINE: dict[str, Callable[[str], Column]] = {"min": F.min, "max": F.max, "sum": F.sum, "collect_set": F.collect_set}


@dataclass(frozen=True)
class FrontierProgram:
    """init: expressions of v for the state's columns, `active` among them. message: what an active vertex sends along
    each out-edge, over its state. combine: min, max, sum or collect_set, by destination. apply: the new state's
    columns, over the old state and `message` (null where nothing came), `active` among them. merge: where none of the
    combiners will do, a Python function from the pandas Series of a vertex's messages to one of the same type; all
    messages of a vertex then come to one call, which hubs make long."""

    init: dict[str, Column]
    message: Column
    combine: str | None
    apply: dict[str, Column]
    merge: Callable | None = None

    def run(self, graph: Graph, max_rounds: int | None = None) -> tuple[DataFrame, Rounds]:
        """The state when no vertex is active; raises when some are after max_rounds."""
        if "active" not in self.init or "active" not in self.apply:
            raise ValueError("init and apply need a column 'active'")
        if self.merge is None and self.combine not in COMBINE:
            raise ValueError(f"combine is one of {', '.join(COMBINE)}")
        merge = self.merge  # alone: columns of the program can't be sent to workers
        start = graph.vertices.select("v", *[c.alias(k) for k, c in self.init.items()])

        def step(state: DataFrame, _: int) -> DataFrame:
            sent = graph.along(state.where("active").select("v", self.message.alias("message")))
            if merge is not None:
                got = sent.select(F.col("dst").alias("v"), "message").groupBy("v").applyInPandas(lambda rows: rows.iloc[:1].assign(message=[merge(rows["message"])]), sent.select(F.col("dst").alias("v"), "message").schema)
            else:
                got = sent.groupBy(F.col("dst").alias("v")).agg(COMBINE[self.combine]("message").alias("message"))
            return state.join(got, "v", "left").select("v", *[self.apply.get(k, F.col(k)).alias(k) for k in self.init])

        return iterate(start, step, lambda _: F.col("active"), "program", max_rounds, graph.buckets)


def components_program() -> FrontierProgram:
    """Connected components of a symmetric graph: the least vertex that is reached."""
    better = F.col("message").isNotNull() & (F.col("message") < F.col("component"))
    return FrontierProgram(
        init={"component": F.col("v"), "active": F.lit(True)},
        message=F.col("component"),
        combine="min",
        apply={"component": F.when(better, F.col("message")).otherwise(F.col("component")), "active": better},
    )
