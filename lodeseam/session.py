"""A session over one immutable view of cards, edges, registry and aliases."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import changes, graph, retrieval, validation
from .schema import REGISTRY_SCHEMA, as_cards
from .sources import sinks


def clamped(value, low: int, high: int, default: int) -> int:
    """Integers are brought into their range; anything else gives the default."""
    try:
        return max(low, min(high, int(value)))
    except (TypeError, ValueError):
        return default


def retried(read: Callable, attempts: int = 3, pause: float = 0.1, deadline: float | None = None):
    """The result of an idempotent read, tried again after a growing pause; the last error is raised with the first as its cause."""
    first, end = None, None if deadline is None else time.monotonic() + deadline
    for n in range(attempts):
        try:
            return read()
        except Exception as e:
            first = first or e
            if n + 1 == attempts or end is not None and time.monotonic() + pause > end:
                raise RuntimeError(f"read failed after {n + 1} attempts") from first
            time.sleep(pause)
            pause *= 2


class Session:
    """Answers come as DataFrames and all from the same view; refresh() puts a later one in its place, never an earlier one."""

    def __init__(
        self, spark: SparkSession, cards: DataFrame, edges: DataFrame | None = None, registry: DataFrame | None = None,
        aliases: DataFrame | None = None, repository: str = "local", composed: bool = False,
    ):
        self.spark, self.repository, self.composed, self.epoch = spark, repository, composed, 0
        self._set(cards, edges, registry, aliases)

    @classmethod
    def from_snapshot(cls, spark: SparkSession, root: str, **more) -> Session:
        tables = retried(lambda: sinks.open_snapshot(spark, root))
        return cls(spark, tables["cards"], tables.get("edges"), tables.get("registry"), tables.get("aliases"), **more)

    def _set(self, cards, edges, registry, aliases) -> None:
        self.cards = as_cards(cards)
        self.edges, self.aliases = edges, aliases
        self.registry = registry if registry is not None else self.spark.createDataFrame([], REGISTRY_SCHEMA)

    def refresh(self, epoch: int, cards: DataFrame, edges=None, registry=None, aliases=None) -> bool:
        if epoch <= self.epoch:
            return False
        self.epoch = epoch
        self._set(cards, edges, registry, aliases)
        return True

    def query(self, queries: DataFrame | str, top: int = 5) -> DataFrame:
        if isinstance(queries, str):
            queries = self.spark.createDataFrame([(0, queries)], "query_id long, query string")
        edges = None if self.edges is None else self._local(self.edges)
        return retrieval.query_cards(self.cards, queries, self.aliases, edges, clamped(top, 1, 100, 5), self.composed)

    def _local(self, edges: DataFrame) -> DataFrame:
        return edges.withColumns({c: T.local_id(c, self.repository) for c in ("src", "dst")})

    def show(self, card_id: str) -> DataFrame:
        """id, status and card: the id itself, else what the registry leads to, else a unique local name."""
        asked = self.spark.createDataFrame([(card_id,)], "asked string")
        ends = graph.registry_resolution(self.registry).select(F.col("id").alias("asked"), "final_id", "state")
        found = asked.join(ends, "asked", "left").withColumn("id", F.coalesce(F.when(F.col("state") == "active", F.col("final_id")), T.local_id("asked", self.repository)))
        status = F.when(F.col("role").isNotNull(), "found").when(F.col("state").isin("ambiguous", "cycle", "retired"), F.col("state")).otherwise("not_found")
        return found.join(self.cards, "id", "left").select("asked", "id", status.alias("status"), "role", "path", "symbol", "search", "owns", "invariant", "rel")

    def context(self, roots: DataFrame, depth: int = 2, budget: int | None = None, max_edges: int = 100) -> DataFrame:
        """Edges around roots(root): at most max_edges each, and with a token budget the first lines that fit it."""
        nodes, edges = graph.build_graph(self.cards, None, self.repository)
        edges = edges if self.edges is None else self.edges
        out = graph.bounded_context(roots, edges, nodes, clamped(depth, 0, graph.MAX_DEPTH, 2), clamped(max_edges, 0, graph.MAX_EDGES, 100))
        if budget is None:
            return out
        from .operators.packing import greedy_prefix

        line = F.concat_ws(" ", "src", F.concat(F.lit("-"), "kind", F.lit("->")), "dst")
        return greedy_prefix(out.withColumn("text", line), "root", ["level", "edge_id"], budget).drop("text", "spent")

    def resolve(self) -> DataFrame:
        return graph.registry_resolution(self.registry)

    def diff(self, later: DataFrame) -> DataFrame:
        return changes.compare_cards(self.cards, later)

    def validate(self) -> DataFrame:
        """All diagnostics of cards, relations and registry."""
        out = validation.card_diagnostics(self.cards).unionByName(validation.relation_diagnostics(self.cards, self.registry))
        return out.unionByName(validation.registry_diagnostics(self.cards, self.registry))


OPERATIONS = {"query": {"query": str, "top": int}, "show": {"id": str}, "context": {"id": str, "depth": int, "budget": int}, "resolve": {}, "validate": {}}


def execute(session: Session, name: str, arguments: dict) -> dict:
    """One operation by name with checked arguments: {"ok": true, "rows"} or {"ok": false, "code", "message"}."""
    if name not in OPERATIONS:
        return {"ok": False, "code": 404, "message": f"unknown operation {name}"}
    known = OPERATIONS[name]
    for key, value in arguments.items():
        if key not in known or not isinstance(value, known[key]):
            return {"ok": False, "code": 400, "message": f"bad argument {key}"}
    if {"query", "id"} & known.keys() - arguments.keys():
        return {"ok": False, "code": 400, "message": "argument missing"}
    try:
        if name == "context":
            key = session.spark.createDataFrame([(arguments["id"],)], "root string").select(T.qualify("root", session.repository).alias("root"))
            df = session.context(key, arguments.get("depth", 2), arguments.get("budget"))
        else:
            calls = {"query": lambda: session.query(arguments["query"], arguments.get("top", 5)), "show": lambda: session.show(arguments["id"]), "resolve": session.resolve, "validate": session.validate}
            df = calls[name]()
        return {"ok": True, "rows": [r.asDict(recursive=True) for r in df.collect()]}
    except Exception as e:
        return {"ok": False, "code": 500, "message": str(e)[:500]}
