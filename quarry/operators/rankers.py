"""Ranking and gate functions that a user registers."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.retrieval import top_k
from quarry.sources.tables import against

_RANKERS: dict[str, Callable[[str, str], float]] = {}
_TOOLS: dict[str, Callable[[str, str, str], float]] = {}
_GATES: dict[str, Callable[[str, int], float]] = {}


def register_ranker(name: str, score: Callable[[str, str], float]) -> None:
    """score(question, document name) gives a number; higher ranks first."""
    _RANKERS[name] = score


def register_gate(name: str, confidence: Callable[[str, int], float]) -> None:
    """confidence(question, number of results) gives a number; from 0.5 on the results are used."""
    _GATES[name] = confidence


def rank_with(name: str, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, name, score, rank): a bounded set of queries, sent to all documents (doc_id, name)."""
    return _ranked(_RANKERS[name], queries, docs, k, ["query", "name"])


def register_tool(name: str, score: Callable[[str, str, str], float]) -> None:
    """score(question, document name, capability) gives a number; from above 0 on a document is a result."""
    _TOOLS[name] = score


def search_with(name: str, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The same by a tool that gets the query's capability too: queries (query_id, query, capability); scores above 0 alone."""
    return _ranked(_TOOLS[name], queries, docs, k, ["query", "name", "capability"], least=0.0)


def _ranked(function: Callable[..., float], queries: DataFrame, docs: DataFrame, k: int, given: list[str], least: float | None = None) -> DataFrame:
    @F.pandas_udf("double")
    def score(asked: pd.DataFrame) -> pd.Series:
        return pd.Series([float(function(*x)) for x in asked.itertuples(index=False)], dtype="float64")

    pairs = against(docs, queries, "query_id").select("query_id", "doc_id", "name", score(F.struct(*given)).alias("score"))
    return top_k(pairs if least is None else pairs.where(F.col("score") > least), k, "name", "doc_id")


def gate_with(name: str, queries: DataFrame) -> DataFrame:
    """Adds use_tool and confidence to queries (query_id, query, n_results)."""
    function = _GATES[name]

    @F.pandas_udf("double")
    def confidence(question, n):
        import pandas as pd

        return pd.Series([float(function(q, int(x))) for q, x in zip(question, n, strict=True)])

    out = queries.withColumn("confidence", confidence("query", "n_results"))
    return out.withColumn("use_tool", (F.col("confidence") >= 0.5) & (F.col("n_results") > 0))


def gated(routed: DataFrame, base: DataFrame, gate: DataFrame) -> DataFrame:
    """The routed rows (query_id, ...) of queries whose gate (query_id, use_tool) says so and that have any, else the base rows.

    A query without a gate, as after an error, falls back. is_routed tells which.
    """
    fine = gate.where("use_tool").select("query_id").join(routed.select("query_id").distinct(), "query_id", "left_semi")
    own = routed.join(fine, "query_id", "left_semi").withColumn("is_routed", F.lit(True))
    return own.unionByName(base.join(fine, "query_id", "left_anti").withColumn("is_routed", F.lit(False)))
