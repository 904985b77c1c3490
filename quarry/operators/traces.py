"""State along a query's log that later steps depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paginate(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, round, rank, chunk, state, first_seen_round, times_seen) of hits (query_id, round, rank, chunk).

    In rank order a chunk of an earlier round is marked SEEN, others are NEW until k of a round are; what comes after
    isn't looked at. What a round shows decides what later rounds have seen, so each query's log is one function.
    """

    def run(frame):
        import pandas as pd

        seen, rows = {}, []
        for rnd, own in frame.sort_values(["round", "rank"]).groupby("round", sort=True):
            new = 0
            for r in own.itertuples():
                if new >= k:
                    break
                first, times = seen.get(r.chunk, (rnd, 0))
                state = "SEEN" if times and first < rnd else "NEW"
                new += state == "NEW"
                seen[r.chunk] = (first, times + 1)
                rows.append((r.query_id, rnd, r.rank, r.chunk, state, first, times + 1))
        return pd.DataFrame(rows, columns=["query_id", "round", "rank", "chunk", "state", "first_seen_round", "times_seen"])

    return hits.groupBy("query_id").applyInPandas(run, "query_id long, round int, rank int, chunk string, state string, first_seen_round int, times_seen int")


def budget(calls: DataFrame, identical: int, searches: int, structures: int | None = None, structure_tool: str = "structure") -> DataFrame:
    """(query_id, seq, allowed, reason) of calls (query_id, seq, tool, key): a call that is blocked counts for nothing.

    Only the first `identical` calls of a key can count, of those of one tool the first `structures`, and of what is left
    the first `searches`: once a limit is reached it stays so, so running counts tell all.
    """
    log = Window.partitionBy("query_id").orderBy("seq")
    key = Window.partitionBy("query_id", "key").orderBy("seq")
    c = calls.withColumn("first", F.row_number().over(key) <= identical)
    structural = (F.col("tool") == structure_tool) if structures is not None else F.lit(False)
    c = c.withColumn("nth", F.sum((F.col("first") & structural).cast("int")).over(log))
    c = c.withColumn("open", F.col("first") & (~structural | (F.col("nth") <= (structures or 0))))
    c = c.withColumn("allowed", F.col("open") & (F.sum(F.col("open").cast("int")).over(log) <= searches))
    used = F.coalesce(F.sum(F.col("allowed").cast("int")).over(key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.coalesce(F.sum(F.col("allowed").cast("int")).over(log.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reason = F.when(F.col("allowed"), "").when(used >= identical, "duplicate").when(total >= searches, "budget").otherwise("structure budget")
    return c.select("query_id", "seq", "allowed", reason.alias("reason"))


#: Events that count rounds, and events that end a query.
ROUND_EVENTS = ("llm_request", "llm_response", "llm_thinking_only", "llm_empty_message")
END_EVENTS = ("final_answer", "max_rounds_reached")


def rounds(log: DataFrame) -> DataFrame:
    """(query_id, rounds, terminated_by) of a log (query_id, seq, event, round); the last ending event counts."""
    return log.where("query_id is not null").groupBy("query_id").agg(
        F.coalesce(F.max(F.when(F.col("event").isin(*ROUND_EVENTS), F.col("round"))), F.lit(0)).alias("rounds"),
        F.coalesce(F.max_by("event", F.when(F.col("event").isin(*END_EVENTS), F.col("seq"))), F.lit("unknown")).alias("terminated_by"),
    )


def round_summary(per_query: DataFrame) -> DataFrame:
    """One row: how many queries, and mean, median, largest and smallest number of rounds, and how often each occurs."""
    dist = per_query.groupBy("rounds").agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("rounds", "n"))).cast("array<string>"), " ").alias("distribution"))
    one = per_query.agg(F.count("*").alias("n_queries"), F.round(F.avg("rounds"), 2).alias("mean"), F.percentile("rounds", F.lit(0.5)).alias("median"), F.max("rounds").alias("most"), F.min("rounds").alias("least"))
    return one.crossJoin(F.broadcast(dist))


def round_distribution(per_query: DataFrame) -> DataFrame:
    """(rounds, n): how many queries had so many rounds."""
    return per_query.groupBy("rounds").agg(F.count("*").alias("n"))


def log_summary(log: DataFrame) -> DataFrame:
    """One row (n_questions, n_rounds, calls) of a log (query_id, event, tool): answers of the model, the queries that have any, and the calls of each tool."""
    own = log.where("event = 'llm_response'").agg(F.countDistinct("query_id").alias("n_questions"), F.count("*").alias("n_rounds"))
    calls = log.where("event = 'tool_call'").groupBy("tool").agg(F.count("*").alias("n"))  # a row a tool
    said = calls.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "tool", F.col("n").cast("string")))), ",").alias("calls"))
    return own.crossJoin(F.broadcast(said))


def merged_results(tasks: DataFrame, done: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Tasks (index, key) with the results of both tables (key, result) by index; a task done before keeps its result."""
    both = done.select(key, "result", F.lit(0).alias("age")).unionByName(fresh.select(key, "result", F.lit(1).alias("age")))
    first = both.groupBy(key).agg(F.min_by("result", "age").alias("result"))
    return tasks.join(first, key)


def candidate_depths(shown: DataFrame, rounds: DataFrame, k: int, limit: int) -> DataFrame:
    """(query_id, round, seen, depth): how many hits to ask for in each round (query_id, round), k and those shown before, up to a limit.

    shown is what paginate gives.
    """
    new = shown.select("query_id", "chunk", F.col("first_seen_round").alias("round")).distinct().groupBy("query_id", "round").agg(F.count("*").alias("new"))
    w = Window.partitionBy("query_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.coalesce("new", F.lit(0))).over(w), F.lit(0))
    out = rounds.select("query_id", "round").distinct().join(new, ["query_id", "round"], "left").withColumn("seen", seen)
    return out.select("query_id", "round", "seen", F.greatest(F.lit(k), F.least(F.lit(limit), F.lit(k) + F.col("seen"))).alias("depth"))


def event_counts(log: DataFrame, events: tuple[str, ...]) -> DataFrame:
    """(query_id, n_<event>...): how often each query has each of some events."""
    return log.groupBy("query_id").agg(*(F.count_if(F.col("event") == e).alias(f"n_{e}") for e in events))


def resumed(tasks: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Tasks that are still to do, and those done with their results; a result that occurs twice counts once."""
    own = done.dropDuplicates([key])
    return tasks.join(own, key, "left_anti"), tasks.join(own, key)


def ingestion_totals(records: DataFrame, failed: DataFrame) -> DataFrame:
    """(group, n, seconds, tokens) of ingestion records (group, seconds, tokens), without the groups that failed."""
    fine = records.join(failed.select("group").distinct(), "group", "left_anti")
    return fine.groupBy("group").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 4).alias("seconds"), F.sum("tokens").cast("long").alias("tokens"))
