"""Pagination of a query's rounds as a stream that keeps what each query has seen."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupStateTimeout

from quarry.sources.tables import scratch_path

ROUNDS = "query_id long, round int, chunks array<string>, last boolean"
SHOWN = "query_id long, round int, rank int, chunk string, state string, first_seen_round int, times_seen int"
_EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"
#: What is kept of a query: the round that comes next, its chunks with first round and times, rounds that came early.
STATE = "next int, chunks array<string>, firsts array<int>, times array<int>, waiting string"


def show(now: int, chunks: list[str], seen: dict[str, tuple[int, int]], k: int):
    """(rank, chunk, state, first round, times) of a round; chunks of an earlier round are SEEN, others NEW until k are."""
    new = 0
    for rank, chunk in enumerate(chunks):
        if new >= k:
            break
        first, times = seen.get(chunk, (now, 0))
        old = times > 0 and first < now
        new += not old
        seen[chunk] = (first, times + 1)
        yield rank, chunk, "SEEN" if old else "NEW", first, times + 1


def paginate_stream(spark: SparkSession, path: str, k: int, checkpoint: str | None = None, files: int = 4, idle: int = 3600) -> DataFrame:
    """What pagination shows (query_id, round, rank, chunk, state, first_seen_round, times_seen) of a folder of rounds.

    Files hold rows (query_id, round, chunks, last); a few of them make a batch, so a batch never has the whole log of a
    query. Rounds count from 0 and are shown in their order, whatever order they come in: one that comes early waits in the
    state. The state of a query goes with its last round, or after `idle` seconds without any. The stream reads all
    files there are and ends; with its checkpoint it goes on later with what has come since, and gives all that it ever showed.
    """

    def step(key, frames, state):
        import pandas as pd

        now, seen, waiting = 0, {}, {}
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            now, chunks, firsts, times, held = state.get
            seen, waiting = dict(zip(chunks, zip(firsts, times))), {int(i): v for i, v in json.loads(held).items()}
        for f in frames:
            for r in f.itertuples():
                waiting[int(r.round)] = (list(r.chunks), bool(r.last))
        rows, ended = [], False
        while now in waiting and not ended:
            chunks, ended = waiting.pop(now)
            rows += [(key[0], now, *x) for x in show(now, chunks, seen, k)]
            now += 1
        if ended:
            state.remove()
        else:
            state.update((now, list(seen), [a for a, _ in seen.values()], [b for _, b in seen.values()], json.dumps(waiting)))
            state.setTimeoutDuration(idle * 1000)
        yield pd.DataFrame(rows, columns=["query_id", "round", "rank", "chunk", "state", "first_seen_round", "times_seen"])

    seen = (checkpoint or scratch_path(spark, "pages-log")).rstrip("/")
    out = f"{seen}-shown"  # a sink keeps its own log, which goes with the checkpoint
    rounds = spark.readStream.schema(ROUNDS).option("maxFilesPerTrigger", files).parquet(path)
    shown = rounds.groupBy("query_id").applyInPandasWithState(step, SHOWN, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    before = spark.conf.get(_EMPTY, None)
    spark.conf.set(_EMPTY, "false")  # batches without files, which only look for idle queries, would keep it from ending
    try:
        writer = shown.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen)
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(_EMPTY) if before is None else spark.conf.set(_EMPTY, before)
    return spark.read.schema(SHOWN).parquet(out)
