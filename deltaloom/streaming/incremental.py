"""Incremental dedup and similarity index over a stream of chunks: by micro-batches over tables, or by keyed state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from deltaloom.operators import reduce as ops
from deltaloom.sources.shared import remove


def segments(batch: int) -> list[tuple[int, int]]:
    """The ranges of earlier batches that tables are kept for: their sizes are the powers of two that add up to the number."""
    out, at = [], 0
    for k in reversed(range(batch.bit_length())):
        if batch >> k & 1:
            out.append((at, at + (1 << k)))
            at += 1 << k
    return out


class IncrementalIndex:
    """Keeps skinny tables under ``path``: first occurrences, and the latest chunk by key, in segments of batches.

    A batch reads as many segments as its number has ones, and equal neighbours are merged after it, so a row is written
    again a logarithmic number of times. Segments are named for their batches: a batch that is repeated overwrites its own
    and the result stays exact; those that no later batch reads are removed one batch later.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, ranges: list[tuple[int, int]], schema: str) -> DataFrame:
        if not ranges:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{a}-{b}" for a, b in ranges])

    def _write(self, name: str, batch: int, rows: DataFrame, schema: str, merged: Callable[[DataFrame], DataFrame]) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/{batch}-{batch + 1}")
        after = segments(batch + 1)
        if after[-1] != (batch, batch + 1):
            low = after[-1][0]
            parts = [s for s in segments(batch) if s[0] >= low] + [(batch, batch + 1)]
            merged(self._read(name, parts, schema)).write.mode("overwrite").parquet(f"{self.path}/{name}/{low}-{batch + 1}")
        for a, b in {*segments(batch - 1), (batch - 1, batch)} - set(segments(batch)) if batch > 1 else ():
            remove(self.spark, f"{self.path}/{name}/{a}-{b}")

    def process(self, rows: DataFrame, batch: int) -> None:
        """rows: ord, fp, sfp. Writes candidates/<batch>: ord, base_ord of chunks that are new.

        Rows may come in any order within a batch. A batch counts as later than those before it: a chunk's base is the latest
        by ord among earlier chunks of its batch and all of earlier batches that came before it in the stream.
        """
        rows = rows.select("ord", "fp", "sfp")
        seen, latest = "fp string, first_ord long", "sf_pos int, sf_value long, ord long"
        known = self._read("seen", segments(batch), seen)
        first = rows.groupBy("fp").agg(F.min("ord").alias("first_ord")).join(known.select("fp"), "fp", "left_anti")
        self._write("seen", batch, first, seen, lambda all_rows: all_rows.groupBy("fp").agg(F.min("first_ord").alias("first_ord")))
        first = self._read("seen", [(batch, batch + 1)], seen)
        fresh = rows.join(first.select(F.col("first_ord").alias("ord")), "ord", "left_semi")
        keys = ops.index_keys(fresh)
        last = lambda all_rows: all_rows.groupBy("sf_pos", "sf_value").agg(F.max("ord").alias("ord"))
        past = last(self._read("latest", segments(batch), latest)).join(keys.select("sf_pos", "sf_value").distinct(), ["sf_pos", "sf_value"], "left_semi")
        found = ops.latest_base(past.select("ord", "sf_pos", "sf_value").unionByName(keys)).join(fresh.select("ord"), "ord", "left_semi")
        found.write.mode("overwrite").parquet(f"{self.path}/candidates/{batch}")
        self._write("latest", batch, last(keys).select("sf_pos", "sf_value", "ord"), latest, lambda all_rows: last(all_rows).select("sf_pos", "sf_value", "ord"))

    def evict(self, batch: int, before_ord: int) -> None:
        """Forgets index keys whose latest chunk is older, among the segments that the next batch reads. Dedup keeps its own."""
        schema = "sf_pos int, sf_value long, ord long"
        for a, b in segments(batch):
            path = f"{self.path}/latest/{a}-{b}"
            kept = self.spark.read.schema(schema).parquet(path).where(F.col("ord") >= before_ord)
            kept.write.mode("overwrite").parquet(path + ".kept")
            self.spark.read.schema(schema).parquet(path + ".kept").write.mode("overwrite").parquet(path)
            remove(self.spark, path + ".kept")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()


def dedup_stream(chunks: DataFrame, time_col: str, delay: str) -> DataFrame:
    """Bounded-state dedup: chunks whose fp came before within the watermark are dropped."""
    return chunks.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["fp"])


def first_seen_stream(chunks: DataFrame, time_col: str, delay: str, keep: str = "1 hour") -> DataFrame:
    """ord, fp, first_ord, is_dup of every chunk (ord, fp, time): state keyed by fp, forgotten ``keep`` after its last chunk.

    First is by arrival, and by ord within a micro-batch; a chunk that arrives late is a duplicate of what came before it.
    Rows beyond the watermark are dropped where they come in. A chunk whose fp was forgotten counts as first again.
    """
    millis = int(pd.Timedelta(keep).total_seconds() * 1000)

    def update(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ord")
        first = state.get[0] if state.exists else int(rows["ord"].iloc[0])
        newest = int(rows["at"].max().timestamp() * 1000)
        state.update((first,))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + millis)
        yield pd.DataFrame({"ord": rows["ord"], "fp": key[0], "first_ord": first, "is_dup": rows["ord"] != first})

    rows = chunks.select("ord", "fp", F.col(time_col).alias("at")).withWatermark("at", delay)
    return rows.groupBy("fp").applyInPandasWithState(
        update, "ord long, fp string, first_ord long, is_dup boolean", "first_ord long", "append", GroupStateTimeout.EventTimeTimeout
    )


def candidate_stream(keys: DataFrame, time_col: str, delay: str, keep: str = "1 hour") -> DataFrame:
    """ord, base_ord, sf_pos for every key (ord, sf_pos, sf_value, time) that came before: state keyed by (sf_pos, sf_value) holds
    the latest chunk by arrival, forgotten ``keep`` after it. A chunk has a row for each position that hits; the lowest
    position is its base (base_of()).
    """
    millis = int(pd.Timedelta(keep).total_seconds() * 1000)

    def update(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ord")
        ords = rows["ord"].tolist()
        before = [state.get[0] if state.exists else None, *ords[:-1]]
        state.update((ords[-1],))
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + millis)
        found = [(o, b, int(key[0])) for o, b in zip(ords, before) if b is not None]
        yield pd.DataFrame(found, columns=["ord", "base_ord", "sf_pos"])

    rows = keys.select("ord", "sf_pos", "sf_value", F.col(time_col).alias("at")).withWatermark("at", delay)
    return rows.groupBy("sf_pos", "sf_value").applyInPandasWithState(
        update, "ord long, base_ord long, sf_pos int", "ord long", "append", GroupStateTimeout.EventTimeTimeout
    )


def base_of(candidates: DataFrame) -> DataFrame:
    """One base for each chunk of candidate_stream()'s rows, once they are a table: that of the lowest position."""
    best = candidates.groupBy("ord").agg(F.min(F.struct("sf_pos", "base_ord")).alias("b"))
    return best.select("ord", F.col("b.base_ord").alias("base_ord"), F.col("b.sf_pos").alias("sf_pos"))


def cluster_stream(sketched: DataFrame, scope: str) -> DataFrame:
    """ord, base_ord, sf_pos by the cluster index, a scope's chunks one after the other: state holds the scope's keys and the
    newest chunk of each cluster. Serial within a scope by nature; sketched: the scope's column, ord, sfp."""

    def update(key, batches, state: GroupState):
        keys, newest = ({}, []) if not state.exists else (dict(zip(state.get[0], state.get[1])), list(state.get[2]))
        out = []
        for o, own in pd.concat(list(batches)).sort_values("ord")[["ord", "sfp"]].itertuples(index=False):
            named = [f"{i}:{k}" for i, k in enumerate(own)]
            pos = next((i for i, k in enumerate(named) if k in keys), None)
            if pos is None:
                newest.append(int(o))
                cluster = len(newest) - 1
            else:
                cluster = keys[named[pos]]
                out.append((o, newest[cluster], pos))
                newest[cluster] = int(o)
            keys |= dict.fromkeys(named, cluster)
        state.update((list(keys), list(keys.values()), newest))
        yield pd.DataFrame(out, columns=["ord", "base_ord", "sf_pos"])

    rows = sketched.where("sfp is not null").select(scope, "ord", "sfp")
    return rows.groupBy(scope).applyInPandasWithState(
        update, "ord long, base_ord long, sf_pos int", "keys array<string>, clusters array<int>, newest array<long>", "append", GroupStateTimeout.NoTimeout
    )
