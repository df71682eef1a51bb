"""Graphs whose edges arrive while programs run on them, by Structured Streaming.

Each micro-batch is appended as one Parquet folder named by its number, so a batch that is retried replaces itself. What
belongs to the graph is in a manifest, written anew under a higher number after each change: a reader or a restarted
driver takes the highest one that is whole, and nothing that it names is ever written again or removed before a later
manifest is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.graph import proper
from lattica.operators.ranking import pagerank, top
from lattica.plans.store import shared_dir, stored


class DynamicGraph:
    """Edges in folders under `path`: base, batch-<n>, and deleted-<n>."""

    SCHEMA = "src long, dst long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        """A graph of its own folder, or the one that was left under path."""
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/dynamic-{uuid.uuid4().hex}"
        self._parts: list[str] = []
        self._deleted: list[str] = []
        self._done: list[str] = []  # names of batches that are part of a compacted folder
        self._version = -1
        self._load()

    def _files(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self) -> None:
        path, files = self._files(self.path)
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        for version in sorted((int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-")), reverse=True):
            done, there = self._files(f"{self.path}/manifest-{version}/_SUCCESS")
            if there.exists(done):
                rows = self.spark.read.schema("kind string, name string, at int").parquet(f"{self.path}/manifest-{version}").orderBy("at").collect()
                self._parts, self._deleted, self._done = ([r.name for r in rows if r.kind == k] for k in ("part", "deleted", "done"))
                self._version = version
                return

    def _commit(self) -> None:
        names = [(k, n) for k, group in (("part", self._parts), ("deleted", self._deleted), ("done", self._done)) for n in group]
        self._version += 1
        rows = self.spark.createDataFrame([(k, n, at) for at, (k, n) in enumerate(names)], "kind string, name string, at int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest-{self._version}")

    def _write(self, rows: DataFrame, name: str, kept: list[str]) -> None:
        if name in self._done:
            return  # a batch that is retried after its compaction
        place = f"{self.path}/{name}"
        rows.select(F.col("src").cast("long"), F.col("dst").cast("long")).write.mode("overwrite").parquet(place)
        if place not in kept:
            kept.append(place)
            self._commit()

    def add(self, edges: DataFrame, name: str) -> None:
        """Appends edges; self-loops are accepted and ignored. The same name again replaces them, or does nothing once they are compacted."""
        self._write(proper(edges), name, self._parts)

    def delete(self, edges: DataFrame, name: str) -> None:
        """Marks all parallel edges of these pairs as deleted until the next compaction."""
        self._write(edges, name, self._deleted)

    def edges(self) -> DataFrame:
        """What is there now: base and batches, without what is deleted."""
        rows = self.spark.read.schema(self.SCHEMA).parquet(*self._parts) if self._parts else self.spark.createDataFrame([], self.SCHEMA)
        if self._deleted:
            rows = rows.join(self.spark.read.schema(self.SCHEMA).parquet(*self._deleted).distinct(), ["src", "dst"], "left_anti")
        return rows

    def compact(self, name: str = "compacted", partitions: int | None = None) -> None:
        """Rewrites everything as one new folder, range-partitioned by dst and sorted by src; the parts go once the manifest names the new one."""
        rows = self.edges()
        rows = (rows.repartitionByRange(partitions, "dst") if partitions else rows.repartitionByRange("dst")).sortWithinPartitions("src")
        old, place = self._parts + self._deleted, f"{self.path}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(place)
        self._done += [x.rsplit("/", 1)[1] for x in old]
        self._parts, self._deleted = [place], []
        self._commit()
        for part in old:
            path, files = self._files(part)
            files.delete(path, True)

    def should_compact(self, most_parts: int = 10, most_deleted: float = 0.1) -> bool:
        if len(self._parts) > most_parts:
            return True
        gone = self.spark.read.schema(self.SCHEMA).parquet(*self._deleted).count() if self._deleted else 0
        return gone > most_deleted * max(1, self.edges().count())

    def follow(self, stream: DataFrame, program: Callable[[DataFrame, int], None], checkpoint: str | None = None, most_parts: int = 10, most_deleted: float = 0.1):
        """Starts a query that appends each micro-batch of stream (src, dst) and runs program(edges, batch number); ends with what is there."""

        def batch(rows: DataFrame, n: int) -> None:
            self.add(rows, f"batch-{n}")
            if self.should_compact(most_parts, most_deleted):
                self.compact()
            program(self.edges(), n)

        place = checkpoint or f"{self.path}/checkpoint"
        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", place).trigger(availableNow=True).start()


def edge_stream(spark: SparkSession, path: str, files_per_batch: int = 1, source: str = "parquet") -> DataFrame:
    """A stream of (src, dst) files, so many per micro-batch."""
    return spark.readStream.schema(DynamicGraph.SCHEMA).option("maxFilesPerTrigger", files_per_batch).format(source).load(path)


def streaming_pagerank(spark: SparkSession, base: DataFrame, stream: DataFrame, supersteps: int = 3, final_supersteps: int = 3, n: int = 20, threshold: float | None = None, **options) -> tuple[DataFrame, list[list]]:
    """id and rank after the stream has ended, and the top vertices after each batch.

    Every batch resumes from the ranks before it, which carries most of the work over; final_supersteps follow the last.
    With a threshold, a batch ends as soon as no rank moves further than that, within its supersteps. options go to
    DynamicGraph.follow(). How fast edges come in is the stream's own setting (see edge_stream).
    """
    graph, state, tops = DynamicGraph(spark), {}, []
    graph.add(base, "base")

    def program(edges: DataFrame, _: int) -> None:
        state["ranks"] = stored(pagerank(edges, supersteps, start=state.get("ranks"), tolerance=threshold), "ranks")
        tops.append([tuple(r) for r in top(state["ranks"], "rank", n).collect()])  # n rows

    graph.follow(stream, program, **options).awaitTermination()
    return pagerank(graph.edges(), final_supersteps, start=state.get("ranks"), tolerance=threshold), tops


def windowed_counts(events: DataFrame, time: str, width: str, slide: str | None = None, late: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """Counts per time window and group of a stream or a table; late rows count within the watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(w.alias("w"), *(by or [])).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "n")
