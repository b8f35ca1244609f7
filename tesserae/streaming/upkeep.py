"""A BM25 index that is kept up to date: generations of postings, with what newer ones replace.

A generation holds the chunks that a batch of changes adds, changes or deletes, the postings of those that stay, and by
how much each term's number of chunks changed. A chunk counts as its newest generation has it. Searches and statistics
come from all generations together and equal those of an index that is built anew; compact() makes them one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.bm25 import FLOOR, Bm25Index, term_counts
from ..tables import materialize

_CHUNKS, _POSTINGS, _CHANGES = "chunk_id {k}, dl bigint, deleted boolean", "chunk_id {k}, term string, tf bigint, dl bigint", "term string, df bigint"


@dataclass
class IndexGenerations:
    """The generations in a folder. kind: the type of chunk ids."""

    spark: SparkSession
    path: str
    kind: str = "string"

    def _fs(self, *parts: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def generations(self) -> list[int]:
        """The generations that are whole: a generation's name is written last, and one that replaces others names them."""
        fs, at = self._fs("done")
        named = {int(s.getPath().getName().split(".")[0]): s.getPath() for s in fs.listStatus(at)} if fs.exists(at) else {}
        gone: set[int] = set()
        for path in named.values():
            stream = fs.open(path)
            gone |= set(json.loads(bytes(stream.readAllBytes()).decode()))
            stream.close()
        return sorted(set(named) - gone)

    def _finish(self, generation: int, replaces: list[int]) -> None:
        fs, at = self._fs("done", f"{generation}.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(replaces).encode()))
        out.close()

    def _read(self, table: str, ddl: str) -> DataFrame:
        known = self.generations()
        none = self.spark.createDataFrame([], ddl.format(k=self.kind) + ", generation bigint")
        for g in known:
            none = none.unionByName(self.spark.read.schema(ddl.format(k=self.kind)).parquet(f"{self.path}/generation={g}/{table}").withColumn("generation", F.lit(g).cast("bigint")))
        return none

    def live(self) -> DataFrame:
        """chunk_id, dl, generation of the chunks that are there, as their newest generation has them."""
        newest = self._read("chunks", _CHUNKS).groupBy("chunk_id").agg(F.max(F.struct("generation", "dl", "deleted")).alias("n"))
        return newest.filter("NOT n.deleted").select("chunk_id", "n.dl", "n.generation")

    def apply(self, changes: DataFrame, generation: int, text: str = "text", order: str | None = None) -> bool:
        """changes (chunk_id, text; a null text deletes) as one generation; whether it was new. Numbers ascend: a number
        that is already there, as after a failure that a stream repeats, changes nothing. Of several changes of one
        chunk the last by `order` counts (without it they must be the same)."""
        known = self.generations()
        if generation in known or known and generation < known[-1]:
            return False
        last = W.partitionBy("chunk_id").orderBy(F.desc(order) if order else F.xxhash64(text))
        rows = changes.filter("chunk_id IS NOT NULL").withColumn("_n", F.row_number().over(last)).filter("_n = 1")
        rows = materialize(rows.select(F.col("chunk_id").cast(self.kind), F.col(text).alias("text")), "index-changes")
        counts = materialize(term_counts(rows.filter("text IS NOT NULL"), "chunk_id"), "index-counts")
        lengths = counts.groupBy("chunk_id").agg(F.sum("tf").alias("dl"))
        old = self._read("postings", _POSTINGS).join(self.live().join(rows, "chunk_id", "left_semi").select("chunk_id", "generation"), ["chunk_id", "generation"])
        change = counts.select("term", F.lit(1).alias("by")).unionByName(old.select("term", F.lit(-1).alias("by"))).groupBy("term").agg(F.sum("by").cast("bigint").alias("df"))
        out = f"{self.path}/generation={generation}"
        change.filter("df <> 0").write.mode("overwrite").parquet(f"{out}/changes")
        counts.join(lengths, "chunk_id").select("chunk_id", "term", "tf", "dl").write.mode("overwrite").parquet(f"{out}/postings")
        rows.join(lengths, "chunk_id", "left").select("chunk_id", F.coalesce("dl", F.lit(0)).cast("bigint").alias("dl"), F.col("text").isNull().alias("deleted")).write.mode("overwrite").parquet(f"{out}/chunks")
        self._finish(generation, [])
        return True

    def index(self) -> Bm25Index:
        """The index over all chunks that are there now. Postings of chunks that newer generations changed are left out by a
        join on ids; numbers of chunks a term come from the changes alone."""
        live = materialize(self.live(), "index-live")
        stats = materialize(live.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), "index-stats")
        df = self._read("changes", _CHANGES).groupBy("term").agg(F.sum("df").cast("bigint").alias("df")).filter("df > 0")
        raw = materialize(df.withColumn("raw", F.log(stats.select("n").scalar() - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "index-terms")
        terms = raw.select("term", "df", F.when(F.col("raw") < 0, FLOOR * raw.agg(F.avg("raw")).scalar()).otherwise(F.col("raw")).alias("idf"))
        postings = self._read("postings", _POSTINGS).join(live.select("chunk_id", "generation"), ["chunk_id", "generation"]).select("chunk_id", "term", "tf", "dl")
        return Bm25Index(postings, terms, stats)

    def compact(self) -> int | None:
        """Writes all generations as one, numbered after them; None where there are none. Files of those before stay until
        they are removed, for readers that have begun."""
        known = self.generations()
        if not known:
            return None
        index, out = self.index(), f"{self.path}/generation={known[-1] + 1}"
        index.postings.write.mode("overwrite").parquet(f"{out}/postings")
        index.terms.select("term", "df").write.mode("overwrite").parquet(f"{out}/changes")
        self.live().select("chunk_id", "dl", F.lit(False).alias("deleted")).write.mode("overwrite").parquet(f"{out}/chunks")
        self._finish(known[-1] + 1, known)
        return known[-1] + 1


def keep_up(changes: DataFrame, path: str, checkpoint: str, kind: str = "string", order: str | None = None):
    """A stream of changes (chunk_id, text) into the generations of a folder, a batch each; compact after the stream has
    stopped only, as batches are numbered by it."""

    def write(batch: DataFrame, epoch: int) -> None:
        IndexGenerations(batch.sparkSession, path, kind).apply(batch, epoch, order=order)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
