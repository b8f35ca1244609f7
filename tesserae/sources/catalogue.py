"""A catalogue of a table's files, by which a read with a budget opens no more files than it needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import non_blank, running_before
from ..tables import materialize

_FILES = "file string, modified timestamp, size bigint, rows bigint, bytes bigint"


def _name(path: Column) -> Column:
    """Local files are named with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


@dataclass
class FileCatalogue:
    """files (file, modified, size, rows, bytes: of the texts that are not blank), a row for each file with rows."""

    files: DataFrame
    schema: str
    text: str = "text"

    @classmethod
    def of(cls, scan: DataFrame, text: str = "text", known: FileCatalogue | None = None) -> FileCatalogue:
        """The catalogue of a scan of Parquet files, in one pass over their texts. With a known one only files that are new
        or changed since (by time or size) are read, and files that are gone leave it."""
        spark, names = scan.sparkSession, scan.inputFiles()
        if not names:
            return cls(spark.createDataFrame([], _FILES), scan.schema.toDDL(), text)
        listed = spark.read.format("binaryFile").load(names).select(_name(F.col("path")).alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
        same = ["file", "modified", "size"]
        old = known.files.join(listed, same, "left_semi") if known else spark.createDataFrame([], _FILES)
        new = [r.file for r in (listed.join(known.files, same, "left_anti") if known else listed).select("file").collect()]
        counted = old
        if new:
            rows = spark.read.schema(scan.schema).parquet(*new)
            about = rows.select(_name(F.col("_metadata.file_path")).alias("file"), F.when(non_blank(F.col(text)), F.octet_length(text)).alias("bytes"))
            found = about.groupBy("file").agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
            counted = old.unionByName(listed.join(found, "file"))
        return cls(materialize(counted, "catalogue"), scan.schema.toDDL(), text)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        self.files.write.mode(mode).parquet(f"{path}/files")
        self.files.sparkSession.range(1).select(F.lit(self.schema).alias("schema"), F.lit(self.text).alias("text")).write.mode(mode).json(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FileCatalogue:
        about = spark.read.schema("schema string, text string").json(f"{path}/about").first()
        return cls(spark.read.schema(_FILES).parquet(f"{path}/files"), about.schema, about.text)

    def budget(self, target: int) -> DataFrame:
        """Rows in order of their files' names and of their places in them until their texts' bytes reach target; the last
        one may overshoot. Blank texts are passed over. Only files that hold such rows are opened, and their names are
        what the driver holds; rows are counted out in the last file alone."""
        spark = self.files.sparkSession
        before = running_before(self.files, "file", F.col("bytes"))
        opened = self.files.join(before, "file").filter((F.col("before") < target) & (F.col("bytes") > 0)).select("file", "before", "bytes").collect()
        whole = sorted(r.file for r in opened if r.before + r.bytes <= target)
        last = [r for r in opened if r.before + r.bytes > target]
        read = lambda *files: spark.read.schema(self.schema).parquet(*files).filter(non_blank(F.col(self.text)))
        out = read(*whole) if whole else spark.createDataFrame([], self.schema)
        for r in last:  # one at most
            rows = read(r.file).withColumn("_row", F.col("_metadata.row_index"))
            kept = running_before(rows, "_row", F.octet_length(self.text)).filter(F.col("before") < target - r.before)
            part = rows.join(kept, "_row", "left_semi").drop("_row")
            out = out.unionByName(part) if whole else part
        return out
