"""Archives of documentation: members of tar files and symbol inventories as rows."""

from __future__ import annotations

import io
import tarfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def tar_members(archives: DataFrame) -> DataFrame:
    """archives (content binary: tar files, compressed or not) -> path (without the top folder), content, source_hash:
    one row per regular file; absolute paths and those with .. are refused."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        path = member.name.partition("/")[2]
                        if not member.isfile() or not path:
                            continue
                        if member.name.startswith("/") or ".." in member.name.split("/"):
                            raise ValueError(f"unsafe path in an archive: {member.name}")
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([tar.extractfile(member).read()], pa.binary())], ["path", "content"])

    return archives.select("content").mapInArrow(run, "path string, content binary").withColumn("source_hash", F.sha2("content", 256))


def inventory(files: DataFrame) -> DataFrame:
    """files (content binary: inventories of version 2) -> name, role, uri, module of the entries of the py domain."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                head, body = content.split(b"\n", 4)[:4], content.split(b"\n", 4)[4]
                if b"version 2" not in head[0]:
                    raise ValueError("not an inventory of version 2")
                yield pa.RecordBatch.from_arrays([pa.array(zlib.decompress(body).decode().splitlines(), pa.string())], ["line"])

    lines = files.select("content").mapInArrow(run, "line string")
    part = lambda n: F.regexp_extract("line", r"^(.+?)\s+([^\s:]+):(\S+)\s+(-?\d+)\s+(\S*)\s+(.*)$", n)
    rows = lines.select(part(1).alias("name"), part(2).alias("domain"), part(3).alias("kind"), part(5).alias("uri")).filter("domain = 'py'")
    return rows.select("name", F.concat_ws(":", "domain", "kind").alias("role"), T.expand_inventory_uri(F.col("uri"), F.col("name")).alias("uri"), T.module_of(F.col("name")).alias("module"))
