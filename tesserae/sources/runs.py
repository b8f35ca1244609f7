"""Evaluation runs and ingested versions as folders of tables."""

from __future__ import annotations

import os
import time
import urllib.request
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionConflict(ValueError):
    """Another archive was ingested under this version."""


def run_folder(root: str, tag: str, at: datetime | None = None) -> str:
    return f"{root.rstrip('/')}/{(at or datetime.now(UTC)).strftime('%Y-%m-%dT%H-%M-%S')}-{tag}"


def write_run(path: str, results: DataFrame, metrics: DataFrame, **metadata: str) -> None:
    """results as per_query and one row of metrics with the metadata as results; an existing run is not overwritten."""
    metrics.withColumns({k: F.lit(v) for k, v in metadata.items()}).write.mode("errorifexists").json(f"{path}/results")
    results.write.mode("errorifexists").json(f"{path}/per_query")


def claim(spark: SparkSession, path: str, content: str) -> str:
    """Creates a file unless there is one, and returns what it holds: content, or what another writer put there first.

    Exactly one of several writers creates it: the file system refuses a second creation (local files by the machine
    itself, others by create without overwriting, which HDFS and stores with conditional writes keep to)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    try:
        if fs.getScheme() == "file":
            with open(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as out:
                out.write(content)
        else:
            out = fs.create(at, False)
            out.write(bytearray(content.encode()))
            out.close()
        return content
    except (FileExistsError, Py4JJavaError) as e:
        if isinstance(e, Py4JJavaError) and "AlreadyExists" not in str(e.java_exception):
            raise
    for _ in range(100):  # the other writer has created it, and may be about to write it
        stream = fs.open(at)
        held = bytes(stream.readAllBytes()).decode()
        stream.close()
        if held:
            return held
        time.sleep(0.05)
    raise VersionConflict(f"{path} was created and never written; remove it if its writer is gone")


def ingest(spark: SparkSession, archive: DataFrame, version: str, root: str, force: bool = False) -> tuple[str, bool]:
    """archive (path, content binary, as Spark's binaryFile source reads it) -> (short hash, whether it is new).

    The files' paths and hashes make the version's fingerprint, first in ranges of the hash (a row each of 4096), then
    over the ranges. The same one again changes nothing; another under the same version raises VersionConflict unless
    force. A writer claims the version before it writes anything, so of several with different archives one goes on;
    with the same archive they write the same. Files are written under version/hash, then the manifest: a claim without
    one is of a writer that failed or is at work, and the same archive can be ingested again."""
    prints = archive.select(F.sha2(F.concat_ws("\n", "path", F.sha2("content", 256)), 256).alias("h"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    ranges = prints.groupBy(F.substring("h", 1, 3).alias("range")).agg(joined("h").alias("h"))
    whole = ranges.agg(joined(F.concat("range", "h")).alias("h")).first()["h"]
    short = whole[:12]
    try:
        known = {r.sha_short for r in spark.read.json(f"{root}/manifest/*").filter(F.col("docs_version") == version).select("sha_short").collect()}
    except AnalysisException:
        known = set()
    if short in known:
        return short, False
    if known and not force:
        raise VersionConflict(f"{version} is already ingested as {', '.join(sorted(known))}")
    first = claim(spark, f"{root}/claims/{version}", short)
    if first != short and not force:
        raise VersionConflict(f"{version} is being ingested as {first}")
    folder = f"{root}/{version}/{short}"
    archive.select("path", "content", F.sha2("content", 256).alias("source_hash")).write.mode("overwrite").parquet(f"{folder}/files")
    manifest = spark.range(1).select(F.lit(version).alias("docs_version"), F.lit(short).alias("sha_short"), F.lit(whole).alias("docs_archive_sha256"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ingest_timestamp"))
    manifest.write.mode("overwrite").json(f"{root}/manifest/{version}-{short}")
    return short, True


def download(url: str, to: str, retries: int = 3, timeout: float = 60.0) -> str:
    """Fetches an archive in blocks to a temporary name, then renames it; waits longer after each failure."""
    for attempt in range(retries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as response, open(f"{to}.part", "wb") as out:
                while block := response.read(1 << 20):
                    out.write(block)
            os.replace(f"{to}.part", to)
            return to
        except OSError:
            if attempt == retries - 1:
                raise
            time.sleep(2**attempt)
    return to
