"""A scan that goes on where it stopped: a stream of files into a snapshot, one version for each micro-batch.

The stream's checkpoint knows which files were read; the snapshot knows which batch was committed.  A batch that was
committed but not marked as done by the stream comes again with the same number, and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.operators import files
from quarry.plans import parsers
from quarry.sources import languages, snapshots

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def candidates(found: DataFrame, root: str, language: str, functions: bool = False) -> DataFrame:
    """(rel_path, language, module, source) of the files that the path rules, the size limit and the sniff keep."""
    plain = F.regexp_replace("path", r"^file:/+", "/")
    rel = F.substr(plain, F.instr(plain, F.lit(root)) + len(root) + 1)
    hit = files.sniff("content", [n.encode() for n in languages.needles(language, functions)])
    rows = found.withColumn("rel_path", rel).where(files.path_verdict("rel_path", languages.EXTENSIONS[language]) == "kept").where(files.within_size("length")).where(hit)
    return rows.select("rel_path", F.lit(language).alias("language"), scalars.module_name("rel_path", language).alias("module"), F.decode("content", "utf-8").alias("source"), F.sha2("content", 256).alias("sha"))


def scan(spark: SparkSession, root: str, language: str, out: str, checkpoint: str, functions: bool = False, per_batch: int = 1000, parse: Callable[[DataFrame], DataFrame] = parsers.extract):
    """Scan what is new below ``root`` into the snapshot ``out``; gives the query, which ends when there is no more.

    One row per file that was parsed and one per endpoint, function, class or import of it (``kind`` null for the file itself).
    """
    root = root.removeprefix("file://").rstrip("/")
    stream = (spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root))

    def commit(batch: DataFrame, number: int) -> None:
        rows = candidates(batch, root, language, functions).persist()
        try:
            facts = parse(rows.drop("sha"))
            one = rows.select("rel_path", "language", "sha")
            snapshots.write(one.unionByName(facts, allowMissingColumns=True), out, append=True, tag=(checkpoint, number))
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
