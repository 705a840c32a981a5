"""A drop folder: files land as they arrive, each once or more often without harm."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources.config import IngestionError, Source
from tallyframe.sources.landing import ingest

#: What Spark's reader of whole files gives for each.
FILES = "path string, modificationTime timestamp, length long, content binary"
PATTERNS = "*.{csv,CSV,ofx,OFX,qfx,QFX}"


@dataclass(frozen=True)
class Outcome:
    path: str
    status: str  # ingested, unmatched or failed
    source: str | None = None
    new_rows: int = 0
    error: str | None = None


def resolve(path: str, sources: list[Source], name: str | None = None) -> Source | None:
    """By name, else by the file's stem, else the one source of orders if the file is named as their exporter does."""
    stem = path.rsplit("/", 1)[-1].rpartition(".")[0]
    by_name = {s.name: s for s in sources}
    if (name or stem) in by_name:
        return by_name[name or stem]
    orders = [s for s in sources if s.kind == "orders"]
    return orders[0] if name is None and stem.startswith("Retail.OrderHistory") and len(orders) == 1 else None


def take(spark: SparkSession, path: str, sources: list[Source], root: str, name: str | None = None) -> Outcome:
    source = resolve(path, sources, name)
    if source is None:
        return Outcome(path, "unmatched")
    try:
        return Outcome(path, "ingested", source.name, ingest(spark, source, path, root))
    except IngestionError as e:
        return Outcome(path, "failed", source.name, error=str(e))


def watch(spark: SparkSession, folder: str, sources: list[Source], root: str, checkpoint: str, report: Callable[[Outcome], None], once: bool = True):
    """A streaming query over the folder's files. once: what is there now, then it ends; else it goes on.

    The stream only says which files came; rows are deduplicated against the whole layer, since a state that forgets would take an
    old export twice. A bad file is reported and doesn't stop the others.
    """

    def batch(files: DataFrame, _: int) -> None:
        for row in files.select("path").orderBy("path").toLocalIterator():
            report(take(spark, row["path"], sources, root))

    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", PATTERNS).load(folder).select("path", F.col("length"))
    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
