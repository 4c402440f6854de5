"""New region files as a stream: every micro-batch is baked and upserted.

An extension of the batch job. Levels above 3 join tiles of several regions, so a batch of
single regions can give levels 0 to 3 only; run the batch job for those above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stratavox.operators.tiles import REGION_LEVELS, nested_tiles
from stratavox.plans.job import BakeOptions, assemble
from stratavox.sources.blobs import encode
from stratavox.sources.regions import scan
from stratavox.sources.sqlite import write_tiles
from stratavox.sources.tables import written

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, options: BakeOptions, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that upserts the tiles of each new region file of a folder.

    A batch that runs again after a failure replaces its own rows, so results stay the same.
    """
    if options.detail_levels > REGION_LEVELS:
        raise ValueError(f"a stream of regions gives levels up to {REGION_LEVELS}")
    files = (
        spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "r.*.mca").load(options.map)
    )

    def upsert(batch: DataFrame, _: int) -> None:
        chunks = written(scan(batch, options.box), "chunks")
        made = assemble(chunks, options.detail_levels, options.top_only)
        write_tiles(encode(nested_tiles(made.tiles, made.runs), options.zstd_level), made.hashes, options.output)

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
