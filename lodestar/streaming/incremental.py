"""Work that goes on where it stopped: embedding new documents as files arrive, first-wins dedup of a stream."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import HashEmbedder, embed
from ..sources import files
from ..sources.records import DOC_SCHEMA


def new_documents(spark: SparkSession, folder: str, schema: str = DOC_SCHEMA, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder; the checkpoint remembers which were seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def embed_stream(docs: DataFrame, target: str, checkpoint: str, embedder: Callable[[], object] = HashEmbedder):
    """Embed what is new and stop. A batch that is run again overwrites its own folder, so no row is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select("id", embed("text", embedder).alias("v")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def dedup_stream(records: DataFrame, digest: str = "digest") -> DataFrame:
    """The first record of each digest that arrives; the state holds the digests."""
    return records.dropDuplicates([digest])


def source_identity(spark: SparkSession, docs: DataFrame) -> dict:
    """Rows and an order-free digest of a table, by partial sums."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*docs.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")).first()
    return {"n_docs": row["n"], "source": row["h"]}


def embed_chunks(docs: DataFrame, target: str, chunks: int, embedder: Callable[[], object] = HashEmbedder, limit: int | None = None, force: bool = False) -> bool:
    """Embed a table (row_id, id, text) in chunks, each committed before the next; True when all are done.

    Finished chunks are kept only if the source and the number of chunks are those of the run that wrote them; another
    source starts anew, and a broken state file is an error unless forced. ``limit`` stops after so many chunks.
    """
    spark = docs.sparkSession
    now = {**source_identity(spark, docs), "chunks": chunks}
    state_path = f"{target}/state.json"
    text = files.read_text(spark, state_path)
    state: dict | None = None
    if text is not None and not force:
        try:
            state = json.loads(text)
        except ValueError as e:
            raise ValueError(f"{state_path} is broken; run with force") from e
    if state is None or any(state.get(k) != v for k, v in now.items()):
        files.delete(spark, target)
        state = {**now, "done": []}
    for n in range(chunks):
        if n in state["done"]:
            continue
        if limit is not None and limit <= 0:
            return False
        part = docs.filter(F.pmod(F.xxhash64("row_id"), F.lit(chunks)) == n)
        part.select("row_id", "id", embed("text", embedder).alias("v")).write.mode("overwrite").parquet(f"{target}/chunk={n}")
        state["done"].append(n)
        files.write_text(spark, state_path, json.dumps(state))
        limit = None if limit is None else limit - 1
    return True
