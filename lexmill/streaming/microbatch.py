"""Mutations from a stream: each micro-batch is one atomic commit, applied once."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.textindex import ORD
from ..sources.storage import numbered

if TYPE_CHECKING:
    from ..engine import SearchEngine


def apply_batch(engine: SearchEngine, batch: DataFrame, batch_id: int, source: str) -> int:
    """Rows of the fields and ``op`` (``upsert`` or ``remove``); of an id that is in the batch more than once the row with the largest
    ``seq`` counts. A batch that was applied already, by this source and number, isn't applied again: the store keeps each source's last."""
    store, name, own = engine.store, engine.schema.id_field.name, engine.schema.struct.names
    with engine._write:
        if store.sources.get(source, -1) >= batch_id:
            return store.version
        last = batch.groupBy(name).agg(F.max_by(F.struct("op", *[c for c in own if c != name]), "seq").alias("last"))
        rows = last.select(F.col("last.op").alias("op"), *[F.col(c) if c == name else F.col(f"last.`{c}`").alias(c) for c in own])
        here = store.at().select(F.col(name).alias("_here"))
        known = rows.join(here, rows[name] == F.col("_here"), "left")
        new = numbered(known.where("op <> 'remove' AND _here IS NULL").select(*own), name).withColumn(ORD, F.col(ORD) + store.next_ord).withColumn("op", F.lit("add"))
        old = known.where("_here IS NOT NULL").withColumn("op", F.when(F.col("op") == "remove", "remove").otherwise("update")).withColumn(ORD, F.lit(None).cast("long"))
        every = new.select("op", ORD, *own).unionByName(old.select("op", ORD, *own)).withColumn("pos", F.lit(0)).persist()
        try:
            adds = every.where("op = 'add'").count()
            return engine._commit(every, "BULK", adds, source=source, batch=batch_id)
        finally:
            every.unpersist()


def start(engine: SearchEngine, df: DataFrame, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Run until stopped; ``processAllAvailable()`` drains it."""
    ready = prepare(df) if prepare else df
    return ready.writeStream.foreachBatch(lambda batch, number: apply_batch(engine, batch, number, checkpoint)).option("checkpointLocation", checkpoint).start()
