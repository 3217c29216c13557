"""Sharding: proportional stratified interleaving, so that every shard has the mixture of sources."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table, whole

#: Rows that one window task ranks on average.
CELL_ROWS = 20_000
MAX_CELL_BITS = 16


def _cell_bits(rows: int) -> int:
    return min(MAX_CELL_BITS, max(2, (rows // CELL_ROWS).bit_length()))


def _before(counts: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Rows in earlier cells of the same key, and in all of them. At most 2 ** MAX_CELL_BITS rows a key."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    running = F.sum("n").over(w.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("before", F.coalesce(running, F.lit(0))).withColumn("in_all", F.sum("n").over(w)).drop("n")


def interleaved_shards(rows: DataFrame, stratum: str, ids: list[str], n_shards: int, seed: int = 0) -> DataFrame:
    """rows with position, shard and slot.

    Rows are shuffled within their stratum by a seeded hash of ids and get the fractional rank (rank - 1/2) / rows of the
    stratum; the order by fractional rank is cut into n_shards runs whose row counts differ by at most one. A rank is a
    count of the rows in earlier hash cells plus a rank inside the cell, so no task holds a whole stratum. Null strata
    form one stratum; rows alike in all ids are interchangeable. An empty table gives an empty result.
    """
    mixed = F.xxhash64(F.lit(seed), *[F.col(c) for c in ids])
    base = staged(rows.withColumns({"_s": F.coalesce(F.concat(F.lit("="), F.col(stratum)), F.lit("")), "_u": mixed}), "shard-rows")
    total = base.count()
    bits = _cell_bits(total)
    base = base.withColumn("_cell", F.shiftright("_u", 64 - bits))
    counts = _before(base.groupBy("_s", "_cell").agg(F.count(F.lit(1)).alias("n")), ["_s"], "_cell")
    inside = Window.partitionBy("_s", "_cell").orderBy("_u", *ids)
    ranked = base.join(counts, ["_s", "_cell"]).withColumn("_rank", F.col("before") + F.row_number().over(inside))
    ranked = staged(ranked.withColumn("_f", (F.col("_rank") - 0.5) / F.col("in_all")).drop("_cell", "before", "in_all"), "shard-ranks")
    ranked = ranked.withColumn("_cell", F.floor(F.col("_f") * (1 << bits)).cast("long"))
    counts = _before(ranked.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")), [], "_cell")
    order = Window.partitionBy("_cell").orderBy("_f", "_s", "_rank")
    placed = ranked.join(counts, "_cell").withColumn("position", F.col("before") + F.row_number().over(order) - 1)
    placed = placed.withColumn("shard", F.expr(f"(position * {n_shards}) div greatest(in_all, 1)").cast("int"))
    first = F.expr(f"(cast(shard as bigint) * in_all + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("slot", F.col("position") - first).drop("_s", "_u", "_f", "_rank", "_cell", "before", "in_all")


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (bytes plus 16), text_crc32, law, position, shard, slot. A null text has no bytes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), whole(text_col).alias("_t"))
    rows = rows.select("doc_id", "source", (F.octet_length("_t") + 16).cast("long").alias("size"), F.crc32("_t").alias("text_crc32"))
    return interleaved_shards(rows, "source", ["doc_id", "text_crc32", "size"], n_shards, seed).withColumn("law", F.lit("rows"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
