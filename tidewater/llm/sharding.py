"""Contiguous shards of balanced bytes (operator 1).

Rows are put in global order of id by one range partitioning, and written with their place
(range, row in the range).  The byte totals of the ranges, one row each, give every range
its global prefix sum; a cut at each equal target falls into one known range, so only the
ranges with a cut are summed row by row.  A shard number is then a comparison with the cuts
of the row's own range: the texts cross the network once.

Special cases.  Null text: 1 byte, checksum of the empty text.  Null ids come first; rows
that share an id are ordered by checksum, and equal rows are interchangeable.  A row larger
than a target may leave shards empty.  An empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, staged, width

LAW = "bytes"


def shard_documents(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, text, size, shard, slot``: shards 0 to ``shards - 1`` are contiguous in id
    order, each row lies in the shard that holds the middle of its bytes, and ``slot`` counts
    the shard's rows from 0."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(1)
    rows = rows.withColumns({"size": size, "tie": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))})
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", "tie", "row"]
    placed = rows.repartitionByRange(width(docs.sparkSession), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    placed = staged(placed.select("doc_id", "text", "size", "tie", place.alias("place")), "ranges")
    placed = placed.withColumn("part", F.shiftright("place", 33))

    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    upto = Window.orderBy("part")  # one row per range
    totals = totals.select("part", "bytes", "rows",
                           (F.sum("bytes").over(upto) - F.col("bytes")).alias("bytes_before"),
                           (F.sum("rows").over(upto) - F.col("rows")).alias("rows_before"))
    total = totals.agg(F.sum("bytes").alias("total"))
    ranges = staged(totals.crossJoin(F.broadcast(total)), "totals").repartition(1)  # total is one row

    def shard_at(twice_middle):
        """Shard of the byte whose doubled position is given."""
        at = F.floor(twice_middle.cast("decimal(38,0)") * shards / (F.col("total") * 2)).cast("int")
        return F.least(at, F.lit(shards - 1))

    first = shard_at(F.col("bytes_before") * 2).alias("first_shard")
    last = shard_at((F.col("bytes_before") + F.col("bytes")) * 2).alias("last_shard")
    ranges = staged(ranges.select("*", first, last), "range_shards")
    torn = ranges.filter("first_shard < last_shard").select(F.col("part").alias("p2"), "bytes_before", "total")
    inside = Window.partitionBy("part").orderBy("place")
    near_cut = placed.select("part", "place", "size").join(F.broadcast(torn), F.col("part") == F.col("p2"))
    twice = (F.col("bytes_before") + F.sum("size").over(inside)) * 2 - F.col("size")
    cuts = near_cut.withColumn("shard", shard_at(twice)).groupBy("part", "shard").agg(
        F.min("place").alias("from_place"))
    cuts = cuts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("from_place", "shard"))).alias("cuts"))
    ranges = staged(ranges.join(cuts.withColumnRenamed("part", "p3"), F.col("part") == F.col("p3"), "left").select(
        F.col("part").alias("p4"), "first_shard", "rows_before", "cuts"), "cuts")
    row = F.col("rows_before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    mine = F.element_at(F.filter("cuts", lambda c: c["from_place"] <= F.col("place")), -1)["shard"]
    dealt = placed.join(F.broadcast(ranges), F.col("part") == F.col("p4")).select(  # one row per range
        "doc_id", "text", "size", "tie", row.alias("row"),
        F.when(F.col("cuts").isNull(), F.col("first_shard")).otherwise(mine).alias("shard"))
    starts = dealt.groupBy("shard").agg(F.min("row").alias("start")).withColumnRenamed("shard", "s2")
    return dealt.join(F.broadcast(starts), F.col("shard") == F.col("s2")).select(  # one row per shard
        "doc_id", "text", "size", "shard", (F.col("row") - F.col("start")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the shards as folders ``shard=N`` of Parquet files."""
    sharded.write.partitionBy("shard").parquet(path)
