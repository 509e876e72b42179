"""Shards with bytes, tokens and rows balanced jointly: vector bin packing by dot product."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flightlens.llm.common import beside, hash32, ranked, read_documents, with_place, word_count
from flightlens.session import stored

SHARDS = 16
# A group of equal texts with more than this part of a shard is placed on its own, so there are at most
# 3 * shards * PARTS of them; the others go together in lots.
PARTS = 64
# Lots are (size class, hash modulo LOTS); a long has 64 size classes.
LOTS = 512


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every item. ``vectors``: one row per item, one column per dimension, in shares of the total.

    Items go in order of their largest share. Among shards with room for the item's first dimension (all shards, if none
    has), it goes where the dot product with the residual capacity is highest; the lowest number wins a tie. The last
    tenth, small items all, evens out the first dimension: it goes where most of that is left.
    """
    capacity = 1.0 / shards
    left = np.full((shards, vectors.shape[1]), capacity)
    out = np.zeros(len(vectors), dtype=np.int64)
    order = np.lexsort((np.arange(len(vectors)), -vectors.max(axis=1))) if len(vectors) else np.zeros(0, dtype=int)
    placed = np.cumsum(vectors[order, 0]) if len(vectors) else order
    for i, done in zip(order.tolist(), placed.tolist(), strict=True):
        v = vectors[i]
        score = left @ v
        fits = left[:, 0] >= v[0]
        if fits.any() and done <= 0.9:
            score = np.where(fits, score, -np.inf)
        else:
            score = left[:, 0]
        out[i] = best = int(np.argmax(score))
        left[best] -= v
    return out


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """All columns of ``docs`` with the shard and slot of every row; see :func:`_pack`. Names may clash."""
    return beside(docs, lambda rows: _pack(rows, text, key, shards), (text, key))


def _pack(docs: DataFrame, text: str, key: str, shards: int) -> DataFrame:
    """Add ``size``, ``tokens``, ``shard`` and ``slot`` to every row of ``docs``.

    Size is the UTF-8 bytes of the text plus 1, tokens its words. Rows of equal texts form a group, which goes to one
    shard; only a group with more than a whole shard's part in some dimension is cut into pieces, by the hash of the key.
    Groups over 1/64 shard are items of their own, the rest go in lots of like size; both lists are bounded by parameters,
    whatever the input, so the greedy choice over them is made on the driver. ``slot`` numbers a shard's rows from 0 without
    gaps, in the order of the hash of the key. Null texts count as empty. Null keys hash alike. An empty table stays
    empty. Columns of the same names as the new ones are replaced.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.drop("size", "tokens", "shard", "slot").withColumns(
        {
            "size": F.octet_length(body).cast("long") + 1,
            "tokens": word_count(body),
            "_group": F.md5(body.cast("binary")),
            "_fine": hash32(F.col(key)),
        }
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum(F.lit(1)).alias("rows")]
    # size, tokens and lot of a group follow from its text, so the group table is all the packing needs
    groups = stored(rows.groupBy("_group", F.col("size").alias("_each")).agg(*sums), "shard-groups")
    totals = [max(1, x or 0) for x in groups.agg(*[F.sum(c) for c in ("size", "tokens", "rows")]).first()]
    share = F.greatest(*[F.col(c) / F.lit(t) for c, t in zip(("size", "tokens", "rows"), totals, strict=True)])
    large = groups.filter(share > 1 / (shards * PARTS))
    lots = groups.filter(share <= 1 / (shards * PARTS)).groupBy(*_lot(F.col("_each"), F.col("_group"))).agg(*sums)
    own, common = large.orderBy("_group").collect(), lots.orderBy("_class", "_part").collect()
    vector = lambda r: np.array([r["size"], r["tokens"], r["rows"]]) / totals
    # a group over a whole shard (there are fewer than 3 * shards) is cut into pieces of about a quarter of a shard
    pieces = {g["_group"]: int(np.ceil(vector(g).max() * shards * 4)) if vector(g).max() > 1 / shards else 1 for g in own}
    whole = [g for g in own if pieces[g["_group"]] == 1]
    items: list[tuple] = [(vector(g), g["_group"], 1, 0) for g in whole]
    if len(whole) < len(own):
        cuts = spark.createDataFrame([(g, n) for g, n in pieces.items() if n > 1], "_group string, _pieces long")
        piece = F.shiftright(F.col("_fine") * F.col("_pieces"), 32).alias("_piece")
        cut = rows.join(F.broadcast(cuts), "_group").groupBy("_group", "_pieces", piece).agg(*sums)
        items += [(vector(r), r["_group"], r["_pieces"], r["_piece"]) for r in cut.orderBy("_group", "_piece").collect()]
    items += [(np.array([x["size"], x["tokens"], x["rows"]]) / totals, x["_class"], x["_part"]) for x in common]
    placed = place(np.array([x[0] for x in items]).reshape(-1, 3), shards).tolist()
    own_rows = [(x[1], x[2], x[3], s) for x, s in zip(items, placed, strict=True) if len(x) == 4]
    lot_rows = [(x[1], x[2], s) for x, s in zip(items, placed, strict=True) if len(x) == 3]
    own_to = spark.createDataFrame(own_rows, "_group string, _pieces long, _piece long, _own int")
    lot_to = spark.createDataFrame(lot_rows, "_class int, _part int, _lot int")
    cuts = own_to.groupBy("_group").agg(F.first("_pieces").alias("_pieces"))
    rows = rows.join(F.broadcast(cuts), "_group", "left")
    rows = rows.withColumn("_piece", F.shiftright(F.col("_fine") * F.col("_pieces"), 32)).withColumns(
        dict(zip(("_class", "_part"), _lot(F.col("size"), F.col("_group")), strict=True))
    )
    rows = rows.join(F.broadcast(own_to.drop("_pieces")), ["_group", "_piece"], "left")
    rows = rows.join(F.broadcast(lot_to), ["_class", "_part"], "left")
    rows = rows.withColumn("shard", F.coalesce("_own", "_lot")).withColumn("_coarse", F.lit(0))
    kept = [c for c in rows.columns if c not in ("_class", "_part", "_piece", "_pieces", "_own", "_lot", "_group")]
    ties = [key] if key in kept else []
    numbered = ranked(rows.select(*kept), ["shard"], "_coarse", "_fine", ties, "slot")
    return numbered.withColumn("slot", F.col("slot") - 1).drop("_coarse", "_fine")


def shard(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """What :func:`pack` adds, for tables with texts: shards and slots are found without them, then joined once by place."""

    def work(rows: DataFrame) -> DataFrame:
        placed = with_place(rows, "shard-documents")
        light = pack(placed.select("_file", "_index", key, text), text, key, shards)
        found = light.select("_file", "_index", "size", "tokens", "shard", "slot")
        return placed.join(found, ["_file", "_index"]).drop("_file", "_index")

    return beside(docs, work, (text, key))


def _lot(size: Column, group: Column) -> list[Column]:
    return [
        F.length(F.bin(size)).alias("_class"),
        (F.conv(F.substring(group, 1, 8), 16, 10).cast("long") % LOTS).cast("int").alias("_part"),
    ]


def op9_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    light = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    packed = pack(light)
    return packed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )
