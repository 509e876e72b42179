"""Join of documents whose sets of word shingles have a Jaccard similarity over a threshold; exact, in tiles of like size."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flightlens.llm.common import WORDS, beside, in_batches, null_safe_join, read_documents
from flightlens.llm.matching import (
    WordHash, components, exact_links, linked_edges, mix64, parities, plausible_edges, record_batch, set_digest, shingles, words_of,
)
from flightlens.session import checked_broadcast, stored

BAND = 1.35  # ratio of the sizes at the ends of a band
# From this similarity on (in percent) parts of the shingle space are keys, below it the rarest shingles. A part holds about
# (1 + t) / (2 - 2 t) shingles: nine at 90 %, which unlike sets hardly share, but only four at 80 %.
PARTS_FROM = 85


class Bands:
    """Size bands and the number of parts into which a band cuts the shingle space.

    Sets of sizes a and b with similarity t or more differ in at most (a + b)(1 - t)/(1 + t) shingles. With more non-empty
    parts than that, some part is equal in both and not empty, so equal parts find every similar pair. A set belongs to
    its own band, and to the next if a similar larger set may lie there. Sets with too few non-empty parts also offer
    their empty ones, so nothing is lost.
    """

    def __init__(self, percent: int):
        self.similar = percent / 100
        if BAND * self.similar <= 1:
            raise ValueError(f"bands need a similarity over {1 / BAND:.2f}")
        self.cache: dict[int, tuple[int, int]] = {}

    def of(self, size: int) -> list[int]:
        band = max(0, int(np.ceil(np.log(size) / np.log(BAND) - 1e-9)))
        top = int(np.floor(BAND**band + 1e-9))
        return [band, band + 1] if size >= self.similar * (top + 1) else [band]

    def parts(self, band: int) -> tuple[int, int]:
        """(most shingles in which two similar sets of a band differ, number of parts)."""
        if band not in self.cache:
            top = int(np.floor(BAND**band + 1e-9))
            errors = int(np.floor(2 * top * (1 - self.similar) / (1 + self.similar) + 1e-9))
            low, wanted = max(1.0, self.similar * BAND ** (band - 1)), 1.02 * (errors + 1) + 2
            parts = next((m for m in range(errors + 1, 2 * errors + 8) if m * (1 - np.exp(-low / m)) >= wanted), errors + 1)
            self.cache[band] = (errors, parts)
        return self.cache[band]

    def keys(self, items: np.ndarray) -> np.ndarray:
        made = []
        scrambled = mix64(items + np.uint64(0x632BE59BD9B4E019))
        for band in self.of(len(items)):
            errors, parts = self.parts(band)
            if not errors:
                continue  # only equal sets can be similar, and they are one class already
            part = (scrambled >> np.uint64(11)) % np.uint64(parts)
            sums, count = np.zeros(parts, dtype=np.uint64), np.bincount(part.astype(np.int64), minlength=parts)
            np.add.at(sums, part.astype(np.int64), scrambled)
            keys = mix64(sums ^ mix64(np.arange(parts, dtype=np.uint64) + np.uint64(band << 40)))
            full = count > 0
            made.append(keys[full] if full.sum() > errors else keys)
        return np.concatenate(made) if made else np.zeros(0, dtype=np.uint64)


SLOTS, SEGMENTS = 2**20, 16  # counters of shingles, by hash; they are sent in so many pieces


def rare_first(items: np.ndarray, percent: int, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set that stand for it: with any similar set it has one of them in common.

    Two sets of similarity t or more share at least t of each, so all but t of a set's shingles, and one more, in an order
    that is the same for all sets, hold the first one shared. The order goes by ``counts``, roughly how many sets have a
    shingle of this slot, so that common ones, which many unlike sets share, come last. Any order would do; this one spares
    comparisons. ``items`` are in order.
    """
    n = len(items)
    order = (counts[(items >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (items >> np.uint64(8))
    return items[np.argsort(order, kind="stable")[: n + percent * -n // 100 + 1]]


def classes(docs: DataFrame, width: int, counted: bool) -> DataFrame:
    """(doc_id, n_shingles, _class, _bits, _segment): a row per document with the digest and bitmap of its set, and rows
    with a segment number that hold, packed, how many of a task's documents have a shingle in each slot of the segment
    (only if ``counted``).
    """

    def run(batches):
        memo, counts = WordHash(), np.zeros(SLOTS, dtype=np.uint32)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(words_of(t or ""), width, memo) for t in batch.column(0).to_pylist()]
            for s in sets if counted else ():
                np.add.at(counts, (s >> np.uint64(44)).astype(np.int64), np.uint32(1))
            digests = [set_digest(s) if len(s) else None for s in sets]
            bits = [parities(s) if len(s) else None for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.int64()), pa.array(bits, pa.binary())]
            return pa.RecordBatch.from_arrays([batch.column(1), *columns, pa.nulls(len(sets), pa.int32())], names)

        yield from in_batches(work)(batches)
        packed = [zlib.compress(part.tobytes(), 1) for part in counts.reshape(SEGMENTS, -1)] if counts.any() else []
        empty = [pa.nulls(len(packed), pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([*empty, pa.array(packed, pa.binary()), pa.array(range(len(packed)), pa.int32())], names)

    names = ["doc_id", "n_shingles", "_class", "_bits", "_segment"]
    return docs.select("text", "doc_id").mapInArrow(run, "doc_id long, n_shingles long, _class long, _bits binary, _segment int")


def slot_counts(segments: DataFrame) -> np.ndarray:
    """Counts of all tasks added up, on a logarithmic scale of one byte; a million of them reach the driver."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.int64)
        rows = [(k, np.minimum(255, np.rint(6 * np.log2(1.0 + n))).astype(np.uint8).tobytes()) for k, n in sums.items()]
        yield record_batch(rows, ("segment", "counts"), (pa.int32(), pa.binary()))

    added = segments.select("_segment", "_bits").repartition("_segment").mapInArrow(add, "segment int, counts binary").collect()
    out = np.zeros((SEGMENTS, SLOTS // SEGMENTS), dtype=np.uint8)
    for r in added:
        out[r["segment"]] = np.frombuffer(r["counts"], np.uint8)
    return out.ravel()


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, items) of every document with words; equal sets of a task once."""

    def run(batches):
        memo, seen = WordHash(), set()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for t in batch.column(0).to_pylist():
                items = shingles(words_of(t or ""), width, memo)
                if len(items) and (d := set_digest(items)) not in seen:
                    seen.add(d)
                    rows.append((d, items.view(np.int64)))
            return record_batch(rows, ("id", "items"), (pa.int64(), pa.list_(pa.int64())))

        yield from in_batches(work)(batches)

    return docs.select("text").mapInArrow(run, "id long, items array<long>")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, n_links), one row per input row; exact.

    A document's set holds the distinct shingles of ``width`` words (A-Z lower-cased; with fewer words, the whole
    sequence). Two documents link when 100 * common >= percent * union. Equal sets are one class, treated once. Classes
    that share the content of a part of the shingle space (see :class:`Bands`) or, below 85 %, one of their rarest shingles
    (see :func:`rare_first`) are candidates; connected candidates are compared in tiles of like size, with bitmaps and then
    exactly. ``component_id`` is the smallest doc_id reachable by links,
    ``n_links`` the number of other documents linked with. Documents without words, null texts included, have 0 shingles,
    no class, themselves as component and no link. Null keys count as unknown: the smallest known key of a component names
    it. Repeated rows link with each other. Other columns are ignored. An empty table gives an empty one.
    """
    counted = stored(classes(docs.select("doc_id", "text"), width, percent < PARTS_FROM), "near-classes")
    light = counted.filter("_segment is null").drop("_segment")
    counts = docs.sparkSession.sparkContext.broadcast(slot_counts(counted.filter("_segment is not null")))
    own = stored(
        light.filter("_class is not null").groupBy(F.col("_class").alias("id")).agg(
            F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("weight"), F.first("n_shingles").alias("size"), F.first("_bits").alias("bits")
        ),
        "near-sizes",
    )

    memo, bands = WordHash(), Bands(percent) if percent >= PARTS_FROM else None

    def keys(batch: pa.RecordBatch):
        ids, found, owner = [], [], []
        seen = set()
        for t in batch.column(0).to_pylist():
            items = shingles(words_of(t or ""), width, memo)
            if len(items) and (d := set_digest(items)) not in seen:
                seen.add(d)
                k = bands.keys(items) if bands else rare_first(items, percent, counts.value)
                owner.append(np.full(len(k), len(ids)))
                found.append(k)
                ids.append(d)
        empty = np.zeros(0, dtype=np.int64)
        return np.array(ids, dtype=np.int64), np.concatenate(found or [empty.astype(np.uint64)]), np.concatenate(owner or [empty])

    edges = stored(linked_edges(docs, ["text"], keys), "near-pairs")
    candidates = components(plausible_edges(edges, own.select("id", "size", "bits"), percent), "near-candidates")
    # one document of each class is enough; its key may have other texts too, which then find no cluster
    wanted = stored(own.join(candidates.select("id"), "id", "left_semi").select(F.col("doc").alias("doc_id")).distinct(), "near-wanted")
    some = null_safe_join(docs.select("doc_id", "text"), checked_broadcast(wanted), ["doc_id"], "left_semi")
    tiles = stored(exact_links(_sets(some, width), candidates, own.select("id", "weight", "size"), percent), "near-links")
    roots = components(tiles.select(F.col("id").alias("a"), F.col("root").alias("b")), "near-roots")
    links = tiles.groupBy("id").agg(F.sum("links").alias("links"))
    named = own.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = named.groupBy("root").agg(F.min("doc").alias("component"))
    table = named.join(smallest, "root").join(links, "id", "left").select(
        F.col("id").alias("_class"), "component", "doc", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    joined = light.join(table, "_class", "left")
    return joined.select(
        "doc_id", "n_shingles", F.when(F.col("_class").isNotNull(), F.col("doc")).alias("class_id"),
        F.when(F.col("_class").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which one stays per group of near duplicates, with all their columns; see :func:`_keep_one`."""
    return beside(docs, lambda rows: _keep_one(rows, width, percent)).select(*docs.columns)


def _keep_one(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The documents of which one stays per group of near duplicates: the one with the smallest key.

    A key is dropped if all of its rows are to go, so of different texts under one key none is lost. Repeated rows are
    kept once; rows without a key or without words stay.
    """
    found = stored(near_duplicates(docs, width, percent), "near-found")
    stays = F.max(F.col("doc_id") == F.col("component_id"))
    gone = found.filter("doc_id is not null").groupBy("doc_id").agg(stays.alias("stays")).filter("not stays").select("doc_id")
    left = docs.join(checked_broadcast(stored(gone, "near-gone")), "doc_id", "left_anti")
    repeated = found.filter("doc_id = component_id AND n_links > 0").groupBy("doc_id", "class_id").count().filter("count > 1")
    again = stored(repeated.select("doc_id").distinct().withColumn("_again", F.lit(True)), "near-again")
    if not again.limit(1).count():
        return left
    # texts without words have no links, so they are no repeats even under such a key
    twice = F.coalesce(F.col("_again") & F.col("text").rlike(WORDS), F.lit(False))
    marked = left.join(checked_broadcast(again), "doc_id", "left")
    rows = marked.filter(~twice).union(marked.filter(twice).dropDuplicates(["doc_id", "text"]))
    return rows.select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir), width=3, percent=90)
