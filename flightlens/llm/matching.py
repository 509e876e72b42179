"""Sets of word shingles: keys that similar sets share, groups of sets that share keys, and exact links inside groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flightlens.llm.common import hash32, ranked
from flightlens.session import checked_broadcast, stored

MEMO = 300_000  # words whose hash a worker remembers; then it starts anew
CHUNK = 500_000  # keys that a task sorts at once
FEW = 32  # ids under one key up to which they are paired; more are chained
MARK = np.iinfo(np.int64).min  # stands for the ids of a key that were chained already
BLOCK_SETS, BLOCK_ITEMS = 512, 1_000_000  # a tile holds two blocks of at most about so many sets and shingles
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str) -> list[bytes]:
    """Words with A-Z in lower case; bytes split at exactly the six separators."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int, memo: WordHash) -> np.ndarray:
    """Sorted distinct hashes of ``width`` words in a row; of all words, if there are fewer; none without words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - width + 1)
    total = np.full(n, np.uint64(min(width, len(words))))
    for k in range(min(width, len(words))):
        total = mix64(total * _M1 + codes[k : k + n])
    return np.unique(total)


def set_digest(items: np.ndarray) -> int:
    """A signed 64-bit digest of a set, equal for equal sets."""
    total = np.array([mix64(items ^ _M3).sum()]) + np.array([len(items)], dtype=np.uint64) * _M1
    return int(mix64(total).view(np.int64)[0])


def parities(items: np.ndarray) -> bytes:
    """A bitmap whose bits say whether an odd number of items falls on them; about one bit per item, at least 64."""
    bits = 1 << int(np.clip(np.ceil(np.log2(max(1, len(items)))), 6, 14))
    return np.packbits(np.bincount((items % np.uint64(bits)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def differ_at_least(a: bytes, b: bytes) -> int:
    """How many items two sets differ in at least, from their parities: each bit that differs needs one."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def plausible_edges(edges: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """(a, b): the sure edges, and edges that connect what is connected by pairs whose bitmaps allow the similarity. ``signs``: (id, size, bits)."""
    left, right = (signs.select(*[F.col(c).alias(f"{c}_{side}") for c in ("id", "size", "bits")]) for side in "ab")
    pairs = edges.filter("not sure").select("a", "b").distinct()
    pairs = pairs.join(left, F.col("a") == F.col("id_a")).join(right, F.col("b") == F.col("id_b"))
    # similar sets differ in at most (a + b)(100 - p) / (100 + p) items
    pairs = pairs.filter(F.abs(F.col("size_a") - F.col("size_b")) * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            left, right, n, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "n", "bits_a", "bits_b"))
            kept = [(p, q) for p, q, m, s, t in zip(left, right, n, x, y, strict=True) if differ_at_least(s, t) * (100 + percent) <= m * (100 - percent)]
            found = np.array(kept, dtype=np.int64).reshape(-1, 2)
            # what is connected matters from here on, so a task sends one edge per id
            a, b = forest(np.concatenate([a, found[:, 0]]), np.concatenate([b, found[:, 1]]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    judged = pairs.select("a", "b", (F.col("size_a") + F.col("size_b")).alias("n"), "bits_a", "bits_b").mapInArrow(judge, "a long, b long")
    return judged.union(edges.filter("sure").select("a", "b"))


def linked_edges(docs: DataFrame, columns: list[str], work: Callable) -> DataFrame:
    """(a, b, sure): pairs of ids that have some key in common; if ``sure``, edges that only connect such ids.

    ``work(batch)`` gives ids, and keys with the index of the id each belongs to. Keys are sent packed by range of the key
    space. A key with at most FEW ids gives all their pairs, so each pair can be judged by itself. A key with more ids is
    not paired: its ids are chained, in the task that meets them, and one goes on for all with a mark. Thus no key gathers
    more than FEW entries per chunk of a task, however frequent it is.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                ids, keys, owner = work(batch.slice(start, 1000))
                held.append((keys, ids[owner] if len(owner) else ids[:0]))
                size += len(keys)
                if size >= CHUNK:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def packed(held):
        keys, ids, number, count = grouped(np.concatenate([k for k, _ in held]), np.concatenate([i for _, i in held]))
        many = count > FEW
        a, b = forest(*chain(keys[many], ids[many]))
        first = many & np.concatenate([[True], number[1:] != number[:-1]])
        marked = keys[first]
        keys = np.concatenate([keys[~many], marked, marked])
        ids = np.concatenate([ids[~many], ids[first], np.full(len(marked), MARK)])
        part = (keys % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        ends = [*cuts[1:], len(order)]
        rows = [(int(part[order[s]]), keys[order[s:e]].tobytes(), ids[order[s:e]].tobytes(), b"", b"") for s, e in zip(cuts, ends, strict=True)]
        rows.append((int(len(keys) % parts), b"", b"", a.tobytes(), b.tobytes()))
        return record_batch(rows, ("part", "keys", "ids", "a", "b"), (pa.int32(), *[pa.binary()] * 4))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[bytes]] = [[], [], [], []]
        for batch in batches:
            for into, name in zip(columns, ("keys", "ids", "a", "b"), strict=True):
                into += batch.column(name).to_pylist()
        keys, ids = np.frombuffer(b"".join(columns[0]), np.uint64), np.frombuffer(b"".join(columns[1]), np.int64)
        keys, ids, number, count = grouped(keys, ids)
        marked = np.zeros(int(number[-1]) + 1 if len(number) else 0, dtype=bool)
        marked[number[ids == MARK]] = True
        sure = (count > FEW) | marked[number]
        own = ids != MARK
        a, b = chain(keys[sure & own], ids[sure & own])
        a = np.concatenate([a, np.frombuffer(b"".join(columns[2]), np.int64)])
        b = np.concatenate([b, np.frombuffer(b"".join(columns[3]), np.int64)])
        a, b = forest(a, b)
        few = ~sure & (count > 1)
        c, d = pairs_of(number[few], count[few], ids[few])
        if len(a) + len(c):
            flag = np.arange(len(a) + len(c)) < len(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, c])), pa.array(np.concatenate([b, d])), pa.array(flag)], ["a", "b", "sure"])

    sent = docs.select(*columns).mapInArrow(spread, "part int, keys binary, ids binary, a binary, b binary")
    return sent.repartition("part").mapInArrow(gather, "a long, b long, sure boolean")


def grouped(keys: np.ndarray, ids: np.ndarray):
    """Distinct (key, id) in order, and for each entry the number of its key and how many ids that key has."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    if len(keys):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        keys, ids = keys[new], ids[new]
    number = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys, ids, number, np.bincount(number)[number] if len(keys) else number


def chain(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that chain the ids of every key; entries are in order of key."""
    same = keys[1:] == keys[:-1]
    return ids[:-1][same], ids[1:][same]


def pairs_of(number: np.ndarray, count: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ids under one key, each once; meant for keys with few ids."""
    left, right = [], []
    for step in range(1, int(count.max(initial=1))):
        same = number[step:] == number[:-step]
        left.append(ids[:-step][same])
        right.append(ids[step:][same])
    if not left:
        return ids[:0], ids[:0]
    names, flat = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    half = len(flat) // 2
    pairs = np.unique(flat[:half] * len(names) + flat[half:])
    return names[pairs // max(1, len(names))], names[pairs % max(1, len(names))]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every id to the smallest id it is connected with, by the given edges."""
    if not len(a):
        return a, b
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(names))])
    other = roots != np.arange(len(names))
    return names[other], names[roots[other]]


def record_batch(rows, names, types) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root): for every id in an edge, the smallest id it is connected with.

    Alternates two steps until nothing changes: every id points its larger neighbours, then its smaller ones, to its
    smallest neighbour. The number of rounds grows with the logarithm of the longest chain. Each step takes grouped
    minima, which combine before the shuffle, and joins them back. Rounds are cut by stored tables.
    """
    current = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    before = None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        current = stored(small.select("e.a", "e.b").filter("a <> b").distinct(), name)
    return current.select(F.col("a").alias("id"), F.col("b").alias("root")).union(current.select("b", "b").distinct())


def exact_links(sets: DataFrame, clusters: DataFrame, weights: DataFrame, percent: int) -> DataFrame:
    """(id, root, links) for ids with a link, one row per id and tile; a link: 100 * common >= percent * union.

    ``sets``: (id, items), where an id may stand more than once. Inside each cluster all pairs of sets are compared, tile by
    tile, without writing pairs: a tile is a pair of blocks, so a large cluster is spread over many tasks. ``weights``:
    (id, weight, size), how many documents have the set and how many items it has. ``root`` is the smallest id connected
    in the tile. Tiles are laid out without the items, which are sent once for each tile.
    """
    rows = stored(clusters.withColumnRenamed("root", "cluster").join(weights, "id"), "cluster-ids")
    tiles = stored(_tiles(rows, percent), "cluster-tiles")
    tiles = sets.join(checked_broadcast(tiles), "id").select("cluster", "i", "j", "block", "id", "weight", "items")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, known = None, [], set()
        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j")), strict=True))
            ids, weight, block = (batch.column(c).to_pylist() for c in ("id", "weight", "block"))
            items = batch.column("items")
            offsets, flat = items.offsets.to_numpy(), items.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for r, k in enumerate(key):
                if k != tile and held:
                    yield from compare(tile, held)
                    held, known = [], set()
                tile = k
                if ids[r] not in known:
                    known.add(ids[r])
                    held.append((ids[r], weight[r], block[r], np.unique(flat[offsets[r] : offsets[r + 1]])))
        if held:
            yield from compare(tile, held)

    def compare(tile, held):
        made = tile_links(held, tile[1] != tile[2], percent)
        if made:
            yield record_batch(made, ("id", "root", "links"), (pa.int64(),) * 3)

    ordered = tiles.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return ordered.mapInArrow(verify, "id long, root long, links long")


def _tiles(rows: DataFrame, percent: int) -> DataFrame:
    """(id, cluster, i, j, block, weight): the tiles in which the sets of ``rows`` (id, cluster, weight, size) take part.

    A cluster that fits into one block is one tile. In a larger one, sets are cut by size into bands whose ends stand in
    the ratio of the similarity, so partners lie in the same band or the next; a band is cut into blocks in order of size.
    A tile is a block, or two of them, if the largest of one and the least of the other are near enough.
    """
    whole = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    one = (F.col("c") <= BLOCK_SETS) & (F.col("s") <= BLOCK_ITEMS)
    large = checked_broadcast(stored(whole.filter(~one).select("cluster"), "cluster-large"))
    alone = rows.join(large, "cluster", "left_anti").select("id", "cluster", F.lit("").alias("i"), F.lit("").alias("j"), F.lit("").alias("block"), "weight")
    ratio = 100 / percent * (1 + 1e-9)
    band = F.floor(F.log(F.col("size").cast("double")) / np.log(ratio)).cast("int")
    cut = rows.join(large, "cluster", "left_semi").withColumns({"band": band, "_fine": hash32(F.col("id"))})
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(BLOCK_ITEMS / F.pow(F.lit(ratio), F.col("band") + 1)))).cast("long")
    placed = ranked(cut, ["cluster", "band"], "size", "_fine", ["id"], "_rank").withColumn("number", F.floor((F.col("_rank") - 1) / most))
    placed = stored(placed.select("id", "cluster", "weight", "size", "band", "number"), "cluster-blocks")
    blocks = placed.groupBy("cluster", "band", "number").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    blocks = stored(blocks.withColumn("block", F.concat_ws(":", "band", "number")), "cluster-ends")
    other = blocks.select("cluster", F.col("band").alias("_band"), *[F.col(c).alias(f"_{c}") for c in ("number", "low", "high", "block")])
    near = blocks.withColumn("_band", F.explode(F.array(F.col("band"), F.col("band") + 1))).join(other, ["cluster", "_band"])
    near = near.filter((F.col("band") < F.col("_band")) | (F.col("number") <= F.col("_number")))
    near = near.filter((F.col("low") * percent <= F.col("_high") * 100) & (F.col("_low") * percent <= F.col("high") * 100))
    both = F.array_distinct(F.array(F.struct("band", "number", "block"), F.struct(F.col("_band").alias("band"), F.col("_number").alias("number"), F.col("_block").alias("block"))))
    sides = near.select("cluster", F.col("block").alias("i"), F.col("_block").alias("j"), F.explode(both).alias("_side")).select("cluster", "i", "j", "_side.*")
    return alone.union(placed.join(sides, ["cluster", "band", "number"]).select("id", "cluster", "i", "j", "block", "weight"))


def tile_links(held: list[tuple], across: bool, percent: int) -> list[tuple[int, int, int]]:
    """Links among the sets of a tile; only between its two blocks if ``across``.

    Sets are sorted by size, so partners lie in a band of sizes. Bits that differ between two bitmaps bound the overlap
    from above; what may still link is decided on the sorted arrays.
    """
    held = sorted(held, key=lambda h: (len(h[3]), h[0]))
    size = np.array([len(h[3]) for h in held])
    block = np.array([h[2] for h in held])
    weight = np.array([h[1] for h in held])
    bits = 1 << int(np.clip(np.ceil(np.log2(4 * size.max() + 1)), 6, 14))
    maps = np.zeros((len(held), bits // 64), dtype=np.uint64)
    for r, h in enumerate(held):
        at = h[3] % np.uint64(bits)
        np.bitwise_or.at(maps[r], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    links, a, b = np.zeros(len(held), dtype=np.int64), [], []
    for r in range(len(held) - 1):
        end = int(np.searchsorted(size, size[r] * 100 // percent, side="right"))
        near = np.arange(r + 1, end)
        if across:
            near = near[block[near] != block[r]]
        if not len(near):
            continue
        both = size[near] + size[r]
        most = (both - np.bitwise_count(maps[near] ^ maps[r]).sum(1, dtype=np.int64)) // 2
        near = near[(100 + percent) * most >= percent * both]
        if not len(near):
            continue
        flat, own = np.concatenate([held[k][3] for k in near]), held[r][3]
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        common = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size[near])[:-1]]))
        hit = near[(100 + percent) * common >= percent * (size[near] + size[r])]
        links[r] += weight[hit].sum()
        links[hit] += weight[r]
        a += [held[r][0]] * len(hit)
        b += [held[k][0] for k in hit]
    roots = dict(zip(*(x.tolist() for x in forest(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))), strict=True))
    return [(h[0], roots.get(h[0], h[0]), int(n)) for h, n in zip(held, links, strict=True) if n]
