"""Merkle manifest of a dataset whose parents keep the hash state before each child, so that a changed child is folded in
from its own place on."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from flightlens.llm.common import read_documents
from flightlens.session import checked_broadcast, stored

FAN = 16  # children of a parent
LEVELS = 2  # levels that one pass builds
CHUNK = FAN**LEVELS  # nodes that one pass turns into one
TOGETHER = 64  # chunks whose hashes a task computes side by side
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "array<struct<slot: int, state: binary, siblings: binary>>"


def _roots(degree: int, count: int) -> np.ndarray:
    """The first 32 bits behind the point of the square or cube roots of the first primes: the constants of SHA-256."""
    primes = [p for p in range(2, 320) if all(p % q for q in range(2, isqrt(p) + 1))][:count]
    out = []
    for p in primes:
        wide = p << (32 * degree)
        low, high = 0, 1 << 40
        while low < high:  # the largest number whose power is not above
            middle = (low + high + 1) // 2
            low, high = (middle, high) if middle**degree <= wide else (low, middle - 1)
        out.append(low & 0xFFFFFFFF)
    return np.array(out, dtype=np.uint32)


START = _roots(2, 8)
ROUND = _roots(3, 64)
HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states (n, 8) after one more block of 64 bytes each (n, 64), all lanes side by side."""

    def turn(x, n):
        return (x >> np.uint32(n)) | (x << np.uint32(32 - n))

    w = list(np.ascontiguousarray(block).view(">u4").astype(np.uint32).T.copy())
    a, b, c, d, e, f, g, h = state.T.copy()
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + (turn(x, 7) ^ turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (turn(y, 17) ^ turn(y, 19) ^ (y >> np.uint32(10))))
        first = h + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
        second = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + first, c, b, a, first + second
    return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def hexed(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32) as hex text (n, 64): the very size of a block, so a state lies between any two children."""
    return HEX[digests].reshape(len(digests), 64)


def finish(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests (n, 32) from the states after all children."""
    block = np.zeros((len(state), 64), dtype=np.uint8)
    block[:, 0] = 0x80
    block[:, 56:] = (children * 512).astype(">u8").view(np.uint8).reshape(-1, 8)
    return compress(state, block).astype(">u4").view(np.uint8).reshape(-1, 32)


def parents(children: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(states before each child slot (n, 16, 8), digests (n, 32)) of parents with ``count`` children (n, 16, 32)."""
    states = np.zeros((len(children), FAN, 8), dtype=np.uint32)
    state = np.tile(START, (len(children), 1))
    for slot in range(FAN):
        states[:, slot] = state
        has = np.flatnonzero(count > slot)
        state[has] = compress(state[has], hexed(children[has, slot]))
    return states, finish(state, count)


def resume(state: np.ndarray, new: np.ndarray, slot: np.ndarray, right: np.ndarray, group: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Digests of parents in which the child at ``slot`` is replaced.

    Goes on from the ``state`` kept before that slot, with the new digest and the siblings to its right only. ``right``
    holds all children of each parent (p, 16, 32), ``group`` the parent of each lane, ``count`` the children it has.
    """
    state = compress(state, hexed(new))
    for step in range(1, FAN):
        more = np.flatnonzero(slot + step < count)
        if not len(more):
            break
        state[more] = compress(state[more], hexed(right[group[more], slot[more] + step]))
    return finish(state, count)


def by_parent(nodes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Nodes of several runs (m, 32) as children of parents (p, 16, 32), their counts, and where each run's parents begin."""
    sizes = [-(-len(x) // FAN) for x in nodes]
    starts = [0, *np.cumsum(sizes).tolist()]
    children, count = np.zeros((starts[-1], FAN, 32), dtype=np.uint8), np.zeros(starts[-1], dtype=np.int64)
    for x, start, end in zip(nodes, starts, starts[1:], strict=False):
        children[start:end].reshape(-1, 32)[: len(x)] = x
        count[start:end] = np.minimum(FAN, len(x) - FAN * np.arange(end - start))
    return children, count, starts


def _depth(n: int) -> int:
    """How many levels this pass adds to a tree with ``n`` nodes."""
    return 0 if n <= 1 else 1 if n <= FAN else LEVELS


def leaf_digest(columns: list[Column]) -> Column:
    """Binary SHA-256 of columns in a row, each ``-`` if null, else its UTF-8 byte count, a colon and its text."""
    parts = []
    for c in columns:
        shown = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def numbered(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """Add ``pos`` (0, 1, 2 ... within the tree in the order given) and ``n``, the size of the tree.

    Rows are dealt by ranges of (tree, order) and their place in line, so a large tree, and rows that tie in all of it, lie
    in many tasks. Each part numbers its rows; running sums over the parts, of which there are at most as many as tasks and
    trees, give where a tree goes on.
    """
    # rows that tie are equal in all that counts, so it does not matter which of them comes first; it only has to be fixed
    line = stored(rows.withColumn("_line", F.monotonically_increasing_id()), f"{name}-lines")
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order, "_line")]
    dealt = line.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(dealt.drop("_line").withColumn("_part", F.shiftright("_at", 33)), f"{name}-places")
    parts = placed.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(tree)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn("n", F.sum("_rows").over(whole))
    joined = placed.join(checked_broadcast(stored(parts.drop("_rows"), f"{name}-parts")), [tree, "_part"])
    return joined.withColumn("pos", F.col("_start") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_start")


def _chunks(nodes: DataFrame, extras: list[str], name: str) -> DataFrame:
    """One row per up to 256 nodes in a row: their members, the digests above, and every parent's retained states."""
    chunk = F.floor(F.col("pos") / CHUNK).cast("long")
    member = F.struct("pos", "digest", *extras)
    grouped = nodes.groupBy("tree", chunk.alias("chunk"), "n").agg(F.sort_array(F.collect_list(member)).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                yield build(batch.slice(start, TOGETHER))

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        levels = [[digests_of(x) for x in batch.column("members")]]
        depth = np.array([_depth(n) for n in batch.column("n").to_pylist()])
        kept: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
        for level in range(LEVELS):
            children, count, starts = by_parent([x if depth[i] > level else x[:0] for i, x in enumerate(levels[-1])])
            states, digests = parents(children, count)
            for i, into in enumerate(kept):
                into.append(states[starts[i] : starts[i + 1]].tobytes())
            levels.append([digests[starts[i] : starts[i + 1]] if depth[i] > level else x for i, x in enumerate(levels[-1])])
        above = [x.tobytes() for x in levels[1]]
        made = [[x[0] for x in kept], [x[1] for x in kept], above, [x[0].tobytes() for x in levels[-1]]]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, *[pa.array(x, pa.binary()) for x in made]], [*batch.schema.names, "low", "high", "nodes", "root"]
        )

    added = [T.StructField(c, T.BinaryType()) for c in ("low", "high", "nodes", "root")]
    return stored(grouped.mapInArrow(run, T.StructType([*grouped.schema, *added])), name)


def digests_of(members) -> np.ndarray:
    return np.frombuffer(b"".join(x["digest"].as_py() for x in members), np.uint8).reshape(-1, 32)


def _tree_passes(nodes: DataFrame, extras: list[str], name: str) -> list[DataFrame]:
    """Chunk tables, lowest first; each pass leaves one node for 256 in trees that have more."""
    passes = [_chunks(nodes, extras, f"{name}-0")]
    while True:
        upper = passes[-1].filter(F.col("n") > CHUNK)
        if upper.isEmpty():
            return passes
        nodes = upper.select("tree", F.col("chunk").alias("pos"), F.ceil(F.col("n") / CHUNK).cast("long").alias("n"), F.col("root").alias("digest"))
        passes.append(_chunks(nodes, [], f"{name}-{len(passes)}"))


def _steps_in(row: dict) -> list[list[dict]]:
    """For every member of a chunk, the steps to the chunk's root: slot, state before it, the other children in order."""
    levels = [b"".join(m["digest"] for m in row["members"]), row["nodes"]]
    out = []
    for i in range(len(row["members"])):
        steps, at = [], i
        for level in range(_depth(row["n"])):
            parent, slot = divmod(at, FAN)
            run = levels[level][parent * FAN * 32 : (parent + 1) * FAN * 32]
            states = (row["low"], row["high"])[level]
            begin = (parent * FAN + slot) * 32
            steps.append({"slot": slot, "state": states[begin : begin + 32], "siblings": run[: slot * 32] + run[(slot + 1) * 32 :]})
            at = parent
        out.append(steps)
    return out


def _members_with_steps(chunks: DataFrame, above: DataFrame | None, extras: list[str]) -> DataFrame:
    """(tree, pos, *extras, steps): every member of the chunks with all steps up to the last root that ``above`` knows."""
    named = chunks if above is None else chunks.join(above.withColumnRenamed("steps", "above"), ["tree", "chunk"])
    wanted = ["tree", "n", "members", "low", "high", "nodes", *(["above"] if above is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                rows = []
                for row in batch.slice(start, TOGETHER).to_pylist():
                    for member, steps in zip(row["members"], _steps_in(row), strict=True):
                        rows.append({"tree": row["tree"], "pos": member["pos"], **{c: member[c] for c in extras}, "steps": steps + row.get("above", [])})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    step = pa.list_(pa.struct([("slot", pa.int32()), ("state", pa.binary()), ("siblings", pa.binary())]))
    arrow = pa.schema([("tree", pa.string()), ("pos", pa.int64()), *[(c, pa.string()) for c in extras], ("steps", step)])
    columns = "".join(f"{c} string, " for c in extras)
    return named.select(*wanted).mapInArrow(run, f"tree string, pos long, {columns}steps {_STEP}")


class Manifest:
    """A two-storey tree over (tree, order..., digest): one Merkle tree per ``tree``, and one over their roots.

    ``passes``: chunk tables of the trees, lowest first, with the digests and retained states of all parents. ``top``: the
    same for the tree over the subroots. ``root``: the digest of all, None for an empty dataset. The tables are stored in
    the shared folder, so leaves can be replaced later without hashing their left siblings again.

    ``leaves`` needs a column ``tree`` (string, not null; its byte order is the order of the subroots), the columns of
    ``order``, a binary ``digest`` of 32 bytes, and may have ``extras`` that stay with the leaf. Nulls come first in the
    order; leaves that tie stand in the order of their digests, so repeated rows are leaves one after the other.
    """

    def __init__(self, leaves: DataFrame, order: list[str], extras: list[str]):
        wanted = leaves.select("tree", *order, "digest", *[c for c in extras if c not in order])
        placed = numbered(wanted, "tree", [*order, "digest"], "merkle-leaves")
        self.passes = _tree_passes(placed, extras, "merkle")
        ended = [p.filter(F.col("n") <= CHUNK).select("tree", "root") for p in self.passes]
        self.subroots = ended[0]
        for more in ended[1:]:
            self.subroots = self.subroots.union(more)
        over = self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
        self.top = _tree_passes(numbered(over, "tree", ["name"], "merkle-subroots"), ["name"], "merkle-top")
        last = self.top[-1].select("root").first()
        self.root = bytes(last[0]) if last else None

    def paths(self) -> DataFrame:
        """(tree, chunk, steps, subroot): for every chunk of leaves, the steps from its root to the root of all."""
        above = None
        for chunks in reversed(self.top[1:]):
            above = _members_with_steps(chunks, above, []).select("tree", F.col("pos").alias("chunk"), "steps")
        named = stored(_members_with_steps(self.top[0], above, ["name"]).select(F.col("name").alias("tree"), "steps"), "merkle-subroot-paths")
        above = None
        for k in reversed(range(len(self.passes))):
            ended = self.passes[k].filter(F.col("n") <= CHUNK).select("tree", F.col("chunk"))
            here = named.join(ended, "tree").select("tree", "chunk", "steps")
            above = here if above is None else here.union(above)
            if k:
                above = _members_with_steps(self.passes[k], above, []).select("tree", F.col("pos").alias("chunk"), "steps")
        return above.join(self.subroots.withColumnRenamed("root", "subroot"), "tree")

    def audit(self, replaced: str) -> DataFrame:
        """(*extras, leaf, subroot, root, proof_sha256, folded_root), hex text, one row per leaf.

        ``proof_sha256``: the hash of all siblings from the leaf to the root. ``folded_root``: the root that follows from
        the digest in the extra column ``replaced`` (the leaf's own if null) and the siblings of the leaf. Every fold goes
        on from the state its parent has kept, through the replacement and the siblings to its right.
        """
        schema = next(f for f in self.passes[0].schema if f.name == "members").dataType.elementType
        extras = [f for f in schema if f.name not in ("pos", "digest", replaced)]
        names = [f.name for f in extras]
        if self.root is None:
            empty = self.passes[0].select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in extras])
            return empty.select("*", *[F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")])
        root = self.root.hex()
        joined = self.passes[0].drop("root").join(stored(self.paths(), "merkle-paths"), ["tree", "chunk"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, TOGETHER):
                    yield audited(batch.slice(start, TOGETHER))

        def audited(batch: pa.RecordBatch) -> pa.RecordBatch:
            members = batch.column("members")
            flat = members.flatten()
            column = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
            rows = [{c: batch.column(c)[i].as_py() for c in ("n", "low", "high", "nodes", "steps", "subroot")} for i in range(batch.num_rows)]
            sizes = np.diff(members.offsets.to_numpy())
            leaf = column["digest"].to_pylist()
            new = [own if r is None else r for own, r in zip(leaf, column[replaced].to_pylist(), strict=True)]
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            for i, row in enumerate(rows):
                row["members"] = leaf[cuts[i] : cuts[i + 1]]
            folded = fold(rows, np.repeat(np.arange(len(rows)), sizes), np.frombuffer(b"".join(new), np.uint8).reshape(-1, 32))
            made = [
                [x.hex() for x in leaf],
                [rows[i]["subroot"].hex() for i in range(len(rows)) for _ in range(sizes[i])],
                [root] * len(leaf),
                [p for row in rows for p in proofs(row)],
                [x.tobytes().hex() for x in folded],
            ]
            return pa.RecordBatch.from_arrays([*[column[c] for c in names], *[pa.array(x, pa.string()) for x in made]], [*names, *hexes])

        hexes = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
        return joined.mapInArrow(run, T.StructType([*extras, *[T.StructField(c, T.StringType()) for c in hexes]]))


def proofs(row: dict) -> list[str]:
    """The hash of all siblings of every member of a chunk, level by level up to the root of all."""
    leaves, nodes = b"".join(row["members"]).hex().encode(), row["nodes"].hex().encode()
    above = b"".join(s["siblings"] for s in row["steps"]).hex().encode()
    out, depth, wide = [], _depth(row["n"]), FAN * 64
    for i in range(len(row["members"])):
        proof = hashlib.sha256()
        at = i
        for level in range(depth):
            parent, slot = divmod(at, FAN)
            run = (leaves, nodes)[level][parent * wide : (parent + 1) * wide]
            proof.update(run[: slot * 64] + run[(slot + 1) * 64 :])
            at = parent
        proof.update(above)
        out.append(proof.hexdigest())
    return out


def fold(rows: list[dict], chunk: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The roots (n, 32) that follow from the digests ``new`` of all members of the chunks ``rows``, member by member."""
    first = np.searchsorted(chunk, chunk)
    at, depth = np.arange(len(chunk)) - first, np.array([_depth(r["n"]) for r in rows])
    current = new.copy()
    below = [np.frombuffer(b"".join(r["members"]), np.uint8).reshape(-1, 32) for r in rows]
    above = [np.frombuffer(r["nodes"], np.uint8).reshape(-1, 32) for r in rows]
    for level, (nodes, kept) in enumerate(((below, "low"), (above, "high"))):
        children, count, starts = by_parent([x if depth[i] > level else x[:0] for i, x in enumerate(nodes)])
        states = np.frombuffer(b"".join(r[kept] for r in rows), np.uint32).reshape(-1, FAN, 8)
        lanes = np.flatnonzero(depth[chunk] > level)
        if len(lanes):
            group, slot = np.array(starts)[chunk[lanes]] + at[lanes] // FAN, at[lanes] % FAN
            current[lanes] = resume(states[group, slot], current[lanes], slot, children, group, count[group])
        at = at // FAN
    for k in range(max((len(r["steps"]) for r in rows), default=0)):
        steps = [r["steps"][k] if k < len(r["steps"]) else None for r in rows]
        children, count = np.zeros((len(rows), FAN, 32), dtype=np.uint8), np.zeros(len(rows), dtype=np.int64)
        states, slot = np.zeros((len(rows), 8), dtype=np.uint32), np.zeros(len(rows), dtype=np.int64)
        for i, s in enumerate(steps):
            if s:
                right = np.frombuffer(s["siblings"], np.uint8).reshape(-1, 32)
                slot[i], count[i], states[i] = s["slot"], len(right) + 1, np.frombuffer(s["state"], np.uint32)
                children[i, s["slot"] + 1 : len(right) + 1] = right[s["slot"] :]
        lanes = np.flatnonzero(count[chunk] > 0)
        group = chunk[lanes]
        current[lanes] = resume(states[group], current[lanes], slot[group], children, group, count[group])
    return current


def lower_latin(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and the root that follows if its text was lower-cased behind the manifest's back.

    A leaf covers doc_id, source, lang, n_chars and text, nulls told from empty ones; other columns are left out. A null
    source is a tree of its own and comes first; null keys come first and are never tampered with. Repeated rows are leaves
    one after the other. An empty table gives an empty result.
    """
    docs = read_documents(spark, sf_dir).select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = leaf_digest([F.col(c) for c in FIELDS[:-1]] + [lower_latin(F.col("text"))])
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"),
        "doc_id",
        leaf_digest([F.col(c) for c in FIELDS]).alias("digest"),
        F.when(tampered, other).alias("replaced"),
    )
    audit = Manifest(leaves, ["doc_id"], ["doc_id", "replaced"]).audit("replaced")
    return audit.withColumn("verified", F.col("folded_root") == F.col("root"))
