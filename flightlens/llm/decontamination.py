"""Benchmark passages in documents: CGK embedding of item-sized windows, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flightlens.llm.common import in_batches, read_documents

MAX_EDIT = 0.1  # edits per character of an item that still count as the item
MIN_ITEM = 24  # normalised characters; a shorter item is a leak only word for word
BLOCK = 20_000  # items that are looked for in one pass over the documents
# Random walks, samples per walk, and positions per sample. Measured recall at the edit limit is over 0.99
# (tests/llm/test_decontamination.py): one of WALKS * SAMPLES samples must agree in all its POSITIONS.
WALKS, SAMPLES, POSITIONS = 6, 40, 5

_GAP = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    """Lower case; every run of other signs than letters and digits is one space."""
    return _GAP.sub(" ", text.lower()).strip()


def edits_allowed(length: int) -> int:
    return int(length * MAX_EDIT)


def embed(codes: np.ndarray, lengths: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK embedding of rows of character codes: at each step copy the current character, then a random bit that depends
    on the step and the character says whether to move on. Past the end the output is 0. Edits become few differences.
    """
    rng = np.random.default_rng(seed)
    at = np.zeros(len(codes), dtype=np.int64)
    rows, out = np.arange(len(codes)), np.zeros((len(codes), steps), dtype=np.uint8)
    padded = np.concatenate([codes, np.zeros((len(codes), 1), dtype=codes.dtype)], axis=1)
    for j in range(steps):
        bits = rng.integers(0, 2, 256, dtype=np.int64)
        now = padded[rows, np.minimum(at, lengths)]
        out[:, j] = now
        at += bits[now] & (at < lengths)
    return out


def as_codes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as numbers from 1 to 255 (equal characters alike), padded by 0; and lengths."""
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    codes = np.zeros((len(pieces), int(lengths.max(initial=0))), dtype=np.uint8)
    for r, p in enumerate(pieces):
        points = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes[r, : len(p)] = points % 255 + 1
    return codes, lengths


def sampled_positions(sizes: np.ndarray) -> np.ndarray:
    """(items, walks, samples, positions): sampled steps of each item, the same fractions of twice its length for all.

    A walk moves every other step, so twice the length covers the item.
    """
    parts = np.random.default_rng(5).random((WALKS, SAMPLES, POSITIONS))
    return (parts * 2 * sizes[:, None, None, None]).astype(np.int64)


def item_signs(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What each item's embeddings hold at its sampled positions, and these positions."""
    codes, lengths = as_codes(items)
    at = sampled_positions(lengths)
    signs = np.zeros(at.shape, dtype=np.uint8)
    for walk in range(WALKS if items else 0):
        out = embed(codes, lengths, 2 * int(lengths.max()), 100 + walk)
        signs[:, walk] = out[np.arange(len(items))[:, None, None], at[:, walk]]
    return signs, at


def collide(windows: list[str], of: np.ndarray, signs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For every window, whether some sample of some walk agrees with its item's (number ``of``) in all positions.

    Windows of all items are embedded together, step by step.
    """
    codes, lengths = as_codes(windows)
    hit = np.zeros(len(windows), dtype=bool)
    for walk in range(WALKS if windows else 0):
        left = np.flatnonzero(~hit)  # a window that has collided needs no further walk
        if not len(left):
            break
        out = embed(codes[left], lengths[left], int(at[of[left]].max()) + 1, 100 + walk)
        same = out[np.arange(len(left))[:, None, None], at[of[left], walk]] == signs[of[left], walk]
        hit[left] = same.all(axis=2).any(axis=1)
    return hit


def edit_distance_within(item: str, text: str) -> int:
    """Smallest edit distance of the item to any piece of the text; bit-parallel, one step per character of the text."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    best = score
    for c in text:
        eq = masks.get(c, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(flat | up)), up & flat
        score += bool(plus & top) - bool(minus & top)
        best = min(best, score)
        plus, minus = (plus << 1) & full, (minus << 1) & full  # a piece may begin anywhere, so no cost comes in
        up, down = minus | (full & ~((eq | down) | plus)), plus & (eq | down)
    return best


class Items:
    """Benchmark items, cut into pieces that anchor windows.

    An item with d edits allowed is cut into d + 2 pieces. d edits leave two of them whole, and in places at most d apart
    from where the item puts them; so windows that have two whole pieces in place lose no true match.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        plain = [(i, normalised(t or "")) for i, t in rows]
        self.rows = [(i, n) for i, n in plain if len(n) >= MIN_ITEM]
        # short items, found as they are between borders of words; their numbers go on after those of the long ones
        short = [(i, n) for i, n in plain if 0 < len(n) < MIN_ITEM]
        self.ids = [i for i, _ in [*self.rows, *short]]
        self.exact = ahocorasick.Automaton()
        for r, (_, text) in enumerate(short, len(self.rows)):
            self.exact.add_word(text, [*self.exact.get(text, [len(text)]), r])
        if short:
            self.exact.make_automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for r, (_, text) in enumerate(self.rows):
            count = edits_allowed(len(text)) + 2
            cuts = [len(text) * k // count for k in range(count + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((r, a))
        self.machine = ahocorasick.Automaton()
        owners = list(pieces.values())
        for k, piece in enumerate(pieces):
            self.machine.add_word(piece, (k, len(piece)))
        if pieces:
            self.machine.make_automaton()
        self.first = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
        self.owner = np.array([r for o in owners for r, _ in o], dtype=np.int64)
        self.offset = np.array([a for o in owners for _, a in o], dtype=np.int64)
        self.edits = np.array([edits_allowed(len(t)) for _, t in self.rows], dtype=np.int64)
        self.signs, self.at = item_signs([t for _, t in self.rows])

    def verbatim(self, text: str) -> set[int]:
        """Short items that a normalised text holds word for word."""
        found = set()
        if len(self.exact):
            for end, (size, *items) in self.exact.iter(text):
                if (end < size or text[end - size] == " ") and (end + 1 == len(text) or text[end + 1] == " "):
                    found.update(items)
        return found

    def anchors(self, text: str) -> list[tuple[int, int]]:
        """(item, start) of item-sized windows of a normalised text with two whole pieces in place."""
        if not self.rows:
            return []
        hits = [(end, *value) for end, value in self.machine.iter(text)]
        if len(hits) < 2:
            return []
        end, piece, length = np.array(hits, dtype=np.int64).T
        count = self.first[piece + 1] - self.first[piece]
        which = np.repeat(self.first[piece], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item, offset = self.owner[which], self.offset[which]
        start = np.repeat(end - length + 1, count) - offset
        order = np.lexsort((start, item))
        item, start, offset = item[order], start[order], offset[order]
        # for every hit, is there another piece of the item among the following hits within the allowed shift?
        found, step = np.zeros(len(item), dtype=bool), 1
        while step < len(item):
            near = (item[step:] == item[:-step]) & (start[step:] - start[:-step] <= 2 * self.edits[item[:-step]])
            if not near.any():
                break
            found[:-step] |= near & (offset[step:] != offset[:-step])
            step += 1
        out: list[tuple[int, int]] = []
        for i, s in zip(item[found].tolist(), start[found].tolist(), strict=True):
            if not out or out[-1] != (i, max(0, s)):
                out.append((i, max(0, s)))
        return out


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, edits), one row per row of ``docs`` and benchmark item found in it.

    An item is found if some piece of the document lies within 10 % of the item's length in edits, both without case and
    punctuation. Windows of the item's size, placed by whole pieces of it, are embedded (CGK) and sampled; those that
    agree with the item in some sample are checked by exact edit distance. Items are a stated query set: they go out in
    blocks of at most ``block``, one pass each, so a benchmark of any size is held in bounded memory.

    Items under MIN_ITEM characters (in that form) are found only word for word, between borders of words, with 0 edits.

    Null and empty texts hold nothing; items that are null or without a letter or digit are not looked for. Repeated items are found under each of
    their ids; repeated rows give repeated rows. Other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    items = benchmark.select("item_id", "text").filter("text is not null")
    blocks = max(1, -(-items.count() // block))
    made = None
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        shared = sc.broadcast({"rows": sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            if "items" not in held:  # built once per worker, which keeps it for its later tasks
                held["items"] = Items(held["rows"])
            yield from in_batches(lambda batch: _search(batch, held["items"]))(batches)

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, edits long")
        made = part if made is None else made.union(part)
    return made


def _search(batch: pa.RecordBatch, known: Items) -> pa.RecordBatch:
    placed: list[tuple[int, int, int, str]] = []
    best: dict[tuple[int, int], int] = {}
    for row, text in enumerate(batch.column(1).to_pylist()):
        if text:
            plain = normalised(text)
            best |= dict.fromkeys(((row, item) for item in known.verbatim(plain)), 0)
            for item, start in known.anchors(plain):
                size, slack = len(known.rows[item][1]), int(known.edits[item])
                around = plain[max(0, start - 2 * slack) : start + size + 2 * slack]
                placed.append((row, item, min(start, 2 * slack), around))
    for some in (placed[i : i + 5000] for i in range(0, len(placed), 5000)):
        windows = [around[at : at + len(known.rows[item][1])] for _, item, at, around in some]
        hit = collide(windows, np.array([p[1] for p in some]), known.signs, known.at)
        for (row, item, _, around), near in zip(some, hit, strict=True):
            if near and best.get((row, item)) != 0:
                edits = edit_distance_within(known.rows[item][1], around)
                if edits <= known.edits[item]:
                    best[row, item] = min(edits, best.get((row, item), edits))
    found = sorted(best.items())
    keys = batch.column(0).take(pa.array([r for (r, _), _ in found], pa.int64()))
    ids = pa.array([known.ids[i] for (_, i), _ in found], pa.int64())
    return pa.RecordBatch.from_arrays([keys, ids, pa.array([e for _, e in found], pa.int64())], ["doc_id", "item_id", "edits"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns; rows without a key always stay."""
    dirty = leaks(docs, benchmark).filter("doc_id is not null").select("doc_id").distinct()
    return docs.join(dirty, "doc_id", "left_anti").select(*docs.columns)


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
