"""Token counts of a byte-level BPE vocabulary: whole-token shortcut, merges only for the rest."""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from flightlens.llm.common import in_batches, read_documents

LIMIT = 1024
MEMO = 1_000_000  # merged pre-tokens that a worker remembers; then it starts anew, so memory is bounded
SHORT = 64  # bytes up to which merging looks at all pairs; longer ones use a heap

# The split that the byte-level pre-tokenizer makes, a fixed value. Its white space is the Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def merged_count(data: bytes, ranks: dict[int, int]) -> int:
    """Tokens left after applying merges, lowest rank first and leftmost among equals.

    ``ranks`` maps a pair of ids, ``left << 32 | right``, to the id of the merged token: 256 plus the rank.
    """
    return _merged_long(data, ranks) if len(data) > SHORT else _merged_short(list(data), ranks.get)


def _merged_short(ids: list[int], get) -> int:
    none = 1 << 40
    pairs = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
    while pairs and (made := min(pairs)) < none:
        i = pairs.index(made)
        ids[i] = made
        del ids[i + 1], pairs[i]
        if i:
            pairs[i - 1] = get(ids[i - 1] << 32 | made, none)
        if i < len(pairs):
            pairs[i] = get(made << 32 | ids[i + 1], none)
    return len(ids)


def _merged_long(data: bytes, ranks: dict[int, int]) -> int:
    ids, n = list(data), len(data)
    count, after, before = n, list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(made, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (made := ranks.get(a << 32 | b))]
    heapq.heapify(heap)
    while heap:
        made, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue  # one side has been merged since
        ids[i], ids[j] = made, -1
        count -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if further := ranks.get(made << 32 | ids[k]):
                heapq.heappush(heap, (further, i, made, ids[k]))
        if (h := before[i]) >= 0 and (further := ranks.get(ids[h] << 32 | made)):
            heapq.heappush(heap, (further, h, ids[h], made))
    return count


def load_vocabulary(path: str) -> tuple[list[str], dict[int, int], list[str]]:
    """(strings proven to be one token alone, merge ranks, special strings) of a tokenizers file.

    The proof runs the merges on every string of the vocabulary; only those that end as one token are listed.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("only byte-level BPE without normalizer or prefix space is known here")
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    ids = {bytes([b]): b for b in range(256)}
    ranks = {}
    for made, (a, b) in enumerate(spec["model"]["merges"], start=256):
        ranks[ids[raw(a)] << 32 | ids[raw(b)]] = ids[raw(a + b)] = made
    special = [t["content"] for t in spec["added_tokens"]]
    whole = []
    for word in spec["model"]["vocab"]:
        if word in special:
            continue
        data = raw(word)
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            continue  # a part of a character is never a pre-token
        if merged_count(data, ranks) == 1:
            whole.append(text)
    return whole, ranks, special


class _Memo(dict):
    """Remembers what ``price`` gave, up to a bound; starts with ``known``."""

    def __init__(self, known: dict, price):
        super().__init__(known)
        self.known, self.price, self.most = known, price, len(known) + MEMO

    def __missing__(self, piece: str) -> int:
        count = self.price(piece)
        if len(self) >= self.most:
            self.clear()
            self.update(self.known)
        if len(piece) <= 100:
            self[piece] = count
        return count


def counter(whole: list[str], ranks: dict[int, int], special: list[str]):
    """A function text -> number of tokens. A special string inside a text is one token, as by the library's default.

    A space between two other signs always begins a pre-token, so a text may be cut before each such space; a piece of
    letters only is one pre-token, with a stop behind it two; others are split by the pattern. Texts with other spaces (in a row, or beside other
    white space) are split as a whole.
    """
    findall = regex.compile(SPLIT).findall
    marks = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    # whole tokens cost one; the rest is merged
    price = _Memo(dict.fromkeys(whole, 1), lambda piece: merged_count(piece.encode("utf-8", "surrogatepass"), ranks))

    def count_part(text: str) -> int:
        first, *rest = text.split(" ")
        total = sum(map(price.__getitem__, findall(first)))
        apart = not first or first[-1].isspace()
        for piece in rest:
            if piece.isalpha():
                total += price[" " + piece]
            elif piece[:-1].isalpha() and piece[-1] in ".,;:!?":
                total += price[" " + piece[:-1]] + price[piece[-1]]
            elif not piece or piece[0].isspace() or piece[-1].isspace():
                apart = True
                break
            else:
                total += sum(map(price.__getitem__, findall(" " + piece)))
        return sum(map(price.__getitem__, findall(text))) if apart and rest else total

    def count(text: str) -> int:
        parts = marks.split(text) if marks else [text]
        return sum(map(count_part, parts)) + len(parts) - 1

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_tokens, over_limit). Null text counts as empty: no bytes, no tokens.

    The vocabulary is of fixed size and broadcast. One row per input row; other columns are ignored.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches):
        count = counter(*vocabulary.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [count(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([c > limit for c in n], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        yield from in_batches(work)(batches)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
