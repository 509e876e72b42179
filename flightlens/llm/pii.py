"""Personal data: fixed patterns, plus a character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flightlens.llm import tagger
from flightlens.llm.common import in_batches, read_documents

KINDS = ("email", "ip", "card", "phone")
# Possessive quantifiers and the look-behind keep the search linear; they do not change what is found.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Documents that the tagger's labelled spans are taken from, at most; chosen by the hash of doc_id.
TRAIN_DOCS = 600
MIN_SCORE = 0.98  # mean probability of its labels that a span of the tagger needs


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, sorted. Matches that fail their check are dropped, without retries."""
    found: list[tuple[int, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, end := m.end(), 0))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def find_spans(texts: list[str], model: dict, min_score: float = MIN_SCORE) -> list[tuple[list, list]]:
    """(base spans, all spans) of every text: the tagger's spans join where they overlap no base span."""
    out: list[tuple[list, list]] = [([], []) for _ in texts]
    some = [i for i, t in enumerate(texts) if tagger.READ.search(t)]  # no kind is written without a digit or an at sign, if spelled out
    for i, tagged in zip(some, tagger.tag([texts[i] for i in some], model), strict=True):
        base = base_spans(texts[i])
        spans = list(base)
        for start, end, kind, score in tagged:
            if score >= min_score and _plausible(texts[i][start:end], kind) and not any(s < end and start < e for s, e, _ in spans):
                spans.append((start, end, kind))
        out[i] = base, sorted(spans, key=lambda s: (s[0], s[2]))
    return out


def _plausible(piece: str, kind: int) -> bool:
    """What a span of a kind must hold at least, whatever its writing."""
    digits = sum(c in "0123456789" for c in piece)
    return any(at in piece.lower() for at in ("@", " at ", "(at)")) and len(piece) >= 5 if kind == 0 else digits >= (4, 12, 7)[kind - 1]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def train_tagger(docs: DataFrame, most: int = TRAIN_DOCS) -> dict:
    """Fit the tagger on windows around the spans of at most ``most`` documents; a table without any gives plain texts."""
    rows = (
        docs.select("doc_id", "text").filter(F.col("text").rlike("[@0-9]")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, tags = [], []
        for text in batch.column(1).to_pylist():
            for window, spans in tagger.training_windows(text, base_spans(text)):
                texts.append(window)
                tags.append(joined(spans))
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(tags, pa.string())], ["text", "spans"])

    made = rows.mapInArrow(in_batches(windows), "text string, spans string").distinct()
    made = made.orderBy(F.xxhash64("text", "spans"), "text").limit(4 * most)
    examples = [
        (r["text"], [(int(a), int(b), KINDS.index(k)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)])
        for r in made.collect()
    ]
    return tagger.train(examples)


_RESULT = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
)


def find_personal_data(docs: DataFrame, most: int = TRAIN_DOCS, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document: base counts by kind, a digest of the base spans, and all spans.

    The tagger reads every window of a text that holds a digit, an at sign, "(at)" or "at" before a domain; it is trained
    on no writing without one of them. Its overlapping windows are decoded and reconciled over the whole text. Null texts
    count as empty; they have no spans. One row per input row; other columns are ignored; repeated rows give repeated rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train_tagger(docs, most))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for base, every in find_spans([t or "" for t in batch.column(1).to_pylist()], model.value, min_score):
            counts = np.bincount([k for _, _, k in base], minlength=4).tolist()
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
        names = [part.split()[0] for part in _RESULT.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(in_batches(work), _RESULT)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_documents(spark, sf_dir))
