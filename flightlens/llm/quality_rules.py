"""Quality rules: base counts, and the Jensen-Shannon distance of a text's histograms to those of its language."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flightlens.llm import textstats as ts
from flightlens.llm.common import in_batches, read_documents
from flightlens.session import stored

COMMON = 200  # words in a language's histogram; all others share one more bin
MIN_SHARE = 0.001  # of all words a language needs for a reference of its own, so there are at most 1000 references
MIN_CHARS, MIN_WORDS = 400, 100  # shorter texts are too small a sample for a verdict by that histogram
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.27, 0.55  # for words a cap; the limits of word_limits lie below it
MIN_CLASS = 20  # texts of about one length that a language needs for a limit of that length

_COUNTS = "lang string, kind string, item string, n long"


def _strip(word: str) -> str:
    return word.lower().strip(".,;:!?'\"()-")


def _count_corpus(table):
    """Words and character classes of a batch, counted per language before anything is shuffled."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words: dict[str | None, Counter] = {}
        chars: dict[str | None, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                words.setdefault(lang, Counter()).update(ts.WORD.findall(text))
                chars[lang] = chars.get(lang, 0) + ts.class_counts(text, table.value)
        rows = []
        for lang, counts in words.items():
            plain: Counter = Counter()
            for word, n in counts.items():
                plain[_strip(word)] += n
            rows += [(lang, "word", w, n) for w, n in plain.items()]
            rows += [(lang, "char", str(k), int(n)) for k, n in enumerate(chars[lang])]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        types = [pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "kind", "item", "n"])

    return in_batches(work, 10_000)


def language_references(docs: DataFrame, table, common: int = COMMON, min_share: float = MIN_SHARE) -> dict:
    """{language: (character histogram, {word: bin}, word histogram)}, counted over all documents.

    Languages below ``min_share`` of all words have no reference. What reaches the driver is bounded: at most
    1 / min_share languages with common + 9 numbers each.
    """
    counted = docs.select("lang", "text").mapInArrow(_count_corpus(table), _COUNTS)
    counts = stored(counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "language-counts")
    totals = counts.filter("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("total"))
    everything = totals.agg(F.sum("total")).first()[0] or 0
    large = totals.filter(F.col("lang").isNotNull() & (F.col("total") >= min_share * everything))
    chosen = counts.join(F.broadcast(large), "lang")
    # the most frequent words of each language: grouped maxima over at most 1000 languages, cut before the sort
    top = (
        chosen.filter("kind = 'word' AND item <> ''")
        .filter(F.col("n") * F.lit(common * 50) >= F.col("total"))  # less frequent ones cannot matter to the histogram
        .groupBy("lang", "total")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col("n"), "item")), asc=False), 1, common).alias("top"))
    )
    chars = chosen.filter("kind = 'char'").groupBy("lang").agg(F.collect_list(F.struct(F.col("item").cast("int"), "n")).alias("chars"))
    references = {}
    for row in chars.join(top, "lang", "left").collect():
        classes = np.zeros(len(ts.CLASSES))
        for k, n in row["chars"]:
            classes[k] = n
        top_words = row["top"] or []
        bins = np.array([n for n, _ in top_words] + [max(0, (row["total"] or 0) - sum(n for n, _ in top_words))], dtype=float)
        references[row["lang"]] = (classes, {w: i for i, (_, w) in enumerate(top_words)}, bins)
    return references


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence to base 2, between 0 and 1; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    a, b = p > 0, q > 0
    return float(np.sqrt(max(0.0, ((p[a] * np.log2(p[a] / m[a])).sum() + (q[b] * np.log2(q[b] / m[b])).sum()) / 2)))


def measure(text: str, lang: str | None, table: np.ndarray, references: dict) -> tuple:
    """Base counts and distances of one text, and the language whose reference it was held against."""
    words = ts.WORD.findall(text)
    numbers, codes = ts.word_codes(words)
    counts = np.bincount(codes, minlength=len(numbers)) if words else np.zeros(0, dtype=np.int64)
    classes = ts.class_counts(text, table)
    plain: Counter = Counter()
    for word, n in zip(numbers, counts.tolist(), strict=True):
        plain[_strip(word)] += n
    best, nearest = (0.0, 0.0), None
    # a text of a language that has no reference is not measured by another language's
    for key in [lang] if lang in references else list(references) if lang is None else []:
        ref_chars, bins, ref_words = references[key]
        own = np.zeros(len(ref_words))
        for word, n in plain.items():
            own[bins.get(word, -1)] += n
        pair = (js_distance(classes.astype(float), ref_chars), js_distance(own, ref_words))
        if nearest is None or sum(pair) < sum(best):
            best, nearest = pair, key
    return (
        len(words), sum(map(len, words)), ts.symbols(text), ts.duplicate_lines(text),
        ts.repeat_words(codes, len(numbers)), *best, nearest,
    )


_RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, char_distance double, word_distance double"
)
_MEASURED = _RESULT.replace("kept boolean, ", "") + ", _lang string, _nearest string"


def word_limits(measured: DataFrame, references: dict, max_word: float, min_words: int) -> list[tuple[str, int, float]]:
    """(language, binary logarithm of the words, limit) for every reference and length.

    A text without any common word of a language has a distance that the reference alone tells. The limit lies midway
    between it and the median of the language's texts of about the same length, as short samples lie further away. Lengths
    with under MIN_CLASS texts take the limit of the next shorter one, which is wider; the shortest take that distance.
    """
    own = measured.filter((F.col("n_words") >= max(1, min_words)) & (F.col("_lang") == F.col("_nearest")))
    middle = F.percentile_approx("word_distance", 0.5, 10_000)
    classes = own.groupBy("_lang", _length().alias("_length")).agg(middle.alias("middle"), F.count(F.lit(1)).alias("n"))
    middles = {(r["_lang"], r["_length"]): r["middle"] for r in classes.filter(F.col("n") >= MIN_CLASS).collect()}
    limits = []
    for lang, (_, _, words) in references.items():
        limit = strange = js_distance(np.eye(len(words))[-1], words)
        for length in range(64):
            if (lang, length) in middles:
                limit = min(strange, (strange + middles[lang, length]) / 2)
            limits.append((lang, length, min(limit, max_word)))
    return limits


def _length():
    """Binary logarithm of the number of words, rounded down."""
    return F.length(F.bin("n_words")) - 1


def quality_rules(
    docs: DataFrame,
    max_char: float = MAX_CHAR_DISTANCE,
    max_word: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row per document: base counts, distances to the language's references, and whether it is kept.

    A text is rejected if a base rule fails, or if it is long enough for a histogram and that histogram lies further from
    the reference of its language than the limit; for words the limit is that of :func:`word_limits`, at most ``max_word``.
    A text without a language is held against the nearest reference; one whose language has no reference, as it is too rare
    for one, has distances 0 and only the base rules to pass. References come from all documents. Null and empty texts have no words, so the base rule fails. With no
    reference at all (an empty table, or no words) distances are 0. One row per input row; other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(ts.class_table())
    references = sc.broadcast(language_references(docs, table))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [
            measure(text or "", lang, table.value, references.value)
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        ]
        *numbers, nearest = zip(*rows, strict=True)
        n, chars, symbols, lines, repeats, far_c, far_w = map(np.array, numbers)
        failed = (n < 50) | (100 * repeats > 50 * n)
        columns = [n, chars, symbols, lines, repeats, failed, far_c, far_w]
        names = [part.split()[0] for part in _MEASURED.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), batch.column(2), pa.array(nearest, pa.string())], names)

    measured = stored(docs.select("doc_id", "text", "lang").mapInArrow(in_batches(work), _MEASURED), "quality-measures")
    limits = word_limits(measured, references.value, max_word, min_words)
    table = docs.sparkSession.createDataFrame(limits, "_of string, _class int, _limit double")
    judged = measured.join(F.broadcast(table), (F.col("_nearest") == F.col("_of")) & (_length() == F.col("_class")), "left")
    far_char = (F.col("word_chars") >= min_chars) & (F.col("char_distance") > max_char)
    far_word = (F.col("n_words") >= min_words) & (F.col("word_distance") > F.coalesce("_limit", F.lit(max_word)))
    names = [part.split()[0] for part in _RESULT.split(", ")]
    return judged.withColumn("kept", ~F.col("base_failed") & ~far_char & ~far_word).select(*names)


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_documents(spark, sf_dir))
