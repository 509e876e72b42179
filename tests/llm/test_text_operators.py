"""The text operators against brute force, libraries, held-out labels, and awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from flightlens.llm import classifier, decontamination, gam, licenses, mixing, near_join, paragraphs, pii, quality_rules, sharding, tagger, textstats, tokens
from flightlens.llm.license_texts import LICENSES
from flightlens.llm.queries import ORACLES, QUERIES
from tests.oracle_check import connect, duck_rows, mismatch, spark_rows

FOLDER = "/root/testdata/sf0.001"
LONG = "word " * 30_000
AWKWARD = [(1, None), (2, ""), (None, "one two three"), (3, "\n \t"), (4, LONG), (5, "x" * 50_000), (6, "same text here"), (6, "same text here")]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    assert mismatch(spark_rows(QUERIES[name](spark, FOLDER)), duck_rows(connect(FOLDER), ORACLES[name])) is None


def test_licenses_by_digest(docs):
    mit = LICENSES["MIT"]
    british = "Copyright (c) 2024 A. Person\n\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE").replace(",", " ,")
    rows = docs((1, british), (2, "A line.\nLICENCED under CC-BY  4.0\nSPDX-License-Identifier: MIT"), (3, mit + " and more"), *AWKWARD[:6])
    got = {r.doc_id: r for r in licenses.scan_licenses(rows.filter("length(trim(text)) > 5 and doc_id <= 3")).collect()}
    assert got[1].license == "MIT" and got[1].n_notices == 0
    assert (got[2].license, got[2].n_notices, got[2].notices) == (None, 2, "CC-BY-4.0,MIT (tag)")
    assert got[3].license is None
    assert licenses.scan_licenses(docs(*AWKWARD)).filter("license is null and n_notices = 0 and notices = ''").count() == len(AWKWARD)
    assert licenses.scan_licenses(docs(*AWKWARD).limit(0)).count() == 0


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    where = defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(covered)


def test_quality_rules(docs, real):
    got = {r.doc_id: r for r in quality_rules.quality_rules(real).collect()}
    for row in real.collect():
        want = brute_rules(row.text)
        r = got[row.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    odd = quality_rules.quality_rules(docs(*AWKWARD)).collect()
    assert len(odd) == len(AWKWARD) and all(r.base_failed and not r.kept for r in odd)
    assert quality_rules.quality_rules(docs(*AWKWARD).limit(0)).count() == 0


def test_quality_rules_reject_other_languages(spark):
    folder = "/root/testdata/sf0.01"
    many = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    before = quality_rules.quality_rules(many)
    good = before.filter("not base_failed").join(labels.filter("quality = 1"), "doc_id").select("doc_id", "kept").collect()
    assert len(good) > 100 and sum(r.kept for r in good) >= 0.98 * len(good)
    rng = random.Random(12)
    clean = many.join(before.filter("kept and n_words >= 100"), "doc_id").select("doc_id", "text", "lang").orderBy("doc_id").collect()
    wrong = [(-1 - r.doc_id, r.text, "en") for r in [r for r in clean if r.lang == "de"][:20]]
    wrong += [(-1 - r.doc_id, r.text, "de") for r in [r for r in clean if r.lang == "en"][:10]]
    salad = [(-100_000 - k, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)), "en") for k in range(5)]
    rows = spark.createDataFrame([*wrong, *salad], many.schema)
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(many.union(rows)).filter("doc_id < 0").collect()}
    assert len(got) == 35 and sum(got.values()) <= 1


def test_js_distance():
    assert quality_rules.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert quality_rules.js_distance(np.array([2.0, 2]), np.array([1.0, 1])) == pytest.approx(0)
    assert quality_rules.js_distance(np.zeros(2), np.ones(2)) == 0


def plain_spans(text):
    patterns = {
        0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def holds(kind, piece):
        digits = [int(c) for c in piece if c in "0123456789"]
        if kind == 1:
            return all(int(p) <= 255 for p in piece.split("."))
        if kind == 2:
            luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and luhn % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    found = [(m.start(), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, text) if holds(k, m[0])]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_base_spans_like_plain_patterns():
    rng = random.Random(5)
    pieces = ["a", "b.c", "@", ".", "1", "25", "256", "-", " ", "+", "(", ")", "4111111111111111", "\n", "é", "+44 20 7946 0958", "%_", "x@y.z"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_tagger_learns_and_adds():
    rng = random.Random(3)
    texts = [f"some words here {rng.choice(['mail', 'write'])} {rng.choice('abcdef')}bc.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com and go on with more prose, then call +1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} for the rest" for _ in range(60)]
    model = tagger.train([w for t in texts for w in tagger.training_windows(t, pii.base_spans(t))])
    clean = ["in 1999 there were 12 of them, at 3.5 each", "no numbers at all"]
    assert all(base == every == [] for base, every in pii.find_spans(clean, model))
    text = texts[0].replace("+1 (", "(")
    base, every = pii.find_spans([text], model, min_score=0.7)[0]
    assert set(base) < set(every) and [k for s, e, k in every if (s, e, k) not in base] == [3]


def test_spelled_out_at_signs_are_read():
    model = tagger.train([])
    model["bias"][:2] = 0, 20.0  # calls all it reads an e-mail
    rng = np.random.default_rng(4)
    plain, span = "Write to jane.doe@mail.example.com about it", (9, 34, 0)
    seen = {tagger._variants(plain, [span], rng)[0] for _ in range(60)}
    assert len(seen) == 4
    for text in seen:
        assert tagger.tag([text], model)[0] and pii.find_spans([text], model)[0][1], text
    assert pii.find_spans(["we met at home. At last"], model) == [([], [])]


def test_personal_data(docs, real):
    got = {r.doc_id: r for r in pii.find_personal_data(real, most=50).collect()}
    for row in real.collect():
        spans = plain_spans(row.text)
        want = Counter(k for _, _, k in spans)
        r = got[row.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want[k] for k in range(4))
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    odd = pii.find_personal_data(docs(*AWKWARD, (9, "1" * 100_000), (10, "a" * 100_000 + "@"))).collect()
    assert len(odd) == len(AWKWARD) + 2 and sum(r.n_email + r.n_card + r.n_ip + r.n_phone for r in odd) == 0
    assert pii.find_personal_data(docs(*AWKWARD).limit(0)).count() == 0


def brute_join(rows, width, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[root(i)].append(key)
    smallest = {r: min((k for k in ks if k is not None), default=None) for r, ks in groups.items()}
    return sorted(((k, len(sets[i]), smallest[root(i)] if sets[i] else k, links[i]) for i, (k, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(docs, width, percent):
    rng = random.Random(width)
    rows = list(AWKWARD)
    for base in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([4, 12, 40, 150]))]
        for copy in range(5):
            changed = [w if rng.random() > 0.02 * copy else "other" for w in words]
            rows.append((100 + base * 10 + copy, " ".join(changed).upper() if copy == 1 else " ".join(changed)))
    got = near_join.near_duplicates(docs(*rows), width, percent).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_join(rows, width, percent)


def test_jaccard_join_of_real_texts(real):
    rows = [(r.doc_id, r.text) for r in real.collect()]
    got = near_join.near_duplicates(real).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_join(rows, 5, 80)


def test_keep_one(docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = docs((5, text), (3, text + " more"), (3, text + " more"), (9, "quite another text"), (None, None))
    assert sorted((r.doc_id for r in near_join.keep_one(rows).collect()), key=str) == [3, 9, None]
    assert near_join.keep_one(rows.limit(0)).count() == 0


def test_keep_one_leaves_rows_without_key_or_words(docs):
    alone = [(None, "no key here"), (None, "no key here"), (None, None), (None, None), (4, ""), (4, "")]
    again = [(3, "one row given twice"), (3, "one row given twice"), (3, ""), (3, "")]
    got = sorted(((r.doc_id, r.text) for r in near_join.keep_one(docs(*alone, *again)).collect()), key=str)
    assert got == sorted([*alone, *again[1:]], key=str)


def edited(text, edits, rng):
    out = list(text)
    for _ in range(edits):
        k = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.34:
            out[k] = rng.choice("abcdefgh ")
        elif kind < 0.67:
            out.insert(k, rng.choice("abcdefgh "))
        else:
            del out[k]
    return "".join(out)


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randint(lo, 20))) for lo in (1, 0))
        assert decontamination.edit_distance_within(a, b) == brute_distance(a, b)


def test_leaks(spark, docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(15)]
    rows = list(AWKWARD)
    want = set()
    for k, (item, text) in enumerate(items):
        plain = decontamination.normalised(text)
        copy = edited(plain, decontamination.edits_allowed(len(plain)) // (1 + k % 3), rng)
        host = " ".join(word() for _ in range(100))
        rows.append((100 + k, f"{host}, {copy.upper()}! {host}"))
        if brute_distance(plain, decontamination.normalised(rows[-1][1])) <= decontamination.edits_allowed(len(plain)):
            want.add((100 + k, item))
        rows.append((200 + k, host))
    benchmark = spark.createDataFrame([*items, (98, None), (99, "short")], "item_id long, text string")
    for block in (20_000, 4):
        got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs(*rows), benchmark, block).collect()}
        assert got <= want and len(got) >= 0.9 * len(want)
    kept = decontamination.decontaminate(docs(*rows), benchmark)
    assert kept.count() == len(rows) - len({d for d, _ in got}) and kept.columns == docs(*rows).columns
    assert decontamination.leaks(docs(*rows), benchmark.limit(0)).count() == 0


def test_tokens_like_the_library(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    pieces = ["a", "the", " the", " ", "  ", "\n", "'s", "'ll", "<|endoftext|>", "123", "é", "!", "　", "ing", "​", "ß.", "x" * 90]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(500)] + [t or "" for _, t in AWKWARD]
    got = sorted(tokens.count_tokens(docs(*enumerate(texts)), path).collect())
    for row, text in zip(got, texts, strict=True):
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), want, want > 1024)
    assert tokens.count_tokens(docs((1, None)), path).collect()[0][1:] == (0, 0, False)


def test_gam_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    assert gam.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2))) == 0.5


def test_classifier(spark, docs, real):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = classifier.score_quality(many, labels)
    held = scored.filter("held_out").join(labels, "doc_id")
    right = held.filter("predicted = quality").count()
    assert right >= 0.95 * held.count() and scored.count() == many.count()
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    again = {r.doc_id: r.score for r in classifier.score_quality(real, flipped).collect()}
    assert again == {r.doc_id: r.score for r in classifier.score_quality(real, labels).collect()}  # held-out labels are never seen
    odd = classifier.score_quality(docs(*AWKWARD), labels).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in classifier.score_quality(docs(*AWKWARD), labels.limit(0)).collect()} == {0.5}


def test_mixing(docs):
    rows = [(k, "w " * (1 + k % 50), None, f"s{k % 3}" if k % 7 else None) for k in range(900)] + [(r[0], r[1], None, "odd") for r in AWKWARD]
    table = docs(*rows).withColumn("size", mixing.word_count(mixing.F.col("text")))
    got = mixing.mix(table, "size").collect()
    taken, sizes, target = Counter(), Counter(), {}
    for r in got:
        taken[r.source] += r.copies * r["size"]
        sizes[r.source] += r["size"]
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    assert len(got) == len(rows) and sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s in ("s0", "s1", "s2", None):
        assert taken[s] == pytest.approx(target[s], abs=150) and target[s] <= 3 * sizes[s]
    emitted = mixing.emit(docs(*rows))
    assert emitted.columns == docs(*rows).columns and emitted.count() == sum(r.copies for r in got)
    assert mixing.emit(docs(*rows).limit(0)).count() == 0


def test_shards(docs):
    rng = random.Random(6)
    rows = [(k, "t" * rng.randint(1, 60) + f" {k % 800}") for k in range(3000)] + [(5000 + k, "copy of one text") for k in range(600)] + AWKWARD[:4] + AWKWARD[6:]
    got = sharding.pack(docs(*rows)).collect()
    assert len(got) == len(rows)
    byte, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 1
        byte[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[r.text or ""].add(r.shard)
    assert set(byte) == set(range(16)) and max(byte.values()) < 1.03 * min(byte.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for t, s in where.items() if t != "copy of one text")
    assert sharding.pack(docs(*rows).limit(0)).count() == 0


def test_passages(docs):
    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(14)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(5))
    common = sentence()
    rows = [(k, f"{common}\n{sentence()} and so {passage if k in (3, 7) else sentence()} {sentence()}") for k in range(10)]
    got = {r.doc_id: r for r in paragraphs.repeated_passages(docs(*rows)).collect()}
    assert {k for k, r in got.items() if r.n_repeated} == {3, 7} and {k for k, r in got.items() if r.n_removed} == {7}
    assert got[7].first_docs == [3] and got[7].removed_chars >= 0.75 * len(passage)
    left = paragraphs.cut_spans(rows[7][1], got[7].spans)
    assert common in left and passage[100:] not in left and len(left) == len(rows[7][1]) - got[7].removed_chars
    odd = paragraphs.repeated_passages(docs(*AWKWARD)).collect()
    assert len(odd) == len(AWKWARD) and not any(r.n_removed for r in odd)
    assert paragraphs.repeated_passages(docs(*AWKWARD).limit(0)).count() == 0


def test_passages_at_word_borders_and_of_short_sentences(docs):
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 7))) for _ in range(n)]
    line = words(51)  # no sentence ends at all
    mixed = [w + "." * (k % 20 == 19) for k, w in enumerate(words(51))]  # two ends, so 20 words between them
    short = [w + "." * (k % 4 == 3) for k, w in enumerate(words(51))]
    rows, want = [], {}
    for k, passage in enumerate((line, mixed, short)):
        rows.append((10 + k, " ".join(words(40) + passage + words(40))))
        rows.append((20 + k, " ".join(words(33 + k) + passage + words(60))))
        want[20 + k] = " ".join(passage)
    rows += [(30 + k, " ".join(words(120))) for k in range(5)]
    got = {r.doc_id: r for r in paragraphs.repeated_passages(docs(*rows)).collect()}
    text = dict(rows)
    for key, r in got.items():
        assert [text[key][slice(*map(int, s.split(":")))] for s in r.spans.split(",") if s] == ([want[key]] if key in want else [])
        assert r.removed_chars == len(want.get(key, "")) and bool(r.n_repeated) == (key < 30)
        assert r.first_docs == ([key - 10] if key in want else [])


def test_passages_leave_what_lies_between_copies(docs):
    rng = random.Random(10)
    line = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 7))) for _ in range(n))
    header, footer, between = line(30), line(30), [line(4) for _ in range(6)]
    halves = line(13), line(13)  # too few words each for a passage
    rows = [(k, "\n".join([header, *(line(3) for _ in range(20)), footer])) for k in (1, 2)]
    rows += [(k, "\n".join([halves[0], line(3), halves[1]])) for k in (3, 4)]
    rows += [(k, "\n".join([header + " x", *between, line(3), *between, footer + " x"])) for k in (5, 6)]
    got = {r.doc_id: r for r in paragraphs.repeated_passages(docs(*rows)).collect()}
    left = {k: paragraphs.cut_spans(text, got[k].spans) for k, text in rows}
    assert left[2].split() == rows[1][1].replace(header, "").replace(footer, "").split()
    assert not got[3].n_repeated and not got[4].n_repeated and got[4].spans == ""
    assert left[6].split() == rows[5][1].split("\n")[7].split()  # copies of short lines go with the passage, own ones stay


def test_minhash_recall():
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(400):
        both, apart = rng.integers(0, 2**63, 40, dtype=np.uint64), rng.integers(0, 2**63, 10, dtype=np.uint64)
        a, b = np.concatenate([both, apart[:5]]), np.concatenate([both, apart[5:]])  # similarity 0.8
        keys = paragraphs.band_keys(np.concatenate([a, b]), np.array([0, 45]))
        found += bool((keys[0] == keys[1]).any())
    assert found >= 0.98 * 400


def test_counts_of_texts():
    assert textstats.duplicate_lines("a\n\n\na\n a\na") == 2
    assert textstats.symbols("#a|b<>") == 4


def test_pipeline(spark):
    import corpus_pipeline

    spread = corpus_pipeline.run(spark, FOLDER)
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert spread.columns[: len(source.columns)] == source.columns and spread.count() > 50
    assert spread.join(source, ["doc_id", "text"], "left_anti").count() == 0


def test_word_codes_tell_words_apart():
    rng = random.Random(3)
    made = ["".join(rng.choice("aAbé漢x") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 60, 64, 65, 3000]))) for _ in range(4000)]
    text = " ".join(made)
    codes = paragraphs._words(text, np.array([len(text)]))["code"].tolist()
    seen = {}
    for word, code in zip(made, codes, strict=True):
        assert seen.setdefault(word.encode().lower(), code) == code
    assert len(set(seen.values())) == len(seen)
    assert len(paragraphs._words("", np.array([0]))["code"]) == 0
