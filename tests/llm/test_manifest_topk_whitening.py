"""Manifest, exact search and whitening against plain versions, and on awkward rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from flightlens.llm import merkle, merkle_sql, topk, whitening
from flightlens.llm.queries import QUERIES
from tests.llm.conftest import DOCUMENTS
from tests.oracle_check import duck_rows, mismatch, spark_rows

FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(digests, places):
    """(root, {place: siblings level by level}, fold(place, digest)) of one run of digests."""
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    proofs = {}
    for p in places:
        at, found = p, []
        for level in levels[:-1]:
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            found += run[: at % 16] + run[at % 16 + 1 :]
            at //= 16
        proofs[p] = found

    def fold(place, digest):
        for level in levels[:-1]:
            run = level[place // 16 * 16 : place // 16 * 16 + 16]
            run[place % 16] = digest
            digest, place = sha("".join(run)), place // 16
        return digest

    return levels[-1][0], proofs, fold


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    leaves = [(r, sha("".join(map(shown, r)))) for r in rows]
    trees = {}
    for r, d in sorted(leaves, key=lambda x: (x[0][1] is not None, (x[0][1] or "").encode(), x[0][0] is not None, x[0][0] or 0, x[1])):
        trees.setdefault(r[1], []).append((r, d))
    roots = {s: plain_tree([d for _, d in t], range(len(t))) for s, t in trees.items()}
    root, above, refold = plain_tree([roots[s][0] for s in trees], range(len(trees)))
    out = []
    for k, (s, t) in enumerate(trees.items()):
        subroot, proofs, fold = roots[s]
        for i, (r, d) in enumerate(t):
            new = d
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                low = r[4] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
                new = sha("".join(map(shown, (*r[:4], low))))
            folded = refold(k, fold(i, new))
            out.append((r[0], d, subroot, root, sha("".join(proofs[i] + above[k])), folded, folded == root))
    return out


def run_manifest(spark, folder, rows):
    extra = [T.StructField(c, T.LongType()) for c in ("pos", "digest", "tree", "members")]
    full = [(r[0], r[4], r[2], r[1], r[3], 7, 7, 7, 7) for r in rows]
    spark.createDataFrame(full, T.StructType([*DOCUMENTS.fields, *extra])).write.parquet(f"{folder}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(folder))
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))


def test_states_resume_like_hashlib():
    rng = np.random.default_rng(1)
    children, count = rng.integers(0, 256, (40, 16, 32)).astype(np.uint8), rng.integers(1, 17, 40)
    states, digests = merkle.parents(children, count)
    slot, new = rng.integers(0, count), rng.integers(0, 256, (40, 32)).astype(np.uint8)
    folded = merkle.resume(states[np.arange(40), slot], new, slot, children, np.arange(40), count)
    for i in range(40):
        texts = [c.tobytes().hex().encode() for c in children[i, : count[i]]]
        assert hashlib.sha256(b"".join(texts)).digest() == digests[i].tobytes()
        texts[slot[i]] = new[i].tobytes().hex().encode()
        assert hashlib.sha256(b"".join(texts)).digest() == folded[i].tobytes()


@pytest.mark.parametrize("sizes", [(1,), (16,), (17, 1, 2), (256, 257, 30), (300, *[1] * 40), (4100,)])
def test_manifest_like_a_plain_tree(spark, tmp_path, sizes):
    rows = [(1000 * s + i, f"s{s}" if s else None, "en", i, f"Text {i} OF Source {s}") for s, n in enumerate(sizes) for i in range(n)]
    assert run_manifest(spark, tmp_path, rows) == sorted(map(repr, plain_manifest(rows)))


def test_manifest_of_awkward_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "a", "en", 3, "Abc"), (None, "a", "en", 3, "Abc"), (5, "a", None, 0, ""), (10, "", "é", -4, "É" * 9)]
    rows += [(7, "a\n", "de", 2, "word " * 30_000), (7, "a\n", "de", 2, "word " * 30_000), (7, "a\n", "de", 2, "Word"), (20, "ü", "", 1, "A"), (15, "😀", "-", 1, "-")]
    assert run_manifest(spark, tmp_path, rows) == sorted(map(repr, plain_manifest(rows)))


def test_manifest_of_nothing(spark, tmp_path):
    assert run_manifest(spark, tmp_path, []) == []


def test_tampered_leaves_alone_fail(spark):
    rows = QUERIES["op11_merkle_manifest"](spark, FOLDER).collect()
    bad = {r.doc_id for r in rows if not r.verified}
    assert bad and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in bad) and len(rows) == 200
    assert all((r.folded_root == r.root) == r.verified for r in rows)
    assert merkle_sql.LEVELS == 8


def write_vectors(spark, folder, rows):
    schema = "vec_id long, embedding array<float>, label int, x int, dim int, bucket int, score int"
    spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], schema).write.parquet(f"{folder}/embeddings.parquet")


def plain_topk(rows, top=10):
    clean = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    whole = {(i, tuple(int(np.floor(1024 * float(np.float32(c)))) for c in v)) for i, v in clean}
    out = []
    for q, x in whole:
        if q is None or q % 100:
            continue
        found = [(-sum(a * b for a, b in zip(x, y, strict=True)), i is None, i or 0) for i, y in whole if i != q and len(y) == len(x)]
        out += [(q, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:top])]
    return sorted(map(repr, out))


def got_topk(spark, folder):
    return sorted(repr((r.query_id, r.rank, r.vec_id, r.score)) for r in topk.op12_exact_topk(spark, str(folder)).collect())


@pytest.mark.parametrize("kind", ["plain", "lengths", "clusters", "ties", "negative"])
def test_topk_like_brute_force(spark, tmp_path, monkeypatch, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "lengths":
        x *= rng.lognormal(0, 2, 900)[:, None]
    elif kind == "clusters":
        x = x[rng.integers(0, 20, 900)] * rng.uniform(0.5, 1, 900)[:, None] + rng.normal(0, 0.01, (900, 8))
    elif kind == "ties":
        x = np.round(x)
    elif kind == "negative":
        x = np.abs(x) * np.where(np.arange(900) % 100 == 0, -1, 1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    write_vectors(spark, tmp_path, rows)
    monkeypatch.setattr(topk, "TILE", 50)
    monkeypatch.setattr(topk, "SEEDS", 100)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 256)  # several blocks of queries
    assert got_topk(spark, tmp_path) == plain_topk(rows)


def test_topk_prunes_both_ways():
    rng = np.random.default_rng(5)
    x = np.round(1024 * np.concatenate([rng.normal(0, 0.02, (500, 16)) + np.eye(16)[0], rng.normal(0, 0.3, (500, 16)), rng.normal(0, 0.01, (500, 16))])).astype(np.int64)
    ids, valid = np.arange(1500), np.ones(1500, dtype=bool)
    queries = topk.Queries(np.array([-1, -2]), np.stack([x[3], x[700]]), None, 10)
    seen = [topk.search_tile(queries, ids[s : s + 250], valid[s : s + 250], x[s : s + 250]) for s in range(0, 1500, 250)]
    assert seen[1]["coordinate"] and sum(s["coordinate"] for s in seen) < 1500  # fewer than there are pairs
    assert sum(s["length"] for s in seen[4:]) == 0  # all too short
    for k, best in enumerate(queries.best):
        scores = sorted((-(queries.x[k] @ v).item(), False, i) for i, v in enumerate(x))[:10]
        assert best == scores


def test_topk_of_awkward_rows(spark, tmp_path):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (100, [0.0, 0.0]), (200, None), (300, [None, 1.0]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0])]
    rows += [(None, [1.0, 0.5]), (None, [0.25, 1.0]), (600, [1.0, 2.0, 3.0]), (7, [-1.0, -2.0, 0.0]), (8, [30000.0, -40000.0]), (-100, [3.0, 3.0]), (700, []), (9, [])]
    write_vectors(spark, tmp_path, rows)
    assert got_topk(spark, tmp_path) == plain_topk(rows)
    wide = spark.createDataFrame([(100, [2**40, 1]), (1, [2**18, 1]), (2, [-(2**22), 2**30])], "vec_id long, x array<long>")
    assert [r.score for r in topk.top_products(wide, wide.filter("vec_id = 100")).orderBy("rank").collect()] == [2**58 + 1, 2**30 - 2**62]


def test_topk_of_nothing(spark, tmp_path):
    write_vectors(spark, tmp_path, [])
    assert got_topk(spark, tmp_path) == []


def test_topk_sql_twin_of_clusters(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(np.eye(6)[rng.integers(0, 6, 400)] + rng.normal(0, 0.05, (400, 6)))] + [(3, None), (None, [1.0] * 6)]
    write_vectors(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert mismatch(spark_rows(topk.op12_exact_topk(spark, str(tmp_path))), duck_rows(con, topk.ORACLES["op12_exact_topk"])) is None


def plain_whitening(rows):
    clean = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in clean]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    rest = np.array([[float(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    return [i for i, _ in clean], n, deviation, rest, values[::-1], vectors[:, ::-1]


def check_whitening(spark, folder, rows, kept):
    write_vectors(spark, folder, rows)
    got = whitening.op13_whitened_vectors(spark, str(folder)).collect()
    ids, n, deviation, rest, values, vectors = plain_whitening(rows)
    assert len(got) == len(ids) * kept
    want = sorted((repr(i), d, k + 1) for i, d in zip(ids, deviation, strict=True) for k in range(kept))
    assert sorted((repr(r.vec_id), r.deviation, r.component) for r in got) == want
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    return got, ids, rest @ (vectors[:, :kept] / np.sqrt(values[:kept]))


def test_whitening_like_a_dense_solve(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 24)) * np.geomspace(3, 0.2, 24)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[5].tolist()) for i in range(90)]  # copies count once
    got, ids, want = check_whitening(spark, tmp_path, rows, 16)
    made = {(r.vec_id, r.component): r.whitened for r in got}
    mine = np.array([[made[i, k + 1] for k in range(16)] for i in ids])
    mine *= np.sign((mine * want).sum(0))
    assert np.abs(mine - want).max() < 1e-10


def test_whitening_of_awkward_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 3)))] + [(3, None), (4, [None, 1.0, 2.0]), (5, [float("nan"), 1.0, 2.0])]
    rows += [(6, [1.0, float("-inf"), 2.0]), (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (70, [])]
    check_whitening(spark, tmp_path / "a", rows, 3)
    other = [(80, [1.0, 2.0])]
    write_vectors(spark, tmp_path / "b", rows + other)
    assert whitening.op13_whitened_vectors(spark, str(tmp_path / "b")).filter("vec_id = 80").count() == 0
    flat = [(i, [float(a), 2.0, float(a)]) for i, a in enumerate(rng.normal(size=30))]  # one direction with spread
    check_whitening(spark, tmp_path / "c", flat, 1)
    for k, few in enumerate(([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)])):
        write_vectors(spark, tmp_path / f"d{k}", few)
        assert whitening.op13_whitened_vectors(spark, str(tmp_path / f"d{k}")).count() == 0


@pytest.mark.parametrize("values", [[1, 1, 1, 2, 2, 5, 5 + 1e-9, 5 + 1e-12], [1.0] * 7, [0, 0, 0], [1e12, 1, 1e-3], [3, 3 + 1e-5, 3 + 2e-5, 1, 0, 0]])
def test_eigenvectors_of_clustered_values(values):
    rng = np.random.default_rng(9)
    turn = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0]
    a = turn @ np.diag(np.array(values, dtype=float)) @ turn.T
    a = (a + a.T) / 2
    found, x = whitening.eigenvectors(a)
    size = max(1e-300, np.abs(a).max())
    assert np.all(np.diff(found) <= 0) and np.abs(found - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-14 * size
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-15 * 8
    assert np.abs(a @ x - x * found).max() <= 4e-16 * size * 4


def test_correction_reaches_double_precision_from_single():
    rng = np.random.default_rng(10)
    b = rng.normal(size=(400, 40)) * np.geomspace(5, 0.5, 40)
    a = b.T @ b / 400
    single = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    wide = single.astype(np.longdouble)
    before = np.abs(single.T @ a @ single - np.diag(np.diag(single.T @ a @ single))).max()
    for _ in range(4):
        wide, values, close = whitening.refine(a.astype(np.longdouble), wide, np.zeros(40), 0.0)
    s = wide.T @ a.astype(np.longdouble) @ wide
    assert np.abs(s - np.diag(np.diag(s))).max() < 1e-15 < 1e-8 < before


def test_deviations_are_exact():
    x = np.array([[2**40, -3], [5, 2**41]])
    want = [sum((7 * int(c) - s) ** 2 for c, s in zip(r, (11, -5), strict=True)) for r in x]
    assert whitening.deviations(x, 7, [11, -5]) == [None if w > 2**63 - 1 else w for w in want]
    assert whitening.deviations(np.array([[3, 4]]), 10, [25, 41]) == [26]
