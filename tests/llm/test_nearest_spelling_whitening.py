"""Nearest neighbours, spelling variants and whitening against brute-force versions."""

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import nearest as near
from tidemark.llm import spelling, whitening

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, id string, v string, block string, rank string, w string, n string"


def vectors_of(rows):
    return [(i, v, *["k"] * 6) for i, v in rows]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(3)
    spread = [(i, [float(np.float32(x)) for x in rng.standard_normal(5)]) for i in range(1, 60)]
    odd = [
        (100, [1.0, 0.0, 0.0, 0.0, 0.0]), (200, [1.0, 0.0, 0.0, 0.0, 0.0]), (200, [1.0, 0.0, 0.0, 0.0, 0.0]), (200, [0.0, 1.0, 0.0, 0.0, 0.0]),
        (61, [1.0, 0.0, 0.0, 0.0, 0.0]), (62, [0.0] * 5), (300, [0.0] * 5), (63, None), (400, None), (64, [1.0, None, 0.0, 0.0, 0.0]), (65, [1.0, NAN, 0.0, 0.0, 0.0]),
        (66, [1.0, INF, 0.0, 0.0, 0.0]), (67, [1.0, 2.0]), (68, []), (None, [1.0, 1.0, 0.0, 0.0, 0.0]), (0, [0.5, 0.5, 0.0, 0.0, 0.0]), (-100, [-1.0, 0.0, 0.0, 0.0, 2.0]),
    ]
    return spark.createDataFrame(vectors_of(spread + odd), VECTORS).repartition(3), spread + odd


def sound(rows, zero):
    return [(i, v) for i, v in rows if v is not None and len(v) == 5 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]


def brute_nearest(rows, k, every):
    rows = sorted({(i, tuple(v)) for i, v in sound(rows, False) if i is not None})
    out = Counter()
    for i, v in rows:
        if i % every == 0:
            far = sorted((float(near.distances(np.array([w]), np.array(v))[0]), j) for j, w in rows if (j, w) != (i, v))
            out.update((i, r, j, d) for r, (d, j) in enumerate(far[:k], 1))
    return out


@pytest.mark.parametrize("k", [1, 10, 500])
def test_nearest_odd(spark, odd_vectors, k, monkeypatch):
    monkeypatch.setattr(near, "LEAST_BYTES", 500)  # several blocks
    have = near.nearest(odd_vectors[0], k=k)
    assert Counter(tuple(r) for r in have.collect()) == brute_nearest(odd_vectors[1], k, 100)
    assert have.columns == ["query_id", "rank", "vec_id", "score"]


def test_nearest_few_and_none(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert near.nearest(empty).collect() == []
    one = spark.createDataFrame(vectors_of([(0, [1.0, 2.0])]), VECTORS)
    assert near.nearest(one).collect() == []
    two = spark.createDataFrame(vectors_of([(0, [3.0]), (7, [-1.0])]), VECTORS)
    assert [tuple(r) for r in near.nearest(two).collect()] == [(0, 1, 7, 4.0)]
    same = spark.createDataFrame(vectors_of([(i, [1.0, 2.0, 3.0]) for i in range(40)]), VECTORS)
    assert sorted(tuple(r) for r in near.nearest(same, k=3).collect()) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, 0.0)]


@pytest.mark.parametrize("table", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_nearest_recall(spark, table):
    t = spark.read.parquet(f"{table}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in t.select("vec_id", "embedding").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    found = defaultdict(set)
    for r in near.nearest(t).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        hits += len(found[ids[q]] & set(ids[np.argsort(far, kind="stable")[:10]].tolist()))
    assert hits >= 0.98 * 10 * len(found)


def test_codes_estimate_and_bound():
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((4000, 100)), rng.standard_normal((30, 100))
    centre = x.mean(axis=0)
    words, norm, correction = near.encode(x, centre, 1)
    assert words.shape == (4000, 2)
    signs = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :100] * 2.0 - 1.0
    unit, _ = near._unit(x, centre)
    u, _ = near._unit(q, centre)
    guess = (signs @ (u @ near.rotation(100, 1)).T) / 10.0 / correction[:, None]
    off = (guess - unit @ u.T) / (np.sqrt(1 - correction**2) / (correction * np.sqrt(99)))[:, None]
    assert abs(off.mean()) < 0.02 and (np.abs(off) > near.MARGIN).mean() < 0.006
    block = near.Block(np.arange(4000), x, words, norm, correction, centre, 1, near.MARGIN)
    for k, ids, far in block.search(np.full(30, -1), q, 10):
        true = near.distances(x, q[k])
        assert len(set(ids.tolist()) & set(np.argsort(true)[:10].tolist())) >= 9 and (far == true[ids]).all()


LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_words(docs, length, count):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= count}


def brute_spelling(docs, length, count, times=5):
    n = brute_words(docs, length, count)
    at = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            at[w[:i], w[i + 1 :]].add(w)
    near_of = defaultdict(set)
    for (a, b), words in at.items():
        for w in words:
            near_of[w] |= words - {w}
            if a + b in n:
                near_of[w].add(a + b)
                near_of[a + b].add(w)
    form = {}
    for w in n:
        if near_of[w]:
            best = min(near_of[w], key=lambda o: (-n[o], o))
            form[w] = best if n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near_of[w]), n[form[w]] if form.get(w) else None))
    return out


WORDS = "doc_id long, text string, word string, n string, shard string, size string, c string"


def spelled(spark, docs, **how):
    df = spark.createDataFrame([(i, t, *["k"] * 5) for i, t in docs], WORDS).repartition(3) if docs else spark.createDataFrame([], WORDS)
    out = spelling.spelling_variants(df, **how)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("how", [{}, {"part": 700}, {"part": 700, "first": 1}, {"first": 5}])
def test_spelling_odd(spark, how):
    rng = np.random.default_rng(8)
    heads = ["colour", "color", "colours", "Éclair", "éclair", "eclair", "straße", "strasse", "abcdefgh", "abcdfegh", "aaaaaa", "aaaaaaa", "aaaaab", "x" * 3000, "x" * 3001, "y" + "x" * 2999]
    texts = [(i, " ".join(rng.choice(heads, 30, p=[0.3, *[0.7 / 15] * 15]).tolist())) for i in range(25)]
    letters = rng.choice(list("abé"), (400, 5))
    texts += [(i, " ".join(map("".join, letters.tolist()))) for i in range(100, 103)]
    docs = [*texts, texts[0], (None, "COLOUR Colour"), (7, None), (8, ""), (9, " 12\t"), (10, "colour_color-colour×colours÷ ĀcolourĀ \U0001f600colour")]
    for length, count in ((6, 5), (1, 1), (5, 2)):
        assert spelled(spark, docs, least_length=length, least_count=count, **how) == brute_spelling(docs, length, count), (length, count)


def test_spelling_empty_and_pieces(spark, monkeypatch):
    assert spelled(spark, []) == set() and spelled(spark, [(1, None), (2, "a b c")]) == set()
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "colour COLOURS straße " * 20 + "x" * 50
    assert [w for runs in spelling.runs_of(text) for w in runs] == [w.translate(LOWER) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]


def test_spelling_search_bounds(monkeypatch):
    monkeypatch.setattr(spelling, "FRONTIER", 50)
    monkeypatch.setattr(spelling, "VERIFIED", 40)
    rng = np.random.default_rng(2)
    words = np.unique(rng.integers(97, 101, (300, 6)).astype(np.uint8), axis=0)
    groups = np.array([c % 4 for c in range(256)])
    trie = spelling.Trie(words, np.arange(len(words)), groups)
    found = set()
    for who, place in trie.search(spelling.group_counts(words, groups), np.ones(len(words), int), np.ones(len(words), int)):
        ok = spelling.one_apart(words[who], trie.words[place])
        found |= set(zip(map(bytes, words[who[ok]]), map(bytes, trie.words[place[ok]]), strict=True))
    assert found == {(bytes(a), bytes(b)) for a in words for b in words if (a != b).sum() == 1}


def test_spelling_tables(spark, sf):
    t = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in t.collect()]
    assert {tuple(r) for r in spelling.spelling_variants(t).collect()} == brute_spelling(docs, 6, 5)


def whitened(df, **how):
    rows = df.collect()
    return rows, {r.component for r in rows}


def brute_whitening(rows, k=8):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True))) for r in x]
    y = np.array([[float(Fraction(int(a)) - Fraction(int(b), n)) for a, b in zip(r, s, strict=True)] for r in x])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    return n, deviation, (y @ v[:, :k]) / np.sqrt(e[:k]), e[:k] / e.sum(), e


def held_against(rows, have, k):
    n, deviation, w, explained, _ = brute_whitening(rows, k)
    own = defaultdict(list)
    for r in have:
        own[r.component].append(r)
    assert sorted(own) == list(range(1, k + 1))
    for j, part in own.items():
        assert len(part) == n and {r.n for r in part} == {n}
        assert all(abs(r.explained / explained[j - 1] - 1) < 1e-9 and r.identity_error < 1e-6 for r in part)
        want = Counter((rows[i][0], deviation[i]) for i in range(n))
        assert Counter((r.vec_id, r.deviation) for r in part) == want
        mine = {r.vec_id: r.whitened for r in part}
        theirs = {rows[i][0]: w[i, j - 1] for i in range(n)}
        sign = np.sign(sum(mine[i] * theirs[i] for i in mine))
        assert max(abs(mine[i] - sign * theirs[i]) for i in mine) < 1e-6


def test_whitening_tables(spark, sf):
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").repartition(40)
    rows = [(r.vec_id, r.embedding) for r in t.collect()]
    held_against(rows, whitening.whiten(t).collect(), 8)


def test_whitening_odd(spark, odd_vectors):
    df, rows = odd_vectors
    rows = [r for r in sound(rows, True) if r[0] not in (200,)]
    df = df.filter(F.coalesce(F.col("vec_id") != 200, F.lit(True)))
    held_against(rows, whitening.whiten(df).collect(), 5)
    assert {r.component for r in whitening.whiten(df, 2).collect()} == {1, 2}


def test_whitening_few_rows(spark):
    make = lambda rows: spark.createDataFrame(vectors_of(rows), VECTORS)
    for rows in ([], [(1, [1.0, 2.0])], [(i, [3.0, 4.0]) for i in range(9)], [(1, None), (2, [NAN])]):
        assert whitening.whiten(make(rows)).collect() == []
    twice = [(i % 5, [float(i % 5), 2.0, float(i % 5)]) for i in range(20)]  # one direction, repeated rows
    have = whitening.whiten(make(twice)).collect()
    assert len(have) == 20 and {r.component for r in have} == {1} and all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in have)
    large = [(i, [1e30 * (-1) ** i, float(i), 0.25 * (i % 3)]) for i in range(30)]
    have = whitening.whiten(make(large)).collect()
    assert all(r.deviation is None for r in have) and {r.vec_id for r in have} == set(range(30))


@pytest.mark.parametrize("name", ["random", "rank", "equal", "pairs", "near", "identity", "ones"])
def test_qd_components(name):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((300, 32)))[0]
    turn = np.linalg.qr(rng.standard_normal((32, 32)))[0]
    a = {
        "random": rng.standard_normal((300, 32)), "rank": rng.standard_normal((300, 3)) @ rng.standard_normal((3, 32)), "equal": q, "identity": np.eye(32),
        "pairs": q * np.repeat(np.arange(16, 0, -1.0), 2) @ turn, "near": q * (1 + 1e-9 * np.arange(32)) @ turn, "ones": rng.integers(-1, 2, (40, 32)).astype(float),
    }[name]
    r = np.linalg.qr(a, mode="r")
    v, squares, total = whitening.components(r, 8)
    true = np.linalg.svd(a, compute_uv=False) ** 2
    assert len(squares) == (3 if name == "rank" else 8) and abs(total / true.sum() - 1) < 1e-12
    assert np.abs(np.array(squares) / true[: len(squares)] - 1).max() < 1e-12
    assert np.abs(v.T @ v - np.eye(len(squares))).max() < 1e-12
    assert np.abs(r.T @ (r @ v) - v * np.array(squares)).max() < 1e-11 * true[0]


def test_dqds_small_values_are_accurate():
    """Entries over many powers of ten: every singular value keeps its digits, the least as well."""
    from math import prod

    rng = np.random.default_rng(9)
    d, u = 10.0 ** rng.integers(-6, 6, 12), 10.0 ** rng.integers(-6, 3, 11)
    found = whitening.squared_singular_values(d, u)
    assert abs(prod(found) / prod((d * d).tolist()) - 1) < 1e-10
