"""Spelling variants, clustering and quality rules: brute force on small tables and edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import centroids, rules, spelling

DOCS = "doc_id bigint, text string"


def table(spark, rows, kind=DOCS):
    """A table with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame(rows, kind).withColumns({c: F.lit("x") for c in ("n", "word", "key", "cluster", "q", "failures", "hash", "n_words", "last")})


# Spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        top = min(others, key=lambda x: (-words[x], x), default=None)
        form = top if top and words[top] >= 10 * n else None
        out[w] = [form, None, n, len(others), words.get(form)]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


def found_variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def misspelt(seed, letters, n_words, length=9):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, length))) for _ in range(n_words)]
    rows = []
    for doc in range(120):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = base[min(int(rng.expovariate(0.3)), len(base) - 1)]
            if rng.random() < 0.2:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]])
            words.append(w.title() if rng.random() < 0.1 else w)
        rows.append((doc, rng.choice([" ", ", ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("seed, letters, n_words", [(1, "ab", 12), (2, "abcé", 40), (3, "aaaaab", 8), (4, "abcdefghijklmnopqrstuvwxyzàÿ", 60)])
def test_variants_against_brute_force(spark, seed, letters, n_words):
    rows = misspelt(seed, letters, n_words)
    rows += [(None, rows[5][1]), (7, None), (8, ""), rows[9], rows[9], (10, "É" * 9 + " é" + "é" * 8), (11, "É" * 9)]
    want = brute_variants(rows)
    assert found_variants(spelling.variants(table(spark, rows))) == want
    assert any(r[0] for r in want.values()) and len(want) > 20


def test_chains_of_forms(spark):
    # each word is one letter away from the next one, which is ten times as frequent
    words = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx"]
    rows = [(0, " ".join(" ".join([w] * (2 * 10**i)) for i, w in enumerate(words)))]
    want = brute_variants(rows)
    assert found_variants(spelling.variants(table(spark, rows))) == want
    assert [want[w][1] for w in words if w in want].count("abcdezyx") == len([w for w in words if w in want])


def test_very_long_words_and_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    long = "ab" * 3000
    rows = [(i, f"{long} {long[:777]}x{long[777:]} {'a' * 5000} {'a' * 5001} seventh, {long}") for i in range(3)]
    assert found_variants(spelling.variants(table(spark, rows))) == brute_variants(rows)
    text = "".join(random.Random(1).choice("abcé ,.") for _ in range(3000))
    assert [text[a:b] for a, b in spelling._pieces(text)] and "".join(text[a:b] for a, b in spelling._pieces(text)) == text


def test_no_words(spark):
    for rows in ([], [(1, None)], [(1, "short words only, no more")]):
        out = spelling.variants(table(spark, rows))
        assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_pivots_are_the_rarest_that_do_not_overlap(seed):
    rng = random.Random(seed)
    grams = [(p, rng.randint(1, 9)) for p in rng.sample(range(9), 5)]
    for need in (2, 3):
        sets = [x for x in itertools.combinations(sorted(grams), need) if all(b[0] - a[0] >= 2 for a, b in itertools.pairwise(x))]
        if sets:
            found = spelling.pivots(grams, need)
            assert sum(dict(grams)[p] for p in found) == min(sum(c for _, c in x) for x in sets)
            assert len(found) == need and all(b - a >= 2 for a, b in itertools.pairwise(found))


# Clustering


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [q for _, q in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cents)) for _, q in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(cents)):
            mine = [q for (_, q), (_, c) in zip(kept, at, strict=True) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    at = assign()
    per = Counter()
    for d, j in at:
        per[j] += d
    return sorted((i if i is not None else -1, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at, strict=True))


def found_clusters(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


VECS = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize("seed, spread", [(1, 1.0), (2, 0.02), (3, 0.0)])
def test_clusters_against_brute_force(spark, seed, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, 64))
    rows = [(i, (middles[i % 5] * (1 if spread else 0.01) + spread * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(150)]
    rows += [rows[3], rows[3], (500, None), (501, []), (502, [1.0] * 63), (503, [None] + [1.0] * 63), (504, [float("nan")] + [1.0] * 63), (505, [float("inf")] + [1.0] * 63), (None, [0.5] * 64), (506, [-0.25] * 64)]
    assert found_clusters(centroids.cluster_vectors(table(spark, rows, VECS))) == brute_clusters(rows)


def test_few_huge_and_no_vectors(spark):
    rows = [(1, [1.0] * 64), (2, [-1.0] * 64)]
    assert found_clusters(centroids.cluster_vectors(table(spark, rows, VECS))) == brute_clusters(rows)
    out = centroids.cluster_vectors(table(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)], VECS), rounds=0, k=1).collect()
    assert sorted(r.distance for r in out) == [0, 64 * (2 * centroids.LIMIT) ** 2]
    none = centroids.cluster_vectors(table(spark, [(1, None)], VECS))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("seed, k, dims", [(1, 1, 1), (2, 7, 2), (3, 16, 3), (4, 40, 5), (5, 16, 64)])
def test_threshold_algorithm_finds_the_nearest(seed, k, dims):
    rng = np.random.default_rng(seed)
    cents, x = rng.integers(-5, 6, (k, dims)), rng.integers(-7, 8, (200, dims))
    cluster, distance = centroids.nearest(x, cents)
    every = ((x[:, None] - cents[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()


# Quality rules


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(lines), len(covered)


def rule_texts(seed=5, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab é#|\x1c\xa0\t") for _ in range(rng.randint(1, 3)))
    out = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "x " * 40, "one\none\none\none\n \n", "w" * 500, "é☃ " * 12]
    for _ in range(n):
        out.append("".join(rng.choice([word(), " ", "\n", "a b c d e ", "line of text\n"]) for _ in range(rng.randint(1, 60))))
    return out


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_measures_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(rules, "PIECE", piece)
    for t in rule_texts():
        assert rules.measure(t or "") == brute_measures(t)


def test_windows_whose_hashes_collide(monkeypatch):
    monkeypatch.setattr(rules, "hash", lambda w: len(w), raising=False)
    for t in rule_texts(6, 60):
        assert rules.measure(t or "") == brute_measures(t)


def test_ledger_policies_and_ablations(spark):
    rows = list(enumerate(rule_texts())) + [(None, "a b c"), (3, "a b c d e")]
    book = rules.ledger(table(spark, rows))
    kept = rules.apply_policy(book).collect()
    assert len(kept) == len(rows)
    checks = [lambda w, c, s, d, n, r: w < 10, lambda w, c, s, d, n, r: 100 * r > 20 * w, lambda w, c, s, d, n, r: w and c < 2 * w, lambda w, c, s, d, n, r: w and c > 20 * w, lambda w, c, s, d, n, r: w and 10 * s > w, lambda w, c, s, d, n, r: n >= 4 and 2 * d > n]
    bits = lambda t: sum(1 << i for i, f in enumerate(checks) if f(*brute_measures(t)))
    key = lambda x: str(x)
    want = sorted(((i, *brute_measures(t), bits(t), bool(bits(t) & 3), not bits(t)) for i, t in rows), key=key)
    assert sorted((tuple(r[c] for c in ("doc_id", *rules.MEASURES, "failures", "base_failed", "kept")) for r in kept), key=key) == want
    found = {(r.version, r.rule): (r.n_failed, r.n_only, r.n_kept, r.n_kept_without) for r in rules.ablations(book).collect()}
    every = [bits(t) for _, t in rows]
    for version, names in rules.POLICIES.items():
        m = rules.mask(names)
        for name in names:
            b = rules.mask([name])
            assert found[version, name] == (sum(x & b > 0 for x in every), sum(x & m == b for x in every), sum(not x & m for x in every), sum(x & m in (0, b) for x in every))
    old = {r.doc_id for r in rules.apply_policy(book, "base").filter("kept").collect()}
    assert {r.doc_id for r in kept if r.kept} <= old


def test_empty_ledger(spark):
    book = rules.ledger(table(spark, []))
    assert rules.apply_policy(book).count() == 0
    assert all(r.n_failed == r.n_only == r.n_kept == r.n_kept_without == 0 for r in rules.ablations(book).collect())
