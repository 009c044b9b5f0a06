"""BPE, exact and near dedup, repeats, mixing: brute force on small tables and edge cases."""

import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from folioforge.llm import anchors, bpe, exact, minhash, mixing, repeats, shingles, suffix

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id bigint, text string"
ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (3, "a"), (4, "A b c d e f"), (5, "a B c d e f"), (6, "x" * 30_000), (7, "é☃ \U0001f600"), (8, "q w e r t y u i o p " * 40)]


def table(spark, rows, kind=DOCS):
    """A table with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame(rows, kind).withColumns({"n": F.lit(1), "rep": F.lit("x"), "key": F.lit("y"), "name": F.lit("z"), "size": F.lit(2)})


def noisy(seed, n=60):
    """Texts with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5)))
    base = [[word() for _ in range(rng.randint(1, 120))] for _ in range(8)]
    passage = " ".join(word() for _ in range(40))
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = word()
        text = " ".join(words)
        if rng.random() < 0.3:
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :]
        out.append((i, text.upper() if rng.random() < 0.2 else text))
    return out


@pytest.fixture(scope="module")
def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_public_encoder(spark, encoder):
    rng = random.Random(3)
    texts = ["", "  a  b ", "don't  stop\n\n \tnow ", "<|endoftext|>", "日本語 ☃", "x" * 2000, "ab" * 500 + "!?" * 200]
    texts += ["".join(rng.choice("abc  \n'ste1²é☃.,!") for _ in range(150)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None)]
    out = {r.doc_id: r for r in bpe.encode_texts(table(spark, rows), VOCABULARY, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = encoder.encode_ordinary(t or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert out[i].ids == raw and out[i].n_tokens == len(ids) and out[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    coded = bpe.encode_texts(table(spark, rows), VOCABULARY, public_tokenizers.PATTERN)
    assert all(r.decoded == (dict(rows)[r.doc_id] or "").encode() for r in bpe.decode_ids(coded, VOCABULARY, public_tokenizers.PATTERN).collect())


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("chars", [4, 8192])
def test_exact_groups(spark, chars):
    rows = noisy(1) + [(100 + i, t) for i, t in ODD] + [(106, "X" * 30_000), (200, "q" * 30_000), (200, "q" * 30_000)]
    want = {}
    for i, t in rows:
        want.setdefault(lower(t), []).append(i)
    digest = lambda t: hashlib.sha256(lower(t).encode()).hexdigest()
    group = {digest(t): ids for t, ids in want.items()}
    out = exact.exact_groups(table(spark, rows), block_chars=chars).collect()
    assert sorted((r.doc_id, r.text_sha256) for r in out) == sorted((i, digest(t)) for i, t in rows)
    for r in out:
        ids = group[r.text_sha256]
        assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), r.doc_id == max(ids))


def test_exact_copies_of_a_hot_text(spark):
    rows = [(i, "HOT text" if i % 3 else f"text {i}") for i in range(900)] + [(None, "hot TEXT")]
    out = {r.doc_id: r for r in exact.exact_groups(table(spark, rows)).collect()}
    assert out[1].keep_id == 899 and out[1].group_size == 601 and not out[None].kept
    left = exact.drop_exact_copies(table(spark, rows))
    assert left.count() == 301 and left.columns == table(spark, rows).columns


def test_blocks_whose_hashes_collide(spark, monkeypatch):
    monkeypatch.setattr(exact.F, "xxhash64", lambda c: F.length(c).cast("bigint"))
    rows = noisy(1)
    want = {}
    for i, t in rows:
        want.setdefault(lower(t), []).append(i)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact.exact_groups(table(spark, rows)).collect()} == {(i, max(ids), len(ids)) for ids in want.values() for i in ids}


def test_exact_copies_under_one_id(spark):
    rows = [(1, "A"), (1, "unique"), (2, "a"), (3, None), (4, ""), (5, "same"), (5, "same"), (None, "lone"), (None, "Same")]
    docs = table(spark, rows).withColumns({"id": F.lit(1), "row": F.lit(2), "own": F.lit(3), "digest": F.lit(4)})
    left = exact.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.filter("doc_id is not null").collect()) == [(1, "unique"), (2, "a"), (4, ""), (5, "same"), (5, "same")]
    assert [r.text for r in left.filter("doc_id is null").collect()] == ["lone"] and exact.drop_exact_copies(docs.filter("false")).count() == 0


def sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts, percent=85):
    s = {i: sets(t) for i, t in texts.items()}
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for x in ids:
        for y in ids:
            if x < y and s[x] and s[y] and 100 * len(s[x] & s[y]) >= percent * len(s[x] | s[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = noisy(seed, 120) + [(1000 + i, t) for i, t in ODD]
    want = brute_components(dict(rows))
    out = minhash.near_duplicates(table(spark, rows)).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_pairs_between_the_thresholds(spark):
    """Jaccard 156 / 192 = 0.8125: near copies at 80 percent, not at op5's 85."""
    import corpus_pipeline

    rows = []
    for k in range(40):
        words = [f"w{k}_{i}" for i in range(178)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:160], *(f"v{k}_{i}" for i in range(18))]))]
    shared, union = len(sets(rows[0][1]) & sets(rows[1][1])), len(sets(rows[0][1]) | sets(rows[1][1]))
    assert 80 * union <= 100 * shared < 85 * union
    docs = table(spark, rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "", threshold=80).collect()) == list(range(0, 80, 2))
    assert all(r.kept for r in minhash.near_duplicates(docs).collect())


@pytest.mark.parametrize("percent", [85, 87, 90])
def test_recall_of_the_bands(percent):
    """Sets at the threshold or above share a bucket: 300 pairs, none missed."""
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(20, 400))
        own = max(1, int(n * (100 - percent) / (100 + percent)))
        both, a, b = (np.sort(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (n - own, own, own))
        x, y = np.concatenate([both, a]), np.concatenate([both, b])
        if 100 * len(both) < percent * (len(both) + 2 * own):
            x, y = np.concatenate([both, a[: own // 2]]), np.concatenate([both, b[: own // 2]])
        assert np.intersect1d(shingles.band_keys(shingles.signature(x)), shingles.band_keys(shingles.signature(y))).size


def test_near_copies_of_a_hot_pivot(spark, monkeypatch):
    """Many partners of one pivot are dealt over several copies of its text."""
    monkeypatch.setattr(minhash, "PIVOT_SHARE", 3)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:-1], f"end{i}"])) for i in range(40)] + [(99, "other words than those of the others here")]
    assert {r.doc_id for r in minhash.near_duplicates(table(spark, rows)).collect() if r.kept} == {0, 99}


def test_dropping_near_copies(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(3, words), (1, words + " x"), (2, words + " y"), (2, words + " y"), (1, words + " x"), (None, words), (None, None), (7, None), (8, ""), (9, "lone text of few words here")]
    docs = table(spark, rows).withColumns({"_gone": F.lit(1), "row": F.lit(2), "id": F.lit(3), "own": F.lit(4), "text_key": F.lit(5)})
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and minhash.drop_near_duplicates(docs.filter("false")).count() == 0
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in left.collect())) == [(False, 1, words + " x"), (False, 1, words + " x"), (False, 7, ""), (False, 8, ""), (False, 9, "lone text of few words here"), (True, 0, ""), (True, 0, words)]


def test_bands_for_a_threshold():
    assert shingles.bands_for(85) == (shingles.BANDS, shingles.ROWS) and shingles.bands_for(80) == (33, 5)


def test_near_duplicates_along_a_chain(spark):
    """Neighbours in a chain are linked, its ends are not."""
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(12):
        for i in range(3):
            base[k * 20 + i] = f"v{k}_{i}"
        rows.append((50 - k, " ".join(base)))
    assert {r.component_id for r in minhash.near_duplicates(table(spark, rows)).collect()} == {39}


def test_signatures_keep_minima_and_maxima():
    s = shingles.shingle_set("a b c d e f g h")
    x = (s >> np.uint64(32)).astype(np.uint32)[None, :]
    y = (x ^ shingles._XOR) * shingles._ODD
    assert (shingles.signature(s) == np.concatenate([y.min(1), y.max(1)])).all()


def brute_repeats(texts, length):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def test_a_line_that_many_documents_share(spark):
    """Between different neighbours, over many batches, some of which hold many of them and some few."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = " ".join(word() for _ in range(40))
    rows = []
    for i in range(120):
        own = [" ".join(word() for _ in range(rng.randint(5, 30))) for _ in range(2)]
        rows.append((i, f"{own[0]} {line} {own[1]}" if i < 60 or i % 10 == 0 else " ".join(own)))
    docs = table(spark, rows).repartitionByRange(6, "doc_id")
    out = {r.doc_id: r for r in suffix.remove_repeats(docs, local_hot=5).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in out.items()} == brute_repeats(dict(rows), 100)


@pytest.mark.parametrize(("hot", "local"), [(0, 64), (512, 64), (512, 2), (512, 0)])
def test_repeated_bytes(spark, hot, local):
    rows = noisy(4, 80) + [(1000 + i, t) for i, t in ODD if i != 3] + [(2000, "ab" * 300)]
    want = brute_repeats(dict(rows), 100)
    out = {r.doc_id: r for r in suffix.remove_repeats(table(spark, rows), hot=hot, local_hot=local).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in out.items()} == want
    assert all(r.kept_sha256 == hashlib.sha256(r.kept).hexdigest() for r in out.values())


def test_repeats_of_rows_without_id(spark):
    rows = [(None, "z" * 150), (1, "z" * 150), (1, "z" * 150)]
    out = suffix.remove_repeats(table(spark, rows)).collect()
    assert [r.n_removed for r in out if r.doc_id is None] == [0] and len({r.n_removed for r in out if r.doc_id == 1}) == 1


@pytest.mark.parametrize("seed", range(20))
def test_maximal_repeats_cover_what_brute_force_finds(seed):
    rng = random.Random(seed)
    letters = b"ab\x00" if seed % 2 else b"abcdef"
    texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(6)]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    doc, start, size = repeats.repeated_spans(data, bounds, 8, np.arange(6), np.zeros(6, int))
    got = {(int(d), k) for d, s, n in zip(doc, start, size, strict=True) for k in range(s, s + n)}
    seen, want = {}, set()
    for i, t in enumerate(texts):
        for s in range(len(t) - 7):
            if t[s : s + 8] in seen:
                want |= {(i, k) for k in range(s, s + 8)}
            seen[t[s : s + 8]] = 1
    assert got == want
    for length, places in repeats.repeat_groups(data, bounds, 8):
        strings = {bytes(data[p : p + length]) for p in places}
        assert len(strings) == 1
        whole = sum(t[s : s + length] in strings for t in texts for s in range(len(t) - length + 1))
        assert whole == len(places)


def test_every_window_is_in_one_block():
    rng = np.random.default_rng(1)
    sizes = [0, 99, 100, 450, 1000]
    data, bounds = rng.integers(97, 100, sum(sizes)).astype(np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    _, _, start, windows = anchors.blocks(data, bounds)
    places = np.concatenate([np.arange(s, s + n) for s, n in zip(start, windows, strict=True)])
    want = np.concatenate([np.arange(a, b - 99) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    assert (np.sort(places) == want).all()


def test_mix(spark):
    rows = [(i, "w " * (i % 7 + 1), ["a", "b", None][i % 3]) for i in range(300)] + [(300, None, "a"), (301, "x", "tiny")]
    docs = table(spark, rows, "doc_id bigint, text string, source string").withColumns({"_id": F.lit(1), "_times": F.lit(2), "_copy": F.lit(3), "taken": F.lit(4), "text_key": F.lit(5)})
    out = mixing.mix(docs).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(1.5 * total)
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size and rs[0].target <= 2 * rs[0].source_size
        assert sum(r.taken for r in rs) == int(rs[0].target)
    assert by["tiny"][0].target == 2.0  # full, and its excess is shared by the others
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_mix_of_repeated_and_missing_ids(spark):
    rows = [(None, f"w{i} " * (i % 5 + 1), "a") for i in range(60)] + [(1, "one two", "a"), (1, "other text here", "b"), (1, "one two", "a"), (2, None, None), (3, "", "c")]
    docs = table(spark, rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r.size for r in out)
    for s in ("a", "b", "c", None):
        own = [r for r in out if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target)
    assert {(r.doc_id, r.text) for r in mixing.apply_mix(docs).collect()} <= {(i, t) for i, t, _ in rows if t}


def test_mix_of_many_rows_without_id_and_text(spark):
    rows = [(None, "same text here", "a")] * 500 + [(None, None, "a")] * 500 + [(i, "one two", "b") for i in range(20)]
    out = mixing.mix(table(spark, rows, "doc_id bigint, text string, source string")).collect()
    own = [r for r in out if r.source == "a"]
    assert len(out) == len(rows) and sum(r.size for r in own) == own[0].source_size == 1500
    assert sum(r.taken for r in own) == int(own[0].target) and max(r.taken for r in own) <= 6


def test_bins_do_not_change_the_mix(spark, monkeypatch):
    rows = [(i, "w " * (i % 7 + 1), "a" if i % 3 else "b") for i in range(300)]
    docs = table(spark, rows, "doc_id bigint, text string, source string")
    one = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BIN_ROWS", 2)
    assert one == sorted(map(str, mixing.mix(docs).collect()))


def test_empty_tables(spark):
    none = table(spark, [], DOCS)
    assert bpe.encode_texts(none, VOCABULARY, public_tokenizers.PATTERN).count() == 0
    assert exact.exact_groups(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert suffix.remove_repeats(none).count() == 0
    assert mixing.mix(none.withColumn("source", F.lit("a"))).count() == 0
