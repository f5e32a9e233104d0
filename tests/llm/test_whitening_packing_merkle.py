"""Whitening, packing and the Merkle manifest against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from storyloom.llm import merkle, packing, whitening

VECTORS = "vec_id long, embedding array<float>, n long, component string"


def vectors(n=300, width=6, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, width)) @ np.diag(range(1, width + 1)) + 3).astype(np.float32).tolist()


def plain_whitening(rows):
    """(id, x) rows; deviations, whitened values and shares by plain numpy."""
    x = np.array([[int(np.floor(1024.0 * c)) + 100_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    away = (n * x - s).astype(float) / n
    e, u = np.linalg.eigh(away.T @ away / n)
    return deviation, away @ u[:, ::-1][:, :8] / np.sqrt(e[::-1][:8]), e[::-1][:8] / e.sum()


def test_whitening_against_numpy(spark):
    sound = list(enumerate(vectors()))
    sound += [(None, sound[0][1]), (7, sound[7][1])]
    odd = [(900, None), (901, []), (902, [1.0]), (903, [None] * 6), (904, [float("nan")] + [0.0] * 5), (905, [float("inf")] + [0.0] * 5)]
    rows = spark.createDataFrame([(i, v, 0, "x") for i, v in sound + odd], VECTORS).repartition(5)
    got = whitening.whitened_rows(rows).collect()
    deviation, whitened, shares = plain_whitening(sound)
    assert Counter(r.vec_id for r in got) == Counter(i for i, _ in sound for _ in range(6))
    want = {i: (d, w) for (i, _), d, w in zip(sound, deviation, whitened, strict=True)}
    signs = {}
    for r in got:
        d, w = want[r.vec_id]
        k = r.component - 1
        assert r.n == len(sound) and r.deviation == d and abs(r.explained - shares[k]) < 1e-12 and r.identity_error < 1e-9
        if abs(w[k]) > 1e-3:
            assert signs.setdefault(k, np.sign(w[k] * r.whitened)) == np.sign(w[k] * r.whitened)
        assert abs(abs(r.whitened) - abs(w[k])) < 1e-9
    assert len(signs) == 6


def test_whitening_of_equal_few_and_no_vectors(spark):
    some = lambda rows: whitening.whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert some([]) == [] and some([(1, None), (2, [])]) == []
    same = some([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(0, None, 0.0, 0.0)] * 4
    two = some([(1, [1.0] * 20), (2, [3.0] * 20)])  # one direction has variance
    assert len(two) == 16 and {round(abs(r.whitened), 9) for r in two if r.component == 1} == {1.0} and all(r.whitened is None for r in two if r.component > 1)
    huge = some([(k, [k * 1e10, float(k % 2)]) for k in range(4)])  # deviations that no long holds
    assert {r.deviation for r in huge} == {None} and {r.component for r in huge} == {1, 2}


def test_first_fit_against_scan():
    rng = random.Random(4)
    for _ in range(200):
        lengths = sorted((rng.randint(1, 50) for _ in range(rng.randint(1, 90))), reverse=True)
        free, want = [], []
        for n in lengths:
            b = next((k for k, x in enumerate(free) if x >= n), len(free))
            if b == len(free):
                free.append(50)
            free[b] -= n
            want.append(b)
        assert packing.first_fit(lengths, 50) == want


@pytest.mark.parametrize("least_cut", [1, 8])
def test_packed_lengths_hold_every_token_once(least_cut):
    rng = random.Random(least_cut)
    for _ in range(200):
        lengths = [rng.randint(1, 63) for _ in range(rng.randint(0, 80))]
        found, padding = {}, 0
        for some in packing.pack_lengths(lengths, 64, least_cut):
            used = sum(p[2] for p in some)
            assert 0 < used <= 64
            padding += packing.padded_size(used, 64) - used
            for k, start, n in some:
                found.setdefault(k, []).append((start, n))
        for k, n in enumerate(lengths):
            at = 0
            for start, m in sorted(found[k]):
                assert start == at and m > 0
                at += m
            assert at == n
        assert padding == 0 if least_cut == 1 else padding <= 8 * (sum(lengths) // 64 + 1)


def test_words_equal_whole_texts():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        e = packing.WordEncoder(f.read(), most=50)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", " \n", "\t", ",", ".", "'s", " a", "word", " Word", "é", "ß", "１", "9", "<|endoftext|>", "　", "###", "日本", "😀", "\r", "\x1c", "_", "²", "́", "\x85", "Σ", "ς", "İ", "'RE", "\x0b", " ", "ﬁ", "가", "가"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))).encode() for _ in range(4000)]
    for k in range(0, len(some), 400):
        assert e.encode(some[k : k + 400]) == e.whole(some[k : k + 400])
    every = [chr(c).encode() + end for c in range(0x21, 0x300) for end in (b"", b"a", b".9")]
    assert [e.encode([x])[0] for x in every] == e.whole(every)
    assert e.by_word and e.by_part
    long = b" ".join(some) + b"x" * 10_000
    e.tried, packing.SLICE = True, 1000
    try:
        assert e.long_text(long) == e.whole([long])[0]
    finally:
        packing.SLICE = 1 << 20


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model, rng = Tokenizer.from_file(path), random.Random(2)
    texts = [" ".join(rng.choice(["lorem", "ipsum", "zq", "Σ.", "9"]) for _ in range(rng.choice([1, 5, 60, 300, 3000]))) for _ in range(60)] + [None, "", " \n", "word " * 9000, "-" * 20_000]
    rows = [(i, t, 5, "x") for i, t in enumerate(texts)] + [(None, "no id", 1, ""), (3, texts[3], 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, ids string").repartition(3)
    sequences = packing.pack(docs, path, group=10_000)
    kept = sequences.collect()
    assert len({s.sequence_id for s in kept}) == len(kept)
    tokens = {}
    for s in kept:
        ids = np.frombuffer(bytes(s.ids), "<u2")
        assert len(ids) == s.size == (s.n_tokens if s.n_tokens & (s.n_tokens - 1) == 0 else 2048) and not ids[s.n_tokens :].any()
        at = 0
        for p in s.pieces:
            assert p.offset == at
            at += p.length
            tokens.setdefault(p.doc_id, []).append((p.start, p.doc_tokens, ids[p.offset : at].tolist()))
        assert at == s.n_tokens
    for i, t, *_ in rows:
        want = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        if i == 3:  # two equal rows
            assert sorted(x for p in tokens[3] for x in p[2]) == sorted(want * 2)
        else:
            assert [x for p in sorted(tokens[i]) for x in p[2]] == want and {p[1] for p in tokens[i]} == {len(want)}
    placed = packing.placed_pieces(sequences).collect()
    assert sorted((r.sequence_id, r.offset, r.ids_crc32) for r in placed) == sorted((s.sequence_id, p.offset, zlib.crc32(np.frombuffer(bytes(s.ids), "<u2")[p.offset : p.offset + p.length].astype("<u4").tobytes())) for s in kept for p in s.pieces)
    assert sum(s.size - s.n_tokens for s in kept) < 0.02 * sum(s.n_tokens for s in kept)
    assert packing.pack(docs.limit(0), path).count() == 0


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, k):
    out = []
    for level in tree[:-1]:
        a = k - k % 3
        out += [x for j, x in enumerate(level[a : a + 3], a) if j != k]
        k //= 3
    return out


def refolded(tree, k, d):
    for level in tree[:-1]:
        a = k - k % 3
        run = level[a : a + 3]
        run[k - a] = d
        d, k = digest("".join(run)), k // 3
    return d


def plain_merkle(rows):
    fields = lambda r: "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in sources:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(fields(r))))
    trees = [levels([digest(fields(r)) for r in by[x]]) for x in sources]
    top = levels([t[-1][0] for t in trees]) if trees else []
    out = []
    for t, x in enumerate(sources):
        for k, r in enumerate(by[x]):
            other = trees[t][0][k]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                other = digest(fields((*r[:4], r[4].replace("\n", ""))))
            root = refolded(top, t, refolded(trees[t], k, other))
            out.append((r[0], trees[t][0][k], trees[t][-1][0], top[-1][0], digest("".join(siblings(trees[t], k) + siblings(top, t))), root, root == top[-1][0]))
    return out


@pytest.mark.parametrize("n,per_block", [(0, 2), (1, 2), (2, 1), (9, 2), (10, 2), (400, 1), (400, 8)])
def test_merkle_against_brute_force(spark, tmp_path, monkeypatch, n, per_block):
    monkeypatch.setattr(merkle, "LEVELS", per_block)
    monkeypatch.setattr(merkle, "BLOCK", 3**per_block)
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(300)]), rng.choice([None, "a", "é", "\U0001f600", "ﬁ"] * 3 + ["hot"] * 20), rng.choice(["en", None]), rng.choice([None, 3]), rng.choice([None, "", "x\ny", "日本\n", "q" * 100_000])) for _ in range(n)]
    rows += rows[:20] * 2
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place int, root string")
    frame.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    order = lambda r: tuple((x is not None, x) for x in r)
    got = merkle.op13_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(plain_merkle(rows), key=order)


def test_merkle_combiners_in_any_order():
    """Nodes of a block come in any order and in any parts; what is combined is the same."""
    rng = random.Random(5)
    for n in (1, 2, 3, 4, 26, 27, 28, 80):
        nodes = [(n, k, hashlib.sha256(bytes([k])).digest(), (k, None)) for k in range(n)]
        want = None
        for _ in range(10):
            rng.shuffle(nodes)
            cut = sorted(rng.randint(0, n) for _ in range(3))
            parts = [p for p in (nodes[: cut[0]], nodes[cut[0] : cut[1]], nodes[cut[1] : cut[2]], nodes[cut[2] :]) if p]
            held = []
            for p in parts:
                h = merkle.create(p[0])
                for x in p[1:]:
                    h = merkle.add(h, x)
                held.append(h)
            whole = held[0]
            for h in held[1:]:
                whole = merkle.merge(whole, h)
            told = merkle.finished(((0, 0), whole))
            assert want is None or told == want
            want = told
        assert bytes(want[4]).hex() == levels([hashlib.sha256(bytes([k])).hexdigest() for k in range(n)])[-1][0]
