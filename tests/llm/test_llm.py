"""Operators against brute force, round trips and held-out accuracy on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from storyloom.llm import chat, decontaminate, lines, lm, mixing, nearcopies, quality, secrets, simhash, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, clash string"
WORDS = [f"w{i}" for i in range(300)]
ODD = [None, "", " ", "\n", "a", "a b", "é ß 日本 😀 x", "x " * 5000]


def texts(seed=3, n=60):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 120))) for _ in range(n)]
    return [*out, *out[:5], out[6] + " more", *ODD]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", 1, "x") for i, t in enumerate(texts())]
    rows += [(None, "no id", None, None, None, None), rows[3], rows[3]]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_token_pieces_equal_whole_texts():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        e = tokens.PieceEncoder(f.read(), "<u2", most=200)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", " \n", "\t", ",", ".", "'s", " a", "word", " Word", "é", "ß", "１", "9", "<|endoftext|>", " ", "　", "###", "日本", "😀", "\r", "\x1c", "_", "²"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for k in range(0, len(some), 400):
        assert e.encode(some[k : k + 400]) == e.encode_whole(some[k : k + 400])


def test_token_files(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    got = tokens.digest_tokens(tokens.write_tokens(docs, f"file://{tmp_path}/t", path, partitions=3), f"file://{tmp_path}/t").collect()
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()))
    at, want = 0, []
    for i, text in rows:
        ids = [*model.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert tokens.read_manifest(spark, f"file://{tmp_path}/t").agg(F.sum("ids")).first()[0] == at
    assert tokens.token_dataset(empty).count() == 0


def test_decontamination_against_brute_force(spark, docs, empty):
    base = [t for t in texts() if t]
    items = [(1, " ".join(base[0].split()[:30])), (2, base[1].upper().replace(" ", ", ")), (3, "w1 w2"), (4, None), (5, " ".join(WORDS[:40])), (6, " ".join([*base[2].split()[:20], "zz", "yy"]))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.sub(r"[^\w]+|_", " ", (t or "").lower()).split()
    grams = lambda t: {tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)}
    by_id = {}
    for r in docs.collect():
        by_id.setdefault(r.doc_id, set()).update(grams(r.text))
    want = {(d, i, len(grams(t) & g)) for d, g in by_id.items() for i, t in items if grams(t) and 100 * len(grams(t) & g) >= 80 * len(grams(t))}
    assert {(r.doc_id, r.item_id, r.n_found) for r in decontaminate.contained(docs, frame).collect()} == want and want
    left = decontaminate.decontaminate(docs, frame)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(by_id) - {d for d, _, _ in want}
    assert decontaminate.contained(empty, frame).count() == 0 and decontaminate.contained(docs, frame.where("item_id = 4")).count() == 0


def test_secrets(docs, empty, spark):
    hexes = "0123456789abcdef" * 2
    key = "Zq9" + "xK4vP2mT8wLrB6nYdH1sJ7gF5cA3eUiOQ"
    cases = [f'Token = "{hexes[:10]}" AKIA{"A" * 16} {hexes}', "token:token:abcdefgh", f"see {key} here", "ſecret: abcdefgh", "a/b/c/d/e/f/g/h/i/long_path/name/of", None, "", "password=123456"]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert got[0].spans == "assign:0:19,access:21:41,hex:42:74" and (got[0].n_assign, got[0].n_access, got[0].n_hex) == (1, 1, 1)
    assert got[1].spans == "" and got[3].spans == "" and got[5].spans == "" and got[7].spans == "assign:0:15" and got[4].spans == ""
    assert got[2].spans == f"entropy:4:{4 + len(key)}" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.scan_secrets(docs).count() == docs.count() and secrets.scan_secrets(empty).count() == 0


def test_secrets_beside_base_spans_and_allowed_parts():
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+") for _ in range(n))
    scanner = secrets.Scanner()
    key = "AKIA" + "Q7ZB" * 4
    access, beside = scanner.spans(f"{key}/{some(40)}")
    assert access == (0, 1, 20) and beside[1:] == (3, 61) and 20 <= beside[0] <= 24
    long = f"{some(300)}/a/b/c/{some(300)}"
    found = scanner.spans(long)
    assert sum(b - a for a, k, b in found if k == 3) > 550 and all(b <= 300 or a >= 300 for a, _, b in found)
    assert scanner.spans("home/user/lib/share/some_name/4-x") == [] and scanner.spans("3f2b8c1d-9a4e-4f6b-8d2c-7e1a5b9c0d3f") == []


def test_incremental_entropy_against_plain():
    import math

    cls = secrets.CLASSES[3]
    rng = random.Random(2)
    for _ in range(30):
        s = "".join(rng.choice("abcDEF0123456789xyzXYZ") for _ in range(60))
        plain = set()
        for k in range(len(s) - cls.width + 1):
            w = s[k : k + cls.width]
            if -sum(c / cls.width * math.log2(c / cls.width) for c in Counter(w).values()) >= cls.limit - 1e-9 and sum(x.isdigit() for x in w) >= cls.digits:
                plain.update(range(k, k + cls.width))
        assert {k for a, b in secrets.hot_spans(s, cls) for k in range(a, b)} == plain


def test_toxicity_held_out(spark, empty):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(800):
        words = [rng.choice(WORDS) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            words[3 : 3 + rng.randint(1, 4)] = rng.sample(["vile", "rotten", "nasty", "awful"], rng.randint(1, 4))
        rows.append((i, " ".join(words), bad))
        marks.append((i, 1, int(bad)))
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (None, "vile")], "doc_id long, text string")
    known = spark.createDataFrame(marks[:400], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.grade_documents(frame, known).collect()}
    assert np.mean([got[i].rejected == bad for i, _, bad in rows[400:]]) > 0.98
    assert not got[900].rejected and toxicity.grade_documents(empty, known).count() == 0
    assert toxicity.grade_documents(frame, known.limit(0)).where("rejected").count() == 0
    model = toxicity.OrdinalModel(np.zeros(4), np.array([0.0, 2.0]))
    above = model.above(np.array([-3.0, 0.0, 3.0]))
    assert (np.diff(above.sum(1)) > 0).all() and (above[:, 0] > above[:, 1]).all()


def brute_simhash(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_brute_force(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.collect()
    fps = [(r.doc_id, brute_simhash(r.text)) for r in rows]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                parent[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((d, f"{f:016x}", ids.get(root(i))) for i, (d, f) in enumerate(fps))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter({d: 1 for i, (d, _) in enumerate(fps) if d is None or ids[root(i)] == d})


def test_simhash_links_with_crowds(spark, monkeypatch):
    from storyloom.llm.common import Scratch
    from storyloom.llm.graph import components

    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    fps |= {f ^ 5 for f in list(fps)[:40]}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash.signed(f), i) for i, f in enumerate(fps)], "fp long, first long")
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and bin(a ^ b).count("1") <= 2:
                parent[root(a)] = root(b)
    want = {}
    for f in fps:
        want.setdefault(root(f), set()).add(simhash.signed(f))
    n, both = simhash.bit_statistics(nodes)
    assert n == len(fps)
    for parts in (simhash.allot(n, both, 2), [simhash.Part(tuple(range(32)), 1), simhash.Part(tuple(range(32, 64)), 0)]):
        assert sum(p.threshold + 1 for p in parts) == 3
        scratch = Scratch(spark, "test")
        labels = components(simhash.links(nodes, parts, 2, scratch), scratch).collect()
        groups = {}
        for r in labels:
            groups.setdefault(r.label, set()).add(r.node)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def shingles_of(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.mark.parametrize("crowd", [32, 1])
def test_near_copies_against_brute_force(spark, docs, empty, monkeypatch, crowd):
    monkeypatch.setattr(nearcopies, "CROWD", crowd)
    rng = random.Random(5)
    words = [f"word{i}" for i in range(5000)]
    base = [[rng.choice(words) for _ in range(rng.randint(150, 500))] for _ in range(40)]
    made = [(i, " ".join(t)) for i, t in enumerate(base)]
    for i, t in enumerate(base):  # near copies by one changed word, copies by case and blanks, and halves, which stay
        for k in range(3):
            near = list(t)
            near[rng.randrange(len(near))] = "changed"
            made.append((100 + 10 * i + k, " ".join(near)))
        made += [(1000 + i, "  ".join(t).upper()), (2000 + i, " ".join(t[: len(t) // 2]))]
    made += [(3000, ""), (3001, None), (3002, " \n"), (3003, "b a"), (3004, "a b"), (3005, "A b"), (None, made[0][1]), (3006, "x " * 3000)]
    frame = spark.createDataFrame(made, "doc_id long, text string").withColumn("component_id", F.lit("clash")).repartition(5)
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(frame.select("doc_id", "text")).collect()}
    want = {1000 + i: i for i in range(40)} | {100 + 10 * i + k: i for i in range(40) for k in range(3)} | {3001: 3000, 3002: 3000, 3005: 3004}
    assert got == want
    kept = nearcopies.one_of_each_group(frame)
    assert kept.columns == frame.columns and Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in made if d not in want)
    assert nearcopies.one_of_each_group(empty).count() == 0
    rows = {}
    for r in docs.collect():
        rows[r.doc_id] = min(rows.get(r.doc_id, (r.text or "")), r.text or "")
    sets = {d: shingles_of(t) for d, t in rows.items() if d is not None}
    exact = {d for d in sets if any(e < d and sets[d] == sets[e] for e in sets)}
    near = {d for d in sets if any(e < d and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]) for e in sets)}
    left = [r.doc_id for r in nearcopies.one_of_each_group(docs).collect()]
    gone = set(sets) - set(left)
    assert len(left) == len(set(left)) and None in left and gone == near | exact


def brute_near_copies(made):
    """component_id by id, of all pairs of shingle sets at 0.8 and more."""
    sets = {i: shingles_of(t) for i, t in made}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets if find(i) != i}


def test_near_copies_in_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "CROWD", 1)
    monkeypatch.setattr(nearcopies, "BLOCK", 3, raising=False)
    rng = random.Random(15)
    base = [rng.choice(WORDS) for _ in range(120)]
    made = []
    for i in range(80):  # a template whose variants drift away from its smallest one
        t = base if i < 2 else made[rng.randrange(max(0, i - 12), i)][1].split()
        near = list(t)
        near[rng.randrange(len(near))] = f"v{i}"
        near[rng.randrange(len(near))] = f"u{i}"
        made.append((i, " ".join(near)))
    want = brute_near_copies(made)
    frame = spark.createDataFrame(made, "doc_id long, text string")
    assert len(want) > 40 and {r.doc_id: r.component_id for r in nearcopies.near_copies(frame).collect()} == want


def test_shingles_are_counted_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SAMPLE", 2, raising=False)
    monkeypatch.setattr(nearcopies, "HELD", 50, raising=False)
    monkeypatch.setattr(nearcopies, "PART", 64, raising=False)
    rows = [(i, t) for i, t in enumerate(texts())]
    hasher = nearcopies.Hasher(5)
    count = Counter(h for _, t in rows for h in np.unique(hasher.shingles(hasher.words(t or ""))).view(np.int64).tolist())
    hashes, counts = nearcopies.often_met(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5)
    assert list(zip(hashes.tolist(), counts.tolist(), strict=True)) == sorted((h, n) for h, n in count.items() if n > 1) != []
    none = nearcopies.often_met(spark.createDataFrame([(1, None)], "doc_id long, text string"), 5)
    assert [len(x) for x in none] == [0, 0]


def test_near_copies_of_equal_fingerprints(spark):
    rng = random.Random(16)
    list_ = rng.sample(WORDS, 60)
    other = rng.sample(list_, 60)
    made = [(0, " ".join(list_)), (1, " ".join([*other, other[30]])), (2, " ".join(other))]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(frame).collect()} == brute_near_copies(made) == {2: 1}


def test_near_copies_of_short_texts(spark):
    rng = random.Random(17)
    made = []
    for i in range(60):
        t = [rng.choice(WORDS) for _ in range(rng.randint(4, 40))]
        made += [(i, " ".join(t)), (100 + i, " ".join([*t, "more"])), (200 + i, " ".join(["so", "much", *t]))]
    want = brute_near_copies(made)
    frame = spark.createDataFrame(made, "doc_id long, text string")
    assert len(want) > 60 and {r.doc_id: r.component_id for r in nearcopies.near_copies(frame).collect()} == want


def test_components_of_a_long_path(spark):
    from storyloom.llm.common import Scratch
    from storyloom.llm.graph import components

    order = list(range(60))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:]), (100, 101)], "a long, b long")
    assert {(r.node, r.label) for r in components(edges, Scratch(spark, "test")).collect()} == {*((i, 0) for i in order), (100, 100), (101, 100)}


def test_quality_counts_and_bounds(docs, empty, labels):
    text = "a b c a b c # $\nx\nx\n \n \ny"
    words = text.split()
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    assert quality.measure(text)[:5] == (len(words), sum(map(len, words)), 2, 1, len(marked))
    assert quality.measure("") == (0,) * 6
    bound = quality.upper_bound(0, 100, 0.05)
    assert abs((1 - bound) ** 100 - 0.05) < 1e-9 and quality.upper_bound(5, 5, 0.1) == 1.0
    got = quality.apply_rules(docs, labels).collect()
    assert len(got) == docs.count() and all(r.kept == (not r.base_failed) for r in got)
    assert quality.apply_rules(empty, labels).count() == 0
    rule = quality.RULES[0]
    found = [("en", r, 0, 1, 9000) for r in range(5)] + [("en", r, 0, 0, 500) for r in range(5)] + [("en", 0, len(rule.grid), 0, 400), ("de", 0, len(rule.grid), 1, 50)]
    cuts = quality.choose_cutoffs(found, 0.02, 0.05)
    assert cuts["en"][0] == len(rule.grid) and set(cuts["en"][1:]) == {len(rule.grid) + 1} and "de" not in cuts


def test_lm_against_plain_counts(docs, empty):
    import math

    got = lm.score(docs).collect()
    rows = docs.collect()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    toks = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for r in rows if not out(r.doc_id) for w in toks(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((r.doc_id or -1, out(r.doc_id), len(toks(r.text)), sum(c[w] > 0 for w in toks(r.text)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(r.text)), 6)) for r in rows)
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert np.mean([r.bits_per_byte for r in held]) < 5 and all(r.score < 0 for r in got)
    assert lm.score(empty).count() == 0


def some_words(seed, n=400):
    rng = random.Random(seed)
    made = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))).encode() for _ in range(n)} | {b"", b"x" * 70}
    return sorted(made), [rng.choice([0, 1, 1, 3, 40]) for _ in made]


def test_lm_chances_of_next_bytes_sum_to_one():
    tokens, counts = some_words(1)
    words = lm.Words(tokens, counts, 3)
    table = np.zeros((lm.TABLES, 2 * lm.SLOTS), np.int64)
    words.add_counts(table)
    mixer = lm.Mixer(table.astype(np.uint32), learns=True)
    mixer.learn(words)
    mixer = lm.Mixer(table.astype(np.uint32), mixer.weights, mixer.came)
    for start in (b"ab", b"abca"):
        every = [start + bytes([k]) for k in range(256)]
        known = dict(zip(tokens, counts, strict=True))
        probe = sorted(set(every) | set(tokens))
        several = lm.Words(probe, [known.get(t, 0) for t in probe], 3)
        chance, at = np.ones(len(probe)), np.flatnonzero([several_text[: len(start)] == start for several_text in [lm.coded(probe[k]) for k in several.order]])
        for some, grams, bit, zeros, ones in several.places(mixer.starts):
            here = np.isin(some, at)
            if len(some) and here.any() and (several.size[some] > len(start)).all() and np.array_equal(several.data[several.first[some] + len(start)], (grams & np.uint64(255)).astype(np.uint8)):
                _, gate, mix = mixer.inputs(grams, bit, zeros, ones, None)
                p = mixer.refined(mix, gate)
                p = np.where(lm.bits_of(grams, bit) == 1, p, 1 - p)
                chance[some] = p if bit == 7 else chance[some] * p
        best = {}
        for k in at:
            best[several.data[several.first[k] + len(start)]] = chance[k]
        assert abs(sum(best.values()) - 1) < 1e-6 and len(best) == 256


def test_lm_counts_of_starts_against_plain():
    tokens, counts = some_words(2)
    words = lm.Words(tokens, counts, 3)
    texts_ = [lm.coded(t) for t in tokens]
    held = [(lm.coded(tokens[k]), counts[k]) for k in words.order]
    depth, seen = -1, None
    for some, grams, bit, zeros, ones in words.places(np.zeros((lm.SLOTS, 2), np.int64)):
        depth += bit == 7
        if depth < 3 or depth >= lm.DEPTH:
            continue
        for k, z, o in list(zip(some, zeros, ones, strict=True))[:: max(1, len(some) // 7)]:
            text = held[k][0]
            same = [(t, c) for t, c in held if len(t) > depth and t[:depth] == text[:depth] and t[depth] >> (bit + 1) == text[depth] >> (bit + 1)]
            want = [sum(c for t, c in same if t[depth] >> bit & 1 == b) for b in (0, 1)]
            assert [z, o] == want
            seen = True
    assert seen and len(texts_) == len(held)


def test_lm_contexts_reach_over_the_starts_of_words():
    words = "b abc é a 日本 x abc".encode().split()
    stream = b"\0\0 " + b" ".join(words) + b" \n"
    want = Counter(int.from_bytes(stream[k - 3 : k + 1], "big") for k in range(3, len(stream)))
    got = Counter()
    known = Counter([*words, lm.END])
    heads = lm.Heads(*np.unique(lm.heads_of([words])[0], return_counts=True))
    for some in (heads, lm.Words(list(known), list(known.values()), 3, lm.HEAD)):
        for at, grams, bit, _, _ in some.places(np.zeros((lm.SLOTS, 2), np.int64)):
            for k, g in zip(at, grams, strict=True):
                got[int(g)] += int(some.n[k]) * (bit == 7)
    assert got == want
    heads, sizes = lm.heads_of([[], words, [b"a"]])
    assert sizes.tolist() == [1, 8, 2] and heads[0] == 10 << 8 and heads[-1] == int.from_bytes(b" a\n\0", "big")


def test_lm_scores_follow_the_order_of_words(spark, monkeypatch):
    rng = random.Random(8)
    pairs = [("xa", "ab"), ("xc", "cd"), ("xe", "ef"), ("xg", "gh")]
    rows = [(i, " ".join(w for _ in range(40) for w in rng.choice(pairs))) for i in range(60)]
    held = [i for i in range(60, 200) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows += [(held[0], "xa ab xc cd xe ef xg gh"), (held[1], "xa cd xc ab xe gh xg ef")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(frame).collect()}
    assert got[held[0]] > got[held[1]] + 1
    monkeypatch.setattr(lm, "HEADS", 0)  # all heads are evaluated where they are met
    assert all(abs(r.score - got[r.doc_id]) < 1e-9 for r in lm.score(frame).collect())


def test_lm_scores_do_not_depend_on_partitions(spark, docs, monkeypatch):
    """One and sixteen partitions, of one and of several learners: the same scores."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for learner in (1 << 16, 40):
            monkeypatch.setattr(lm, "LEARNER", learner)
            told = []
            for n in (1, 16):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                told.append(sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score) for r in lm.score(docs.repartition(n)).collect()))
            assert len(told[0]) == docs.count() and [x[:2] for x in told[0]] == [x[:2] for x in told[1]]
            assert max(abs(a[2] - b[2]) for a, b in zip(*told, strict=True)) < 1e-9
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def brute_lines(rows, least=20):
    """Unit numbers by (id, text): all units of runs that occur earlier and have that many words, a unit counting as one at least."""

    def units(t):
        ends = [m.end() for m in re.finditer(r"\n(?!\n)|[.!?] (?!\n)", t)]
        return [t[a:b] for a, b in zip([0, *ends], [*ends, len(t)])]

    docs_ = sorted((-1 if i is None else i, t or "") for i, t in rows)
    plain = [[u.strip(" \n\r\t") for u in units(t)] for _, t in docs_]
    firsts, out = {}, {}
    for d, us in enumerate(plain):
        for a in range(len(us)):
            for b in range(a + 1, len(us) + 1):
                firsts.setdefault(tuple(us[a:b]), (d, a))
    for d, us in enumerate(plain):
        size = [max(1, len(u.split())) for u in us]
        out[docs_[d]] = sorted({k for a in range(len(us)) for b in range(a + 1, len(us) + 1) if sum(size[a:b]) >= least and firsts[tuple(us[a:b])] < (d, a) for k in range(a, b)})
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_line_dedup_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.choice([1, 2, 4, 7, 9, 12, 25]))) + rng.choice([". ", "\n", "! ", "\n\n"]) for _ in range(40)]
    rows = []
    for i in range(90):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        if i > 10 and rng.random() < 0.6:
            o = rows[rng.randrange(i)][1]
            a = rng.randrange(len(o) + 1)
            t += o[a : a + 300] + "".join(rng.choice(pool) for _ in range(3))
        rows.append((i, t))
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = brute_lines(rows)
    assert any(want.values()) and all(got[i].dropped == w for (i, _), w in want.items())


def test_line_dedup_of_a_copy_whose_parts_occurred_before(spark):
    unit = [f"u{k} v{k} w{k} x{k} y{k} z{k}.\n" for k in range(60)]
    rows = [(1, unit[20] + unit[21]), (2, unit[30] + unit[31] + "q.\n" + unit[29]), (3, unit[25]), (100, "".join(unit)), (101, "".join(unit))]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[101].text == "" and got[100].dropped == []


def test_line_dedup(spark, docs, empty):
    run = "One two three four five six seven. Eight nine ten eleven twelve thirteen. Fourteen fifteen sixteen seventeen.\n Eighteen nineteen twenty twentyone twentytwo."
    long = " ".join(f"q{i}" for i in range(60)) + "\n"
    rows = [(2, "Start here. " + run + " End."), (1, "First. " + run), (3, "x\n" + long + "y"), (4, "z\n" + long), (5, "Short one. Short one."), (6, None), (7, run + " Mid. " + run)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].dropped == [] and got[3].dropped == [] and got[5].dropped == [] and got[6].text == ""
    assert got[2].text.replace("\n", "").strip() in ("Start here. End.", "Start here.  End.") and got[4].text == "z\n"
    assert "Mid." in got[7].text and "nineteen" not in got[7].text
    for df in (docs, empty):
        out = lines.dedup_lines(df).collect()
        assert len(out) == df.count() and all(r.dropped or r.n_units for r in out)
    assert sum(not r.text for r in lines.dedup_lines(spark.createDataFrame([(i, run) for i in range(50)], "doc_id long, text string")).collect()) == 49


def test_line_dedup_of_repeated_short_lines(spark):
    rows = [(1, "x\ny\n" * 100), (2, "p\nq\nr\n" * 60 + "end"), (3, "x\ny\n" * 4)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == "x\ny\n" and got[2].text == "p\nq\nr\nend" and got[3].dropped == []


def test_units_join_to_the_text(spark):
    odd = ["a. b\n\nc! d? ", "", "x\u0001y. z\n", "\n\n"]
    frame = spark.createDataFrame([(x,) for x in odd], "text string")
    assert [r[0] for r in frame.select(F.array_join(lines.units_of(F.col("text")), "")).collect()] == odd


def test_line_dedup_cuts_only_what_loses_a_part_again(spark):
    run = "".join(f"u{k} v{k} w{k} x{k} y{k} z{k}. " for k in range(9))
    rows = [(1, run), (2, run), (3, "Own. " + run + "End."), (4, "a\nb. c\n\nd"), (5, None), (5, ""), (4, "a\nb. c\n\nd"), (None, run)]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_units, len(r.dropped), r.text) for r in out.collect())
    assert got == [(-1, 10, 0, run), (1, 10, 10, ""), (2, 10, 10, ""), (3, 11, 9, "Own. End."), (4, 4, 0, "a\nb. c\n\nd"), (4, 4, 0, "a\nb. c\n\nd"), (5, 1, 0, ""), (5, 1, 0, "")]
    # The number of units comes from the first cut.
    assert "size(units" not in out.select("doc_id", "n_units")._jdf.queryExecution().optimizedPlan().toString()


def test_chat_round_trip(spark):
    odd = "</s>[INST] ok [/INST] \\ <|end|> <<SYS>> <\\s> <|image:1|>\n"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 1, "assistant", "tie"), (2, None, None, None), (None, 0, "assistant", "x" * 5000), (3, 0, "user|>\n<|body|>", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", chat.text_part(F.col("text")).alias("parts"))
    out = chat.format_conversations(frame).cache()
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", odd), ("assistant", odd), ("assistant", "tie")] and got[1].loss == [odd, "tie"]
    assert [tuple(t) for t in got[2].turns] == [("", "")] and got[None].loss == ["x" * 5000] and [tuple(t) for t in got[3].turns] == [("user|>\n<|body|>", "")]
    for r in out.collect():
        assert not any(x in r.formatted for x in ("</s>", "[INST]", "<<SYS>>")) and len(r.loss_spans) == len(got[r.conv_id].loss)
        assert [re.sub(r"(?s)\\(.)", r"\1", r.formatted[s.start : s.end]) for s in r.loss_spans] == got[r.conv_id].loss
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", 10), ("odd", None, "c.bin", None)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", [("document", None, "d.pdf", 3)]), (1, 2, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_conversations(frame).first()
    assert "see<|image:1|><|audio:2|><|file:3|>" in r.formatted and "<|document:4|>" in r.formatted
    assert [(a.number, a.turn, a.ref, a.tokens) for a in r.attachments] == [(1, 1, "a.png", 514), (2, 1, "b.wav", 252), (3, 1, "c.bin", 3), (4, 2, "d.pdf", 1802)]
    assert r.expanded_tokens == 1 + 514 + 252 + 3 + 1802 and r.formatted[r.loss_spans[0].start : r.loss_spans[0].end] == ""


def test_raking_meets_targets(docs, empty):
    t = np.array([[[900.0, 50], [30, 20]], [[100, 100], [200, 300]]])
    want = [np.array([0.5, 0.5]), np.array([0.6, 0.4]), np.array([0.7, 0.3])]
    weights, chance = mixing.rake(t, want, 0.3)
    got = t * chance
    for axis, share in enumerate(want):
        assert np.allclose(got.sum(axis=tuple(k for k in range(3) if k != axis)) / got.sum(), share, atol=1e-4)
    assert got.sum() / t.sum() <= 0.3 + 1e-9 and (abs(got.sum() / t.sum() - 0.3) < 1e-9 or abs(chance.max() - 1) < 1e-9) and chance.max() <= 1 and weights.shape == t.shape
    assert abs((t * weights).sum() - t.sum()) < 1e-6
    rows = mixing.mixed(docs)
    assert rows.agg(F.max("residual")).first()[0] < 1e-2  # few sparse cells
    assert rows.count() == docs.count() and rows.where("kept IS NULL").count() == 0
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and mixing.sample(empty).count() == 0


def test_raking_of_many_categories(spark):
    rows = [(40 * i + j, "w " * (1 + (i * j) % 7 + 20 * (i == j)), f"l{j:02d}", f"s{i:03d}") for i in range(300) for j in range(36)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    wanted = {"source": {f"s{i:03d}": float(1 + i % 3) for i in range(300)}, "lang": {f"l{i:02d}": float(1 + i % 2) for i in range(36)}}
    for targets in (wanted, None):
        cells = mixing.mixed(frame, targets, budget=0.05).groupBy("source", "lang").agg(F.sum("n_tokens").alias("have"), F.sum(F.col("n_tokens") * F.col("chance")).alias("n")).collect()
        for axis in ("source", "lang"):
            have, n = Counter(), Counter()
            for r in cells:
                have[r[axis]] += r["have"]
                n[r[axis]] += r["n"]
            share = {x: targets[axis][x] if targets else have[x] ** mixing.TEMPER for x in have}
            assert all(abs(n[x] / sum(n.values()) * sum(share.values()) / share[x] - 1) < 1e-3 for x in have)


def test_tempered_targets_keep_the_budget():
    rng = np.random.default_rng(3)
    tokens = rng.pareto(0.7, 60) * 100 + 1
    places = [np.arange(60) % 5, np.arange(60) // 15]
    wanted = mixing.tempered_targets(tokens, places, [None, None], [5, 4], 0.5, 0.6)
    weights, chance = mixing.rake_cells(tokens, places, wanted, 0.6)
    assert abs((tokens * chance).sum() / tokens.sum() - 0.6) < 1e-6 and chance.max() <= 1 and max(mixing.residuals(tokens * chance, places, wanted)) < 1e-6
    own = [np.bincount(p, tokens) / tokens.sum() for p in places]
    assert all(np.abs(w - o).max() > 1e-4 for w, o in zip(wanted, own, strict=True))


def test_mixing_reaches_given_targets(spark):
    rng = random.Random(12)
    rows = [(i, "w " * rng.randint(5, 60), rng.choice(["en", "en", "de"]), rng.choice(["a", "a", "b"])) for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("weight", F.lit("clash"))
    wanted = {"source": {"a": 0.4, "b": 0.6}, "lang": {"en": 0.5, "de": 0.5}}
    got = mixing.mixed(frame, wanted, budget=0.5)
    assert got.agg(F.max("residual")).first()[0] < 1e-8
    kept = got.where("kept").groupBy("source", "lang").agg(F.sum("n_tokens").alias("n")).collect()
    total = sum(r.n for r in kept)
    for name, shares in wanted.items():
        for x, share in shares.items():
            assert abs(sum(r.n for r in kept if r[name] == x) / total - share) < 0.04
    assert frame.columns == mixing.sample(frame).columns


def test_secrets_recall_of_random_keys():
    rng = random.Random(21)
    kinds = {"0123456789ABCDEF": 40, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567": 40, "abcdefghijklmnopqrstuvwxyz0123456789": 40, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/": 44}
    scanner = secrets.Scanner()
    for chars, n in kinds.items():
        keys = ["".join(rng.choice(chars) for _ in range(n)) for _ in range(200)]
        hits = sum(any(k == 3 for _, k, _ in scanner.spans(f"see {key} here")) for key in keys)
        assert hits >= 190, (chars, hits)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 14))) for _ in range(5000)) + " 4736962573099581 2024-01-02T03:04:05 /usr/local/lib/python3.11/site-packages/some_package_name"
    assert scanner.spans(prose) == []


def test_toxicity_severity_follows_held_out_evidence(spark):
    rng = random.Random(6)
    bad = ["vile", "rotten", "nasty", "awful", "hateful"]
    rows, level = [], {}
    for i in range(1500):
        words = [rng.choice(WORDS) for _ in range(40)]
        n = rng.choice([0, 0, 0, 1, 4])
        words[: len(words[:n])] = rng.sample(bad, n)
        rng.shuffle(words)
        level[i] = n
        rows.append((i, " ".join(words)))
    known = spark.createDataFrame([(i, 1, int(level[i] > 0)) for i in range(800)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.severity for r in toxicity.grade_documents(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    mean = {n: np.mean([got[i] for i in range(800, 1500) if level[i] == n]) for n in (0, 1, 4)}
    assert mean[0] < mean[1] < mean[4] and mean[4] > 1


def test_quality_cutoffs_reject_in_one_stratum(spark):
    rng = random.Random(8)
    plain = lambda: " ".join(rng.choice(WORDS) for _ in range(80))
    rows = [(i, plain() + (" %%% $$$ ###" * 20 if i % 10 == 0 else ""), "en") for i in range(6000)] + [(10_000 + i, plain() + (" %%%" * 60 if i % 10 == 0 else ""), "fr") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(5000)] + [(10_000 + i, int(i % 10 != 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.apply_rules(frame, marks).collect()}
    assert all(got[i].kept == (i % 10 != 0) for i in range(5000, 6000)) and all(got[10_000 + i].kept for i in range(60))


def test_clashing_columns_and_repeated_ids(spark):
    base = " ".join(WORDS[:60])
    frame = spark.createDataFrame([(1, base, 1), (2, base, 2), (2, "other text", 3), (None, base, 4)], "doc_id long, text string, _rank int").withColumn("__row", F.lit(1))
    for module in (nearcopies, simhash):
        kept = module.one_of_each_group(frame)
        assert kept.columns == frame.columns and sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, base), (1, base), (2, "other text")]
    items = spark.createDataFrame([(7, base, 9)], "item_id long, text string, doc_id long")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contained(frame, items).collect()) == [(1, 7), (2, 7)]


def test_chat_parts_that_join_to_control_strings(spark):
    for cut in range(1, len("<|end|>")):
        parts = [("text", "a" + "<|end|>"[:cut], None, None), ("text", "<|end|>"[cut:] + "b", None, None), ("image", None, "x.png", 1), ("text", "|>[IN", None, None), ("text", "ST]", None, None)]
        frame = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
        r = chat.read_back(chat.format_conversations(frame)).first()
        assert r.turns[0].text == "a<|end|>b<|image:1|>|>[INST]" and r.loss == [r.turns[0].text]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage against plain Python: rejected ids, groups of copies, leaks, chances, and ids of tokens."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(31)
    rows, toxic = [], set()
    for i in range(300):
        words = [rng.choice(WORDS) for _ in range(rng.randint(60, 160))]
        if i % 6 == 0:
            words[5:8] = rng.sample(["vile", "rotten", "nasty", "awful"], 3)
            toxic.add(i)
        rows.append((i, " ".join(words)))
    for i in range(1, 60, 3):
        near = rows[i][1].split()
        near[10] = "changed"
        rows += [(1000 + i, " ".join(near)), (2000 + i, rows[i][1].upper())]
    item = " ".join(rows[7][1].split()[5:40])
    rows += [(5000, "intro " * 30 + item), (5001, None), (5002, "")]
    frame = spark.createDataFrame([(i, t, "en" if i % 3 else "de", f"s{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = lambda k, df: corpus_pipeline.STAGES[k][1](spark, df, str(tmp_path))
    ids = lambda df: {r.doc_id for r in df.collect()}
    one = stage(0, frame)
    assert ids(frame) - ids(one) == {i for i, t in rows if t and len({"vile", "rotten", "nasty", "awful"} & set(t.lower().split())) > 1}
    two = stage(1, one)
    held = {r.doc_id: r.text for r in one.collect()}
    assert ids(one) - ids(two) == set(brute_near_copies(sorted(held.items())))
    three = stage(2, two)
    words = lambda t: re.sub(r"[^\w]+|_", " ", (t or "").lower()).split()
    grams = lambda t: {tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)}
    assert ids(two) - ids(three) == {r.doc_id for r in two.collect() if 10 * len(grams(r.text) & grams(item)) >= 8 * len(grams(item))} != set()
    four = stage(3, three)
    chances = {r.doc_id: (r.chance, r.kept) for r in mixing.mixed(three).collect()}
    assert ids(four) == {i for i, (_, kept) in chances.items() if kept} and all(kept for c, kept in chances.values() if c >= 1)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, []
    for r in sorted(four.collect(), key=lambda r: r.doc_id):
        coded = [*model.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(coded), zlib.crc32(np.array(coded, "<u4").tobytes())))
        at += len(coded)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_pipeline_on_empty_tables_and_long_texts(spark, tmp_path):
    import corpus_pipeline

    long = spark.createDataFrame([(1, "x" * 3_000_000, "en", "s", 1), (2, "line " * 300_000, "en", "s", 1), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, docs_ in {"empty": long.limit(0), "long": long}.items():
        at = tmp_path / name
        docs_.write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
        left = [r.doc_id for r in corpus_pipeline.run(spark, str(at)).collect()]
        assert len(left) == len(set(left)) and set(left) <= ({1, 2, 3} if name == "long" else set())


def test_shingles_are_dealt_in_little_memory():
    """Counts by ranges of hashes; at its peak it holds less than five times what it is given."""
    import tracemalloc
    from collections import Counter

    from storyloom.llm import nearcopies

    rng = np.random.default_rng(8)
    for parts, size in ((1, 10), (7, 5000), (1000, 3000)):
        h = rng.integers(0, 2**64, size, np.uint64, endpoint=False)
        h = np.concatenate([h, h[: size // 3], h[: size // 9], np.array([0, 2**64 - 1], np.uint64)])
        want, got = Counter(h.tolist()), {}
        for r in nearcopies.dealt(h, parts).to_pylist():
            own = {x: 1 for x in np.frombuffer(r["once"], np.uint64).tolist()} | dict(zip(np.frombuffer(r["h"], np.uint64).tolist(), np.frombuffer(r["n"], np.int64).tolist(), strict=True))
            assert own and all((x >> 32) * parts >> 32 == r["part"] for x in own) and not own.keys() & got.keys()
            got |= own
        assert got == want
    h = rng.integers(0, 2**64, 1 << 20, np.uint64, endpoint=False)
    tracemalloc.start()
    nearcopies.dealt(h, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * h.nbytes


def test_near_copies_and_toxicity_ship_small_batches(spark, docs, labels, monkeypatch):
    """What a task holds of texts does not grow with Spark's bounds of 10,000 rows and 64 MB; these stand again afterwards."""
    import pyarrow as pa

    from storyloom.llm import common

    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    bounds = lambda: tuple(spark.conf.get(n) for n in names)
    before, seen, write = bounds(), {}, common.Scratch.write
    monkeypatch.setattr(common.Scratch, "write", lambda self, name, df: (seen.update({name: bounds()}), write(self, name, df))[1])
    nearcopies.one_of_each_group(docs)
    toxicity.drop_toxic(docs, labels)
    sets = [n for n in seen if n.startswith("sets-")]
    assert sets
    for name in ("sketches", "graded", *sets):
        assert int(seen[name][0]) <= 1_000 and int(seen[name][1].rstrip("B")) <= 4 << 20
    assert bounds() == before
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]}) for b in batches)
    long = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    with common.small_batches(spark):
        told = long.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in told) == 3000 and max(r["bytes"] for r in told) < 6 << 20
    assert bounds() == before
