"""Groups of near copies against a comparison of all pairs."""

import random
from collections import Counter

import data
import numpy as np
import pyarrow as pa
import pytest
import test_llm_operators as plain

import corpus_pipeline
from lexloom.llm import near, simhash


def shingles(text):
    w = plain.WORD.findall((text or "").translate(plain.LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(sets):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if root[i] != root[j] and 5 * common >= 4 * either:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def test_near_copies_of_edited_words(spark):
    rng = random.Random(4)
    rows = data.rows()
    for k in range(60):  # copies with 1 to 9 words changed in 200, some of them copies of a copy
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for step in range(4):
            rows.append((10_000 + 10 * k + step, " ".join(words), *rows[0][2:]))
            for at in rng.sample(range(200), 1 + k % 9):
                words[at] = f"new{rng.randrange(5000)}"
    rows += [(20_000 + k, t, *rows[0][2:]) for k, t in enumerate(["a b c d", "A b  c d", "a b c e", "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m x"])]
    root = groups([shingles(r[1]) for r in rows])
    ids = lambda g: [r[0] for r, x in zip(rows, root) if x == g and r[0] is not None]
    want = Counter(min(ids(g)) if ids(g) else None for g in set(root))
    after = corpus_pipeline.dedup_near(spark, data.frame(spark, rows), "").collect()
    assert Counter(r.doc_id for r in after) == want
    assert {tuple(r) for r in after} <= set(rows)
    assert corpus_pipeline.dedup_near(spark, data.frame(spark, []), "").count() == 0


def test_large_sets_are_taken_apart(spark):
    """Copies of one base, chains, and texts that share bands without being copies: any bound gives the same groups as all pairs."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(150)]

    def changed(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = rng.choice(vocabulary)
        return words

    texts = [base] + [changed(base, n % 5) for n in range(10)]  # near the base, not always near each other
    chain = [base]
    for n in range(8):
        chain.append(changed(chain[-1], 1 + n % 4))
    texts += chain + [changed(base, 12) for _ in range(6)]
    rng.shuffle(texts)
    other = data.rows()[0][2:]
    rows = [(k, " ".join(t), *other) for k, t in enumerate(texts)]
    rows += [rows[3], (None, *rows[5][1:]), (500, None, *other), (501, "", *other)]
    root = groups([shingles(r[1]) for r in rows])
    want = Counter(min(r[0] for r, x in zip(rows, root) if x == g and r[0] is not None) for g in set(root))
    assert 4 < len(want) < 20  # some texts share bands and are no copies
    for bounds in ((4, 2, 8), (1, 0, 5)):
        assert Counter(r.doc_id for r in near.keep_one(data.frame(spark, rows), *bounds).collect()) == want, bounds


def connected(fps, bits):
    root = {f: f for f in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {f: new if r == old else r for f, r in root.items()}
    return root


def edited():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(300)) for _ in range(20)]
    for t in texts[:20]:
        for n in (1, 1, 2):
            words = t.split()
            for at in rng.sample(range(300), n):
                words[at] = f"new{rng.randrange(3000)}"
            texts.append(" ".join(words))
    return texts + ["", "one", "One", "two words", " ".join(["a b c d e f"] * 30)]


def test_fingerprints_by_definition():
    """A bit is set if over half of the distinct five-word shingles' hashes have it."""
    texts = edited()
    _, h, edges = near.shingles(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
    want = []
    for a, b in zip(edges[:-1], edges[1:]):
        own = {int(x) for x in h[a:b]}
        want.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in own) > len(own)))
    assert [int(x) for x in near.fingerprints(h, edges)] == want
    assert len({len({int(x) for x in h[a:b]}) for a, b in zip(edges[:-1], edges[1:])} & {0, 1, 6}) == 3


def test_simhash_gives_candidates(spark):
    """SimHash bands connect two texts exactly if steps of BITS bits connect their fingerprints."""
    texts = edited()
    key, h, edges = near.shingles(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
    fps = near.fingerprints(h, edges)
    rows = sorted({(int(k), int(f)) for k, f in zip(key.view(np.int64), fps.view(np.int64))})
    bands, band = {}, {k: k for k, _ in rows if k}
    for r in near.by_simhash(spark.createDataFrame(rows, "key long, fp long")).collect():
        bands.setdefault(r.band, []).append(r.key)
    for keys in bands.values():
        low = min(band[k] for k in keys)
        band = {k: low if r in {band[k] for k in keys} else r for k, r in band.items()}
    root = connected(sorted({f % 2**64 for k, f in rows if k}), near.BITS)
    assert {k for keys in bands.values() for k in keys} == set(band)
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[:i] if a[0] and b[0]]
    linked = sum(root[a[1] % 2**64] == root[b[1] % 2**64] for a, b in pairs)
    assert all((band[a[0]] == band[b[0]]) == (root[a[1] % 2**64] == root[b[1] % 2**64]) for a, b in pairs) and linked > 20


def test_simhash_bands_reach_the_stage(spark, monkeypatch):
    """Without any band of minimum hashes, the stage still finds what SimHash links, verified on whole texts."""
    texts = edited()
    rows = [(k, t, *data.rows()[0][2:]) for k, t in enumerate(texts)]
    monkeypatch.setattr(near.F, "explode", lambda c, explode=near.F.explode: explode(near.F.array(near.F.xxhash64("key"))) if isinstance(c, str) else explode(c))
    sets = [shingles(t) for t in texts]
    _, h, edges = near.shingles(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
    fps = [int(x) for x in near.fingerprints(h, edges)]
    root = connected(sorted(set(fps)), near.BITS)
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and (sets[i] == sets[j] or sets[i] and sets[j] and root[fps[i]] == root[fps[j]] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert len(set(group)) < len(set(map(tuple, map(sorted, sets)))) - 10
    assert sorted(r.doc_id for r in near.keep_one(data.frame(spark, rows)).collect()) == sorted(set(group))


@pytest.mark.parametrize("held", [1 << 22, 1000])
def test_large_groups_at_four_bits(monkeypatch, held):
    monkeypatch.setattr(simhash, "NEIGHBOURS", held)
    rng = np.random.default_rng(8)
    free = (1 << 20) - 1
    fps = np.unique(rng.integers(0, 1 << 20, 120).astype(np.uint64))
    links = [(int(fps[i]), int(fps[j])) for i, j in simhash._spanning(fps, free, 4)]
    assert all((a ^ b).bit_count() <= 4 for a, b in links) and links
    root = {int(f): int(f) for f in fps}
    for a, b in links:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {f: new if r == old else r for f, r in root.items()}
    assert root == connected([int(f) for f in fps], 4) and 1 < len(set(root.values()))
