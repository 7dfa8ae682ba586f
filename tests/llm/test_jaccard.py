import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import jaccard
from tidemark.llm.common import WordHash
from tidemark.llm.components import components

CAPITALS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_hand(rows):
    """(set size, smallest linked doc_id) of every document, by counting common shingles."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(CAPITALS))
        sets[i] = set(zip(*(words[k:] for k in range(5)), strict=False)) if len(words) >= 5 else ({tuple(words)} if words else set())
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for ids in holders.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, groups=20, copies=6, hot=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    passage = rng.choices(vocabulary, k=30)
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 6, 20, 60, 200, 330, 1500]))
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += passage
            rows.append(" ".join(words))
    # a large group of near copies, one of exact copies, and texts that are mostly one passage
    base = rng.choices(vocabulary, k=80)
    for _ in range(hot):
        words = list(base)
        words[rng.randrange(80)] = rng.choice(vocabulary)
        words[rng.randrange(80)] = rng.choice(vocabulary)
        rows.append(" ".join(words))
        rows.append("the same text every time it is found here again")
        rows.append(" ".join(passage + rng.choices(vocabulary, k=rng.randint(3, 25))))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_brute_force(spark, docs, seed, monkeypatch):
    if seed:  # frequent hashes, salted tiles and several rounds at a small size
        monkeypatch.setattr(jaccard, "FREQUENT", 5)
        monkeypatch.setattr(jaccard, "HOT", 9)
        monkeypatch.setattr(jaccard, "SALTS", 3)
        monkeypatch.setattr(jaccard, "CLOSEST", 1)
        monkeypatch.setattr(jaccard, "GROWTH", 64)
        monkeypatch.setattr(jaccard, "CHUNK", 7)
        monkeypatch.setattr(jaccard, "BLOCK", 3)
    rows = corpus(seed)
    members, links = jaccard.link(docs(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()}
    assert got == by_hand(rows)
    sets = {i: set(re.findall(r"\S+", t)) for i, t in rows}
    assert all(sets[r.a] & sets[r.b] for r in links.collect())


def test_doc_ids_of_several_texts_keep_their_links(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 5)
    monkeypatch.setattr(jaccard, "SALTS", 3)
    monkeypatch.setattr(jaccard, "CLOSEST", 1)
    rows, rng = corpus(1), random.Random(9)
    unlike = [(i, " ".join(f"v{rng.randrange(10**9)}" for _ in range(400))) for i, _ in rows]  # 396 shingles
    members, _ = jaccard.link(docs([x for pair in zip(unlike, rows, strict=True) for x in pair]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect() if r.n_shingles != 396}
    assert got == by_hand(rows)


def test_awkward_rows(awkward):
    members, _ = jaccard.link(awkward)
    rows = members.collect()
    assert len(rows) == awkward.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == (1, 4) and got[5] == (1, 4)
    assert got[8] == (1, 8)


def test_empty_table(docs):
    members, links = jaccard.link(docs([]))
    assert members.collect() == [] and links.collect() == []


def test_threshold_is_inclusive(docs):
    base = [f"a{i}" for i in range(16)]  # 12 shingles
    exact = base[:13]  # 9 of them: 9 / 12
    below = base[:12]  # 8 of them: 8 / 12
    members, _ = jaccard.link(docs([(1, " ".join(base)), (2, " ".join(exact)), (3, " ".join(b.upper() for b in below))]))
    got = {r.doc_id: r.component_id for r in members.collect()}
    assert got == {1: 1, 2: 1, 3: 1}  # 3 links with 2: 8 / 9
    members, _ = jaccard.link(docs([(1, " ".join(base)), (3, " ".join(below))]))
    assert {r.doc_id: r.component_id for r in members.collect()} == {1: 1, 3: 3}


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, len(a) // 2), rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64)]))
        u, v = (np.frombuffer(jaccard.bitmap(x), dtype="<u8") for x in (a, b))
        least = min(len(u), len(v))
        apart = int(np.bitwise_count(jaccard.folded(u, least) ^ jaccard.folded(v, least)).sum())
        assert apart <= len(np.setxor1d(a, b))
        if jaccard.similar(a, b, 75, 100):
            assert jaccard._possible(len(a), len(b), apart, 75, 100)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 40, rng.integers(1, 80)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.12], rng.integers(0, 1 << 40, 3).astype(np.uint64)]))
        if jaccard.similar(a, b, 75, 100):
            frequent = np.sort(rng.choice(a, len(a) // 3, replace=False))
            order = jaccard.Order(frequent, rng.random(len(frequent)) < 0.5)
            p, q = (jaccard.prefix(x, order, 75, 100)[0] for x in (a, b))
            assert np.intersect1d(p, q).size


def test_components_of_long_chains(spark):
    rows = [(i, i + 1) for i in range(1, 200)] + [(500, 400), (400, 450), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {400: 400, 450: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shingles_follow_the_definition():
    h = WordHash()
    assert len(jaccard.shingles(None, h)) == len(jaccard.shingles(b" \n", h)) == 0
    assert jaccard.shingles("ÄB c".encode(), h).tolist() != jaccard.shingles("äb c".encode(), h).tolist()
    assert jaccard.shingles(b"AB c", h).tolist() == jaccard.shingles(b"ab\x0bC", h).tolist()
    assert jaccard.shingles(b"a b c d", h).tolist() != jaccard.shingles(b"a b c d d", h).tolist()
    assert len(jaccard.shingles(b"a b a b a b a b a b", h)) == 2
