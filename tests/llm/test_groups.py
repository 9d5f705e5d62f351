"""Clusters of vectors, spelling variants and SimHash components against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from eventloom.llm import clustering, common, queries, simhash_join, spelling
from eventloom.llm.clustering import centroid_clusters, coefficients, components, nearest
from eventloom.llm.simhash_join import Tree, fingerprint, linked_within, near_links, simhash_duplicates
from eventloom.llm.spelling import near_words, spelling_variants

VECTORS = "vec_id long, embedding array<float>, cluster string, id string, w string, distance string"


# centroid clustering


def lloyd(rows, k=8, rounds=10, salt="3"):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    mark = lambda r: hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    at = [v for _, v in sorted(kept, key=lambda r: (mark(r), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    pick = lambda v: min((far(v, c), n) for n, c in enumerate(at))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[pick(v)[1]].append(v)
        at = [[sum(x) // len(held[n]) for x in zip(*held[n])] if held[n] else c for n, c in enumerate(at)]
    found = [(i, *pick(v)) for i, v in kept]
    own = Counter()
    for _, d, n in found:
        own[n] += d
    return Counter((i, n, d, own[n], sum(own.values()), hashlib.sha256(",".join(map(str, at[n])).encode()).hexdigest()) for i, d, n in found)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "c", "i", "w", "d") for i, v in rows], VECTORS)


def some_vectors(n=150):
    draw = np.random.default_rng(5)
    centers = draw.normal(0, 0.2, (5, 64))
    rows = [(i, [float(x) for x in (centers[i % 5] + draw.normal(0, 0.1, 64)).astype(np.float32)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(40)]  # a common vector
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 63 + [None]), (904, [0.5] * 63 + [float("nan")]), (905, [0.5] * 63 + [float("inf")]), (906, [0.0] * 64), (906, [0.0] * 64), (None, [-0.1] * 64), (None, [0.1] * 64), (-4, [-3.0e-4] * 64)]
    return rows


def test_centroid_clusters(spark):
    rows = some_vectors()
    out = centroid_clusters(vectors(spark, rows).repartition(3))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, out.collect())) == lloyd(rows)


@pytest.mark.parametrize("rows", [[], [(1, [0.25] * 64)], [(i, [float(i % 2)] * 64) for i in range(12)], [(i, None) for i in range(3)]])
def test_few_and_equal_vectors(spark, rows):
    assert Counter(map(tuple, centroid_clusters(vectors(spark, rows)).collect())) == lloyd(rows)


def test_transform_is_exact_and_invertible():
    x = np.random.default_rng(1).integers(-clustering.LARGEST, clustering.LARGEST, (50, 64))
    w = coefficients(x)
    assert (components(w) == x).all() and (components(w.astype(object)) == x).all()
    assert (((w[0] - w[1:]) ** 2).sum(axis=1) == 64 * ((x[0] - x[1:]) ** 2).sum(axis=1)).all()
    assert (w[:, 0] == x.sum(axis=1)).all()  # the coarsest is the sum


def test_search_drops_centroids_and_keeps_ties():
    draw = np.random.default_rng(2)
    centers = draw.integers(-300, 300, (8, 64))
    centers[5] = centers[2]
    x = centers[draw.integers(0, 8, 500)] + draw.integers(-40, 40, (500, 64))
    x[:8] = centers
    own, sums, added = nearest(coefficients(x), coefficients(centers))
    whole = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    assert (own == whole.argmin(axis=1)).all() and (sums == 64 * whole.min(axis=1)).all()
    assert added < 0.5 * 500 * 8 * 64


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="scaled component"):
        centroid_clusters(vectors(spark, [(1, [1e30] * 64)])).collect()


# spelling variants


def variants(rows, least_chars=6, least_count=5, ratio=5, modulus=199):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if modulus and h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_chars and c >= least_count}
    close = defaultdict(set)
    for w in n:
        for x in n:
            if w != x and abs(len(w) - len(x)) <= 1:
                p = next((k for k, (a, b) in enumerate(zip(w, x)) if a != b), min(len(w), len(x)))
                a, b = w[p:], x[p:]
                if (len(a) == len(b) and a[1:] == b[1:]) or a[1:] == b or a == b[1:]:
                    close[w].add(x)
    form = {}
    for w in n:
        best = min(close[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n)


def misspelt(seed=3):
    draw, rows = random.Random(seed), []
    letters = "abcdeéÀz"
    base = ["".join(draw.choices(letters, k=draw.randint(6, 9))) for _ in range(25)]
    for k, word in enumerate(base):
        rows.append((k, f"{word} " * draw.choice([5, 30, 200])))
        for j in range(12):
            p, kind = draw.randrange(len(word)), draw.random()
            other = word[:p] + ("" if kind < 0.3 else draw.choice(letters)) + word[p + (kind < 0.6) :]
            rows.append((1000 + 20 * k + j, f"{other.title()}, " * draw.choice([4, 5, 6, 31])))
    rows += [(5000 + i, f"prefixes{a}{b} " * 6) for i, (a, b) in enumerate((a, b) for a in letters for b in letters)]
    rows += [(6000, "chainword " * 900 + "chainwords " * 90 + "chainwordsy " * 9)]
    return rows + [(None, "Wording " * 400), (-3, None), (7, ""), (8, "x" * 4000 + " " + ("y" * 3000 + " ") * 6 + ("y" * 3001 + "!") * 40)]


@pytest.mark.parametrize("modulus", [199, 3, None])
def test_spelling_variants(spark, modulus):
    rows = misspelt()
    docs = spark.createDataFrame([(i, t, "w", "n", "r") for i, t in rows], "doc_id long, text string, word string, n string, root string").repartition(3)
    out = spelling_variants(docs, drop_modulus=modulus)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants(rows, modulus=modulus)
    assert Counter(map(tuple, out.collect())) == want
    assert modulus == 3 or any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 3 for r in want)


def test_spelling_of_documents(docs, rows):
    assert Counter(map(tuple, spelling_variants(docs, drop_modulus=199).collect())) == variants(rows)


def test_no_words(no_docs):
    assert spelling_variants(no_docs, drop_modulus=199).count() == 0


def test_common_chunks_are_halved_again(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(spelling, "PAIRS", 20)
    monkeypatch.setattr(spelling, "_halved", lambda x, f=spelling._halved: rounds.append(1) or f(x))
    letters = "abcdef"
    made = [f"commonest{a}{b}{c}" for a in letters for b in letters for c in letters] + [f"commonest{a}{b}" for a in letters for b in letters]
    out = near_words(spark.createDataFrame([(w, 5) for w in made], "word string, n long"), 6).collect()
    want = {(w, x) for w, _, _, _, k, _ in variants([(1, " ".join(made))], least_count=1, modulus=None) for x in made if w != x and one_apart(w, x)}
    assert {(r["word"], r["near"]) for r in out} == want and len(out) == len(want)
    assert len(rounds) > 4


def one_apart(w, x):
    if len(w) == len(x):
        return sum(a != b for a, b in zip(w, x)) == 1
    long, short = sorted((w, x), key=len, reverse=True)
    return len(long) == len(short) + 1 and any(long[:p] + long[p + 1 :] == short for p in range(len(long)))


def test_blocks_cut_no_run(monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_CHARS", 5)
    text = "abc defghijk, lm nopqrstuvw"
    assert "".join(spelling._blocks(text, re.compile("[^a-z]"))) == text
    assert [w for b in spelling._blocks(text, re.compile("[^a-z]")) for w in re.findall("[a-z]+", b)] == re.findall("[a-z]+", text)


# SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(rows, bits=2):
    fps = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    at = np.array(distinct, np.uint64)
    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(at[i + 1 :] ^ at[i]) <= bits):
            root[find(distinct[i + 1 + j])] = find(f)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return Counter((i, f"{f:016x}", least.get(find(f))) for (i, _), f in zip(rows, fps))


def test_simhash_duplicates(docs, rows):
    out = simhash_duplicates(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    got = Counter(map(tuple, out.collect()))
    assert got == simhash_components(rows)
    assert sum(n for (i, _, c), n in got.items() if i != c) > 10


def test_no_fingerprints(no_docs):
    assert simhash_duplicates(no_docs).count() == 0


def test_fingerprint_in_blocks(monkeypatch):
    texts = ["One two  three\tfour " * 9, "a b", "a", " ", "Á É x y\nz", "word " * 50 + "tail", "x" * 300 + " y z"]
    want = [plain_fingerprint(t) for t in texts]
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(simhash_join, "BLOCK_BYTES", size)
        assert [fingerprint(t) for t in texts] == want


def families(n, seed=4):
    """Random fingerprints, chains of near ones, and a dense ball."""
    draw = np.random.default_rng(seed)
    points = list(draw.integers(0, 1 << 64, n, np.uint64))
    flip = lambda x, k: x ^ np.uint64(sum(1 << int(b) for b in draw.choice(64, k, replace=False)))
    for _ in range(n // 4):
        points.append(flip(points[draw.integers(len(points))], int(draw.integers(1, 5))))
    points += [flip(points[0], int(draw.integers(1, 4))) for _ in range(n // 2)]
    return np.unique(np.array(points, np.uint64))


def plain_labels(points, bits):
    label = list(range(len(points)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= bits):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            label[b] = a
    return [find(i) for i in range(len(points))]


@pytest.mark.parametrize(("bits", "bucket", "cells"), [(2, 16, 1 << 21), (2, 8, 300), (1, 16, 1 << 21), (3, 30, 1 << 21)])
def test_linked_within(monkeypatch, bits, bucket, cells):
    monkeypatch.setattr(simhash_join, "BUCKET", bucket)
    monkeypatch.setattr(simhash_join, "CELLS", cells)
    points = families(700)
    assert linked_within(points, bits).tolist() == plain_labels(points, bits)


def test_near_points_share_a_shard():
    points = families(3000)
    tree = Tree.fitted(points[::3], 2, 20)
    at, shard = tree.shards_of(points)
    homes = defaultdict(set)
    for i, s in zip(at.tolist(), shard.tolist()):
        homes[i].add(s)
    assert len(set(shard.tolist())) > 30 and set(homes) == set(range(len(points)))
    near = [(i, i + 1 + int(j)) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= 2)]
    assert len(near) > 1000 and all(homes[i] & homes[j] for i, j in near)


@pytest.mark.parametrize("group", [40_000, 60])
def test_links_over_shards(spark, monkeypatch, group):
    monkeypatch.setattr(simhash_join, "LEAF_POINTS", 100)
    monkeypatch.setattr(simhash_join, "GROUP_POINTS", group)
    points = families(1500)
    table = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    got = near_links(table, 2).collect()
    place = {int(p): i for i, p in enumerate(points.view(np.int64))}
    edges = [(place[r["a"]], place[r["b"]]) for r in got]
    label = simhash_join.merged(np.arange(len(points)), *map(np.array, zip(*edges)))
    assert label.tolist() == plain_labels(points, 2)
    assert all(a < b for a, b in edges) and len(edges) < 8 * len(points)


def test_fingerprints_of_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(common, "HOT_LEAST", 10)
    rows = [(i, "the same few words in each of these") for i in range(60)] + [(100 + i, f"some other text number {i} of its own") for i in range(20)] + [(None, None), (3000, None), (50, "one")]
    out = simhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, out.collect())) == simhash_components(rows)


def test_queries_are_registered():
    assert {"op11_centroid_clusters", "op12_spelling_variants", "op13_simhash_duplicates"} <= set(queries.queries())
