import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import eventloom.llm.line_dedup as line_dedup_module
from eventloom.llm import common, sharding
from eventloom.llm import substring_dedup as sub
from eventloom.llm.fingerprints import anchors, code_points, edited_anchors, fingerprints, hashes_in, in_order, likeness, scheme_of, syncmers, written
from eventloom.llm.line_dedup import LineRuns, line_dedup, without_shared_lines
from eventloom.llm import ngram_join
from eventloom.llm.ngram_join import PartEnum, may_link, near_duplicates, one_of_each, parity_bits
from eventloom.llm.quality_rules import passing, quality_rules
from eventloom.llm.sharding import hypergeometric_sql, sharded
from eventloom.llm.words import Runs, mixed

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return (text or "").encode().split()


# line dedup


def lines_left(rows, least):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    return [(i, (t or "").split("\n"), [x for x in (t or "").split("\n") if held[key(x)] < least]) for i, t in rows]


@pytest.mark.parametrize("n_batches", [1, 4, 9])
def test_line_dedup(docs, rows, n_batches):
    out = line_dedup(docs, 10, n_batches=n_batches).select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert Counter(map(tuple, out)) == Counter((i, len(a), len(a) - len(k), sha("\n".join(k))) for i, a, k in lines_left(rows, 10))


def test_line_runs_are_compacted(spark):
    runs = LineRuns(spark, min_docs=3, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(i, "common\nown %d" % i)], "doc_id long, text string"))
    assert len(runs.levels) > 1 and runs.sealed
    assert runs.shared_lines().count() == 1


def test_later_batches_meet_sealed_lines(spark, monkeypatch):
    met, levels = [], []

    def add(self, batch, text_col="text", f=LineRuns.add):
        met.append(sum(x.count() for x in self.sealed))
        f(self, batch, text_col)
        levels.append(len(self.levels))

    monkeypatch.setattr(LineRuns, "add", add)
    spread = spark.createDataFrame([(i, f"Common\nown {i}") for i in range(180)], "doc_id long, text string")
    out = line_dedup(spread, 10).select("row.doc_id", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, out)) == [(i, 2, 1) for i in range(180)]
    assert len(met) == 9 and met[3] == 1 and met[-1] == 1 and levels[-1] == 3


def test_line_dedup_by_other_ids(docs, rows, monkeypatch):
    held = []
    monkeypatch.setattr(LineRuns, "add", lambda self, batch, text_col="text", f=LineRuns.add: held.append(batch.count()) or f(self, batch, text_col))
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = line_dedup(named, 10).select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert Counter(map(tuple, out)) == Counter((None if i is None else str(i), len(a), len(a) - len(k), sha("\n".join(k))) for i, a, k in lines_left(rows, 10))
    assert len(held) == 9 and min(held) > 0 and sum(held) == len(rows)


def test_many_shared_lines_are_not_broadcast(docs, rows, monkeypatch):
    monkeypatch.setattr(line_dedup_module, "BROADCAST_ROWS", 0)
    out = line_dedup(docs, 10).select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert Counter(map(tuple, out)) == Counter((i, len(a), len(a) - len(k), sha("\n".join(k))) for i, a, k in lines_left(rows, 10))


def test_lines_keep_columns(docs):
    assert without_shared_lines(docs, 10).schema == docs.schema


# quality rules


def test_quality_rules(docs, rows):
    hosts = {(r["doc_id"], r["text"]): r["source"] or "" for r in docs.select("doc_id", "text", "source").collect()}
    want, by_host = [], defaultdict(list)
    for i, t in rows:
        w, text = words(t), t or ""
        grams = [tuple(w[p : p + 3]) for p in range(len(w) - 2)]
        twice = Counter(grams)
        covered = {p + d for p, g in enumerate(grams) if twice[g] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        bad = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        by_host[hosts[i, t]].append(bad)
        want.append((i, t, len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), bad))
    total, failed = sum(map(len, by_host.values())), sum(map(sum, by_host.values()))
    m = failed / total
    surplus = max(sum(sum(v) ** 2 / len(v) for v in by_host.values()) / total - m * m - m * (1 - m) * len(by_host) / total, 1e-9)
    strength = max(m * (1 - m) / surplus - 1, 1.0)
    rate = {h: (sum(v) + m * strength) / (len(v) + strength) for h, v in by_host.items()}
    got = Counter(tuple(r)[:8] for r in quality_rules(docs).collect())
    assert got == Counter((i, n, a, b, c, d, bad, not bad and rate[hosts[i, t]] <= 0.75) for i, t, n, a, b, c, d, bad in want)
    kept = passing(docs)
    assert kept.schema == docs.schema
    assert kept.count() == sum(k[7] * n for k, n in got.items())


@pytest.mark.parametrize("many", [False, True])
def test_bad_host_goes(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
        monkeypatch.setattr(common, "HOT_LEAST", 30)
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "junk" if h == "bad" and i % 10 else good, h) for h in ("bad", "fine", "ok") for i in range(40)]
    out = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["source_bad"] for r in out.withColumn("source_bad", F.col("host_rate") > 0.75).collect()} == {True, False}
    assert out.filter("kept").count() == 80


# sharding


def test_sharding(docs, rows):
    out = sharded(docs, 16).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_matrix_is_a_tree_of_draws(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN", 3)
    sizes = {b: 5 + b % 4 for b in range(20)}
    counts = spark.createDataFrame(list(sizes.items()), "block long, n long")
    sums = np.zeros(4)
    for seed in range(12):
        rows = {r["block"]: np.diff([0, *r["bounds"]]) for r in sharding.communication_matrix(counts, 20, 4, seed).collect()}
        assert {b: int(x.sum()) for b, x in rows.items()} == sizes and all((x >= 0).all() for x in rows.values())
        got = sum(rows.values())
        assert got.tolist() == [33, 33, 32, 32]
        sums += rows[0]
    assert (sums > 0).all()


def test_rows_without_an_id_are_spread(spark, monkeypatch):
    blocks = []
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 500)
    monkeypatch.setattr(sharding, "communication_matrix", lambda counts, *a, f=sharding.communication_matrix: blocks.extend(r["n"] for r in counts.collect()) or f(counts, *a))
    out = sharded(spark.createDataFrame([(None, "same text")] * 10_000, "doc_id long, text string").repartition(3), 16).collect()
    assert len(blocks) == 20 and max(blocks) < 1000
    assert sorted((r["shard"], r["slot"]) for r in out) == [(s, i) for s in range(16) for i in range(625)]


def test_shards_do_not_depend_on_the_cluster(docs, spark):
    rows = lambda: sorted((r["text_crc32"], r["shard"], r["slot"]) for r in sharded(docs.filter("doc_id < 9000"), 16).collect())
    first = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_shuffle_is_uniform(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 8)
    df = spark.range(30).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    together, places = 0, np.zeros(3)
    for seed in range(40):
        shard = {r["doc_id"]: r["shard"] for r in sharded(df, 3, seed).collect()}
        together += sum(shard[i] == shard[i + 1] for i in range(0, 30, 2))
        places[shard[7]] += 1
    assert abs(together / 600 - 9 / 29) < 0.07  # two rows of a uniform permutation into shards of ten
    assert (places > 3).all()


def test_hypergeometric_draws(spark):
    good, bad, draws, n = 30, 50, 20, 4000
    x = spark.range(n).select(F.expr(hypergeometric_sql(f"{good}L", f"{bad}L", f"{draws}L", f"((id + 0.5D) / {n})")).alias("x")).toPandas()["x"]
    assert abs(x.mean() - draws * good / 80) < 0.02
    assert abs(x.var() - draws * good / 80 * bad / 80 * 60 / 79) < 0.05
    one = lambda *a: spark.range(1).select(F.expr(hypergeometric_sql(*a, "0.5D"))).first()[0]
    assert (one("5L", "0L", "3L"), one("0L", "5L", "3L"), one("5L", "5L", "10L"), one("0L", "0L", "0L")) == (3, 0, 5, 0)


# fingerprints


def test_fingerprints(docs, rows):
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], (r[1] or "").encode()))
    want = Counter()
    for j, (i, t) in enumerate(order):
        text, after = t or "", order[(j + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        a, b, c = (written(anchors(code_points(x))) for x in (text, edited, after))
        want[(i, n, sha(edited), a, b, likeness(hashes_in(a), hashes_in(b)), likeness(hashes_in(a), hashes_in(c)))] += 1
    assert Counter(map(tuple, fingerprints(docs).collect())) == want


def test_syncmers_by_a_plain_loop():
    rng = np.random.default_rng(6)
    for k, s in ((48, 12), (12, 4), (3, 2)):
        for text in (rng.integers(97, 123, 300), rng.integers(97, 99, 120), np.resize(rng.integers(97, 123, 5), 130)):
            points = text.astype(np.uint64)
            value = lambda p, n: int(mixed(Runs(mixed(points[p : p + n])).at(np.zeros(1, np.int64), n))[0])
            want = []
            for p in range(len(points) - k + 1):
                inner = [value(p + i, s) for i in range(k - s + 1)]
                if min(inner) in (inner[0], inner[-1]):
                    want.append((p, value(p, k) >> 34))
            at, found = syncmers(points, k, s)
            assert list(zip(at.tolist(), (found & (1 << 30) - 1).tolist())) == want


def test_likeness_by_the_textbook():
    rng = np.random.default_rng(7)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(0, 30)).tolist() for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        want = 1.0 if a == b else 2 * row[-1] / (len(a) + len(b)) if a and b else 0.0
        assert likeness(a, b) == want


def test_syncmers_do_not_depend_on_context():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 105, 2000).astype(np.uint64)
    at, value = syncmers(text, 48, 12)
    assert 0.02 < len(at) / 2000 < 0.12
    for p, v in zip(at[::7], value[::7]):
        assert syncmers(text[p : p + 48], 48, 12)[1].tolist() == [v]
    for cut in (0, 30, 700, 1999):
        tail = rng.integers(97, 105, 2000 - cut).astype(np.uint64)
        whole = np.concatenate([text[:cut], tail])
        assert written(edited_anchors(text, syncmers(text, *scheme_of(2000)), cut, tail)) == written(anchors(whole))


def test_texts_that_keep_three_quarters_are_alike():
    rng = np.random.default_rng(8)
    like = lambda x, y: likeness(hashes_in(written(anchors(x))), hashes_in(written(anchors(y))))
    for n in [*range(4, 200), 500, 3000]:
        for period in (n, 1, 2, 7, 12, 36):
            text = np.resize(rng.integers(97, 123, period).astype(np.uint64), n)
            for tail in (0, n // 8, n // 4):
                edited = np.concatenate([text[: n - n // 4], rng.integers(48, 58, tail).astype(np.uint64)])
                assert like(text, edited) > 0 and like(edited, text) == like(text, edited), (n, period, tail)
                assert written(edited_anchors(text, anchors(text), n - n // 4, edited[n - n // 4 :])) == written(anchors(edited))
        assert like(text, np.concatenate([text, text[:1]])) > 0
    assert like(code_points("a" * 20), code_points("a" * 200)) == 0.0


def test_values_in_order():
    rng = np.random.default_rng(9)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for kinds in (1, 2, 5, 300):
        for n, m in ((0, 5), (70, 90), (200, 150)):
            a, b = rng.integers(0, kinds, n).tolist(), rng.integers(0, kinds, m).tolist()
            assert in_order(a, b) == longest(a, b)
    began = time.monotonic()
    assert in_order([1] + [0] * 60_000, [0] * 50_000 + [2]) == 50_000
    assert time.monotonic() - began < 30


# substring dedup


def kept_words(rows, window):
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for p in range(len(w) - window + 1):
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        yield i, len(w), len(gone), [x for p, x in enumerate(w) if p not in gone]


@pytest.mark.parametrize("group", [2, 5_000])
def test_substring_dedup(docs, rows, group, monkeypatch):
    monkeypatch.setattr(sub, "GROUP_DOCUMENTS", group)
    monkeypatch.setattr(sub, "HELD_WORDS", group * 40)
    out = sub.substring_dedup(docs).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, out)) == Counter((i, n, k, hashlib.sha256(b" ".join(w)).hexdigest()) for i, n, k, w in kept_words(rows, 50))


def test_deep_nodes_are_maximal_repeats():
    rng = np.random.default_rng(4)
    for depth, alphabet in ((1, 3), (2, 2), (3, 2), (4, 1), (5, 4)):
        for _ in range(30):
            texts = [[b"%d" % x for x in rng.integers(0, alphabet, rng.integers(depth, 40))] for _ in range(6)]
            groups = sorted(rng.integers(0, 2, 6).tolist())
            trees = sub.SuffixTrees(texts, groups)
            places = [(g, i, p) for i, (g, t) in enumerate(zip(groups, texts)) for p in range(len(t) - depth + 1)]
            order, begins, depths = trees.deep_nodes(np.array([trees.begin[i] + p for _, i, p in places]), depth)
            code = {w: c for c, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
            keys = [(g, [code[w] for w in texts[i][p:]]) for g, i, p in (places[j] for j in order)]
            assert keys == sorted(keys)
            nodes = {}
            for a, b, d in zip(begins, [*begins[1:], len(order)], depths):
                held = frozenset(places[j] for j in order[a:b])
                nodes[held] = d
            want = defaultdict(set)
            for g, i, p in places:
                want[g, tuple(texts[i][p : p + depth])].add((g, i, p))
            common = lambda held: next(n for n in range(1000) if len({(texts[i] + [i])[p + n : p + n + 1][0] if p + n < len(texts[i]) else ("end", i, p) for _, i, p in held}) > 1)
            assert nodes == {frozenset(v): common(v) if len(v) > 1 else 0 for v in want.values()}


def test_substring_dedup_keeps_texts(docs, rows):
    out = sub.without_repeats(docs)
    assert out.schema == docs.schema
    assert Counter((r["doc_id"], tuple(words(r["text"]))) for r in out.collect()) == Counter((i, tuple(w)) for i, _, _, w in kept_words(rows, 50))


# near-duplicates


def components(rows, k, percent):
    sets, parent = [], {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and i is not None and j is not None and 100 * len(s & u) >= percent * len(s | u):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (2, 50)])
def test_near_duplicates(docs, rows, k, percent):
    assert Counter(map(tuple, near_duplicates(docs, k, percent).collect())) == components(rows, k, percent)


def test_shuffles_are_freed_between_steps(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ngram_join, "stored", lambda df, f=ngram_join.stored: seen.append("stored") or f(df))
    monkeypatch.setattr(ngram_join, "release", lambda s: seen.append("freed"))
    near_duplicates(spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h i")], "doc_id long, text string"), 3, 90)
    assert seen[:3] == ["stored", "stored", "freed"]  # the signatures' shuffle goes before they are joined


@pytest.mark.parametrize("rounds", [1, 3])
def test_differences_are_shuffled_in_rounds(spark, monkeypatch, rounds):
    monkeypatch.setattr(ngram_join, "ROUND_ROWS", 4)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    freed = []
    monkeypatch.setattr(ngram_join, "release", lambda s: freed.append(1))
    told = [(1, 1, i, c, i, 10, 10, 3, True, False, False, [0] * 8, [7, x], [-9]) for i, c, x in ((2, 2, 8), (3, 3, 11), (4, 4, 13))]
    told += told[-1:]  # a row that is there twice
    got = ngram_join.pairs_of_families(spark.createDataFrame(told, ngram_join._DIFFERENCES), 80, 100)
    assert len(freed) == 2 * rounds + 1  # after the spots of each round, after the rows at them, after all
    assert sorted(map(tuple, got.collect())) == [(2, 3), (2, 4), (3, 4)]


def test_near_duplicates_on_chains(spark):
    rng, rows = np.random.default_rng(3), []
    for family in range(12):
        n = int(rng.integers(8, 300))
        text = [f"f{family}w{x}" for x in rng.integers(0, 10**6, n)]
        for step in range(15):
            rows.append((family * 100 + step, " ".join(text)))
            text[int(rng.integers(0, n))] = f"n{rng.integers(0, 10**6)}"
    common = " ".join(f"c{i}" for i in range(80))
    rows += [(5000 + i, common + " " + " ".join(f"d{i}x{j}" for j in range(40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, near_duplicates(df, 3, 90).collect())) == components(rows, 3, 90)
    assert Counter(map(tuple, near_duplicates(df, 5, 80).collect())) == components(rows, 5, 80)


def test_signatures_and_parities_lose_nothing():
    rng, scheme = np.random.default_rng(11), PartEnum(80, 100)
    for n in (5, 9, 12, 25, 60, 300):
        for _ in range(40):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            lost, new = rng.integers(0, n // 5 + 1), rng.integers(0, n // 5 + 1)
            b = np.concatenate([a[lost:], rng.integers(0, 2**63, new).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert may_link(parity_bits(a), parity_bits(b), len(a), len(b), 80, 100)
                assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b))) or np.array_equal(a, b)


def test_one_of_each(docs):
    out = one_of_each(docs)
    assert out.schema == docs.schema
    assert 9005 in {r["doc_id"] for r in out.collect()} and 9012 not in {r["doc_id"] for r in out.collect()}


def test_empty_tables(no_docs):
    assert line_dedup(no_docs, 10).count() == 0
    assert quality_rules(no_docs).count() == 0 and passing(no_docs).count() == 0
    assert sharded(no_docs, 16).count() == 0
    assert fingerprints(no_docs).count() == 0
    assert sub.substring_dedup(no_docs).count() == 0
    assert near_duplicates(no_docs).count() == 0 and one_of_each(no_docs).count() == 0
