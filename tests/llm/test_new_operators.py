"""Centroid clustering, spelling variants and near-duplicates of embeddings against brute force, with nulls, empty and very long
values, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from notemill.llm import kmeans, queries, subspace, variants

VECTORS = "vec_id long, embedding array<float>, label int"
CLASH = {"id": 1, "v": 2, "q": 3, "cluster": 4, "distance": 5, "word": 6, "n": 7, "k": 8, "l": 9, "node": 10, "n_links": 11, "run": 12, "least": 13, "side": 14}


def clashing(df):
    return df.withColumns({k: F.lit(x) for k, x in CLASH.items()})


# ---- centroid clustering


@pytest.mark.parametrize("seed", range(40))
def test_filtering_equals_the_nearest_centroid(seed):
    r = np.random.default_rng(seed)
    n, d, k, scale = int(r.integers(1, 400)), int(r.integers(1, 6)), int(r.integers(1, 12)), int(r.choice([1, 2, 5, 100, kmeans.MOST]))
    q = r.integers(-scale, scale + 1, (n, d))[r.integers(0, n, n)]
    c = q[r.integers(0, n, k)] if seed % 2 else r.integers(-scale, scale + 1, (k, d))
    tree, order = kmeans.Tree.build(q)
    tree = kmeans.Tree.unpack(tree.pack(), d)
    number, distance = tree.assign(c)
    every = ((q[order][:, None] - c) ** 2).sum(-1)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    found, sums = tree.totals(c)
    assert (found == np.bincount(number, minlength=k)).all() and all((sums[i] == q[order][number == i].sum(0)).all() for i in range(k))


def test_filtering_prunes():
    r = np.random.default_rng(3)
    centres = r.integers(-5000, 5000, (20, 4))
    q = centres[r.integers(0, 20, 4000)] + r.integers(-40, 40, (4000, 4))
    tree, _ = kmeans.Tree.build(q)
    whole, resolved = tree.filter(centres)
    # of medians, those that fall between two groups leave leaves of both: at most one leaf a split
    assert sum(tree.end[x] - tree.begin[x] for x, _ in whole) > 3000 and len(whole) < 400 and sum(len(x) for _, x in resolved) < 1000


def brute_clusters(rows, k, rounds, width, seed):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"{seed}:{x[0]}".encode()).hexdigest() if x[0] is not None else "", x[1]))[:k]
    z = [q for _, q in first]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(z))
    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, q in kept:
            of[near(q)[1]].append(q)
        z = [[sum(x) // len(of[j]) for x in zip(*of[j])] if j in of else c for j, c in enumerate(z)]
    return collections.Counter((i, near(q)[1], near(q)[0]) for i, q in kept), z


def test_clusters(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=4).round(1)], i % 3) for i in range(300)]
    rows += [(i, rows[0][1], 1) for i in range(300, 420)] + [rows[5]] * 3 + [(None, rows[7][1], None), (None, rows[8][1], 0)]
    rows += [(500, None, 1), (501, [], 1), (502, [1.0, 2.0], 1), (503, [1.0, None, 0.0, 0.0], 1), (504, [float("nan")] * 4, 1), (505, [1.0, float("inf"), 0.0, 0.0], 1), (506, [1.0] * 5, 1)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    want, z = brute_clusters([(i, v) for i, v, _ in rows], 12, 4, 4, 2)
    found, centroids = kmeans.centroid_clusters(clashing(df), k=12, rounds=4, width=4)
    assert collections.Counter((x.vec_id, x.cluster, x.distance) for x in found.collect()) == want and centroids == z
    found, centroids = kmeans.centroid_clusters(df.where("vec_id < 3"), k=12, rounds=2, width=4)
    assert len(centroids) == 3 and sorted((x.cluster, x.distance) for x in found.collect()) == [(0, 0), (1, 0), (2, 0)]
    found, centroids = kmeans.centroid_clusters(df.limit(0), k=12, rounds=2, width=4)
    assert found.count() == 0 and centroids == []


def test_components_that_64_bits_cannot_square_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30], 1)], VECTORS)
    with pytest.raises(Exception, match="64 bits"):
        kmeans.centroid_clusters(df, k=1, rounds=1, width=1)[0].collect()


# ---- spelling variants


def brute_variants(n):
    alphabet = {c for w in n for c in w}
    near = {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
        near[w] = [x for x in edits - {w} if x in n]
    out = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        out[w] = best if best and n[best] >= 5 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while out[root]:
            root = out[root]
        rows.add((w, out[w], root, n[w], len(near[w]), n[out[w]] if out[w] else None))
    return rows


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_of_words(spark):
    r = random.Random(2)
    n = {}
    for _ in range(60):
        w = "".join(r.choice("abcé") for _ in range(r.randint(6, 9)))
        for _ in range(6):
            n.setdefault(w, r.choice([5, 6, 25, 26, 130, 700, 4000]))
            i, c = r.randint(0, len(w)), r.choice("abcéÿ")
            w = r.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]) or "a"
    n |= {"aabbcc": 9, "aabbc": 50, "aabcc": 50, "bbaacc": 45, "abcabc": 9}  # runs of a letter, ties, anagrams
    n |= {"x" * 3000: 5, "x" * 2999: 30, "x" * 1500 + "y" + "x" * 1499: 7}
    df = spark.createDataFrame(sorted(n.items()), "word string, n long").repartition(3)
    assert rows_of(variants.variants(df)) == brute_variants(n)
    assert variants.variants(df.limit(0)).count() == 0


def test_chains_lead_to_their_root(spark):
    n = {"aaaaaa" + "b" * i: 5 ** (12 - i) for i in range(12)}
    df = spark.createDataFrame(sorted(n.items()), "word string, n long")
    assert {r.root for r in variants.variants(df).collect()} == {"aaaaaa"}


def test_anagrams_of_one_bag_do_not_meet_all_to_all(spark):
    import itertools

    words = ["".join(p) for p in itertools.permutations("abcdefgh") if p[0] < p[1] < p[2]]
    own = variants.entries(spark.createDataFrame([(w, 5) for w in words], "word string, n long"))
    largest = own.where("not whole").groupBy("key", "left", "side", "part").count().agg(F.max("count")).first()[0]
    assert largest <= 120 < len(words) / 50  # the orders of the five letters beyond one half


def counted(rows):
    n = collections.Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def test_entries_are_not_broadcast(spark, tmp_path):
    """Entries take many times the bytes of the stored words from which the planner judges their size."""
    spark.createDataFrame([("abcdef", 5), ("abcdeg", 30)], "word string, n long").write.parquet(f"{tmp_path}/words")
    found = variants.near_words(spark.read.parquet(f"file://{tmp_path}/words"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, found.collect())) == [("abcdef", "abcdeg", 30), ("abcdeg", "abcdef", 5)]


def test_variants_query_of_texts(spark, tmp_path):
    r = random.Random(4)
    base = ["häuser", "ÀÉÜöøÿ", "gardens", "Garden", "printing", "Printer", "a" * 5000]
    rows = [(i, " ".join(r.choice(base) for _ in range(60)) + r.choice([" Gardens!", " pr1nting", "\nhàuser", ""]), "en") for i in range(60)]
    rows += [(None, None, None), (None, "gardens " * 9, "en"), (7, "", "en"), rows[3], rows[3], (99, "word" * 50_000 + " " + "gardens " * 40_000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("word", F.lit(1)).withColumn("run", F.lit("a")).write.parquet(f"file://{tmp_path}/documents.parquet")
    n = counted(rows)
    assert len(n) >= 10 and any(w not in text.lower() for w in n for _, text, _ in rows[-1:])
    assert rows_of(queries.op12_variants(spark, f"file://{tmp_path}")) == brute_variants(n)


# ---- near-duplicates of embeddings


def test_the_rotation_keeps_distances_and_is_the_same_for_any_batch():
    r = np.random.default_rng(1)
    for d in (1, 3, 64, 100):
        u = subspace.unit_vectors(r.normal(size=(50, d)))
        y = subspace.rotated(u)
        true = ((u[:, None] - u) ** 2).sum(-1)
        scaled = ((y[:, None] - y) ** 2).sum(-1) / (y.shape[1] * 2.0**40)
        assert np.allclose(true, scaled, atol=1e-4)
        assert (y == np.concatenate([subspace.rotated(u[i : i + 1]) for i in range(50)])).all()


@pytest.mark.parametrize("seed", range(24))
def test_each_link_is_counted_in_one_block(seed):
    r = np.random.default_rng(seed)
    d, n, least = int(r.choice([1, 3, 8, 20, 64])), int(r.integers(2, 900)), float(r.choice([0.5, 0.8, 0.93]))
    c = r.normal(size=(max(1, n // 8), d))
    v = (c[r.integers(0, len(c), n)] + r.normal(size=(n, d)) * r.choice([0.02, 0.1, 0.3])) * r.uniform(0.1, 9, (n, 1))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = u @ u.T >= least
    np.fill_diagonal(want, False)
    copies, side = r.integers(1, 4, n), (r.random(n) < 0.3).astype(int)
    blocks = max(1, (1 << max(0, d - 1).bit_length()) // subspace.BLOCK)
    for inner in (True, False):
        own = want & ~((side[:, None] == 1) & (side == 1)) if inner else want & (side[:, None] != side)
        assert (sum(subspace.unit_links(v, copies, side, inner, b, least).n for b in range(blocks)) == (own * copies).sum(1)).all()


def brute_near(rows, least):
    fine = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = {i: set() for i in range(len(rows))}
    for a in fine:
        for b in fine:
            x, y = (np.array(rows[k][1], float) for k in (a, b))
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                linked[a].add(b)
    out = collections.Counter()
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out[rows[i][0], len(linked[i]), min(ids, default=None), rows[i][0] == min(ids, default=None)] += 1
    return out


@pytest.mark.parametrize("unit_bytes", [subspace.UNIT_BYTES, 1])
def test_embedding_near(spark, unit_bytes):
    r = np.random.default_rng(6)
    own = lambda x: [float(np.float32(y)) for y in x]
    centres = r.normal(size=(40, 16))
    rows = [(1000 - i, own(centres[i % 40] + r.normal(size=16) * 0.2), i % 3) for i in range(240)]
    rows += [(2000 + i, own(centres[0] * (1 + i / 9) + r.normal(size=16) * 0.05), 0) for i in range(150)]  # one group holds a third of all rows
    rows += [(3000 + i, rows[4][1], rows[4][2]) for i in range(60)] + [rows[9]] * 3 + [(None, rows[4][1], rows[4][2]), (None, rows[2][1], None), (None, own(r.normal(size=16)), 1)]
    rows += [(1, None, 1), (2, [], 1), (3, [0.0] * 16, 1), (4, [0.0] * 16, 1), (5, [float("nan")] * 16, 1), (6, [1.0, None], 1), (7, [1.0, 1.0], 1), (8, [2.0, 2.0], 1), (9, [1e30, 1e30], 1), (10, [-1.0, -1.0], 1), (11, [3.0], 1), (12, [5.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).repartition(6)
    found = subspace.embedding_near(clashing(df), least=0.93, unit_bytes=unit_bytes)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = collections.Counter({(i, n, c, (i == c)): k for (i, n, c, _), k in brute_near(rows, 0.93).items()})
    assert collections.Counter((x.vec_id, x.n_links, x.component_id, x.kept) for x in found.collect()) == want
    assert subspace.embedding_near(df.limit(0)).count() == 0


def test_queries_over_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op13_embedding_near(spark, sf).collect()
    assert collections.Counter((x.vec_id, x.n_links, x.component_id, x.kept) for x in got) == brute_near(rows, 0.93)
    want, z = brute_clusters([(i, v) for i, v, _ in rows], 40, 5, 64, 2)
    got = queries.op11_clusters(spark, sf).collect()
    assert collections.Counter((x.vec_id, x.cluster, x.distance) for x in got) == want
    of = collections.Counter()
    for (_, c, d), n in want.items():
        of[c] += d * n
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z]
    assert all((x.cluster_inertia, x.inertia, x.centroid_sha256) == (of[x.cluster], sum(of.values()), digest[x.cluster]) for x in got)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(queries.op12_variants(spark, sf)) == brute_variants(counted(docs))
