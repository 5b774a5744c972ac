"""SimHash and embedding near-duplicates against brute force; connected components."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickspark.llm import simhash as S
from tickspark.llm import vectors as V
from tickspark.llm.common import connected_components, picked


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("which", ["edges", "small"])
def test_simhash_components(request, which):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    got = sorted(S.simhash_components(df).collect(), key=str)
    prints = [plain_simhash(r.text) for r in rows]
    assert sorted((r.doc_id or -1, r.fp & (1 << 64) - 1) for r in got) == sorted((r.doc_id or -1, p) for r, p in zip(rows, prints, strict=True))
    own = sorted(set(prints))
    root = components(own, [(a, b) for a in own for b in own if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r.doc_id is not None:
            least[root[p]] = min(r.doc_id, least.get(root[p], 1 << 62))
    assert all(r.component_id == least.get(root[r.fp & (1 << 64) - 1]) for r in got)


def test_simhash_of_nothing(none):
    assert S.simhash_components(none).count() == 0 and S.drop_near_duplicates(none).count() == 0


def test_drop_keeps_columns_and_one_of_each(edges):
    kept = S.drop_near_duplicates(edges)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 in ids and 6 not in ids and 12 not in ids


def test_drop_judges_rows_by_id_and_text(spark):
    """Of a group one row stays, repeated or without doc_id as its rows may be; an unrelated text of a lost doc_id stays."""
    import random

    from tests.llm.conftest import prose

    rng = random.Random(2)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(1, a), (2, a + " end"), (2, b), (2, b), (None, a), (None, c), (None, c), (None, c + " end"), (3, d), (3, d + " end"), (4, ""), (None, None), (5, None)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, h1 int")
    kept = S.drop_near_duplicates(df)
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert kept.columns == df.columns and [g for g in got if g[0] == 2] == [(2, b)] and (1, a) in got and (4, "") in got
    assert len(got) == 5 and got[0][1].startswith(c) and got[3][1].startswith(d)


def test_clashing_hashes_are_told_apart(spark):
    rows = spark.createDataFrame([(7, 1), (7, 2), (8, 1), (7, 1)], "h1 long, h2 long")
    clashes = spark.createDataFrame([(7, True)], "h1 long, clash boolean")
    got = {(r.h1, r.h2): r.node for r in S._as_nodes(rows, clashes).collect()}
    assert len(set(got.values())) == 3 and got[8, 1] == 8
    assert {r.node for r in S._as_nodes(rows, None).collect()} == {7, 8}


@pytest.mark.parametrize("n", [1, 300, 10**7, 10**11])
def test_plans_lose_no_pair(n):
    """Partitions cover all bits once and thresholds sum up as the pigeonhole principle asks, at any size."""
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (2000, 64))
    masks, thresholds = S.plan_probes((bits.T @ bits) * (n / 2000), n, 4)
    assert sum(masks) == (1 << 64) - 1 and np.bitwise_or.reduce(np.array(masks, np.uint64)) == (1 << 64) - 1
    assert sum(thresholds) == 4 - len(masks) + 1


def test_correlated_bits_are_estimated_from_pairs():
    """Bits that are always equal: pairs of a sample show how many fingerprints a probe meets, independent bits don't."""
    rng = np.random.default_rng(3)
    one = rng.integers(0, 2, 600).astype(np.uint64)
    sample = one * np.uint64(0xFFFF) | rng.integers(0, 1 << 47, 600).astype(np.uint64) << np.uint64(16)
    chance = S.sampled_chance(sample, list(range(16)), 4)
    pairs = [(int(a ^ b) & 0xFFFF).bit_count() for k, a in enumerate(sample) for b in sample[:k]]
    assert chance == pytest.approx([np.mean([d <= t for d in pairs]) for t in range(5)]) and chance[0] > 0.45
    assert S.near_chance(np.full(16, 0.5), 0)[0] < 1e-4
    assert (S.sampled_chance(sample[:1], [0], 2) == 0).all() and (S.sampled_chance(sample[:0], [0], 2) == 0).all()


@pytest.mark.parametrize("plan", [([0xFFFF, 0xFFFFFFFFFFFF0000], [1, 2]), ([(1 << 21) - 1, ((1 << 21) - 1) << 21, ((1 << 22) - 1) << 42], [0, 1, 1])])
def test_wide_probes(spark, monkeypatch, plan):
    """Thresholds over 0, which only large corpora get, find the same links."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    more = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 7), replace=False)) for b in base for _ in range(4)]
    own = sorted({int(b) for b in base} | set(more))
    fps = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in own], "fp long")
    monkeypatch.setattr(S, "plan_probes", lambda *a: plan)
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in S.near_links(fps).collect()]
    assert components(own, links) == components(own, [(a, b) for a in own for b in own if a < b and (a ^ b).bit_count() <= 4])


def test_large_group_gives_few_links(spark):
    own = [1 << 40 | k for k in range(2000)]
    links = S.near_links(spark.createDataFrame([(f,) for f in own], "fp long"))
    assert links.count() <= 5 * len(own)


def test_connected_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)]
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*edges, (None, 7)], "a long, b long")).collect()}
    assert got == components(nodes, edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_picked(spark):
    df = spark.createDataFrame([(k, "a" if k % 10 else "b") for k in range(1000)], "id long, g string")
    got = picked(df, "g", "id", 30).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"a": 30, "b": 30}


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            v = rng.standard_normal(16)
            rows.append((k, v.tolist(), label))
            for _ in range(int(rng.integers(0, 4))):
                k += 1
                rows.append((k, (v + rng.standard_normal(16) * np.linalg.norm(v) * rng.choice([0.0, 0.02, 0.045, 0.06])).tolist(), label))
            k += 1
    nan = float("nan")
    return [*rows, (k, None, 0), (k + 1, [0.0] * 16, 0), (k + 2, [nan] * 16, 0), (k + 3, rows[0][1], None), (k + 4, [None] + [1.0] * 15, 0), (k + 5, rows[0][1], 0), (k + 6, [], 1), (k + 7, [1.0, 2.0], 1), (k + 8, [2.0, 4.0], 1), (k + 9, [float("inf")] * 16, 1)]


@pytest.mark.parametrize("block", [8000, 20])
def test_near_vectors(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("links", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_vectors(df, block=block).collect()}
    good = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a, x, p in good for b, y, q in good if a < b and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98]
    root = components([r[0] for r in rows], links)
    n = {i: sum(i in link for link in links) for i, *_ in rows}
    assert got == {i: (n[i], root[i], root[i] == i) for i, *_ in rows}
    assert V.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("size", [16, 64])
def test_large_labels_are_dealt_to_cells(spark, monkeypatch, size):
    """A label of more vectors than a block: at least 0.99 of the pairs at 0.98 to 0.99 are found, each once, and nothing else."""
    rng = np.random.default_rng(size)
    base = rng.standard_normal((1500, size))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal(base.shape)
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = rng.uniform(0.98, 0.99, (1500, 1))
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * off]).astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(V, "COPY", 1)
    for block in (300, 40):
        assert V.cuts_for(3000, 0.98, 0.9995, block) > 0
        got = {r.vec_id: r.n_links for r in V.near_vectors(df, block=block).collect()}
        n = np.array([got[k] for k in range(3000)])
        assert (n <= wanted).all() and n.sum() >= 0.99 * wanted.sum()


def test_work_grows_slower_than_a_label():
    """Copies and comparisons for a vector: five times the vectors of a label cost at most 1.5 times as many."""

    def work(n):
        k = V.cuts_for(n, 0.98, 0.9995, 8000)
        return V.tables_needed(k, 0.9995) * (n * (V.CELL * 0.2 / 2 / np.sqrt(np.pi)) ** k + V.COPY)

    assert work(50_000) <= 1.5 * work(10_000) and work(10**9) <= 12 * work(10_000)
    rng = np.random.default_rng(4)
    for cuts in (1, 3, 6):
        x, y = rng.standard_normal((2, 4000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        met = (V.cells(x, cuts, 0.9995, V.CELL * 0.2) == V.cells(y, cuts, 0.9995, V.CELL * 0.2)).any(axis=1)
        assert met.mean() > 0.995


def test_calibration():
    assert V.misses_allowed(0.5) <= V.misses_allowed(0.999) <= 6
    rng = np.random.default_rng(0)
    d = V.directions(64)[:, 1:]
    passed = 0
    for _ in range(2000):
        x, y = rng.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * y / np.linalg.norm(y)
        passed += (np.abs((x - y) @ d) > V.WIDE * 0.2).sum() <= V.misses_allowed(0.999)
    assert passed >= 1980


def test_similar_components(spark, edges, none):
    """Groups of copies with few changed words come together, documents of lower similarity don't."""
    import random

    from tests.llm.conftest import prose

    rng = random.Random(8)
    texts = []
    for _ in range(40):
        words = prose(rng, rng.randint(60, 300)).split()
        texts.append(words)
        for changed in rng.choices([0, 1, 2, 3, 30], k=rng.randint(0, 4)):
            own = list(words)
            for k in rng.sample(range(len(own)), min(changed, len(own))):
                own[k] = prose(rng, 1)
            texts.append(own)
    texts = [" ".join(t) for t in texts]
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    wanted = components(range(len(texts)), links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.similar_components(df).collect()}
    assert all(wanted[got[k]] == wanted[k] for k in got)  # nothing comes together that shouldn't
    near = [(a, b) for a, b in links if wanted[a] == wanted[b]]
    assert all(got[a] == got[b] for a, b in near)
    assert S.similar_components(edges).count() == edges.count() and S.similar_components(none).count() == 0


def changed(rng, words, at):
    from tests.llm.conftest import prose

    return [prose(rng, 1) if k in at else w for k, w in enumerate(words)]


def test_copies_that_are_alike_only_by_their_original(spark):
    """Every copy of a large group finds the original, though other copies are candidates too and most are less alike."""
    import random

    from tests.llm.conftest import prose

    rng = random.Random(12)
    words = prose(rng, 304).split()
    texts = [words, *(changed(rng, words, set(rng.sample(range(5, 299, 6), 6))) for _ in range(300))]
    sets = [set(zip(*(t[k:] for k in range(5)))) for t in texts]
    like = lambda a, b: len(a & b) / len(a | b)
    assert all(like(sets[0], s) >= 0.8 for s in sets) and np.mean([like(a, b) < 0.8 for a, b in zip(sets[1:], sets[2:])]) > 0.9
    order = rng.sample(range(len(texts)), len(texts))
    df = spark.createDataFrame([(k, " ".join(texts[t])) for k, t in enumerate(order)], "doc_id long, text string")
    assert {r.component_id for r in S.similar_components(df).collect()} == {0}


def test_hub_is_not_needed(spark, monkeypatch):
    """A chain, of which only neighbours are similar, comes together over blocks of two rows."""
    import random

    from tests.llm.conftest import prose

    rng = random.Random(13)
    texts = [prose(rng, 304).split()]
    for k in range(12):
        texts.append(changed(rng, texts[-1], {5 + 6 * (4 * k + j) for j in range(4)}))
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(S, "BLOCK", 2)
    assert {r.component_id for r in S.similar_components(df).collect()} == {0}


def test_repeated_passages(spark):
    """Equal sets of shingles come together however often a passage is repeated, and so do pairs of far fingerprints."""
    import random

    from tests.llm.conftest import prose

    rng = random.Random(14)
    texts, pairs = [], []
    for _ in range(30):
        words = prose(rng, 300).split()
        pairs.append((len(texts), len(texts) + 1))
        texts += [words[:20] * 2 + words[20:], words[:20] * 30 + words[20:]]
    while len(texts) < 90:  # fingerprints that differ in over 14 bits at a similarity of 0.8 or more
        words = prose(rng, 304).split()
        own = changed(rng, words, set(rng.sample(range(5, 299, 6), 6)))
        a, b = " ".join(words), " ".join(own)
        if (S.described(a, 5)[0] ^ S.described(b, 5)[0]).bit_count() > 14:
            pairs.append((len(texts), len(texts) + 1))
            texts += [words, own]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.similar_components(df).collect()}
    assert all(got[a] == got[b] for a, b in pairs) and len(set(got.values())) == len(pairs)


def test_rare_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(6)
    frequent = np.sort(rng.integers(0, 1 << 63, 50, np.uint64))
    for n in [*range(1, 40), 300]:
        own = np.unique(np.r_[rng.choice(frequent, min(n, 20), replace=False), rng.integers(0, 1 << 63, n, np.uint64)])
        for lost in range(len(own) // 5 + 1):
            other = np.sort(rng.permutation(own)[lost:])  # similarity 0.8 or more
            a, b = (S.rare_shingles(x, 0.8, frequent, np.arange(50) + 3) for x in (own, other))
            assert np.isin(a, b).any()


def test_all_links_of_documents(spark):
    """Documents and four of a larger table whose fingerprints are far apart: every pair of similarity 0.8 comes together."""
    far = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id IN (1, 4, 205, 9622)").select("doc_id", "text")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text").unionByName(far)
    sets = {r.doc_id: S._shingle_set(r.text, 5) for r in docs.collect()}
    own = sorted(sets, key=lambda k: len(sets[k]))
    links = []
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if 0.8 * len(sets[b]) > len(sets[a]):
                break
            if S._similar(sets[a], sets[b], 0.8):
                links.append((a, b))
    wanted = components(own, links)
    got = {r.doc_id: r.component_id for r in S.similar_components(docs).collect()}
    assert got == wanted and got[205] == got[4] == 4 and got[9622] == got[1] == 1
