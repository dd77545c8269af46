"""Near copies against all pairs of shingle sets."""

import random

SCHEMA = "doc_id long, text string, n_chars long"


def shingles(t, width=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def kept(rows, percent=80):
    """Row numbers that stay, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return [min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for g in groups.values()]


def planted(seed, n=40):
    """Texts with copies of some replaced words, so that similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(40, 300))] for _ in range(n)]
    out = [*base]
    for w in base:
        for edits in rng.sample(range(1, 9), 3):
            c = list(w)
            for at in rng.sample(range(len(c)), edits):
                c[at] = f"x{rng.randrange(10**6)}"
            out.append(c)
    rng.shuffle(out)
    return [" ".join(w) for w in out]


def test_similarity(spark):
    from catascope.llm.near_copies import keep_one

    texts = planted(1) + ["a b", "A  B", "a b c", None, "", " \n"]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA).repartition(3)
    want = kept(rows)
    assert len(want) < len(rows) - 20
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted((rows[i][0], rows[i][1]) for i in want)
    assert keep_one(docs.where("false")).count() == 0


def test_crowded_key(spark):
    """A passage that many texts share, in groups of copies that are not similar to each other."""
    from catascope.llm.near_copies import keep_one

    rng = random.Random(9)
    common, rows = " ".join(f"c{i}" for i in range(30)), []
    for g in range(6):
        own = " ".join(f"g{g}x{i}" for i in range(30 if g else 4))
        rows += [(len(rows) + k, f"{common} {own} {rng.randrange(10**6)}") for k in range(15)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in keep_one(docs).collect()) == sorted(rows[i][0] for i in kept(rows))


def test_pairs_that_meet_no_hub(spark, monkeypatch):
    """With hubs that find nothing, members of a key are still compared with each other."""
    from catascope.llm import near_copies

    rows = list(enumerate(planted(3, 12)))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA)
    hubs, simhash = near_copies.hub_pairs, near_copies.simhash_pairs
    monkeypatch.setattr(near_copies, "hub_pairs", lambda *a: hubs(*a).where("false"))
    monkeypatch.setattr(near_copies, "simhash_pairs", lambda nodes: simhash(nodes).where("false"))
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == sorted(rows[i][0] for i in kept(rows))


def test_open_pairs_are_nearly_all_similar(spark, monkeypatch):
    """Many texts that share rare shingles and are not similar: their pairs do not leave the join."""
    from catascope.llm import near_copies

    rng, base = random.Random(4), [f"b{i}" for i in range(100)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(100), 3 if i % 5 else 1):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    seen, stored = {}, near_copies.stored

    def counted(df, name):
        out = stored(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(near_copies, "stored", counted)
    hubs, simhash = near_copies.hub_pairs, near_copies.simhash_pairs
    monkeypatch.setattr(near_copies, "hub_pairs", lambda *a: hubs(*a).where("false"))
    monkeypatch.setattr(near_copies, "simhash_pairs", lambda nodes: simhash(nodes).where("false"))
    rows = list(enumerate(texts))
    got = near_copies.keep_one(spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(rows[i][0] for i in kept(rows))
    sets = [shingles(t) for t in texts]
    near = sum(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert 0 < near <= seen["open-pairs"] <= 1.5 * near + 10


def test_parity_bits_drop_no_similar_pair(spark):
    import numpy as np
    from catascope.llm import near_copies
    from pyspark.sql import functions as F

    rng, rows, want = np.random.default_rng(2), [], []
    for i in range(150):
        n = int(rng.integers(1, 3000))
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        b = np.unique(np.concatenate([a[int(len(a) * rng.random() * 0.25) :], rng.integers(-(2**63), 2**63 - 1, int(len(a) * rng.random() * 0.1))]))
        both = len(np.intersect1d(a, b))
        rows += [(2 * i + k, len(s), np.frombuffer(near_copies.parity_bits(s), "<i8").tolist()) for k, s in enumerate((a, b))]
        if 100 * both >= 80 * (len(a) + len(b) - both):
            want.append(2 * i)
    marks = spark.createDataFrame(rows, "node long, n int, bits array<long>")
    pairs = spark.range(150).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"))
    got = {r["a"] for r in near_copies.alike_pairs(pairs, marks, 80).collect()}
    assert len(want) > 30 and set(want) <= got


def test_open_pairs_meet_at_one_key(spark, monkeypatch):
    """A pair of many shared keys leaves the join about once, and what it links are components, not texts."""
    from catascope.llm import near_copies

    rows = list(enumerate(planted(5, 30)))
    hubs, simhash, opened, components = near_copies.hub_pairs, near_copies.simhash_pairs, near_copies.open_pairs, near_copies.components
    monkeypatch.setattr(near_copies, "simhash_pairs", lambda nodes: simhash(nodes).where("false"))
    monkeypatch.setattr(near_copies, "hub_pairs", lambda *a: hubs(*a).where("a % 3 = 0"))
    seen = []

    def pairs(*a):
        out = opened(*a)
        seen.append((out.count(), out.distinct().count()))
        return out

    def joined(edges):
        seen.append({x for r in edges.collect() for x in (r["a"], r["b"])})
        out = components(edges)
        seen.append({r["node"]: r["label"] for r in out.collect()})
        return out

    monkeypatch.setattr(near_copies, "open_pairs", pairs)
    monkeypatch.setattr(near_copies, "components", joined)
    got = near_copies.keep_one(spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(rows[i][0] for i in kept(rows))
    _, labels, (n, distinct), linked, _ = seen
    assert 20 < distinct <= n <= 1.2 * distinct and linked and all(labels.get(x, x) == x for x in linked)
