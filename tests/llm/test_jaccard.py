import random

import pyarrow as pa

import corpus_pipeline
from rivulet.llm import jaccard, simhash


def shingles(text, k=5):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_roots(texts, least=0.8):
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= least * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if r == old else r for d, r in root.items()}
    return root


def copies(seed=6):
    """Texts with near copies at all similarities, a chain, a large group, short and empty texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for n in (60, 120, 300):
        for _ in range(25):
            text = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(text))
            for _ in range(2):
                near = list(text)
                for _ in range(rng.randrange(1, 6)):
                    near[rng.randrange(n)] = rng.choice(words)
                texts.append(" ".join(near).upper())
    base = [rng.choice(words) for _ in range(150)]
    for _ in range(60):
        near = list(base)
        for _ in range(3):
            near[rng.randrange(150)] = rng.choice(words)
        texts.append("  ".join(near))
    texts += ["a b", "A  b", "a b c", "", " ", "one", base[0]]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_stage_finds_all_near_copies(spark, sf):
    texts = copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()}
    want = set(brute_roots(texts).values())
    assert got == want and len(want) < 0.7 * len(texts)
    assert len({r.doc_id for r in simhash.representatives(docs).collect()} - want) > 50  # the contract of op7 alone is not enough


def test_odd_groups(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (7, "A b c D"), (None, "a b c d"), (None, "x y z w"), (None, "x y z w"), (9, None), (8, ""), (6, "one two three"), (6, "other words here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, simhash.representatives(df, shingle=5, similarity=0.8).collect()), key=repr)
    assert got == sorted([(5, "a b c d"), (None, "x y z w"), (8, ""), (6, "one two three"), (6, "other words here now")], key=repr)


def test_simhash_grid_links_without_bands(spark, sf, monkeypatch):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(40):
        text = [rng.choice(words) for _ in range(400)]
        texts += [" ".join(text), " ".join([*text[:-1], "other"])]
    cycle = "one two three four five " * 60
    texts += [cycle + "red green blue pink gray teal", cycle + "cat dog cow pig hen fox"]  # one fingerprint, unlike sets
    prints, sets = [simhash.fingerprint(t.encode(), 5) for t in texts], [shingles(t) for t in texts]
    near = [k for k in range(0, 80, 2) if ((prints[k] ^ prints[k + 1]) % 2**64).bit_count() <= 2 and len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1])]
    assert len(near) > 20 and prints[80] == prints[81] and len(sets[80] & sets[81]) < 0.8 * len(sets[80] | sets[81])
    none = lambda members, sets, similarity: members.select(members.fp.alias("u"), members.fp.alias("v")).limit(0)
    for name in ("_star_links", "_block_links"):
        monkeypatch.setattr(jaccard, name, none)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()}
    assert got == set(range(len(texts))) - {k + 1 for k in near}


def count_rows(block):
    return pa.table({"u": pa.array([block.num_rows], pa.int64()), "v": pa.array([-1], pa.int64())})


def test_rows_for_blocks_grow_with_the_group(spark, monkeypatch):
    """Copies of one text, each with shingles of its own: half of one component, the others too far from all."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "_verify", lambda similarity: count_rows)
    made = []
    for n in (100, 400):
        rows = [(1, k, 0 if k % 2 else k, [*range(30 if k % 2 == 0 else 1, 140), *range(1000 + 1000 * k, 1030 + 1000 * k if k % 2 == 0 else 1001 + 1000 * k)]) for k in range(1, n + 1)]
        docs = spark.createDataFrame(rows, "band long, fp long, root long, hashes array<long>")
        sets = docs.selectExpr("fp", "size(hashes) n", "hashes")
        made.append(sum(r.u for r in jaccard._block_links(docs.select("band", "fp", "root"), sets, 0.8).collect() if r.v == -1))
    assert made[1] <= 5 * made[0]


def test_crowded_bands_against_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "FEW", 3)
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    far = []
    for _ in range(50):  # near the base, too far from it, and copies of such copies
        text = list(rng.choice(far) if far and rng.random() < 0.4 else base)[rng.randrange(12) :]
        for _ in range(rng.randrange(1, 6)):
            text[rng.randrange(len(text))] = rng.choice(words)
        far.append(text)
    texts = dict(enumerate(" ".join(t) for t in far))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = set(brute_roots(texts).values())
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()} == want and 5 < len(want) < 45
