import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rivulet.llm import queries
from rivulet.llm.components import components
from rivulet.llm.simhash import fingerprint, grid_points, links, near_duplicates, segment_counts


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: {key: (least id, fingerprint)}; the least id reachable over links of 2 bits or fewer."""
    keys, root = list(fps), {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array([fps[k] for k in keys], np.uint64)
    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2):
            a, b = find(k), find(keys[i + 1 + j])
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    want = brute_components(fps)
    got = queries.op7_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{v:016x}", want[k]) for k, v in fps.items()}
    assert len(got) == len(docs)


def test_links_with_full_grid_points(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(1500):  # a dense ball, chains that leave it, and noise
        x = centre
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    for _ in range(300):
        fps.add(rng.getrandbits(64))
        y = rng.getrandbits(64)
        fps |= {y, y ^ 3, y ^ 15, y ^ 63}
    want = brute_components({k: f for k, f in enumerate(sorted(fps))})
    ordered = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in ordered]
    for cell in (4, 256):
        edges = links(spark.createDataFrame([(f,) for f in signed], "fp long"), cell)
        got = {r.vertex: r.root for r in components(edges).collect()}
        groups = {}
        for k, f in enumerate(signed):
            groups.setdefault(got.get(f, f), set()).add(k)
        expect = {}
        for k, r in want.items():
            expect.setdefault(r, set()).add(k)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_grid_is_a_lower_bound(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        rows.append([int(np.uint64(x).astype(np.int64)) for x in (a, b)])
    df = spark.createDataFrame(rows, "a long, b long")
    meet = F.arrays_overlap(grid_points(segment_counts(F.col("a"))), grid_points(segment_counts(F.col("b"))))
    assert df.where(meet).count() == len(rows)


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (None, "One two three four"), (7, "one TWO three four"), (7, "one TWO three four"), (8, "solo"), (None, "alone here"), (2, "w " * 70000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "component_id": F.lit(2)})
    got = {(r.doc_id, r.fp): r.component_id for r in near_duplicates(docs).collect()}
    assert near_duplicates(docs).count() == len(rows)
    assert [got[k, 0] for k in (5, 3, 9)] == [3, 3, 3]
    fp = fingerprint(b"one two three four")
    assert got[None, fp] == 7 and got[7, fp] == 7
    assert got[None, fingerprint(b"alone here")] is None
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 101)], "u long, v long")
    got = {r.vertex: r.root for r in components(edges).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[101] == 100
