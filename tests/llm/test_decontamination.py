import random
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import decontamination as D
from rivulet.llm import queries



def plain(text):
    return re.sub(rb"[^a-z0-9\x80-\xff]", b"", re.sub("[À-ÖØ-Þ]", lambda m: m[0].lower(), text.translate({c: c + 32 for c in range(65, 91)})).encode())


def least_edits(p, t):
    """Edit distance of p to the nearest substring of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "st", "é", "Ñ"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.mark.parametrize("hits", [D.HITS, 20])
def test_candidates_and_alignment_lose_nothing(monkeypatch, hits):
    monkeypatch.setattr(D, "HITS", hits)  # 20: halved again and again
    rng = random.Random(1)
    items = [prose(rng, n) for n in (14, 20, 30, 60)]
    index = D.Index([t.encode() for t in items])
    texts = []
    for _ in range(120):
        it = list(rng.choice(items))
        for _ in range(rng.randrange(9)):
            k = rng.randrange(len(it))
            it[k : k + rng.randrange(2)] = rng.choice(["", "x", "q ", "."])
        a = rng.randrange(20)
        texts.append(prose(rng, rng.randrange(12)) + " " + "".join(it)[a if rng.random() < 0.4 else 0 :] + " " + prose(rng, rng.randrange(12)))
    reduced = [plain(t) for t in texts]
    chars = np.frombuffer(b"".join(reduced), np.uint8)
    offsets = np.r_[0, np.cumsum([len(r) for r in reduced])]
    got = set()
    for doc, segment, low, high in (x for part in index.candidates(chars, offsets) for x in zip(*part)):
        s = index.segments[segment]
        e, b, end = D.align([index.items[s[0]][s[1] : s[2]]], chars, np.array([s[1] + low - index.budget[segment]]), np.array([high - low + 2 * index.budget[segment] + 1]), offsets[doc : doc + 1], offsets[doc + 1 : doc + 2])
        if e[0] <= index.budget[segment]:
            got.add((int(doc), int(segment)))
            assert least_edits(index.items[s[0]][s[1] : s[2]].tobytes(), chars[b[0] : end[0]].tobytes()) == e[0]
    want = {(d, s) for d, t in enumerate(reduced) for s, (k, a, b) in enumerate(index.segments) if least_edits(index.items[k][a:b].tobytes(), t) <= index.budget[s]}
    assert got == want and len(want) > 60


def test_reduced_text():
    text = "Héllo, WÖRLD × ÷ 42!\n日本 ÑÇ"
    chars, at = D.reduced(np.frombuffer(text.encode(), np.uint8))
    assert chars.tobytes() == plain(text)
    assert text.encode()[at[0] : at[0] + 1] == b"H"


def test_gram_hashes():
    rng = np.random.default_rng(0)
    x = rng.integers(97, 100, 5000).astype(np.uint8)
    h, grams = D.gram_hashes(x), [x[i : i + D.Q].tobytes() for i in range(len(x) - D.Q + 1)]
    assert len(set(zip(h.tolist(), grams))) == len(set(grams)) == len(set(h.tolist()))
    assert len(D.gram_hashes(x[:9])) == 0 and len(D.gram_hashes(x[:10])) == 1


def test_query_finds_every_exact_passage(spark, sf):
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = queries.op6_decontamination(spark, sf).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    want = {(d, i) for d, t in docs.items() for i, p in items.items() if p in t}
    assert want and want <= got
    assert len(found) == len(got)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in found:
        if (r.doc_id, r.item_id) in want and r.edits == 0 and docs[r.doc_id].count(items[r.item_id]) == 1:
            assert plain(text[r.doc_id][r.start : r.end]) == items[r.item_id]


@pytest.mark.parametrize("index_bytes", [300, 1 << 20])
def test_odd_rows(spark, index_bytes):
    rng = random.Random(5)
    item, other = prose(rng, 40), prose(rng, 40)
    bench = spark.createDataFrame([(1, item), (None, other), (3, None), (4, "short"), (5, "")], "item_id long, text string").withColumn("start", F.lit(1))
    rows = [(1, None), (2, ""), (3, "é " + item), (3, "é " + item), (None, other + " x"), (6, item[: len(item) // 3]), (7, "short"), (8, (item + " ") * 300), (9, prose(rng, 3000)), (10, item.upper().replace(" ", "--"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"edits": F.lit(1), "item_id": F.lit(2)})
    got = sorted(((r.doc_id, r.item_id) for r in D.leaks(docs, bench, index_bytes=index_bytes).collect()), key=repr)
    assert [x for x in got if x[0] != 6] == sorted([(3, 1), (3, 1), (None, None), (7, 4), (8, 1), (10, 1)], key=repr)
    kept = D.without_leaks(docs, bench, index_bytes=index_bytes)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} - {6} == {1, 2, 9}
    assert D.leaks(docs.limit(0), bench).count() == 0 and D.leaks(docs, bench.limit(0)).count() == 0
    assert D.without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_excerpts_are_found_wherever_they_begin(spark):
    rng = random.Random(7)
    long, middle, tiny = prose(rng, 90), prose(rng, 25), prose(rng, 7)
    letters, part = plain(long).decode(), plain(middle).decode()[:100]
    assert len(letters) > 250 and 10 <= len(plain(tiny)) < D.MIN_ITEM and len(part) == 100
    bench = spark.createDataFrame([(1, long), (2, part), (3, tiny)], "item_id long, text string")
    rows = [(k, letters[k : k + 88]) for k in range(120)]
    rows += [(200, part[:85]), (201, f"{prose(rng, 20)} {tiny} {prose(rng, 20)}"), (202, tiny[: len(tiny) // 2])]
    got = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(k, 1) for k in range(120)} | {(200, 2), (201, 3)}


def test_repetitive_texts_take_bounded_memory():
    """An item that ends in 60 zeros, one of 20,000 letters of one kind, and a text of 1 MB of zeros."""
    code = """
import resource, numpy as np
from rivulet.llm import decontamination as D
index = D.Index([b"how many zeros are there in " + b"0" * 60, b"z" * 20_000])
text = b"0" * 1_000_000 + b"z" * 3_000
found = index.matches(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
print([x[:4] for x in found], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=60, check=True).stdout
    found, mb = eval(out[: out.index("]") + 1]), int(out[out.index("]") + 1 :])
    assert [x[:2] for x in found] == [(0, 1)] and found[0][2] >= 999_990 and found[0][3] == 1_003_000
    assert mb < 1500


def test_short_items_match_whole_documents_only(spark):
    bench = spark.createDataFrame([(1, "42"), (2, "B."), (3, "b"), (4, "..."), (5, "nine zero")], "item_id long, text string")
    docs = spark.createDataFrame([(1, " 4-2!"), (2, "b"), (3, "42 is it"), (4, ""), (5, "Nine, zero"), (6, "?")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()} == {(1, 1), (2, 2), (2, 3), (5, 5)}


def test_squeezed_stretches():
    rng = random.Random(3)
    parts = [b"0" * 500, b"abc" * 300, b"xyzzy", b"q" * 90, b"lorem ipsum dolor" * 40, bytes(rng.choices(b"abcdef", k=300))]
    texts = [b"".join(rng.choices(parts, k=4)) for _ in range(6)]
    chars, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    places = D.squeezed(chars, offsets, 60)
    assert len(places) < 0.7 * len(chars)
    for a, b in zip(offsets, offsets[1:]):
        left = chars[places[(places >= a) & (places < b)]].tobytes()
        text = chars[a:b].tobytes()
        assert {text[k : k + 55] for k in range(len(text) - 54)} == {left[k : k + 55] for k in range(len(left) - 54)}
