import random
import re

import numpy as np
from pyspark.sql import functions as F

from rivulet.llm import quality_rules as Q
from rivulet.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_counts_against_brute_force(spark, sf):
    rng = random.Random(2)
    odd = [" ".join(rng.choice(["a", "bé", "#x", "<>", "\n", "\x0b", " z", "😀"]) for _ in range(rng.randrange(80))) for _ in range(200)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.unionAll(spark.createDataFrame([(10_000 + k, t, "en", None) for k, t in enumerate([*odd, None, "", "same words here " * 50_000, "l\n" * 1000])], docs.schema))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in Q.text_counts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text[r.doc_id]), r.doc_id


def test_query(spark, sf):
    rows = queries.op10_quality_rules(spark, sf).collect()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    good = [r.kept for r in rows if quality.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(good) >= 0.98 * len(good)


def test_labelled_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert len(bad) > 20 and sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def clean_counts(rng, n):
    words = rng.integers(30, 3000, n)
    return [(int(w), int(w * rng.normal(5, 0.1)), 0, 0, 0, int(w // 12), int(w * 0.1), int(w * 0.25), 0) for w in words]


def test_outliers_do_not_hide_each_other(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "en", "a", *c) for k, c in enumerate(clean_counts(rng, 600))]
    rows += [(1000 + k, "en", "a", w, int(w * 9), w * 3, 0, 0, 5, w * 4, w, 0) for k, w in enumerate(rng.integers(30, 3000, 180).tolist())]
    rows += [(5000, None, None, 300, 1500, 0, 0, 0, 20, 30, 75, 0), (None, "xx", "a", 19, 90, 0, 0, 0, 1, 0, 0, 0)]
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in Q._COUNTS)
    got = {r.doc_id: r for r in Q.judged(spark.createDataFrame(rows, schema)).collect()}
    assert all(got[k].kept for k in range(600)) and not any(got[1000 + k].kept for k in range(180))
    assert got[5000].kept and got[None].base_failed and not got[None].kept


def plain_estimates(x, groups, chosen):
    """Means and covariances drawn to the language's and all rows', by loops."""
    floor, every = np.square(list(Q.FLOORS.values())), [k for k in groups if len(chosen[k])]

    def pooled(keys):
        n = sum(len(chosen[k]) for k in keys)
        total = sum(x[chosen[k]].sum(axis=0) for k in keys)
        scatter = sum((x[chosen[k]] - x[chosen[k]].mean(axis=0)).T @ (x[chosen[k]] - x[chosen[k]].mean(axis=0)) for k in keys)
        return n, total, scatter

    n, total, scatter = pooled(every)
    mean_all, cov_all = total / n, scatter / n
    out = {}
    for k in every:
        n, total, scatter = pooled([j for j in every if groups[j][0] == groups[k][0]])
        mean, cov = (total + Q.SHRINK * mean_all) / (n + Q.SHRINK), (scatter + Q.SHRINK * cov_all) / (n + Q.SHRINK)
        n, total, scatter = pooled([k])
        mean, cov = (total + Q.SHRINK * mean) / (n + Q.SHRINK), (scatter + Q.SHRINK * cov) / (n + Q.SHRINK)
        out[k] = mean, 0.99 * cov + np.diag(np.maximum(np.diag(cov), floor) - 0.99 * np.diag(cov))
    return out


def test_verdict_against_numpy(spark):
    """The whole search in numpy: more starts, exact quantiles, all concentration steps to their end."""
    rng = np.random.default_rng(4)
    rows, bad = [], set()
    for lang, source, n in (("en", "a", 160), ("en", "b", 12), ("de", "a", 60), (None, None, 3)):
        for c in clean_counts(rng, n):
            rows.append((len(rows), lang, source, *c))
        for w in rng.integers(30, 3000, n // 6).tolist():
            bad.add(len(rows))
            rows.append((len(rows), lang, source, w, int(w * 8), w // 4, 0, 0, 5, w // 3, w // 6, w // 20))
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in Q._COUNTS)
    got = {r.doc_id: r for r in Q.judged(spark.createDataFrame(rows, schema)).collect()}
    x = np.array([got[k].x for k in range(len(rows))])
    groups = {got[k].g: (rows[k][1], rows[k][2]) for k in got}
    at = {g: np.array([k for k in range(len(rows)) if got[k].g == g]) for g in groups}

    def distances(e, g):
        d = x[at[g]] - e[g][0]
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(e[g][1]), d)

    best = {}
    for seed in range(12):
        pick = np.random.default_rng(seed)
        chosen = {g: pick.permutation(a)[: len(a) // 2 + 1] for g, a in at.items()}
        for _ in range(30):
            e = plain_estimates(x, groups, chosen)
            d = {g: distances(e, g) for g in groups}
            chosen = {g: at[g][np.argsort(d[g], kind="stable")[: int(np.ceil(Q.SHARE * len(at[g])))]] for g in groups}
        total = sum(np.linalg.slogdet(c)[1] for _, c in e.values())
        best = min(best or (total, e), (total, e), key=lambda b: b[0])
        best = tuple(best)
    inner = np.sort(np.square(np.random.default_rng(0).normal(size=(400_000, len(Q.NAMES)))).sum(axis=1))
    factor = len(Q.NAMES) / inner[: int(Q.SHARE * len(inner))].mean()  # by simulation
    want = {k: d for g in groups for k, d in zip(at[g].tolist(), distances(best[1], g) / factor)}
    assert all(np.isclose(got[k].distance, want[k], rtol=0.05) for k in want)
    cut = Q.chi_squared_quantile(1 - Q.TAIL, len(Q.NAMES))
    assert [k for k in want if want[k] > cut] == [k for k in got if not got[k].kept] == sorted(bad)


def test_floors_are_under_the_spread_of_texts(spark, sf):
    """Where ordinary texts differ at all, their own spread counts, not the floor."""
    spread = Q.quality(spark.read.parquet(f"{sf}/documents.parquet")).where("kept").agg(*[F.stddev(F.col("x")[k]).alias(n) for k, n in enumerate(Q.NAMES)]).first()
    for name in ("log_words", "word_length", "capitals", "marks", "adjacent"):
        assert Q.FLOORS[name] < 0.9 * spread[name], name


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "en", "s"), (None, "w " * 30, "en", None), (2, "", "en", "s")], "doc_id long, text string, lang string, source string").withColumns({"g": F.lit(1), "x": F.lit(2), "n_words": F.lit(3)})
    got = Q.quality(docs).collect()
    assert len(got) == 4 and all(r.base_failed and not r.kept for r in got)
    assert Q.quality(docs.limit(0)).count() == 0
    assert abs(Q.chi_squared_quantile(0.95, 6) - 12.59) < 0.05
