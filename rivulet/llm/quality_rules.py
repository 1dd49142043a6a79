"""Quality rules: fixed base rules, then robust multivariate outliers.

Each text gives counts; the counts give a vector of transformed statistics: shares
by their square roots, drawn in where a text is too short to tell, so that their
spread does not depend on the text's length.  Per language and source, a
minimum-covariance-determinant estimate is found by concentration steps over all
rows that pass the base rules: distances to the present estimate, the nearest
``SHARE`` of the group, their moments, a new estimate.  Three starts (diagonal
scale, the covariance of the values' hyperbolic tangents, that of their directions)
take ``FIRST_STEPS`` each; that of the least determinant goes on until the
determinants stand still.  A step is two grouped aggregates; only the estimate
itself (a few numbers a group) is made in pandas.

Small groups need no switch: a group's mean and covariance are drawn towards those
of its language, and these towards those of all rows, by ``SHRINK`` rows' weight.
A variance is raised to its floor only where the group's own is less; the floors are
of the order of one counted event, and lie under the spread of ordinary texts.

A row is rejected when its squared Mahalanobis distance, divided by the consistency
factor of the estimate (the nearest ``SHARE`` of normal rows are closer together than
all), exceeds the chi-squared quantile ``TAIL``.

Defined results: null and empty texts have zero counts and fail the base rules;
null languages and sources are values of their own; a null doc_id and repeated
rows keep their rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import exp, factorial
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.shared_tables import written
from rivulet.llm.textbatch import IS_SEPARATOR, Words, covered, map_batches, runs, utf8

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SHARE = 0.75
FIRST_STEPS = 2
MOST_STEPS = 20
SHRINK = 40
RIDGE = 0.01
TAIL = 1e-6
#: Words, characters and lines from which a share's own spread outweighs that of a short text; a repeat has 16 words.
STEADY = {"n_words": 200, "word_chars": 2000, "n_lines": 50}
STEADY_REPEATS = 1600

#: Statistics and the least standard deviation that a group is taken to have in each.  Of rare events
#: (symbols, dup_lines, repeats) it is half of what one counts in a short text, of the other shares a quarter; a length may be twice as large.
FLOORS = {"log_words": 0.69, "word_length": 0.05, "symbols": 0.0112, "dup_lines": 0.0707, "repeats": 0.05, "capitals": 0.0056, "marks": 0.0056, "adjacent": 0.0177}
NAMES = list(FLOORS)
_N = len(NAMES)
_UPPER = [(i, j) for i in range(_N) for j in range(i, _N)]

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_adjacent"]
_SYMBOL, _CAPITAL, _MARK = (np.isin(np.arange(256), list(x)) for x in (b"[#*$%&|<>]", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!\"'()+,-./:;=?@\\^_`{}~"))
_SYMBOL[[ord("["), ord("]")]] = False


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines)), len(lines)


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a batch."""
    data, offsets = utf8(column)
    out = {k: np.zeros(len(offsets) - 1, np.int64) for k in _COUNTS}
    for first, last in runs(offsets):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]

        def per_row(mask: np.ndarray, places: np.ndarray = at) -> np.ndarray:
            return np.diff(np.r_[0, np.cumsum(mask)][places])

        words, to = Words(part, at), slice(first, last)
        out["n_words"][to] = words.count
        out["word_chars"][to] = per_row(~IS_SEPARATOR[part] & ((part & 0xC0) != 0x80))
        for name, table in (("n_symbols", _SYMBOL), ("n_capitals", _CAPITAL), ("n_marks", _MARK)):
            out[name][to] = per_row(table[part])
        start = words.windows(WINDOW)
        key = words.grams(start, start + WINDOW) + words.doc[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        out["n_repeat_words"][to] = per_row(covered(len(words.start), start[twice], WINDOW), words.first)
        again = np.zeros(len(words.start), bool)
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        out["n_adjacent"][to] = per_row(again, words.first)
        whole = part.tobytes()
        for k in range(last - first):
            out["n_dup_lines"][first + k], out["n_lines"][first + k] = _dup_lines(whole[at[k] : at[k + 1]])
    return out


def text_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = counts(batch.column("text"))
        return pa.record_batch([batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(found[c]) for c in _COUNTS], ["doc_id", "lang", "source", *_COUNTS])

    return map_batches(rows, run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _raw() -> tuple[list[Column], list[Column]]:
    """The statistics, and how much of each one's distance from the middle a text of this length is given."""

    def share(a: str, of: str) -> Column:
        return F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(of), F.lit(1))))

    def steady(of: str, n: int | None = None) -> Column:
        return F.sqrt(F.col(of) / (F.col(of) + (n or STEADY[of])))

    raw = [F.log1p("n_words"), F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_capitals", "word_chars"), share("n_marks", "word_chars"), share("n_adjacent", "n_words")]
    weight = [F.lit(1.0), steady("n_words"), steady("word_chars"), steady("n_lines"), steady("n_words", STEADY_REPEATS), steady("word_chars"), steady("word_chars"), steady("n_words")]
    return raw, weight


def chi_squared_quantile(p: float, k: int) -> float:
    """The Wilson-Hilferty approximation."""
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * (2 / (9 * k)) ** 0.5) ** 3


def consistency(share: float, k: int) -> float:
    """By how much the covariance of k normal variables exceeds that of their nearest ``share``; k is even."""
    half = chi_squared_quantile(share, k) / 2
    inner = 1 - exp(-half) * sum(half**i / factorial(i) for i in range(k // 2 + 1))
    return share / inner


def _distance() -> Column:
    """Squared Mahalanobis distance of x from mean under the flattened inverse."""
    d = [f"(x[{k}] - mean[{k}])" for k in range(_N)]
    return F.expr(" + ".join(f"{d[i]} * ({' + '.join(f'{1 if i == j else 2}D * inverse[{i * _N + j}] * {d[j]}' for j in range(i, _N))})" for i in range(_N)))


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """by, v: sums of the elements of v."""
    return rows.groupBy(*by).agg(F.expr(f"array({', '.join(f'sum(v[{k}])' for k in range(1 + _N + len(_UPPER)))})").alias("v"))


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    """by, v: the number of rows, the sums of x, and those of its products; first within each batch, then over all."""
    first, second = np.array(_UPPER).T
    names = [*by, "v"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = pa.table({c: batch.column(c) for c in by}).append_column("_row", pa.array(np.arange(batch.num_rows)))
        groups = keys.group_by(list(by)).aggregate([("_row", "list")])
        x = batch.column("x").flatten().to_numpy().reshape(-1, _N)
        v = np.zeros((groups.num_rows, 1 + _N + len(_UPPER)))
        for k, at in enumerate(groups.column("_row_list").to_pylist()):
            mine = x[at]
            v[k] = np.r_[len(at), mine.sum(axis=0), (mine.T @ mine)[first, second]]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
        return pa.record_batch([*(groups.column(c).combine_chunks() for c in by), lists], names)

    types = dict(rows.dtypes)
    return _sums(map_batches(rows.select(*by, "x"), run, ", ".join(f"{c} {types[c]}" for c in by) + ", v array<double>"), *by)


def _full(upper: np.ndarray) -> np.ndarray:
    """Symmetric matrices from their upper triangles."""
    out = np.zeros((len(upper), _N, _N))
    for k, (i, j) in enumerate(_UPPER):
        out[:, i, j] = out[:, j, i] = upper[:, k]
    return out


def estimated(own: np.ndarray, lang: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """mean and covariance of each group from (n, sums, scatter within groups) of it, its language and all."""
    parts = []
    for v in (every, lang, own):
        n, total, scatter = v[:, :1], v[:, 1 : 1 + _N], _full(v[:, 1 + _N :])
        if not parts:
            parts = [total / n, scatter / n[:, :, None]]
        else:
            parts = [(total + SHRINK * parts[0]) / (n + SHRINK), (scatter + SHRINK * parts[1]) / (n + SHRINK)[:, :, None]]
    mean, cov = parts
    at = np.arange(_N)
    diagonal = cov[:, at, at].copy()
    cov *= 1 - RIDGE  # no correlation is full
    cov[:, at, at] = np.maximum(diagonal, np.square(list(FLOORS.values())))
    return mean, cov


def _estimates(moments: DataFrame) -> DataFrame:
    """g, s, mean, inverse, logdet from the moments (g, lang_key, s, v) of each group."""

    within = [f"v[{1 + _N + k}] - v[{1 + i}] * v[{1 + j}] / v[0]" for k, (i, j) in enumerate(_UPPER)]
    own = moments.select("g", "lang_key", "s", F.expr(f"array({', '.join([f'v[{k}]' for k in range(1 + _N)] + within)})").alias("v"))
    joined = own.join(_sums(own, "lang_key", "s").withColumnRenamed("v", "of_lang"), ["lang_key", "s"]).join(_sums(own, "s").withColumnRenamed("v", "of_all"), "s")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                mean, cov = estimated(*(np.stack(pdf[c].to_list()) for c in ("v", "of_lang", "of_all")))
                yield pd.DataFrame({"g": pdf["g"], "s": pdf["s"], "mean": list(mean), "inverse": [m.ravel() for m in np.linalg.inv(cov)], "logdet": np.linalg.slogdet(cov)[1]})

    return joined.select("g", "s", "v", "of_lang", "of_all").mapInPandas(run, "g string, s int, mean array<double>, inverse array<double>, logdet double")


def _starts(fit: DataFrame) -> DataFrame:
    """g, s, mean, inverse: three scatters of each language, about its middle."""
    spread = fit.groupBy("lang_key").agg(F.array(*[F.greatest(1.4826 * F.percentile_approx(F.abs(F.col("x")[k]), 0.5, 1000), F.lit(f)) for k, f in enumerate(FLOORS.values())]).alias("sd"))
    spread = written(spread, "quality-spread")
    scaled = fit.join(spread, "lang_key").select("lang_key", F.array(*[F.col("x")[k] / F.col("sd")[k] for k in range(_N)]).alias("u"))
    size = F.greatest(F.sqrt(sum((F.col("u")[k] * F.col("u")[k] for k in range(_N)), F.lit(0.0))), F.lit(1e-9))
    both = scaled.select("lang_key", F.explode(F.array(F.struct(F.lit(1).alias("s"), F.transform("u", F.tanh).alias("x")), F.struct(F.lit(2).alias("s"), F.transform("u", lambda e: e / size).alias("x")))).alias("t")).select("lang_key", "t.*")
    made = _moments(both, "lang_key", "s").join(spread, "lang_key")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, s, v, sd in zip(pdf["lang_key"], pdf["s"], pdf["v"], pdf["sd"]):
                r = _full(np.array(v, float)[None, 1 + _N :])[0]
                scale = np.sqrt(np.maximum(np.diag(r), 1e-6 * v[0]))
                r = 0.9 * r / np.outer(scale, scale)
                np.fill_diagonal(r, 1.0)
                yield pd.DataFrame({"lang_key": [lang], "s": [s], "inverse": [np.linalg.inv(np.outer(sd, sd) * r).ravel()]})

    plain = spread.select("lang_key", F.lit(0).alias("s"), F.array(*[1 / F.pow(F.col("sd")[i], 2) if i == j else F.lit(0.0) for i in range(_N) for j in range(_N)]).alias("inverse"))
    starts = written(plain.unionAll(made.mapInPandas(run, "lang_key string, s int, inverse array<double>")), "quality-starts")
    return fit.select("g", "lang_key").distinct().join(starts, "lang_key").select("g", "s", F.array(*[F.lit(0.0)] * _N).alias("mean"), "inverse")


def _step(fit: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """The estimate of the nearest ``share`` of each group."""
    near = fit.join(estimate.select("g", "s", "mean", "inverse"), "g").select("g", "lang_key", "s", "x", _distance().alias("d"))
    cut = written(near.groupBy("g", "s").agg(F.percentile_approx("d", share, 2000).alias("cut")), "quality-cut")
    chosen = near.join(cut, ["g", "s"]).where("d <= cut")
    return written(_estimates(written(_moments(chosen, "g", "lang_key", "s"), "quality-moments")), "quality-estimate")


def _middles(rows: DataFrame) -> DataFrame:
    """key, middle: each language's medians, drawn towards those of all rows."""

    def medians() -> Column:
        return F.array(*[F.percentile_approx(F.col("raw")[k], 0.5, 1000) for k in range(_N)]).alias("median")

    of_all = rows.agg(medians()).select(F.col("median").alias("overall"))
    of_lang = rows.groupBy("lang_key").agg(F.count("*").alias("n"), medians()).crossJoin(F.broadcast(of_all))  # one row
    drawn = F.zip_with("median", "overall", lambda a, b: (F.col("n") * a + SHRINK * b) / (F.col("n") + SHRINK))
    return of_lang.select(F.col("lang_key").alias("key"), drawn.alias("middle"))


def judged(stats: DataFrame, *, share: float = SHARE, tail: float = TAIL) -> DataFrame:
    """The counts with g, x (the transformed statistics), distance, base_failed, kept."""
    lang, source = F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("-")), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    raw, weight = _raw()
    keyed = stats.withColumns({"base_failed": base_failed(), "raw": F.array(*raw), "lang_key": lang, "g": F.to_json(F.struct(lang.alias("l"), source.alias("s")))})
    middles = written(_middles(keyed.where("not base_failed")), "quality-middles")
    x = F.array(*[(F.col("raw")[k] - F.col("middle")[k]) * weight[k] for k in range(_N)])
    rows = keyed.join(middles, F.col("lang_key") == F.col("key"), "left").withColumn("x", x).drop("key", "raw", "middle")
    rows = written(rows, "quality-statistics")
    fit = rows.where("not base_failed").select("g", "lang_key", "x")

    estimate = written(_starts(fit), "quality-estimate")
    for _ in range(FIRST_STEPS):
        estimate = _step(fit, estimate, share)
    estimate = estimate.groupBy("g").agg(F.min_by(F.struct("mean", "inverse", "logdet"), F.struct("logdet", "s")).alias("e")).select("g", F.lit(0).alias("s"), "e.*")
    now = estimate.agg(F.avg("logdet")).first()[0]
    for _ in range(MOST_STEPS if now is not None else 0):
        estimate, before = _step(fit, estimate, share), now
        now = estimate.agg(F.avg("logdet")).first()[0]
        if before - now < 1e-3:
            break
    final = estimate.select(F.col("g").alias("g2"), "mean", "inverse")
    out = rows.join(final, F.col("g") == F.col("g2"), "left").withColumn("distance", _distance() / consistency(share, _N))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_squared_quantile(1 - tail, _N), F.lit(True))
    return out.withColumn("kept", verdict).drop("mean", "inverse", "g2", "lang_key")


def quality(docs: DataFrame, **columns: str) -> DataFrame:
    """Counts, statistics and verdict of every row."""
    return judged(written(text_counts(docs, **columns), "quality-counts"))
