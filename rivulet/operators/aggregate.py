"""Reducers of whole streams: timelines, scores, captions, histograms, box selection."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.ordered import numbered

TS, SEQ = "ts_us", "seq"


def timeline(changes: DataFrame, ends: DataFrame, keys: list[str], ts: str = TS, last: str = "last_us") -> DataFrame:
    """Intervals (seconds) between change points: from 0 to the first, ..., to the last time.

    Equal points give no empty interval; ``ends`` has each key's last time.
    """
    zero = ends.select(*keys, F.lit(0).cast("long").alias("p"))
    points = changes.select(*keys, F.col(ts).alias("p")).unionAll(zero).unionAll(ends.select(*keys, F.col(last).alias("p"))).distinct()
    bound = points.join(ends.select(*keys, F.col(last).alias("_last")), keys).where("p <= _last")
    w = Window.partitionBy(*keys).orderBy("p")
    return bound.withColumn("_next", F.lead("p").over(w)).where("_next > p").select(*keys, (F.col("p") / 1e6).alias("start"), (F.col("_next") / 1e6).alias("end"))


#: Bounds of the expected score, and its scale.
SCORE_LOW, SCORE_HIGH = 2.60, 7.42
#: Scale and shift of a raw quality.
RAW_SCALE, RAW_SHIFT = 9.8 - 1 / 9, 1 / 9


def expected_score(probabilities: Column) -> Column:
    """The mean class (from 1) of a distribution, clipped and put on a square-root scale of 0 to 100."""
    mean = F.aggregate(F.transform(probabilities, lambda p, i: p.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    clipped = F.least(F.lit(SCORE_HIGH), F.greatest(F.lit(SCORE_LOW), mean))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.sqrt((clipped - SCORE_LOW) / (SCORE_HIGH - SCORE_LOW)) * 100))


def score_mean(df: DataFrame, keys: list[str], probabilities: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg(expected_score(F.col(probabilities))), 2).alias("score"))


def quality_mean(df: DataFrame, keys: list[str], raw: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg(F.col(raw) * RAW_SCALE + RAW_SHIFT), 2).alias("quality"))


def caption_batches(df: DataFrame, keys: list[str], size: int, text: str, order: tuple[str, ...] = (TS, SEQ), *, spread: bool = False) -> DataFrame:
    """Frames in batches of ``size`` (the last may be short), ids from 1, texts in order."""
    rows = numbered(df, keys, order, "_rn", spread=spread).withColumn("batch_id", F.floor((F.col("_rn") - 1) / size + 1).cast("long"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", text))), lambda s: s[text]), " ")
    return rows.groupBy(*keys, "batch_id").agg(F.count("*").alias("frames"), texts.alias("description"))


def caption_summary(batches: DataFrame, keys: list[str], seconds: str | None = None) -> DataFrame:
    """Frames analysed, mean time a frame (4 places) and all descriptions in batch order."""
    parts = F.array_sort(F.collect_list(F.struct("batch_id", "description")))
    agg = [F.sum("frames").alias("frames_analysed"), F.array_join(F.transform(parts, lambda s: s["description"]), " ").alias("summary")]
    if seconds:
        agg.append(F.round(F.sum(seconds) / F.sum("frames"), 4).alias("average_inference"))
    return batches.groupBy(*keys).agg(*agg)


def evaluation_means(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Means of each measure and key, over rows in which no measure is null."""
    whole = df.dropna(subset=measures)
    return whole.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in measures])


def text_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def rouge1(candidate: Column, reference: Column) -> Column:
    """F-measure of the words two texts share, each as often as in both; 0 if either has none."""
    a, b = text_words(candidate), text_words(reference)
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    shared = F.aggregate(F.transform(F.array_intersect(a, b), lambda w: F.least(count(a, w), count(b, w))), F.lit(0), lambda s, n: s + n)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * shared / (F.size(a) + F.size(b)))


def bleu_of(candidate: list[str], reference: list[str], most: int = 4) -> float:
    """Geometric mean of clipped n-gram precisions up to ``most`` (0 if any is), times the brevity penalty."""
    logs = 0.0
    for n in range(1, most + 1):
        a, b = (Counter(zip(*(words[k:] for k in range(n)))) for words in (candidate, reference))
        shared, total = sum((a & b).values()), sum(a.values())
        if not shared:
            return 0.0
        logs += np.log(shared / total) / most
    return float(np.exp(logs + min(0.0, 1 - len(reference) / len(candidate))))


def meteor_of(candidate: list[str], reference: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """Weighted harmonic mean of exact word matches, less a penalty for the number of runs they come in (no stems or synonyms).

    Words are matched in order, each with its first free place.
    """
    free: dict[str, list[int]] = {}
    for k, w in reversed(list(enumerate(reference))):
        free.setdefault(w, []).append(k)
    places = [(k, free[w].pop()) for k, w in enumerate(candidate) if free.get(w)]
    if not places:
        return 0.0
    precision, recall = len(places) / len(candidate), len(places) / len(reference)
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(places, places[1:]))
    return precision * recall / (alpha * precision + (1 - alpha) * recall) * (1 - gamma * (chunks / len(places)) ** beta)


def text_scores(df: DataFrame, candidate: str, reference: str) -> DataFrame:
    """df with bleu, rouge1 and meteor of a text against another; null texts have no words."""

    def each(score):
        @F.pandas_udf("double")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([score(list(x), list(y)) for x, y in zip(a, b)], dtype=float)

        return run(text_words(F.col(candidate)), text_words(F.col(reference)))

    return df.withColumns({"bleu": each(bleu_of), "rouge1": rouge1(F.col(candidate), F.col(reference)), "meteor": each(meteor_of)})


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """Counts of rounded values from 0 to bins - 1 (clamped), with empty bins."""
    bin_no = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.round(value))).cast("int")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, bin_no.alias("bin")).agg(F.count("*").alias("n"))
    every = (df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counted, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def extent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.sum(value), 4).alias("sum"))


def module_stats(df: DataFrame, keys: list[str], duration: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("process_count"), F.sum(duration).alias("total_us"), F.floor(F.sum(duration) / F.count("*")).cast("long").alias("avg_us"), F.min(duration).alias("min_us"), F.max(duration).alias("max_us"))


def probe(df: DataFrame, keys: list[str], ts: str = TS) -> DataFrame:
    """First and last time, duration in seconds, frames, mean rate."""
    span = (F.max(ts) - F.min(ts)) / 1e6
    return df.groupBy(*keys).agg(F.min(ts).alias("first_us"), F.max(ts).alias("last_us"), span.alias("duration"), F.count("*").alias("frames"), F.round((F.count("*") - 1) / F.when(span > 0, span), 6).alias("fps"))


def keep_best(boxes: np.ndarray, scores: np.ndarray, most: float = 0.5) -> list[int]:
    """Greedy non-maximum suppression over (x1, y1, x2, y2), sides counted inclusively."""
    area = (boxes[:, 2] - boxes[:, 0] + 1) * (boxes[:, 3] - boxes[:, 1] + 1)
    order, kept = np.argsort(-scores, kind="stable"), []
    while len(order):
        best, order = order[0], order[1:]
        kept.append(int(best))
        low, high = np.maximum(boxes[best, :2], boxes[order, :2]), np.minimum(boxes[best, 2:], boxes[order, 2:])
        both = np.prod(np.maximum(0, high - low + 1), axis=1)
        order = order[both / (area[best] + area[order] - both) < most]
    return kept


def nms(df: DataFrame, most: float = 0.5, boxes: str = "boxes", scores: str = "scores") -> DataFrame:
    """df with ``kept``: indices of each frame's boxes that remain, best first."""

    @F.pandas_udf("array<int>")
    def select(b: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else keep_best(np.array([list(r) for r in x], float).reshape(-1, 4), np.array(y, float), most) for x, y in zip(b, s)])

    return df.withColumn("kept", select(boxes, scores))


def largest_free_rect(points: list[tuple[float, float]], width: float, height: float) -> tuple[float, float, float, float]:
    """The largest axis-parallel part of the frame with none of the points inside: (x1, y1, x2, y2)."""
    best = (0.0, (0.0, 0.0, 0.0, 0.0))
    todo = [(0.0, 0.0, width, height, list(points))]
    seen: set[tuple] = set()
    while todo:
        x1, y1, x2, y2, inside = todo.pop()
        area = (x2 - x1) * (y2 - y1)
        if area <= best[0] or (x1, y1, x2, y2) in seen:
            continue
        seen.add((x1, y1, x2, y2))
        inside = [p for p in inside if x1 < p[0] < x2 and y1 < p[1] < y2]
        if not inside:
            best = (area, (x1, y1, x2, y2))
            continue
        middle = ((x1 + x2) / 2, (y1 + y2) / 2)
        px, py = min(inside, key=lambda p: (p[0] - middle[0]) ** 2 + (p[1] - middle[1]) ** 2)
        parts = [(x1, y1, px, y2), (px, y1, x2, y2), (x1, y1, x2, py), (x1, py, x2, y2)]
        todo += [(*p, inside) for p in sorted(parts, key=lambda p: (p[2] - p[0]) * (p[3] - p[1]))]
    return best[1]


def free_rect(df: DataFrame, keys: list[str], x: str, y: str, width: float, height: float, ratio: float = 0.5) -> DataFrame:
    """Of each key's points: the largest free rectangle in shares of the frame, and whether it exceeds ``ratio`` of it."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys) + ", x1 double, y1 double, x2 double, y2 double, large boolean"

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, c, d = largest_free_rect(sorted(set(zip(pdf[x].astype(float), pdf[y].astype(float)))), width, height)
        return pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], a / width, b / height, c / width, d / height, (c - a) * (d - b) > ratio * width * height)])

    return df.select(*keys, x, y).groupBy(*keys).applyInPandas(find, schema)
