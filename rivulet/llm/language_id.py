"""Language identification by a byte convolutional network, trained in numpy.

A text is cut into windows of 256 bytes (its last one padded).  Filters of width
2, 3 and 4 slide over embedded bytes, each filter's maximum over the window is
kept, and a softmax over the languages follows; a text's probabilities are the
mean over all its windows.  For inference the embedding and the filters fold into
two tables indexed by pairs of bytes, so that a position costs two look-ups.

Training reads a bounded sample: at most about ``PER_LANG`` labelled rows of each
language (chosen by a hash of their id), fewer where there are so many languages
that this would exceed ``SAMPLE`` rows, and two excerpts of each row.  A language
of which no row is drawn can't be predicted.

Defined results: a null text or one without a letter is ``und`` with score 0, as
is every text if there is nothing to learn from; a null doc_id and repeated rows
keep their rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.shared_tables import written
from rivulet.llm.textbatch import kept, map_batches, map_parts, pick, runs, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
PER_LANG = 1500
SAMPLE = 60_000
EXCERPT = 400
#: About so many steps of 64 windows train the network.
STEPS = 1500
UNDETERMINED = "und"
_PAD = max(WIDTHS) - 1


class ByteCNN:
    """E: byte embeddings; conv[w]: filters (w, EMBED, FILTERS); W, b: the softmax layer."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.params = {"E": rng.normal(0, 0.5, (256, EMBED)), "W": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))), "b": np.zeros(len(langs)), "c": np.zeros(FILTERS * len(WIDTHS))}
        for w in WIDTHS:
            self.params[f"F{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS))
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """x: (n, WINDOW + _PAD) bytes; y: class indices."""
        p, n = self.params, len(x)
        emb = p["E"][x]
        pooled, where = [], []
        for w in WIDTHS:
            conv = sum(emb[:, k : k + WINDOW] @ p[f"F{w}"][k] for k in range(w))
            where.append(conv.argmax(axis=1))
            pooled.append(np.take_along_axis(conv, where[-1][:, None], 1)[:, 0])
        pre = np.concatenate(pooled, axis=1) + p["c"]
        hidden = np.maximum(pre, 0)
        prob = softmax(hidden @ p["W"] + p["b"])
        loss = float(-np.log(prob[np.arange(n), y] + 1e-9).mean())
        d = prob
        d[np.arange(n), y] -= 1
        d /= n
        g = {"W": hidden.T @ d, "b": d.sum(axis=0), "E": np.zeros_like(p["E"])}
        back = (d @ p["W"].T) * (pre > 0)
        g["c"] = back.sum(axis=0)
        rows = np.arange(n)[:, None]
        for j, w in enumerate(WIDTHS):
            db = back[:, j * FILTERS : (j + 1) * FILTERS]
            g[f"F{w}"] = np.zeros_like(p[f"F{w}"])
            for k in range(w):
                at = x[rows, where[j] + k]  # (n, FILTERS): the byte under tap k where each filter is largest
                g[f"F{w}"][k] = np.einsum("nfe,nf->ef", p["E"][at], db)
                np.add.at(g["E"], at, db[:, :, None] * p[f"F{w}"][k].T[None])
        return g, loss

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, size: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam; in each epoch about half of the windows are cut short at random."""
        rng = np.random.default_rng(seed)
        first, second, step = {k: 0.0 for k in self.params}, {k: 0.0 for k in self.params}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), size):
                rows = order[at : at + size]
                part = x[rows].copy()
                short = rng.integers(24, 2 * WINDOW, len(rows))
                part[np.arange(part.shape[1])[None] >= short[:, None]] = 0
                g, _ = self.gradients(part, y[rows])
                step += 1
                now = rate * (0.5 if epoch >= epochs * 2 // 3 else 1)
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.params[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """All filters' sums over the first two bytes of a position, and over the next two."""
        p, pair = self.params, np.zeros((256, 256, 2, FILTERS * len(WIDTHS)), np.float32)
        for j, w in enumerate(WIDTHS):
            to = slice(j * FILTERS, (j + 1) * FILTERS)
            for k in range(w):
                tap = p["E"] @ p[f"F{w}"][k]
                pair[:, :, k // 2, to] += tap[:, None] if k % 2 == 0 else tap[None]
        flat = pair.reshape(65536, 2, -1)
        return np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded windows (n, WINDOW + _PAD) of each row, and the row of each."""
    length = np.diff(offsets)
    per = -(-length // WINDOW)
    row = np.repeat(np.arange(len(length)), per)
    within = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[row] + within * WINDOW
    left = offsets[row + 1] - start
    padded = np.concatenate([data, np.zeros(WINDOW + _PAD, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + _PAD)[start]
    short = np.flatnonzero(left < WINDOW + _PAD)
    if len(short):
        out[short] = np.where(np.arange(WINDOW + _PAD)[None] < left[short, None], out[short], 0)
    return out, row


class Scorer:
    """Probabilities of whole texts from the folded tables."""

    BLOCK = 64

    def __init__(self, params: dict[str, np.ndarray], langs: tuple[str, ...]):
        self.net = ByteCNN(list(langs))
        self.net.params = params
        self.near, self.far = self.net.tables()

    def pooled(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.near.shape[1]), np.float32)
        pairs = (x[:, :-1].astype(np.intp) << 8) | x[:, 1:]
        for at in range(0, len(x), self.BLOCK):
            p = pairs[at : at + self.BLOCK]
            m = self.near[p[:, :WINDOW]]
            m += self.far[p[:, 2 : WINDOW + 2]]
            while m.shape[1] > 1:
                half = m.shape[1] // 2
                m = np.maximum(m[:, :half], m[:, half:])
            out[at : at + self.BLOCK] = m[:, 0]
        return out

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, langs); zero for empty rows."""
        p = self.net.params
        x, row = windows(data, offsets)
        prob = softmax(np.maximum(self.pooled(x) + p["c"], 0) @ p["W"] + p["b"])
        out = np.zeros((len(offsets) - 1, len(self.net.langs)))
        np.add.at(out, row, prob)
        return out / np.maximum(np.bincount(row, minlength=len(out)), 1)[:, None]


def _scorer(key: tuple) -> Scorer:
    """The tables are built once in a worker, not once in a task."""
    langs, packed = key
    return kept(("language_id", key), lambda: Scorer({k: np.frombuffer(v, np.float32).reshape(shape) for k, shape, v in packed}, langs))


def fit(docs: DataFrame, *, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, sample: int = SAMPLE) -> tuple | None:
    """A model from the rows for which ``train`` holds: (langs, parameters), or None without such rows.

    At most about ``per_lang`` rows of each language, and ``sample`` in all, and two excerpts of each come to the driver.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    per = F.least(F.lit(per_lang), F.lit(sample) / F.col("langs"))
    shares = counts.crossJoin(F.broadcast(counts.agg(F.count("*").alias("langs")))).select(F.col("lang").alias("_lang"), (per / F.col("n")).alias("share"))
    shares = written(shares, "languages")  # one row a language: of known size, so that texts are not shuffled to it
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = (F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.length("text") - EXCERPT, F.lit(1))) + 1).cast("int")
    drawn = rows.join(shares, F.col("lang") == F.col("_lang")).where(draw < F.col("share")).select("lang", F.array(F.substring("text", 1, EXCERPT), F.substr("text", place, F.lit(EXCERPT))).alias("parts"))
    found = sorted(drawn.collect())
    if not found:
        return None
    langs, parts, labels = sorted({r.lang for r in found}), [], []
    number = {lang: k for k, lang in enumerate(langs)}
    for r in found:
        parts += r.parts
        labels += [number[r.lang]] * 2
    encoded = [p.encode() for p in parts]
    x, row = windows(np.frombuffer(b"".join(encoded), np.uint8), np.r_[0, np.cumsum([len(e) for e in encoded])])
    net = ByteCNN(langs)
    net.train(x, np.array(labels)[row], epochs=min(60, max(4, STEPS * 64 // len(x))))
    return tuple(langs), tuple((k, v.shape, v.astype(np.float32).tobytes()) for k, v in net.params.items())


def _predict(column: pa.Array, model: tuple | None) -> tuple[list[str], np.ndarray]:
    data, offsets = utf8(column)
    n = len(offsets) - 1
    langs, score = [UNDETERMINED] * n, np.zeros(n)
    if model is None:
        return langs, score
    scorer = _scorer(model)
    values = column.to_pylist()
    for first, last in runs(offsets):
        prob = scorer.probabilities(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        for k, best in enumerate(prob.argmax(axis=1).tolist(), first):
            if values[k] and any(map(str.isalpha, values[k])):
                langs[k], score[k] = scorer.net.langs[best], min(1.0, float(prob[k - first, best]))
    return langs, score


def identify(docs: DataFrame, model: tuple | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, score = _predict(batch.column("text"), model)
        return pa.record_batch([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return map_batches(pick(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: tuple | None, *, text_col: str = "text", min_score: float = 0.4) -> DataFrame:
    """The rows, unchanged, whose language is determined with at least that score."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, score = _predict(batch.column(text_col), model)
        return batch.filter(pa.array([x != UNDETERMINED and s >= min_score for x, s in zip(langs, score)]))

    return map_parts(docs, run, docs.schema)
