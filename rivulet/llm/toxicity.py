"""Toxicity: a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two strings is the gap-weighted subsequence kernel: each triple of
letters in order, with up to three letters between them, counts DECAY to the
power of its span; kernels are normalised.  Strings are the parts of a sentence
that can be an insult: its words without their marks (so that marks put into a
word do not hide it), inner digits read as the letters they stand for, and runs
of single letters read as one word.

Labels are of documents, so learning is multiple-instance: of the sentences of a
document labelled toxic, some string is the insult.  Parts of four to six letters
(with the word's beginning) are chosen one after the other that toxic documents hold far more
often than chance would have it, in strings that no chosen part explains.  Strings
of toxic documents with such a part are positive.  Negative ones are strings of clean documents, the highest scoring of
them first.  Landmarks are chosen among both by pivoted Cholesky steps on the kernel;
a squared-hinge SVM is fitted to the Nyström features by Newton steps.  Kernel
and weights fold into one table over triples, so a string costs a sum of look-ups
and its own norm.  A text's score is a logistic function of its highest string,
the mean of its ``TOP`` highest, and the number of its strings.

Fitting reads a bounded sample: at most about ``SAMPLE`` labelled documents of
each class, of at most ``SAMPLE_CHARS`` characters.  Scores read whole texts.

Defined results: null and empty texts have the score of a text without strings;
without labels of both classes every score is 0; a null doc_id and repeated rows
keep their rows; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.textbatch import map_batches, pick, texts

DECAY = 0.7
REACH = 5  # from the first to the last letter of a triple
LANDMARKS = 64  # of either class
ROUNDS = 3
#: Parts that chance alone may choose, and their lengths.
CHANCE = 1.0
PARTS = (4, 5, 6)
TOP = 3
SAMPLE = 1500
SAMPLE_CHARS = 6000
PIECE = 24  # letters of a longer word that are looked at together
MEMO = 500_000
_N = 60  # letters of Latin-1, lower case, and 0
_GAPS = [(a, b) for b in range(2, REACH + 1) for a in range(1, b)]
_WEIGHTS = np.array([DECAY ** (b + 1) for _, b in _GAPS])
_SENTENCE = re.compile(rb"[.!?\n]+")
_INNER = str.maketrans("013457@$", "oieastas")
_ALPHABET = "abcdefghijklmnopqrstuvwxyz\xdfàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_CODE = np.zeros(256, np.int32)
_CODE[np.frombuffer(_ALPHABET.encode("latin-1"), np.uint8)] = np.arange(1, len(_ALPHABET) + 1)
_EDGE = re.compile(f"^[^{_ALPHABET}]+|[^{_ALPHABET}]+$")
_OTHER = re.compile(f"[^{_ALPHABET}]")
_SPELLED = re.compile(rb"(?:(?<=\s)|^)[A-Za-z][^\sA-Za-z\x80-\xff]?(?:\s+[A-Za-z][^\sA-Za-z\x80-\xff]?){2,}(?=\s|$)")


def letters(word: bytes) -> str:
    """A word's letters: marks dropped, inner digits read as letters, other scripts by their base letter if it is Latin."""
    s = word.decode(errors="ignore").lower()
    if _OTHER.search(s):
        s = "".join(c if c in _ALPHABET else unicodedata.normalize("NFKD", c)[:1] for c in s) if not s.isascii() else s
        s = _OTHER.sub("", _EDGE.sub("", s).translate(_INNER))
    return s


def spelled(text: bytes) -> list[bytes]:
    """Runs of three or more single letters, without what lies between them."""
    return [re.sub(rb"[^A-Za-z]", b"", m[0]) for m in _SPELLED.finditer(text)]


def strings_of(text: bytes) -> list[bytes]:
    return text.split() + spelled(text)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as 1 to 26, padded with 0, in pieces of PIECE that overlap by half; and each piece's string."""
    pieces, owner = [], []
    for k, s in enumerate(strings):
        for a in range(0, max(1, len(s) - PIECE // 2), PIECE // 2) if len(s) > PIECE else (0,):
            pieces.append(s[a : a + PIECE])
            owner.append(k)
    out = np.zeros((len(pieces), PIECE + REACH), np.int32)
    flat = _CODE[np.frombuffer("".join(pieces).encode("latin-1"), np.uint8)]
    n = np.array([len(p) for p in pieces])
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out, np.array(owner, np.int64)


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse feature vectors of unit length: row, triple, value."""
    row, triple, weight = [], [], []
    width = codes.shape[1] - REACH
    for (a, b), w in zip(_GAPS, _WEIGHTS):
        r, c = np.nonzero(codes[:, b : b + width])
        row.append(r)
        triple.append(codes[r, c] * (_N * _N) + codes[r, c + a] * _N + codes[r, c + b])
        weight.append(np.full(len(r), w))
    key, at = np.unique(np.concatenate(row) * _N**3 + np.concatenate(triple), return_inverse=True)
    value = np.bincount(at, np.concatenate(weight), minlength=len(key))
    row = key // _N**3
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(codes)))
    return row, key % _N**3, value / norm[row]


class Landmarks:
    """Feature vectors of chosen strings over the triples that occur in them."""

    def __init__(self, codes: np.ndarray):
        row, triple, value = features(codes)
        self.triples, at = np.unique(triple, return_inverse=True)
        self.place = np.full(_N**3, len(self.triples), np.int64)
        self.place[self.triples] = np.arange(len(self.triples))
        self.dense = np.zeros((len(self.triples) + 1, len(codes)))  # the last line is for other triples
        self.dense[at, row] = value

    def kernel(self, codes: np.ndarray) -> np.ndarray:
        """The kernel of each string with each landmark."""
        out = np.zeros((len(codes), self.dense.shape[1]))
        for a in range(0, len(codes), 256):
            row, triple, value = features(codes[a : a + 256])
            if len(row):
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                out[a + row[starts]] = np.add.reduceat(self.dense[self.place[triple]] * value[:, None], starts, axis=0)
        return out


def pivots(codes: np.ndarray, most: int) -> np.ndarray:
    """Indices of the strings whose span, in turn, explains most of what is left of the kernel."""
    k = Landmarks(codes).kernel(codes)
    left, chosen, basis = np.diag(k).copy(), [], np.zeros((0, len(k)))
    for _ in range(min(most, len(k))):
        best = int(left.argmax())
        if left[best] < 1e-3:
            break
        line = (k[best] - basis[:, best] @ basis) / np.sqrt(left[best])
        basis = np.vstack([basis, line])
        left = np.maximum(left - line**2, 0)
        chosen.append(best)
    return np.array(chosen, np.int64)


def svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 20) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last weight is the bias."""
    x = np.c_[z, np.ones(len(z))]
    keep = np.full(x.shape[1], ridge * weight.sum() / len(weight))
    keep[-1] *= 1e-3
    w, active = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(steps):
        xa, ca = x[active], weight[active]
        w = np.linalg.solve(xa.T @ (xa * ca[:, None]) / len(x) + np.diag(keep), xa.T @ (ca * y[active]) / len(x))
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


class Model:
    """table: margin of each triple; bias; logistic: weights of a text's summary, and a shift."""

    def __init__(self, table: np.ndarray, bias: float, logistic: tuple[float, ...] = ()):
        self.table, self.bias, self.logistic = table, bias, np.array(logistic)

    def margins(self, strings: list[str]) -> np.ndarray:
        out = np.full(len(strings), -1.0)
        for a in range(0, len(strings), 4096):
            codes, owner = _codes(strings[a : a + 4096])
            row, triple, value = features(codes)
            margin = np.bincount(row, self.table[triple] * value, minlength=len(codes)) + self.bias
            margin[np.bincount(row, minlength=len(codes)) == 0] = -1.0
            np.maximum.at(out[a : a + 4096], owner, margin)
        return out

    def score(self, summaries: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summaries @ self.logistic[:-1] + self.logistic[-1], -30, 30)))


def summary(margins: np.ndarray) -> tuple[float, float, float]:
    """The highest margin, the mean of the TOP highest (short texts: as if followed by -1), and the size."""
    n = len(margins)
    top = np.partition(margins, n - TOP)[n - TOP :] if n > TOP else margins
    return float(top.max(initial=-1.0)), float((top.sum() - (TOP - len(top))) / TOP), float(np.log1p(n) / 5)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights and shift by Newton steps; targets are drawn in a little, as Platt does."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, p = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    ridge = 0.005 * np.eye(len(p))
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(a @ p, -30, 30)))
        step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + ridge, a.T @ (t - q) - ridge @ p)
        p += np.clip(step, -3, 3)
    return tuple(map(float, p))


def typical_parts(parts: list[list[str]], held: list[np.ndarray], in_clean: np.ndarray, n_clean: int, most: int = 200) -> set[str]:
    """Parts that, in turn, are most typical of strings of the toxic documents ``held``.

    A part that k toxic and c clean documents hold is as typical as it would be
    unlikely if documents held it whatever their label: at most exp(-n KL(k/n, p)),
    n = k + c, p the share of toxic ones (Chernoff).  All parts are tried, so this has
    to be under CHANCE by their number.  A string that a chosen part explains no
    longer counts.
    """
    number: dict[str, int] = {}
    lists = [np.array([number.setdefault(p, len(number)) for p in ps], np.int64) for ps in parts]
    size = np.array([len(x) for x in lists])
    against = np.bincount(np.concatenate(lists), np.repeat(in_clean, size), minlength=len(number))
    pairs = [np.unique(h) for h in held]
    string = np.concatenate(pairs)
    doc = np.repeat(np.repeat(np.arange(len(held)), [len(p) for p in pairs]), size[string])
    part = np.concatenate([lists[k] for k in string.tolist()])
    string = np.repeat(string, size[string])
    share, names, chosen = len(held) / (len(held) + n_clean), list(number), set()
    least = np.log(len(number) / CHANCE)
    for _ in range(most):
        k = np.bincount(np.unique(part * len(held) + doc) // len(held), minlength=len(number))
        n = k + against
        mine = k / np.maximum(n, 1)
        odds = k * np.log(np.maximum(mine, 1e-300) / share) + against * np.log(np.maximum(1 - mine, 1e-300) / (1 - share))
        typical = np.where(mine > share, odds, 0)
        best = int(typical.argmax())
        if typical[best] < least:
            break
        chosen.add(names[best])
        alive = ~np.isin(string, np.unique(string[part == best]))
        doc, part, string = doc[alive], part[alive], string[alive]
    return chosen


def train(docs: list[tuple[bytes, int]], seed: int = 5) -> Model | None:
    """From texts and labels (1: toxic); None without both classes."""
    docs = sorted(set(docs))
    labels = np.array([y for _, y in docs])
    if labels.min(initial=1) == labels.max(initial=0):
        return None
    held: list[list[str]] = []
    for text, _ in docs:
        sentences = _SENTENCE.split(text)
        held.append([s for part in sentences for w in strings_of(part) if len(s := letters(w)) > 2])
    names = sorted({s for h in held for s in h})
    number = {s: k for k, s in enumerate(names)}
    held_at = [np.array([number[s] for s in h], np.int64) for h in held]
    in_clean = np.zeros(len(names))
    for h, y in zip(held_at, labels):
        in_clean[np.unique(h)] += y == 0
    parts = [sorted({t[k : k + n] for n in PARTS for k in range(len(t) - n + 1)}) for t in (f"^{s}" for s in names)]
    typical = typical_parts(parts, [h for h, y in zip(held_at, labels) if y and len(h)], in_clean, int((labels == 0).sum()))
    count = Counter(k for h, y in zip(held_at, labels) if y for k in set(h.tolist()))
    positive = np.array([k for k, _ in count.most_common() if in_clean[k] == 0 and not typical.isdisjoint(parts[k])][:4000], np.int64)
    negatives = np.flatnonzero(in_clean > 0)
    if not len(positive) or not len(negatives):
        return None
    margin = np.array([0.0 if typical.isdisjoint(ps) else 1.0 for ps in parts])
    rng = np.random.default_rng(seed)
    codes_of = lambda at: _codes([names[k][:PIECE] for k in at])[0]
    frequency = np.array([count[k] for k in positive.tolist()], float)
    for _ in range(ROUNDS):
        order = negatives[np.argsort(-margin[negatives], kind="stable")]
        negative = np.r_[order[:3000], rng.choice(order[3000:], min(3000, len(order[3000:])), replace=False)]
        pool = negative[:: max(1, len(negative) // 800)]
        marks = np.r_[positive[:800][pivots(codes_of(positive[:800]), LANDMARKS)], pool[pivots(codes_of(pool), LANDMARKS)]]
        land = Landmarks(codes_of(marks))
        values, vectors = np.linalg.eigh(land.dense.T @ land.dense)
        root = vectors / np.sqrt(np.maximum(values, 1e-6))
        at = np.r_[positive, negative]
        y = np.where(np.arange(len(at)) < len(positive), 1.0, -1.0)
        weight = np.r_[frequency * len(at) / (2 * frequency.sum()), np.full(len(negative), len(at) / (2 * len(negative)))]
        w = svm(land.kernel(codes_of(at)) @ root, y, weight)
        table = np.zeros(_N**3)
        table[land.triples] = (land.dense @ (root @ w[:-1]))[:-1]
        model = Model(table, float(w[-1]))
        margin = model.margins(names)
    model.logistic = np.array(_logistic(np.array([summary(margin[h]) for h in held_at]), labels))
    return model


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> tuple | None:
    """A model from the labels for which ``train_rows`` (over a column ``id``) holds.

    About ``sample`` documents of each class, of at most ``sample_chars``
    characters, come to the driver.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(train_rows & F.col("y").isin(0, 1))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(draw < F.when(F.col("y") == 1, min(1.0, sample / counts[1])).otherwise(min(1.0, sample / counts[0]))).limit(4 * sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= sample_chars)
    found = rows.join(F.broadcast(chosen), "id").select("text", "y").collect()
    model = train([(r.text.encode(), r.y) for r in found])
    return model and (model.table.astype(np.float32).tobytes(), model.bias, tuple(model.logistic.tolist()))


@functools.lru_cache(maxsize=1)
def _loaded(key: tuple) -> tuple[Model, dict[bytes, float]]:
    return Model(np.frombuffer(key[0], np.float32).astype(float), *key[1:]), {}


def score_texts(docs: list[bytes], key: tuple) -> tuple[np.ndarray, list[str | None]]:
    """The score of each text, and its most toxic string."""
    model, memo = _loaded(key)
    summaries, term = np.zeros((len(docs), 3)), [None] * len(docs)
    for a in range(0, len(docs), 256):
        split = [strings_of(t) for t in docs[a : a + 256]]
        if len(memo) > MEMO:
            memo.clear()
        new = list(set().union(*split).difference(memo))
        reads = [letters(w) for w in new]
        some = [k for k, s in enumerate(reads) if len(s) > 2]
        memo.update(dict.fromkeys(new, -1.0))
        memo.update(zip([new[k] for k in some], model.margins([reads[k] for k in some]).tolist()))
        for k, words in enumerate(split, a):
            margins = np.fromiter(map(memo.__getitem__, words), float, len(words))
            summaries[k] = summary(margins)
            if words:
                term[k] = letters(words[int(margins.argmax())])
    return model.score(summaries), term


def scored(docs: DataFrame, model: tuple | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, term (the string it rests on) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if model is None:
            score, term = np.zeros(batch.num_rows), [None] * batch.num_rows
        else:
            score, term = score_texts(texts(batch.column("text")), model)
        return pa.record_batch([batch.column("doc_id"), pa.array(score), pa.array(term, pa.string())], ["doc_id", "score", "term"])

    return map_batches(pick(docs, id_col, text_col), run, "doc_id long, score double, term string")
