"""Secret scan: three fixed patterns, and a token-efficiency test.

Random strings cost many tokens: a run of 20 or more token characters whose
characters per token under a public vocabulary are at most ``MAX_RATIO`` is a
secret of kind ``random``, unless it is a digest of a known length, a UUID, a
number or a date, or overlaps a pattern's span.  A run that passes as a whole, as
a readable name dilutes it, is tested in its parts between separators, of which
neighbours are joined; UUIDs and digests between separators divide a run.

Defined results: null and empty texts have no spans; a null doc_id and repeated
rows keep their rows; an empty table gives no rows; long texts are read whole.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.textbatch import map_batches, map_parts, pick, runs, utf8

KINDS = ["assign", "access", "hex", "random"]
N_BASE = 3
MIN_RANDOM = 20
MAX_RATIO = 1.9

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_UUID = re.compile(rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NUMBER = re.compile(rb"[0-9+/_=-]*")
_HEX = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
#: Parts of a run between separators, and those that may be a UUID or a digest.
_PART = re.compile(rb"[A-Za-z0-9]+")
_KNOWN = re.compile(rb"(?<![A-Za-z0-9])(?:" + _UUID.pattern + rb"|[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])")
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
_DIGESTS = {32, 40, 56, 64, 96, 128}


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_HEX_CHARS = _table(b"0123456789abcdef")
_TOKEN_CHARS = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


@functools.cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _tokens(run: bytes, vocabulary: str) -> int:
    return len(_encoding(vocabulary).encode_ordinary(run.decode("ascii")))


def chars_per_token(run: bytes, vocabulary: str) -> float:
    return len(run) / _tokens(run, vocabulary)


def _known(run: bytes) -> bool:
    """A number or date, a UUID, or a digest."""
    return bool(_NUMBER.fullmatch(run) or _UUID.fullmatch(run) or (len(run) in _DIGESTS and _HEX.fullmatch(run)))


def _stretches(parts: list[tuple[int, int, float]]) -> Iterator[tuple[int, int]]:
    """start and end of each maximal scoring stretch of (start, end, score), by Ruzzo and Tompa."""
    found: list[tuple[float, float, int, int, int]] = []  # score before, score up to the end, start, end, last one that began lower
    total = 0.0
    for x, y, score in parts:
        low, total = total, total + score
        if score <= 0:
            continue
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][0] >= low:
                k = found[k][4]
            if k < 0 or found[k][1] >= total:
                break
            low, x = found[k][0], found[k][2]
            del found[k:]
            k -= 1
        found.append((low, total, x, y, k))
    yield from (f[2:4] for f in found)


def _random_parts(run: bytes, vocabulary: str) -> Iterator[tuple[int, int, float]]:
    """start, end and ratio of what fails the token-efficiency test in a run: what lies
    between UUIDs and digests, or else stretches of its parts, each of which counts what
    its tokens are worth at ``MAX_RATIO`` less its characters."""
    known = [m.span() for m in _KNOWN.finditer(run) if _known(m[0])]
    for a, b in zip([0, *(y for _, y in known)], [*(x for x, _ in known), len(run)]):
        whole = run[a:b]
        if len(whole) < MIN_RANDOM or _NUMBER.fullmatch(whole):
            continue
        ratio = chars_per_token(whole, vocabulary)
        if ratio <= MAX_RATIO:
            yield a, b, ratio
            continue
        parts = [(*m.span(), MAX_RATIO * _tokens(m[0], vocabulary) - len(m[0])) for m in _PART.finditer(whole)]
        for x, y in _stretches(parts):
            if y - x >= MIN_RANDOM and not _NUMBER.fullmatch(whole[x:y]) and (ratio := chars_per_token(whole[x:y], vocabulary)) <= MAX_RATIO:
                yield a + x, a + y, ratio


def _class_runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """row, start and end (in the row) of each maximal run of the table's bytes, from that length."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    keep = ends - starts >= least
    starts, ends = starts[keep], ends[keep]
    rows = np.searchsorted(offsets, starts, "right") - 1
    yield from zip(rows.tolist(), (starts - offsets[rows]).tolist(), (ends - offsets[rows]).tolist())


def find(column: pa.Array, vocabulary: str) -> dict[int, tuple[bytes, list[tuple[int, int, int, float | None]]]]:
    """For each row with spans: its text, and (start, kind, end, ratio) in bytes, in order."""
    data, offsets = utf8(column)
    found: dict[int, list] = {}
    kept: dict[int, bytes] = {}
    for first, last in runs(offsets):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        whole = part.tobytes()
        for k in range(last - first):
            text = whole[at[k] : at[k + 1]]
            spans = []
            if b"=" in text or b":" in text:
                spans += [(m.start(), 0, m.end(), None) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
            if b"AKIA" in text:
                spans += [(m.start(), 1, m.end(), None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
            if spans:
                found[first + k], kept[first + k] = spans, text
        for k, a, b in _class_runs(part, at, _HEX_CHARS, 24):
            found.setdefault(first + k, []).append((a, 2, b, None))
            kept[first + k] = whole[at[k] : at[k + 1]]
        for k, a, b in _class_runs(part, at, _TOKEN_CHARS, MIN_RANDOM):
            for x, y, ratio in _random_parts(whole[at[k] + a : at[k] + b], vocabulary):
                x, y = a + x, a + y
                if not any(p < y and x < q for p, _, q, _ in found.get(first + k, ())):
                    found.setdefault(first + k, []).append((x, 3, y, ratio))
                    kept[first + k] = whole[at[k] : at[k + 1]]
    return {k: (kept[k], sorted(v, key=lambda s: s[:3])) for k, v in found.items()}


_SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("secret", T.StringType()), T.StructField("chars_per_token", T.DoubleType())]),
)
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string()), ("chars_per_token", pa.float64())]))


def secret_spans(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans of every row (code points, end exclusive), by start, then kind."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for row, (text, spans) in find(batch.column("text"), vocabulary).items():
            follow = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)]
            out[row] = [{"kind": KINDS[k], "start": a - int(follow[a]), "end": b - int(follow[b]), "secret": text[a:b].decode(), "chars_per_token": r} for a, k, b, r in spans]
        return pa.record_batch([batch.column("doc_id"), pa.array(out, _ARROW_SPANS)], ["doc_id", "secrets"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("secrets", _SPANS)])
    return map_batches(pick(docs, id_col, text_col), run, schema)


def redacted(docs: DataFrame, vocabulary: str, *, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each secret replaced by ``mark``; chars_col follows, if there is one."""
    fields = docs.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find(batch.column(text_col), vocabulary)
        if not found:
            return batch
        out = batch.column(text_col).to_pylist()
        for row, (text, spans) in found.items():
            parts, at = [], 0
            for a, _, b, _ in spans:
                if b > at:
                    parts += [text[at:a].decode(), mark] if a >= at else []
                    at = b
            out[row] = "".join(parts) + text[at:].decode()
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        columns[text_col] = pa.array(out, batch.schema.field(text_col).type)
        return pa.record_batch(list(columns.values()), names=list(columns))

    cleaned = map_parts(docs, run, fields)
    if chars_col in fields.names:
        cleaned = cleaned.withColumn(chars_col, F.length(text_col).cast(fields[chars_col].dataType))
    return cleaned
