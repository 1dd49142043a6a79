"""Benchmark decontamination by the q-gram lemma.

Texts are reduced to their lower-cased letters and digits (UTF-8 bytes; Latin
letters with marks are lower-cased too).  Benchmark items are cut into segments of
``SEGMENT`` characters, one at every ``STEP``, so that part of an item is found as
well, wherever it begins: an excerpt of SEGMENT + STEP - 1 holds a whole segment.
Items of up to half as many again are also one segment as a whole.  A segment of m characters may differ from the document by k = EDITS * m
edits; then the two share at least t = m - q + 1 - k * q q-grams, whose diagonals
(place in the document less place in the item) lie within k of each other.  Bands
of 2 * BAND diagonals, each overlapping the next by half and BAND > k, hold all of
them: where a band has t distinct q-grams of a segment, banded alignment verifies.

Equal segments of one item count once.  Where documents and items share more than
``HITS`` (document place, item place) pairs, long periodic stretches of the documents
lose their middle, which changes no match as no match spans what stays of them; then
both sides are halved, with an overlap of what one match can span.  So texts and items
that repeat themselves take some time, not memory.

The q-gram index is made on the driver from blocks of the benchmark of about
``INDEX_BYTES`` each; a larger benchmark takes several passes over the documents.

Defined results: null and empty texts match nothing; items of fewer than
``MIN_ITEM`` letters and digits match whole and without an edit; those of fewer
than one q-gram, which are parts of most texts, match documents that hold nothing
else; items without a letter or digit match nothing; a null item_id or doc_id is
kept; repeated rows match as often as they come; an empty benchmark or table gives
no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.textbatch import covered, map_batches, map_parts, pick, runs, utf8

Q = 10
SEGMENT = 80
STEP = 8
EDITS = 0.075
BAND = 16
MIN_ITEM = 40
INDEX_BYTES = 8 << 20
_TABLE_BITS = 21
_DP = 2048  # alignments at once
HITS = 1 << 17
_PERIODS = 32

_MAP = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _MAP[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _MAP[_c] = _c + 32
_MAP[128:] = np.arange(128, 256)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def reduced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters and digits of UTF-8 bytes, and the place of each."""
    out = _MAP[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[upper] += 32
    at = np.flatnonzero(out)
    return out[at], at


def gram_hashes(chars: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes from each place on."""
    if len(chars) < Q:
        return np.zeros(0, np.uint64)
    n = len(chars) - Q + 1
    h, span, total, done = chars.astype(np.uint64), 1, None, 0
    while True:  # binary powers of the length
        if Q & span:
            part = h[done : done + n]
            total = part if total is None else total * _power(span) + part
            done += span
        if done == Q:
            return total * np.uint64(0xD1342543DE82EF95)
        h = h[:-span] * _power(span) + h[span:]
        span *= 2


@functools.cache
def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def squeezed(chars: np.ndarray, offsets: np.ndarray, keep: int) -> np.ndarray:
    """Places that stay when stretches of a period of up to _PERIODS keep ``keep`` characters at either end, and the rest of a period."""
    places = np.arange(len(chars))
    for p in range(1, _PERIODS + 1):
        now = chars[places]
        same = now[p:] == now[:-p]
        for edge in np.searchsorted(places, offsets[1:-1]).tolist():
            same[max(0, edge - p) : edge] = False
        steps = np.diff(np.r_[False, same, False].astype(np.int8))
        first, last = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        long = last - first > 2 * keep + p
        stays = np.ones(len(places), bool)
        for a, b in zip(first[long].tolist(), last[long].tolist()):
            stays[a + keep : a + keep + (b - a - 2 * keep) // p * p] = False
        places = places[stays]
    return places


class Index:
    """q-grams of a block of the benchmark, and its segments."""

    def __init__(self, items: list[bytes]):
        self.items = [reduced(np.frombuffer(t, np.uint8))[0] for t in items]
        segments, grams, owner, place = [], [], [], []
        for k, chars in enumerate(self.items):
            m = len(chars)
            if m < Q:
                continue
            mine = [(0, m)] if m < SEGMENT * 3 // 2 else []
            if m > SEGMENT:
                mine += [(a, a + SEGMENT) for a in [*range(0, m - SEGMENT, STEP), m - SEGMENT]]
            mine = sorted({chars[a:b].tobytes(): (a, b) for a, b in reversed(mine)}.values())
            segments += [(k, a, b) for a, b in mine]
            used = np.flatnonzero(covered(m, np.array([a for a, _ in mine]), np.array([b - a - Q + 1 for a, b in mine])))
            grams.append(gram_hashes(chars)[used])
            owner.append(np.full(len(used), k))
            place.append(used)
        self.short: dict[bytes, list[int]] = {}
        for k, chars in enumerate(self.items):
            if 0 < len(chars) < Q:
                self.short.setdefault(chars.tobytes(), []).append(k)
        self.segments = np.array(segments, np.int64).reshape(-1, 3)
        length = self.segments[:, 2] - self.segments[:, 1]
        self.longest = np.zeros(len(items), np.int64)
        np.maximum.at(self.longest, self.segments[:, 0], length)
        #: One match lies within its segment's length and the bands beside it.
        self.reach = int(self.longest.max(initial=0)) + 4 * BAND
        self.span = max(map(len, self.items), default=0) + 1
        self.begins = self.segments[:, 0] * self.span + self.segments[:, 1]
        self.budget = np.where(length < MIN_ITEM, 0, EDITS * length).astype(np.int64)
        self.least = np.maximum(1, length - Q + 1 - self.budget * Q)
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.owner, self.place = (np.concatenate(x)[order] if grams else np.zeros(0, np.int64) for x in (owner, place))
        base = np.r_[0, np.cumsum([len(c) for c in self.items])]
        self.letters = int(base[-1])
        self.values, self.start = np.unique(h[order], return_index=True)
        self.end = np.r_[self.start[1:], len(h)]
        #: q-gram and place among all letters of the block, ascending
        self.key = np.repeat(np.arange(len(self.values)), self.end - self.start) * (self.letters + 1) + base[self.owner] + self.place
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.values >> np.uint64(64 - _TABLE_BITS)] = True

    def _known(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose q-gram is in the index, the doc of each, and which q-gram it is."""
        h = gram_hashes(chars)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - _TABLE_BITS)])
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[doc + 1]
        at, doc = at[inside], doc[inside]
        k = np.searchsorted(self.values, h[at])
        k[k == len(self.values)] = 0
        real = self.values[k] == h[at] if len(self.values) else np.zeros(0, bool)
        return at[real], doc[real], k[real]

    def candidates(self, chars: np.ndarray, offsets: np.ndarray, known: tuple | None = None) -> Iterator[tuple[np.ndarray, ...]]:
        """doc, segment, least and largest diagonal of each band that meets its segment's bound, part by part."""
        at, doc, k = known or self._known(chars, offsets)
        if len(at):
            yield from self._parts(at, doc, k, 0, self.letters)

    def _parts(self, at: np.ndarray, doc: np.ndarray, k: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Candidates among the hits with item places (among all letters) from low to high."""
        start, end = self.start[k], self.end[k]
        if (low, high) != (0, self.letters):
            start, end = (np.searchsorted(self.key, k * (self.letters + 1) + x) for x in (low, high))
        longest, reach = int(self.longest.max(initial=0)), self.reach
        if (end - start).sum() > HITS:
            if at[-1] - at[0] > 4 * reach:
                middle = (at[0] + at[-1]) // 2
                for part in (at < middle + reach, at >= middle):
                    yield from self._parts(at[part], doc[part], k[part], low, high)
                return
            if high - low > 4 * longest:
                middle = (low + high) // 2
                yield from self._parts(at, doc, k, low, middle + longest)
                yield from self._parts(at, doc, k, middle, high)
                return
        some = end > start
        if some.any():
            yield self._bands(at[some], doc[some], start[some], (end - start)[some])

    def _bands(self, at: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        none = (np.zeros(0, np.int64),) * 4
        hit = np.repeat(np.arange(len(at)), n)
        occurrence = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        item, place, diagonal, doc = self.owner[occurrence], self.place[occurrence], at[hit] - self.place[occurrence], doc[hit]
        # by item and half band first: a band is two neighbouring halves
        half = (diagonal - diagonal.min()) // BAND + 1
        key = (doc * len(self.items) + item) * (half.max() + 2) + half
        values, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        near = np.zeros((2, len(values)), np.int64)
        joined = np.flatnonzero(values[1:] == values[:-1] + 1)
        near[0, joined + 1], near[1, joined] = count[joined], count[joined + 1]
        bound = np.full(len(self.items), np.iinfo(np.int64).max)
        np.minimum.at(bound, self.segments[:, 0], self.least)
        may = np.maximum(count + near[0], count + near[1])[inverse] >= bound[item]
        item, place, diagonal, doc, half = (x[may] for x in (item, place, diagonal, doc, half))
        if not len(item):
            return none
        # then by segment and whole band
        first = np.searchsorted(self.begins, item * self.span + np.maximum(0, place + Q - self.longest[item]))
        per = np.searchsorted(self.begins, item * self.span + place, "right") - first
        row = np.repeat(np.arange(len(item)), per)
        segment = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(first, per)
        within = (place[row] >= self.segments[segment, 1]) & (place[row] + Q <= self.segments[segment, 2])
        row, segment = row[within], segment[within]
        row, segment, band = np.r_[row, row], np.r_[segment, segment], np.r_[half[row], half[row] - 1]
        # a gram of the segment counts once in a band
        order = np.lexsort((place[row], band, segment, doc[row]))
        row, segment, band = row[order], segment[order], band[order]
        new_band = np.r_[True, (doc[row][1:] != doc[row][:-1]) | (segment[1:] != segment[:-1]) | (band[1:] != band[:-1])]
        new_gram = new_band | np.r_[True, place[row][1:] != place[row][:-1]]
        begin = np.flatnonzero(new_band)
        enough = np.add.reduceat(new_gram.astype(np.int64), begin) >= self.least[segment[begin]]
        low, high = np.minimum.reduceat(diagonal[row], begin), np.maximum.reduceat(diagonal[row], begin)
        return tuple(x[enough] for x in (doc[row][begin], segment[begin], low, high))

    def matches(self, chars: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """doc, item, start and end (in chars), segments and least edits of what is verified: one for each doc and item."""
        found: dict[tuple[int, int], tuple[int, int, set[int], int]] = {}
        whole, bounds, places = chars, offsets, None
        known = self._known(chars, offsets)
        if (self.end[known[2]] - self.start[known[2]]).sum() > HITS:
            places = squeezed(chars, offsets, 2 * self.reach)
            chars, offsets, known = chars[places], np.searchsorted(places, offsets), None
        for doc, segment, low, high in self.candidates(chars, offsets, known):
            for at in range(0, len(doc), _DP):
                to = slice(at, at + _DP)
                d, s = doc[to], segment[to]
                patterns = [self.items[k][x:y] for k, x, y in self.segments[s]]
                start, width = self.segments[s, 1] + low[to] - self.budget[s], high[to] - low[to] + 2 * self.budget[s] + 1
                edits, begin, end = align(patterns, chars, start, width, offsets[d], offsets[d + 1])
                for k in np.flatnonzero(edits <= self.budget[s]).tolist():
                    key = int(d[k]), int(self.segments[s[k], 0])
                    a, b, of, least = found.get(key, (int(begin[k]), int(end[k]), set(), int(edits[k])))
                    of.add(int(s[k]))
                    found[key] = min(a, int(begin[k])), max(b, int(end[k])), of, min(least, int(edits[k]))
        if places is not None:
            found = {key: (int(places[min(a, len(places) - 1)]), int(places[max(b, 1) - 1]) + 1, of, least) for key, (a, b, of, least) in found.items()}
        for d in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < Q)).tolist() if self.short else ():
            for item in self.short.get(whole[bounds[d] : bounds[d + 1]].tobytes(), ()):
                found[d, item] = int(bounds[d]), int(bounds[d + 1]), {-1}, 0
        return [(d, item, a, b, len(of), least) for (d, item), (a, b, of, least) in sorted(found.items())]


def align(patterns: list[np.ndarray], chars: np.ndarray, start: np.ndarray, width: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each pattern along ``width`` diagonals from ``start`` on, and where that match lies.

    Row by row over all patterns at once; column j of row i stands for the text
    place start + i + j, so that the array holds the band and nothing else.  Both
    ends in the text are free; places outside low:high equal no character.
    """
    n, m, j = len(patterns), np.array([len(p) for p in patterns]), np.arange(int(width.max()))
    lines = np.zeros((n, int(m.max())), np.uint8)
    for k, p in enumerate(patterns):
        lines[k, : len(p)] = p
    far = np.int64(1 << 30)
    outside = j[None] >= width[:, None]
    cost = np.where(outside, far, 0)
    begin = np.broadcast_to(j, cost.shape).copy()
    edits, where, ends = np.full(n, far), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(1, int(m.max()) + 1):
        at = start[:, None] + (i + j - 1)[None]
        text = np.where((at >= low[:, None]) & (at < high[:, None]), chars[np.clip(at, 0, len(chars) - 1)], 0)
        across = cost + (text != lines[:, i - 1, None])
        down = np.concatenate([cost[:, 1:], np.full((n, 1), far)], axis=1) + 1
        came = np.where(across <= down, begin, np.concatenate([begin[:, 1:], begin[:, -1:]], axis=1))
        best = np.minimum(across, down) - j[None]
        run = np.minimum.accumulate(best, axis=1)
        source = np.maximum.accumulate(np.where(best == run, j[None], 0), axis=1)
        cost = np.where(outside, far, np.minimum(run + j[None], far))
        begin = np.take_along_axis(came, source, 1)
        now = np.flatnonzero(m == i)
        if len(now):
            best_at = cost[now].argmin(axis=1)
            edits[now] = cost[now, best_at]
            where[now] = start[now] + begin[now, best_at]
            ends[now] = start[now] + i + best_at
    return edits, np.clip(where, low, high), np.clip(ends, low, high)


def _find(column: pa.Array, index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """row, item, start and end byte, matched segments, least edits: one for each row and item."""
    data, offsets = utf8(column)
    out: list = []
    for a, b in runs(offsets):
        chars, at = reduced(data[offsets[a] : offsets[b]])
        bounds = np.searchsorted(at, offsets[a : b + 1] - offsets[a])
        here = int(offsets[a])
        for doc, item, start, end, segments, edits in index.matches(chars, bounds):
            shift = here - int(offsets[a + doc])
            out.append((a + doc, item, shift + int(at[start]), shift + int(at[min(end, len(at)) - 1]) + 1, segments, edits))
    return out


@functools.lru_cache(maxsize=1)
def _index(packed: bytes) -> Index:
    lines = zlib.decompress(packed)
    items, at = [], 0
    while at < len(lines):
        n = int.from_bytes(lines[at : at + 8], "little")
        items.append(lines[at + 8 : at + 8 + n])
        at += 8 + n
    return Index(items)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, index_bytes: int) -> Iterator[tuple[list[int | None], bytes]]:
    """item ids and packed texts of blocks of about ``index_bytes`` each."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // index_bytes)
    for block in range(n):
        rows = sorted(((r.id, r.text) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == block).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        packed = b"".join(len(b := text.encode()).to_bytes(8, "little") + b for _, text in rows)
        yield [i for i, _ in rows], zlib.compress(packed)


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, start, end (code points of the text), segments matched, least edits: one row for each pair."""
    rows, schema = pick(docs, id_col, text_col), "doc_id long, item_id long, start long, end long, segments long, edits long"
    found = docs.sparkSession.createDataFrame([], schema)
    for ids, packed in _blocks(benchmark, item_col, item_text_col, index_bytes):

        def run(batch: pa.RecordBatch, ids: list[int | None] = ids, packed: bytes = packed) -> pa.RecordBatch:
            texts = batch.column("text")
            table = []
            for row, item, start, end, segments, edits in _find(texts, _index(packed)):
                text = texts[row].as_py().encode()
                table.append((batch.column("doc_id")[row].as_py(), ids[item], len(text[:start].decode(errors="ignore")), len(text[:end].decode(errors="ignore")), segments, edits))
            names = ["doc_id", "item_id", "start", "end", "segments", "edits"]
            return pa.record_batch([pa.array([r[k] for r in table], pa.int64()) for k in range(6)], names)

        found = found.unionAll(map_batches(rows, run, schema))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows, unchanged, that match no item."""
    for _, packed in _blocks(benchmark, item_col, item_text_col, index_bytes):

        def run(batch: pa.RecordBatch, packed: bytes = packed) -> pa.RecordBatch:
            keep = np.ones(batch.num_rows, bool)
            keep[[x[0] for x in _find(batch.column(text_col), _index(packed))]] = False
            return batch.filter(pa.array(keep))

        docs = map_parts(docs, run, docs.schema)
    return docs
