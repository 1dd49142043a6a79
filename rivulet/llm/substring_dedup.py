"""Substring deduplication by relative Lempel-Ziv factors over indexed blocks.

A window is ``WINDOW`` consecutive words of one document; a word goes when a
window that covers it also begins in a document with a smaller id.

Blocks.  A window's anchor is its least hashed ``GRAM``-word phrase, so equal
windows have equal anchors at equal places.  The windows of one document that
share an anchor occurrence form a block (the words from its first window to its
last); blocks tile a document's windows.  All blocks are indexed by anchor, and
the reference block of a content is the one of the least document id.

Factors.  A document is factored against every reference block that its anchors
name: a block equal to a reference block of an earlier document is one factor,
taken whole, however many documents hold it.  Only where a factor ends inside a
block (at the edges of a shared passage, and around edits) does a block differ
from every earlier one of its anchor: there, at the factor boundaries, the
windows themselves are compared, between the distinct contents of that anchor.

Volume.  About one block in 20 words is made, and what is shuffled first is its
anchor and document id.  Bitmaps of fixed size, ``FILTER_BITS``, let later scans
drop blocks whose anchor lies in one document, or whose windows nobody compares;
a full bitmap drops less and changes no result.  Frequent blocks are combined
before each shuffle, and anchors of more than ``LOCAL`` contents are compared by
window hash, not in one group.  Hashes have 64 bits.

Defined results: null and empty texts have no words; rows without an id lose
nothing and are no reference; repeated rows share one id, so neither removes
from the other; rows of one id and different texts are judged each by its text;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.shared_tables import written
from rivulet.llm.textbatch import Words, covered, map_batches, mix, pick, runs, utf8

WINDOW = 50
GRAM = 10
FILTER_BITS = 1 << 27
LOCAL = 1000
_CHUNK = 1 << 19  # bits of the filter in one row


class Blocks:
    """The blocks of a run of documents: row, anchor, content, first (word in its document), n (windows)."""

    def __init__(self, words: Words):
        self.words = words
        starts = words.windows(WINDOW)
        if not len(starts):
            self.row = self.first = self.n = self._at = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.uint64)
            return
        at = np.arange(len(words.start) - GRAM + 1)
        grams = words.grams(at, at + GRAM)
        place = least_places(grams, WINDOW - GRAM + 1)[starts]
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
        self._at, self.n = starts[new], np.diff(np.r_[new, len(starts)])
        self.row = words.doc[self._at]
        self.first = self._at - words.first[self.row]
        anchor = place[new]
        self.anchor = grams[anchor]
        self.content = mix(words.grams(self._at, self._at + self.n + WINDOW - 1) + (anchor - self._at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window hashes of the chosen blocks, one after the other, and offsets of each block's."""
        offsets = np.r_[0, np.cumsum(self.n[of])]
        at = np.repeat(self._at[of] - offsets[:-1], self.n[of]) + np.arange(offsets[-1])
        return self.words.grams(at, at + WINDOW), offsets


def least_places(values: np.ndarray, size: int) -> np.ndarray:
    """For each full window of ``size`` values, where its least value is (the first of equals)."""
    place, span = np.arange(len(values), dtype=np.int32), 1
    while span < size:
        step = min(span, size - span)
        left = values[:-step] <= values[step:]
        place = np.where(left, place[:-step], place[step:])
        values = np.minimum(values[:-step], values[step:])
        span += step
    return place


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _in_filter(keys: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    if bits is None:
        return np.ones(len(keys), bool)
    at = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.intp)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _key(anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    return anchor ^ (content * np.uint64(0x9E3779B97F4A7C15))


def _scan(rows: DataFrame, filled: Broadcast | None, what: str) -> DataFrame:
    """Blocks of all documents: "anchors" of each, whole "blocks" by anchor filter, or "windows" by key filter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if filled is None else np.frombuffer(filled.value, np.uint8)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            hashes = batch.column("text_hash").to_numpy()
            for a, b in runs(offsets):
                blocks = Blocks(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                if what == "anchors":
                    # once for each document and run
                    pairs = np.unique(np.stack([blocks.anchor.view(np.int64), ids[a:b][blocks.row]]), axis=1) if len(blocks.row) else np.zeros((2, 0), np.int64)
                    yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["anchor", "doc_id"])
                elif what == "blocks":
                    of = np.flatnonzero(_in_filter(blocks.anchor, bits))
                    row = blocks.row[of]
                    yield pa.record_batch(
                        [_signed(blocks.anchor[of]), _signed(blocks.content[of]), pa.array(ids[a:b][row]), pa.array(hashes[a:b][row]), pa.array(blocks.first[of].astype(np.int32)), pa.array(blocks.n[of].astype(np.int32))],
                        ["anchor", "content", "doc_id", "text_hash", "first", "n"],
                    )
                else:
                    key = _key(blocks.anchor, blocks.content)
                    _, of = np.unique(key, return_index=True)
                    of = of[_in_filter(key[of], bits)]
                    found, at = blocks.windows(of)
                    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), _signed(found))
                    yield pa.record_batch([_signed(blocks.anchor[of]), _signed(blocks.content[of]), lists], ["anchor", "content", "windows"])

    schema = {"anchors": "anchor long, doc_id long", "blocks": "anchor long, content long, doc_id long, text_hash long, first int, n int", "windows": "anchor long, content long, windows array<long>"}
    return rows.mapInArrow(run, schema[what])


def _filter_of(keys: DataFrame, key: Column, bits: int) -> Broadcast:
    """A bitmap of fixed size with a bit for each key; made in pieces on the executors."""
    at = keys.select(key.bitwiseAND(F.lit(bits - 1)).alias("at")).distinct()

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(min(_CHUNK, bits), bool)
        part[pdf["at"].to_numpy() % len(part)] = True
        return pd.DataFrame({"piece": [int(pdf["at"].iloc[0]) // len(part)], "bits": [np.packbits(part, bitorder="little").tobytes()]})

    whole = np.zeros(bits // 8, np.uint8)
    size = min(_CHUNK, bits) // 8
    for r in at.groupBy(F.floor(F.col("at") / min(_CHUNK, bits)).alias("p")).applyInPandas(piece, "piece long, bits binary").toLocalIterator():
        whole[r.piece * size : (r.piece + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole.tobytes())


def _repeated_here(batch: pa.RecordBatch) -> pa.RecordBatch:
    """For complete anchors: a mask of each content's windows that an earlier document's content has."""
    contents = batch.column("contents").flatten()
    per = np.diff(batch.column("contents").offsets.to_numpy())
    anchor = np.repeat(batch.column("anchor").to_numpy(), per)
    least, content, lists = (contents.field(k) for k in ("least", "content", "windows"))
    least, n = least.to_numpy(), np.diff(lists.offsets.to_numpy())
    found = lists.flatten().to_numpy()
    owner = np.repeat(np.arange(len(n)), n)
    bit = np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((least[owner], found))
    new = np.r_[True, found[order][1:] != found[order][:-1]] if len(found) else np.zeros(0, bool)
    earliest = least[owner][order][np.flatnonzero(new)][np.cumsum(new) - 1]
    again = order[least[owner][order] > earliest]
    mask = np.zeros(len(n), np.uint64)
    np.bitwise_or.at(mask, owner[again], np.uint64(1) << bit[again].astype(np.uint64))
    keep = mask > 0
    return pa.record_batch([pa.array(anchor[keep]), content.filter(pa.array(keep)), _signed(mask[keep])], ["anchor", "content", "mask"])


def duplicate_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS, local: int = LOCAL) -> DataFrame:
    """doc_id, text_hash, first, mask: bit i is set if the window at word first + i also begins in an earlier document."""
    rows = pick(docs, id_col, text_col).where("doc_id is not null and text is not null").withColumn("text_hash", F.xxhash64("text"))
    in_docs = _scan(rows, None, "anchors").groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = written(in_docs.where("least < most").select("anchor", "least"), "dedup-anchors")
    by_anchor = _scan(rows, _filter_of(shared, F.col("anchor"), filter_bits), "blocks")
    blocks = written(by_anchor.join(shared.select("anchor"), "anchor"), "dedup-blocks")

    contents = blocks.groupBy("anchor", "content").agg(F.min("doc_id").alias("least"))
    contents = written(contents, "dedup-contents")
    spread = contents.groupBy("anchor").agg(F.min("least").alias("lo"), F.max("least").alias("hi"), F.count("*").alias("n_contents")).where("lo < hi")
    compared = written(contents.join(written(spread.select("anchor", "n_contents"), "dedup-spread"), "anchor"), "dedup-compared")
    keyed = map_batches(compared.select("anchor", "content"), lambda b: pa.record_batch([_signed(_key(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64)))], ["key"]), "key long")
    seen = _scan(rows, _filter_of(keyed, F.col("key"), filter_bits), "windows")
    seen = seen.groupBy("anchor", "content").agg(F.first("windows").alias("windows"))
    candidates = written(compared.join(seen, ["anchor", "content"]), "dedup-windows")

    grouped = candidates.where(F.col("n_contents") <= local).groupBy("anchor").agg(F.collect_list(F.struct("least", "content", "windows")).alias("contents"))
    here = map_batches(grouped, _repeated_here, "anchor long, content long, mask long")
    apart = candidates.where(F.col("n_contents") > local).select("anchor", "content", "least", F.posexplode("windows").alias("bit", "window"))
    first = written(apart.groupBy("window").agg(F.min("least").alias("earliest")), "dedup-earliest")
    there = apart.join(first, "window").where("least > earliest").groupBy("anchor", "content").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("mask"))
    masks = written(here.unionAll(there), "dedup-masks")

    judged = blocks.join(contents, ["anchor", "content"])
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n")) - 1
    whole = judged.where("doc_id > least").select("doc_id", "text_hash", "first", full.alias("mask"))
    part = judged.where("doc_id = least").join(masks, ["anchor", "content"]).select("doc_id", "text_hash", "first", "mask")
    return whole.unionAll(part)


def _removed(batch: pa.RecordBatch, n_words: np.ndarray) -> np.ndarray:
    """For all words of the batch, one row after the other, whether each goes."""
    ranges = batch.column("ranges")
    per = pc.list_value_length(ranges).fill_null(0).to_numpy(zero_copy_only=False)
    flat = ranges.flatten()
    row = np.repeat(np.arange(len(per)), per)
    first, mask = flat.field("first").to_numpy().astype(np.int64), flat.field("mask").to_numpy()
    begins = np.cumsum(n_words) - n_words
    bits = np.unpackbits(np.ascontiguousarray(mask).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    of, bit = np.nonzero(bits)
    return covered(int(n_words.sum()), begins[row[of]] + first[of] + bit, WINDOW)


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) of every row."""
    found = duplicate_windows(docs, id_col=id_col, text_col=text_col, **options)
    ranges = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "mask")).alias("ranges"))
    rows = pick(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    joined = rows.join(written(ranges, "dedup-ranges"), ["doc_id", "text_hash"], "left").select("doc_id", "text", "ranges")

    def part(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
        data, offsets = utf8(batch.column("text"))
        whole = data.tobytes()
        words = [whole[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        n_words = np.array([len(w) for w in words], np.int64)
        gone = _removed(batch, n_words)
        ends = np.cumsum(n_words)
        n_gone = np.diff(np.r_[0, np.cumsum(gone)][np.r_[0, ends]])
        kept = []
        for w, end, g in zip(words, ends.tolist(), n_gone.tolist()):
            if g:
                w = [x for x, out in zip(w, gone[end - len(w) : end].tolist()) if not out]
            kept.append(b" ".join(w).decode())
        return n_words, n_gone.astype(np.int64), kept

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, offsets = utf8(batch.column("text"))
        parts = [part(batch.slice(a, b - a)) for a, b in runs(offsets)]
        n_words, n_gone = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        return pa.record_batch([batch.column("doc_id"), pa.array(n_words), pa.array(n_gone), pa.array([t for p in parts for t in p[2]], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return map_batches(joined, run, "doc_id long, n_words long, n_removed long, kept string")
