"""SimHash near-duplicates: a grid range-join over segment popcounts.

A 64-bit fingerprint maps to 16 counts, the set bits of its 4-bit segments, kept
as 16 nibbles of one long.  The Manhattan distance of two count vectors is never
more than the Hamming distance of the fingerprints.  Two vectors at Manhattan
distance 2 or less share a grid point at distance 1 or less from both, so each
distinct fingerprint is sent to its own grid point and the (at most 32) points
beside it; fingerprints that meet are verified exactly.

Equal fingerprints are one row from the start.  A grid point with up to ``cell``
fingerprints is verified pair by pair in numpy, and gives a spanning forest of
its links, never its pairs.  Fingerprints of fuller points go through an exact
second step: both ends of a link of 2 or fewer bits lie within one flipped bit of
a common value, and at most 65 fingerprints lie that near to any value.

Defined results: no word: fingerprint zero, linked like any other; null text
likewise; a null doc_id keeps its row and is never a component's id (null if the
component has no other); repeated rows share their component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm import jaccard
from rivulet.llm.components import components
from rivulet.llm.shared_tables import written
from rivulet.llm.textbatch import map_batches, pick, texts

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints of one grid point that are verified pair by pair.
CELL = 256
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text as a signed 64-bit integer."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    norm, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        h = [digest(norm[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())]
        counts += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, shingle) for t in texts(batch.column("text"))]
        return pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(fps, pa.int64())})

    return map_batches(pick(docs, id_col, text_col), run, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """Set bits of each 4-bit segment, as 16 nibbles."""
    ones = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in (1, 2, 3)), fp.bitwiseAND(ones))


def grid_points(counts: Column) -> Column:
    """The point itself and those that differ by one in one count (0 to 4)."""
    near = [counts]
    for k in range(0, 64, 4):
        nibble, step = F.shiftrightunsigned(counts, k).bitwiseAND(F.lit(15)), F.shiftleft(F.lit(1).cast("long"), k)
        near += [F.when(nibble < 4, counts + step), F.when(nibble > 0, counts - step)]
    return F.filter(F.array(*near), lambda x: x.isNotNull())


def _links_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the fingerprints of one grid point."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= MAX_BITS
    root = np.arange(len(fps))
    while True:  # least reachable index; few rounds, as rows are unions of cliques
        least = np.where(near, root[None, :], len(fps)).min(axis=1)
        if (least == root).all():
            break
        root = least[least]
    at = np.flatnonzero(root != np.arange(len(fps)))
    return fps[at], fps[root[at]]


def _verify(cell: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point: int | None = None
        held: list[np.ndarray] = []  # fingerprints of the point at the end of the last batch
        n_held, hot = 0, False

        def out(u: np.ndarray, v: np.ndarray, is_hot: bool) -> pa.RecordBatch:
            return pa.record_batch({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64)), "hot": pa.array(np.full(len(u), is_hot))})

        def closed() -> Iterator[pa.RecordBatch]:
            if n_held > 1 and not hot:
                yield out(*_links_of(np.concatenate(held)), False)

        for batch in batches:
            points = batch.column("point").to_numpy()
            fps = batch.column("fp").to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, points[1:] != points[:-1]])
            ends = np.r_[starts[1:], len(points)]
            if len(starts) > 2:  # points of two, at once
                two = starts[1:-1][(ends - starts)[1:-1] == 2]
                u, v = fps[two], fps[two + 1]
                near = np.bitwise_count(u ^ v) <= MAX_BITS
                if near.any():
                    yield out(u[near], v[near], False)
            size = ends - starts
            size[(size <= 2) & (np.arange(len(size)) > 0) & (np.arange(len(size)) < len(size) - 1)] = 0
            for k in np.flatnonzero(size).tolist():
                a, b = int(starts[k]), int(ends[k])
                if points[a] != point:
                    yield from closed()
                    point, held, n_held, hot = points[a], [], 0, False
                here = fps[a:b]
                n_held += len(here)
                if n_held > cell:
                    here, held, hot = np.concatenate([*held, here]), [], True
                    yield out(here, here, True)
                else:
                    held.append(here)
        yield from closed()

    return run


def links(distinct: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of fp within MAX_BITS."""
    at_points = distinct.select(F.explode(grid_points(segment_counts(F.col("fp")))).alias("point"), "fp")
    found = at_points.repartition("point").sortWithinPartitions("point").mapInArrow(_verify(cell), "u long, v long, hot boolean")
    found = written(found, "simhash-links")
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), k)) for k in range(64)])
    between = found.where("hot").select(F.col("u").alias("fp")).distinct().select(F.explode(flips).alias("between"), "fp")
    near = between.groupBy("between").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = near.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return found.where("not hot").select("u", "v").unionAll(stars)


def _groups(prints: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """fp, group (the same for all fingerprints that links connect), component_id."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(link(distinct.select("fp")), "simhash-components")
    rooted = distinct.join(roots, F.col("fp") == F.col("vertex"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("linked_id"), F.lit(True).alias("is_linked"))
    linked = rooted.join(ids, "root").select("fp", "root", "linked_id", "is_linked")
    component = F.when(F.col("is_linked"), F.col("linked_id")).otherwise(F.col("least_id"))
    return distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("group"), component.alias("component_id"))


def _meetings(prints: DataFrame, cell: int) -> DataFrame:
    """Pairs (u, v) of keys (fp) whose fingerprints (sketch) are equal or linked: a few for each key."""
    sketched = written(prints.select("sketch", "fp").distinct(), "simhash-sketches")
    first = written(sketched.groupBy("sketch").agg(F.min("fp").alias("first")), "simhash-first")
    same = sketched.join(first, "sketch").where("fp <> first").select(F.col("first").alias("u"), F.col("fp").alias("v"))
    ends = links(first.select(F.col("sketch").alias("fp")), cell).select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    for c in ("u", "v"):
        ends = ends.join(first.select(F.col("sketch").alias(f"_{c}"), F.col("first").alias(c)), f"_{c}")
    return written(same.unionAll(ends.select("u", "v")).where("u <> v").distinct(), "simhash-meetings")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable over links) for every row."""
    prints = written(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "simhash")
    return prints.join(written(_groups(prints, lambda fps: links(fps, cell)).drop("group"), "simhash-groups"), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float | None = None, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, unchanged, that stand for their component: that of the least id.

    Where several rows could (equal ids, or no id in the component), one stays.
    With a ``similarity``, links are pairs whose shingle sets have at least that
    Jaccard similarity: fingerprints that meet on the grid are verified on the sets,
    and pairs farther apart than ``MAX_BITS`` come from ``rivulet.llm.jaccard``.
    """
    names = docs.columns
    id_col, text_col = (f"c{names.index(c)}" for c in (id_col, text_col))
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])  # no name clashes with those made here
    columns = {"shingle": shingle, "id_col": id_col, "text_col": text_col}
    prints = written(fingerprints(docs, **columns) if similarity is None else jaccard.prints(docs, fingerprint, **columns), "simhash")
    groups = written(_groups(prints, lambda fps: links(fps, cell) if similarity is None else jaccard.links(docs, prints, _meetings(prints, cell), similarity, **columns)), "simhash-groups")
    least = groups.where("component_id is not null").select(F.col("component_id").alias("_id"))
    unsure = prints.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    unsure = written(unsure.select(F.col("doc_id").alias("_id")), "simhash-unsure")
    doc_id = F.col(id_col).cast("long")
    plain = least.join(unsure, "_id", "left_anti")
    kept = docs.join(plain, doc_id == F.col("_id"), "left_semi")
    if unsure.isEmpty():
        return kept.toDF(*names)
    rows = docs.join(unsure, doc_id.eqNullSafe(F.col("_id")), "left_semi").withColumn("_row", F.struct("*"))
    rows = rows.select("_row", doc_id.alias("_id"), F.sha2(F.to_json(F.struct("_row")), 256).alias("_hash"), F.col(text_col).cast("string").alias("_text"))
    keyed = map_batches(rows.select("_id", "_hash", "_text").distinct(), _keyed(shingle, similarity), "_id long, _hash string, fp long")
    best = keyed.join(groups, "fp").where("component_id is null or component_id = _id").groupBy("group").agg(F.min("_hash").alias("_hash"))
    chosen = rows.join(best.select("_hash").distinct(), "_hash", "left_semi").dropDuplicates(["_hash"])
    return kept.unionAll(chosen.select("_row.*")).toDF(*names)


def _keyed(shingle: int, similarity: float | None):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("_text")
        fps = pa.array([fingerprint(t, shingle) for t in texts(column)], pa.int64()) if similarity is None else jaccard.keys(column, shingle)
        return pa.record_batch([batch.column("_id"), batch.column("_hash"), fps], ["_id", "_hash", "fp"])

    return run
