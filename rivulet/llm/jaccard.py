"""Links between texts whose word shingles have a Jaccard similarity of at least a bound.

Texts of equal shingle sets are one key (64 bits).  At a similarity of 0.8 two
fingerprints of 64 bits differ in about 10 bits, which no grid of the SimHash
join carries; candidates are keys that share one of ``BANDS`` bands of ``ROWS``
min-hashes instead.  A pair of similarity s shares none with probability
(1 - s**ROWS)**BANDS: 3e-6 at 0.8, less above.  Every link is verified on the
shingle sets themselves (64-bit hashes of shingles).  The caller may give candidates of its
own, SimHash's say: they are verified first, and bands only complete them.

Within a band no pairs are made.  In each of ``STARS`` rounds every band's hub (the
member whose bands are largest) is compared with the others: a row for each member
at most, as near copies share their hub over all bands.  Hubs leave, what is linked
is one component, and bands of one component are done.  In the
bands that then hold more than a block, two sets that share a shingle of at most
``FEW`` holders are a pair of their own; all others share no more than the common
shingles of either, so a set stays in its band only if, by these counts and by size,
some set of the band could be similar to it.  What stays is compared in blocks of
about ``BLOCK`` sets: the members of a band's largest component against all others,
and the others among themselves, a task for each pair of blocks.  So no group's size
bounds the memory of a task, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.components import components
from rivulet.llm.shared_tables import written
from rivulet.llm.textbatch import Words, map_parts, mix, pick, runs, texts, utf8

BANDS = 24
ROWS = 4
STARS = 1
#: Sets that may hold a shingle whose holders are paired.
FEW = 8
#: Sets, and hashes of all its sets, that a block holds on average.
BLOCK = 128
BLOCK_HASHES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALT = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)
_SALT[1] |= np.uint64(1)


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run of rows: the distinct shingle hashes of all rows, ascending in each, and n + 1 offsets.

    A text of fewer words has one shingle of all of them; one without a word, none.
    """
    data, offsets = utf8(column)
    for first, last in runs(offsets):
        words = Words(_LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first])
        start = words.windows(shingle)
        short = np.flatnonzero((words.count > 0) & (words.count < shingle))
        h = np.r_[words.grams(start, start + shingle), words.grams(words.first[short], words.first[short + 1])]
        doc = np.r_[words.doc[start], short]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
        h, doc = h[new], doc[new]
        yield h, np.searchsorted(doc, np.arange(last - first + 1))


def _keys(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The key of each set; 0 for an empty one."""
    total = np.r_[np.uint64(0), np.cumsum(mix(h), dtype=np.uint64)]
    return mix(total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


def _bands(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of bands for each set."""
    out = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for k in range(BANDS * ROWS):
            least = np.minimum.reduceat((h ^ _SALT[0, k]) * _SALT[1, k], offsets[full])
            out[full, k // ROWS] = mix(out[full, k // ROWS] + least + np.uint64(k))
    return out.view(np.int64)


def prints(docs: DataFrame, sketch: Callable[[bytes, int], int], *, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the key of the shingle set), bands and sketch (of the text) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(_sets(batch.column("text"), shingle))
        sketches = pa.array([sketch(t, shingle) for t in texts(batch.column("text"))], pa.int64())
        keys, bands = (np.concatenate([f(*s) for s in sets]) for f in (_keys, _bands))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
        return pa.record_batch([batch.column("doc_id"), pa.array(keys), lists, sketches], ["doc_id", "fp", "bands", "sketch"])

    return map_parts(pick(docs, id_col, text_col), run, "doc_id long, fp long, bands array<long>, sketch long")


def keys(column: pa.Array, shingle: int) -> pa.Array:
    return pa.array(np.concatenate([_keys(*s) for s in _sets(column, shingle)]))


def _similar(size_u: Column, size_v: Column, common: Column, similarity: float) -> Column:
    return common >= F.lit(similarity) * (size_u + size_v - common) - F.lit(1e-9)


def _similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that are similar."""
    mine = sets.select(F.col("fp").alias("v"), F.col("n").alias("n_v"), F.col("hashes").alias("h_v"))
    others = sets.select(F.col("fp").alias("u"), F.col("n").alias("n_u"), F.col("hashes").alias("h_u"))
    joined = pairs.join(mine, "v").join(others, "u").where(_similar(F.col("n_u"), F.col("n_v"), F.least("n_u", "n_v"), similarity))
    return joined.where(_similar(F.col("n_u"), F.col("n_v"), F.size(F.array_intersect("h_u", "h_v")), similarity)).select("u", "v")


def _star_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) from each band's hub to the members that are similar to it."""
    pairs = members.where("fp <> hub and root <> hub_root").select(F.col("hub").alias("u"), F.col("fp").alias("v")).distinct()
    return _similar_pairs(pairs, sets, similarity)


def _thinned(crowd: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The members whose links may rest on common shingles alone, and the links of all that share a rare one."""
    held = crowd.select("fp", "root").distinct().join(sets.select("fp", "hashes"), "fp").select("fp", "root", F.explode("hashes").alias("h"))
    rare = held.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") <= FEW)
    rare = written(held.join(rare, "h"), "jaccard-rare")
    holders = rare.where("c > 1").groupBy("h").agg(F.collect_list(F.struct("fp", "root")).alias("all")).select(F.explode("all").alias("a"), "all")
    pairs = holders.select("a", F.explode("all").alias("b")).where("a.fp < b.fp and a.root <> b.root").select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()
    links = written(_similar_pairs(pairs, sets, similarity), "jaccard-links")

    common = F.col("n") - F.coalesce("rare", F.lit(0))
    counted = crowd.join(rare.groupBy("fp").agg(F.count("*").alias("rare")), "fp", "left").withColumn("most", common * F.lit(1 + 1 / similarity) - F.col("n") + F.lit(1e-6))
    counted = written(counted.select(*crowd.columns, "most"), "jaccard-crowd")  # most: the size up to which a set may be similar to this one
    sizes = counted.groupBy("band", F.floor(F.log("n") * 50)).agg(F.min("n").alias("least"), F.max("most").alias("most"))
    sizes = sizes.groupBy("band").agg(F.collect_list(F.struct("least", "most")).alias("sizes"))
    stay = counted.join(sizes, "band").where(F.exists("sizes", lambda x: (x["least"] <= F.col("most")) & (x["most"] >= F.col("n"))))
    return written(stay.select(*crowd.columns), "jaccard-crowd"), links


def _plan(sized: DataFrame) -> DataFrame:
    """For each band of several components: the largest one, its number of blocks and that of the others."""
    by_root = sized.groupBy("band", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    per_band = by_root.groupBy("band").agg(F.max(F.struct("c", "s", "root")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s")).where("c > top.c")

    def blocks(c: Column, s: Column) -> Column:
        return F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_HASHES), F.lit(1)).cast("int")

    plan = per_band.select("band", F.col("top.root").alias("top"), blocks(F.col("top.c"), F.col("top.s")).alias("n_top"), blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("n_rest"))
    return written(plan, "jaccard-plan")


def _block_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) whose components, with those given by root, are those of all similar pairs of each band."""
    sized = written(members.join(sets.select("fp", "n"), "fp"), "jaccard-rest")
    plan, links = _plan(sized), None
    crowded = plan.where("n_top > 1 or n_rest > 1").select("band")
    if not crowded.isEmpty():
        stay, links = _thinned(sized.join(crowded, "band", "left_semi"), sets, similarity)
        sized = sized.join(crowded, "band", "left_anti").unionByName(stay)
        plan = _plan(sized)
    dealt = sized.join(plan, "band").withColumn("is_top", F.col("root") == F.col("top"))
    mine = F.pmod(F.xxhash64("fp"), F.when(F.col("is_top"), F.col("n_top")).otherwise(F.col("n_rest"))).cast("int").alias("b")
    dealt = dealt.select("band", "fp", "root", "is_top", "n_top", "n_rest", mine)

    def tasks(n: str, pair: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), pair)

    def named(kind: str, i: Column, j: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    of_top = tasks("n_rest", lambda j: named("top", F.col("b"), j))
    of_rest = F.concat(tasks("n_top", lambda i: named("top", i, F.col("b"))), tasks("n_rest", lambda k: named("rest", F.least(F.col("b"), k), F.greatest(F.col("b"), k))))
    spread = dealt.select("band", "fp", "root", F.explode(F.when(F.col("is_top"), of_top).otherwise(of_rest)).alias("t")).select("band", "t.*", "fp", "root")
    found = spread.join(sets.select("fp", "hashes"), "fp").groupBy("band", "kind", "i", "j").applyInArrow(_verify(similarity), "u long, v long")
    return found if links is None else found.unionAll(links)


def _verify(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """Links of a few sets that join different roots; what is linked is one root from then on."""

    def run(block: pa.Table) -> pa.Table:
        fps = block.column("fp").to_numpy()
        lists = block.column("hashes").combine_chunks()
        starts = lists.offsets.to_numpy()
        size = np.diff(starts)
        code = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        starts = starts - starts[0]
        root, u, v = np.unique(block.column("root").to_numpy(), return_inverse=True)[1], [], []
        for k in range(len(fps) - 1):
            rest = np.flatnonzero(root[k + 1 :] != root[k]) + k + 1
            if not len(rest):
                continue
            mine = np.zeros(len(code), bool)
            mine[code[starts[k] : starts[k + 1]]] = True
            common = np.add.reduceat(mine[code], starts[:-1], dtype=np.int64)[rest]
            for j in rest[common >= similarity * (size[k] + size[rest] - common) - 1e-9].tolist():
                if root[j] != root[k]:
                    root[root == root[j]] = root[k]
                    u.append(fps[k])
                    v.append(fps[j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members (band, fp) of bands of several components, with each one's root."""
    roots = components(links, "jaccard-roots").select(F.col("vertex").alias("fp"), F.col("root").alias("_root"))
    rooted = members.join(roots, "fp", "left").select("band", "fp", F.coalesce("_root", "fp").alias("root"))
    rooted = written(rooted, "jaccard-rooted")
    return rooted.join(rooted.groupBy("band").agg((F.min("root") != F.max("root")).alias("_open")).where("_open").select("band"), "band", "left_semi")


def links(docs: DataFrame, prints: DataFrame, candidates: DataFrame, similarity: float, *, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Edges (u, v) whose components are those of all keys of at least that similarity.

    candidates: pairs (u, v) of keys that are verified before any band is looked at.
    """
    banded = written(prints.select(F.explode("bands").alias("band"), "fp").distinct(), "jaccard-bands")
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("members")).where("n > 1")
    shared = shared.groupBy("n", "members").agg(F.min("band").alias("band"))  # one band of each membership
    members = written(banded.join(shared.select("band", F.col("n").alias("band_size")), "band"), "jaccard-members")
    weight = written(members.groupBy("fp").agg(F.sum("band_size").alias("weight")), "jaccard-weights")
    wanted = written(weight.select("fp").unionAll(candidates.select("u")).unionAll(candidates.select("v")).distinct(), "jaccard-wanted")
    ids = prints.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("_id")).select("_id").distinct()
    some = docs.join(ids, F.col(id_col).cast("long").eqNullSafe(F.col("_id")), "left_semi")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(_sets(batch.column("text"), shingle))
        ends = np.cumsum(np.concatenate([np.diff(offsets) for _, offsets in sets]))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(np.concatenate([h for h, _ in sets]).view(np.int64)))
        return pa.record_batch([pa.array(np.concatenate([_keys(*s) for s in sets])), lists], ["fp", "hashes"])

    found = map_parts(pick(some, id_col, text_col), run, "fp long, hashes array<long>").join(wanted, "fp", "left_semi")
    sets = written(found.dropDuplicates(["fp"]).select("fp", F.size("hashes").alias("n"), "hashes"), "jaccard-sets")

    edges, left = written(_similar_pairs(candidates, sets, similarity), "jaccard-links"), members.select("band", "fp")
    for _ in range(STARS):
        rest = _open(left, edges)
        hubs = rest.join(weight, "fp").groupBy("band").agg(F.max(F.struct("weight", "fp", "root")).alias("_hub")).select("band", F.col("_hub.fp").alias("hub"), F.col("_hub.root").alias("hub_root"))
        rest = written(rest.join(hubs, "band"), "jaccard-stars")
        edges = written(edges.unionAll(_star_links(rest, sets, similarity)), "jaccard-links")
        left = rest.where("fp <> hub").select("band", "fp")
    blocks = _block_links(_open(left, edges), sets, similarity)
    return edges.unionAll(written(blocks, "jaccard-links"))
