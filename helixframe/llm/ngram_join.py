"""Near-duplicates: n-gram Jaccard join by MinHash banding.

Texts become sets of hashed word n-grams. Minima under `rows * bands` hash functions are
grouped in bands; the number of bands is what the target recall at the threshold needs.
Texts that agree in a band meet in its bucket and are verified on their full sets.

- Equal texts are one entry that stands for all its copies.
- A bucket with the same members as one of an earlier band is left out, and a pair is
  verified in the first band it shares only, so no list of pairs has to be made distinct.
- A bucket of many n-grams is cut into blocks of bounded size, and each pair of blocks is a
  group of its own: no task gets a whole hot bucket, and no pair is left out. A member is
  copied once for each block; groups are verified tile by tile in bounded memory.
- Pairs are never emitted: a group yields, for each member, its number of links and one
  edge to the root of its component there. Components over all groups are found by minimum
  labels with pointer jumping, in tables.
- Texts are moved only for entries that share a bucket.

Defined results: a text with 1 to n - 1 words is one n-gram; a text without words (null,
empty) has no links and is a class of its own; copies link to each other; a null doc_id is
larger than any other; equal rows are copies; a very long text is one set, which counts by
its own size; similarity just at the threshold is a link; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONGEST, materialize, without, worker_cache

#: N-grams (8 bytes each) of a block of a bucket, each member counting for MEMBER more.
BLOCK = 1 << 19
MEMBER = 32
#: Members and, about, n-grams of a tile; columns that are compared at once.
TILE, TILE_GRAMS, COLUMNS = 256, 1 << 17, 4096
CACHED = 300_000


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """As many bands as find a pair at the threshold with the given probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int, cache: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    hashes = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(cache) < CACHED and len(w) <= LONGEST:
                cache[w] = h
        hashes.append(h)
    x = np.array(hashes, dtype=np.uint64)
    n = min(n, len(x))
    out = np.full(len(x) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + x[k : len(x) - n + 1 + k])
    return np.unique(out)


def minima(sets: list[np.ndarray], functions: int, seed: int = 11) -> np.ndarray:
    """A row of minima for each set; none may be empty."""
    draw = np.random.default_rng(seed)
    flip, times = draw.integers(0, 2**63, functions, dtype=np.uint64), draw.integers(0, 2**63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    joined = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((functions, len(sets)), np.uint64)
    for i in range(functions):
        out[i] = np.minimum.reduceat((joined ^ flip[i]) * times[i], starts)
    return out.T


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    m = minima(sets, bands * rows).reshape(len(sets), bands, rows)
    out = np.zeros((len(sets), bands), np.uint64)
    for i in range(rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + m[:, :, i])
    return out.view(np.int64)


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, sha, n (size of the set), bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        cache = worker_cache(("word hashes",), dict)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sets, held, to = [], 0, at
                while to < batch.num_rows and held < 200_000:
                    sets.append(shingles(batch.column(2)[to].as_py(), n, cache))
                    held, to = held + len(sets[-1]), to + 1
                full = [i for i, s in enumerate(sets) if len(s)]
                found: list = [[] for _ in sets]
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full], bands, rows), strict=True):
                        found[i] = row
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array([len(s) for s in sets], pa.int32()), pa.array(found, pa.list_(pa.int64()))], schema=schema)
                at = to

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.sha2(text, 256).alias("sha"), "text").mapInArrow(run, "doc_id long, sha string, n int, bands array<long>")


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set. Only n-grams on both
    sides count; columns go in chunks, so memory is bounded by the sets' own size."""
    x, y = np.concatenate(left), np.concatenate(right)
    out = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.unique(x), np.unique(y), assume_unique=True)
    if not len(shared):
        return out
    sides = []
    for joined, sets in ((x, left), (y, right)):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.searchsorted(shared, joined).clip(max=len(shared) - 1)
        known = shared[column] == joined
        column, owner = column[known], owner[known]
        order = np.argsort(column, kind="stable")
        sides.append((column[order], owner[order], len(sets)))
    for lo in range(0, len(shared), COLUMNS):
        dense = []
        for column, owner, n in sides:
            a, b = np.searchsorted(column, [lo, lo + COLUMNS])
            part = np.zeros((n, min(COLUMNS, len(shared) - lo)), np.float32)
            part[owner[a:b], column[a:b] - lo] = 1
            dense.append(part)
        out += dense[0] @ dense[1].T
    return out


def _tiles(members: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
    """members in runs of at most TILE, or about TILE_GRAMS n-grams."""
    out, start, held = [], 0, 0
    for i, m in enumerate(members.tolist()):
        held += len(sets[m])
        if i - start + 1 >= TILE or held >= TILE_GRAMS:
            out.append(members[start : i + 1])
            start, held = i + 1, 0
    return out + ([members[start:]] if start < len(members) else [])


def linked_in_group(band: int, cross: bool, side: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], threshold: float):
    """Pairs (of places in the group) whose sets are similar and that meet here first, tile
    by tile."""
    size = np.array([len(s) for s in sets], float)
    left = _tiles(np.flatnonzero(side == 0) if cross else np.arange(len(sets)), sets)
    right = _tiles(np.flatnonzero(side == 1), sets) if cross else left
    for i, a in enumerate(left):
        for b in right if cross else right[i:]:
            same = bands[a][:, None, :] == bands[b][None, :, :]
            mine = same[:, :, band] & (same.argmax(2) == band)
            if a is b:
                mine &= a[:, None] < b[None, :]
            n, m = size[a][:, None], size[b][None, :]
            mine &= np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
            rows, columns = np.flatnonzero(mine.any(1)), np.flatnonzero(mine.any(0))
            if not len(rows):
                continue
            both = _intersections([sets[x] for x in a[rows]], [sets[x] for x in b[columns]])
            n, m = size[a[rows]][:, None], size[b[columns]][None, :]
            x, y = np.nonzero(mine[np.ix_(rows, columns)] & (both >= threshold * (n + m - both) - 1e-9))
            if len(x):
                yield np.stack([a[rows][x], b[columns][y]], axis=1)


def _groups(batches, keys: int):
    """Runs of rows with equal first `keys` columns, across batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:], strict=False):
            key = tuple(int(c[lo]) for c in columns)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)


def joined(root: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """root (of each place the smallest place known to be connected) with the pairs' places
    connected, too."""
    while True:
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        for side in (0, 1):
            np.minimum.at(new, root[pairs[:, side]], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """edges(id, root) -> id, comp: the smallest id of the connected component."""
    both = materialize(edges.select("id", F.col("root").alias("to")).union(edges.select(F.col("root"), F.col("id"))).distinct(), "join-edges")
    labels = materialize(both.groupBy("id").agg(F.least("id", F.min("to")).alias("comp")), "join-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), F.col("comp").alias("c")), "to").groupBy("id").agg(F.min("c").alias("c"))
        low = labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("j"))
        after = materialize(low.join(jump, "comp", "left").select("id", "was", F.least("comp", F.coalesce("j", "comp")).alias("comp")), "join-labels")
        labels = after.select("id", "comp")
        if not after.filter("was <> comp").limit(1).count():
            return labels


def _key(doc_id: str):
    """doc_id as text; a null one, too, is a key."""
    return F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("-"))


def _joined(docs: DataFrame, words: int, threshold: float, rows: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, sha) and entries (sha, rep, copies, n, comp, links)."""
    bands = bands_for(threshold, rows, recall)
    signed = materialize(_signed(docs, words, bands, rows), "join-signed")
    entries = signed.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("bands").alias("bands"))
    entries = materialize(entries.withColumn("id", F.monotonically_increasing_id()), "join-entries")
    places = entries.select("id", "n", F.posexplode("bands").alias("band", "h"))
    buckets = places.groupBy("band", "h").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.col("n") + MEMBER).alias("grams"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x2")
    ).filter("m > 1")
    buckets = buckets.groupBy("m", "grams", "x1", "x2").agg(F.min(F.struct("band", "h")).alias("b")).select("grams", "b.band", "b.h")
    met = places.join(buckets, ["band", "h"]).groupBy("id").agg(F.collect_list(F.struct("band", "h", "grams")).alias("met"))
    wanted = materialize(entries.join(met, "id").select("id", _key("rep").alias("key"), "sha", "copies", "n", "bands", "met"), "join-candidates")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(_key("doc_id").alias("key"), F.sha2(text, 256).alias("sha"), "text")
    # as many candidates as the corpus has: Spark broadcasts their keys if it finds them small
    texts = texts.join(wanted.select("key", "sha", "id"), ["key", "sha"]).select("id", "text")

    def to_sets(batches):
        cache = worker_cache(("word hashes",), dict)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py(), words, cache).tobytes() for t in part.column(1)], pa.binary())], names=["id", "set"])

    sets = texts.mapInArrow(to_sets, "id long, set binary").groupBy("id").agg(F.max("set").alias("set"))  # equal rows are one
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # blocks of at most BLOCK n-grams, and smaller ones where that gives too few groups to go round
    grams = wanted.agg(F.sum((F.col("n") + MEMBER) * F.size("met"))).first()[0] or 0
    block = min(BLOCK, max(BLOCK >> 5, grams // (2 * n_parts)))
    spread = (
        sets.join(wanted.select("id", "copies", "bands", "met"), "id")
        .select("id", "copies", "bands", "set", F.inline("met"))
        .withColumn("blocks", F.ceil(F.col("grams") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "copies", "bands", "set")
    )
    spread = spread.repartition(n_parts, "band", "h", "i", "j").sortWithinPartitions("band", "h", "i", "j", "id")
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def verify(batches):
        out: list[tuple] = []
        for (band, _, i, j), group in _groups(batches, 4):
            ids, first = np.unique(group.column("id").to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            group = group.take(first)
            own = group.column("own").to_numpy()
            signs = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("set")]
            weight = group.column("copies").to_numpy()
            links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for pairs in linked_in_group(band, i != j, (own == j).astype(int), signs, sets, threshold):
                np.add.at(links, pairs[:, 0], weight[pairs[:, 1]])
                np.add.at(links, pairs[:, 1], weight[pairs[:, 0]])
                root = joined(root, pairs)
            some = links > 0
            out += zip(ids[some].tolist(), links[some].tolist(), ids[root[some]].tolist(), strict=True)
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    found = materialize(spread.mapInArrow(verify, "id long, links long, root long"), "join-links")
    labels = components(found.filter("id <> root").select("id", "root").distinct())
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    entries = entries.drop("bands").join(links, "id", "left").join(labels, "id", "left")
    return signed.select("doc_id", "sha"), entries.select("sha", "rep", "copies", "n", F.coalesce("comp", "id").alias("comp"), F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, rows: int = 4, recall: float = 0.999) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its component), n_links (other documents at the
    threshold or above, copies included), n_grams."""
    members, entries = _joined(docs, words, threshold, rows, recall)
    classes = entries.groupBy("comp").agg(F.min("rep").alias("class_id"))
    entries = entries.join(classes, "comp")
    out = members.join(entries, "sha")
    bare = F.col("n") == 0
    return out.select(
        "doc_id", F.when(bare, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(bare, 0).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("n").cast("long").alias("n_grams"),
    )


def one_of_each(docs: DataFrame, words: int = 5, threshold: float = 0.8, rows: int = 4, recall: float = 0.999) -> DataFrame:
    """The documents without their near-duplicates: of each class the one with the smallest
    doc_id stays, with its own columns. Texts without words all stay."""
    members, entries = _joined(docs, words, threshold, rows, recall)
    entries = materialize(entries.filter("n > 0"), "join-classes")
    stay = entries.groupBy("comp").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "sha")).alias("stay"), F.sum("copies").alias("size")).filter("size > 1")
    rows_ = members.join(entries.select("sha", "rep", "comp"), "sha").join(stay.select("comp", "stay"), "comp")
    kept = F.col("doc_id").eqNullSafe(F.col("stay.rep")) & (F.col("sha") == F.col("stay.sha"))
    judged = materialize(rows_.select("doc_id", "sha", kept.alias("kept")), "join-drop")
    again = judged.filter("kept").groupBy("doc_id", "sha").count().filter("count > 1").select("doc_id", "sha")
    return without(docs, judged.filter(~F.col("kept")).select("doc_id", "sha").distinct(), again)
