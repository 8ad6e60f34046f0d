"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised with a codebook of its own; a vector's cell
is its pair of centroids. For a query, the pairs are traversed by summed inner product of
query half and centroid, best first, with a heap over the two sorted lists, until the cells
met hold a share of the index; the vectors in them are ranked by their inner product.

Codebooks are fitted on at most `fit_rows` vectors (those with the smallest hash). The share
is what the target recall needs on that sample, where neighbours are known by brute force:
it is small where vectors cluster, and near a half for directions without clusters. Every
vector is indexed. Equal vectors are one entry with their `k + 1` smallest ids, which is all
that any result can show of them, so a vector that fills a third of the table weighs no
more than any other.

Entries are dealt in chunks of neighbouring cells and queries in blocks of neighbouring
cells, both of bounded size. Chunks make up at most SPANS spans. A query goes to the spans
that it visits, and a chunk to the blocks that visit it; a task reads a block's queries and
then the span's chunks one after the other, and keeps each query's nearest so far. So work
and copies grow with what is visited, and the rows of results with the queries alone.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part; vectors of different lengths have no inner product, so each length has an index of its
own; equal rows are one row; rows of a query's own id aren't its candidates; ties go to the
smaller id; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, sized

#: Most entries of a chunk and queries of a block; fewer where there are few for each task.
CHUNK, BLOCK = 32_768, 8_192
#: Most parts of the index that make results for a query each.
SPANS = 8
#: Queries of the sample that set the share.
PROBES = 256
RESULT = "query_id long, rank int, vec_id long, score double"


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0))


def fit_codebook(points: np.ndarray, size: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means; fewer centroids than `size` if there are fewer points."""
    points = np.unique(points, axis=0)
    centroids = points[np.random.default_rng(seed).permutation(len(points))[:size]].copy()
    for _ in range(rounds):
        nearest = codes(points, centroids)
        for j in range(len(centroids)):
            if (own := nearest == j).any():
                centroids[j] = points[own].mean(0)
    return centroids


def codes(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(1) - 2 * points @ book.T, axis=1).astype(np.int32)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, budget: int) -> tuple[list[tuple[int, int]], float]:
    """Pairs of centroids that have entries, best sum first, until these reach the budget;
    and the sum of the last."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y, n = first[a].tolist(), second[b].tolist(), counts[np.ix_(a, b)].tolist()
    heap, out, met, last = [(-(x[0] + y[0]), 0, 0)], [], 0, -np.inf
    while heap and met < budget:
        total, i, j = heapq.heappop(heap)
        if n[i][j]:
            out.append((i, j))
            met, last = met + n[i][j], -total
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):  # a row of pairs comes in with its best
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))
    return [(int(a[i]), int(b[j])) for i, j in out], last


def needed_share(points: np.ndarray, books: list[np.ndarray], half: int, k: int, recall: float) -> float:
    """The share of the sample's entries in cells at least as good as a neighbour's, at the
    quantile `recall` of its probes' k nearest."""
    if len(points) <= k + 1:
        return 1.0
    own = [codes(points[:, :half], books[0]), codes(points[:, half:], books[1])]
    asked = points[:: max(1, len(points) // PROBES)][:PROBES]
    at = np.arange(0, len(points), max(1, len(points) // PROBES))[:PROBES]
    near = asked @ points.T
    near[np.arange(len(at)), at] = -np.inf
    best = np.argpartition(-near, k, axis=1)[:, :k]
    cell = (asked[:, :half] @ books[0].T)[:, own[0]] + (asked[:, half:] @ books[1].T)[:, own[1]]
    share = [1 - np.searchsorted(np.sort(line), line[b] - 1e-12) / len(points) for line, b in zip(cell, best, strict=True)]
    return float(np.quantile(np.concatenate(share), recall))


def dealt(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first group and its number of groups: cells in order share groups of
    about `most`, and a larger cell has several of its own."""
    first, pieces = np.zeros(counts.shape, np.int32), np.ones(counts.shape, np.int32)
    group, held = 0, 0
    for cell in zip(*np.nonzero(counts), strict=True):
        n = int(counts[cell])
        if held and held + n > most:
            group, held = group + 1, 0
        first[cell], pieces[cell] = group, -(-n // most)
        held += n
        if n > most:
            group, held = group + int(pieces[cell]), 0
    return first, pieces


def search(vectors: DataFrame, k: int = 20, every: int = 20, centroids: int = 128, recall: float = 0.95, fit_rows: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for each row whose id is divisible by `every`."""
    rows = materialize(valid(vectors, id_col, vector_col), "ann-rows")
    keep = W.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("place", F.row_number().over(keep)).filter(F.col("place") <= k + 1)
    entries = few.groupBy("v").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.filter(F.col("vec_id") % every == 0).distinct()
    entries = materialize(entries.join(asked.select("v").distinct().withColumn("asked", F.lit(True)), "v", "left"), "ann-entries")
    ids = materialize(asked.join(entries.filter("asked").select("v", "entry"), "v").select(F.col("vec_id").alias("query_id"), "entry").distinct(), "ann-asked")
    sizes = [r["d"] for r in entries.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    parts = [_search(entries.filter(F.size("v") == d), ids, k, centroids, recall, fit_rows) for d in sizes]
    return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], RESULT)


def _search(entries: DataFrame, ids: DataFrame, k: int, centroids: int, recall: float, fit_rows: int) -> DataFrame:
    """The results among vectors of one length."""
    spark = entries.sparkSession
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(fit_rows).select("v").toArrow().column("v").combine_chunks()
    points = np.ascontiguousarray(sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1))
    half = points.shape[1] // 2
    books = [fit_codebook(points[:, :half], centroids), fit_codebook(points[:, half:], centroids)]
    share = needed_share(points, books, half, k, recall)

    coded = pa.schema([("entry", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("x", pa.binary()), ("ids", pa.list_(pa.int64())), ("asked", pa.bool_())])

    def quantise(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            a, b = codes(x[:, :half], books[0]), codes(x[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2).cast(pa.list_(pa.int64())), batch.column(3)], schema=coded)

    index = materialize(entries.select("entry", "v", "ids", "asked").mapInArrow(quantise, "entry long, a int, b int, x binary, ids array<long>, asked boolean"), "ann-index")
    counts, queries = (np.zeros((len(books[0]), len(books[1])), dtype=np.int64) for _ in range(2))
    for r in index.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("q")).collect():  # at most centroids ** 2 rows
        counts[r["a"], r["b"]], queries[r["a"], r["b"]] = r["n"], r["q"]
    total, tasks = int(counts.sum()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    budget = max(k + 1, int(np.ceil(share * total)))
    chunk, chunks = dealt(counts, max(1024, min(CHUNK, total // (2 * tasks))))
    block, blocks = dealt(queries, BLOCK)
    held = np.nonzero(counts)
    last = int((chunk + chunks)[held].max()) if len(held[0]) else 1
    cells = spark.createDataFrame(
        pd.DataFrame({"a": held[0], "b": held[1], "chunk": chunk[held], "chunks": chunks[held], "block": block[held], "blocks": blocks[held]}).astype("int32"), "a int, b int, chunk int, chunks int, block int, blocks int"
    )  # at most centroids ** 2 rows
    among = lambda group: (F.col(group) + F.pmod(F.xxhash64("entry"), F.col(f"{group}s"))).cast("int").alias(group)
    placed = index.join(F.broadcast(cells), ["a", "b"])

    visit = pa.schema([("entry", pa.int64()), ("block", pa.int32()), ("x", pa.binary()), ("least", pa.float64()), ("span", pa.int32()), ("met", pa.list_(pa.int32())), ("fresh", pa.list_(pa.int32()))])

    def probe(batches):
        seen = set()  # a block's chunks are named once per task
        for batch in batches:
            out = []
            for entry, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(data)
                pairs, least = traverse(books[0] @ x[:half], books[1] @ x[half:], counts, budget)
                met = tuple(np.array(pairs).T)
                to = np.unique(np.repeat(chunk[met], chunks[met]) + np.concatenate([np.arange(n) for n in chunks[met]]))
                span = to * SPANS // last
                for one in np.unique(span).tolist():
                    own = to[span == one].tolist()
                    fresh = [c for c in own if (block, c) not in seen]
                    seen.update((block, c) for c in fresh)
                    out.append((entry, block, data, least, one, own, fresh))
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), visit, strict=True)], schema=visit)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), visit, strict=True)], schema=visit)

    asking = placed.filter("asked").select("entry", among("block"), "x").repartition(2 * tasks, "entry")
    visits = materialize(asking.mapInArrow(probe, "entry long, block int, x binary, least double, span int, met array<int>, fresh array<int>"), "ann-visits")
    wanted = visits.select(F.explode("fresh").alias("to"), F.col("block").alias("from")).distinct()
    there = placed.select(among("chunk"), "a", "b", "x", "ids").join(sized(wanted), F.col("chunk") == F.col("to"))
    span = F.floor(F.col("chunk") * SPANS / last).cast("int").alias("span")
    there = there.select(span, F.col("from").alias("block"), "chunk", "x", "a", "b", "ids")
    asked = visits.select("span", "block", F.lit(-1).alias("chunk"), "x", "entry", "least", "met")

    def rank(batches):
        at, asked, ahead, size = None, [], [], 0

        def meet():
            """The held entries of a chunk and the queries that visit it."""
            rows = pa.Table.from_batches(ahead)
            vectors = np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype=np.float64).reshape(rows.num_rows, -1)
            a, b, ids = rows.column("a").to_numpy(), rows.column("b").to_numpy(), rows.column("ids").to_pylist()
            here = [q for q in asked if at[2] in q["met"]]
            step = max(1, (1 << 20) // len(vectors))
            for lo in range(0, len(here), step):
                part = here[lo : lo + step]
                x = np.frombuffer(b"".join(q["x"] for q in part), dtype=np.float64).reshape(len(part), -1)
                score = x @ vectors.T
                cell = (x[:, :half] @ books[0].T)[:, a] + (x[:, half:] @ books[1].T)[:, b]
                score[cell < np.array([q["least"] for q in part])[:, None] - 1e-12] = -np.inf
                best = np.partition(score, -(k + 1), axis=1)[:, -(k + 1)] if score.shape[1] > k + 1 else np.full(len(part), -np.inf)
                for q, line, least in zip(part, score, best.tolist(), strict=True):
                    near = q["near"]
                    if len(near) > k:
                        least = max(least, -near[k][0])
                    found = [(-line[c], i) for c in np.flatnonzero((line >= least) & (line > -np.inf)) for i in ids[c]]
                    if found:
                        q["near"] = heapq.nsmallest(k + 1, near + found)

        def results():
            rows = [(q["entry"], i, -s) for q in asked for s, i in q["near"]]
            columns = zip(*rows) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["entry", "vec_id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if hi == lo:
                    continue
                key = tuple(keys[lo].tolist())
                if ahead and (key != at or size >= CHUNK):
                    meet()
                    ahead, size = [], 0
                if at and key[:2] != at[:2]:
                    yield results()
                    asked = []
                at, part = key, batch.slice(lo, hi - lo)
                if key[2] < 0:
                    asked += [q | {"met": set(q["met"]), "near": []} for q in part.select(["x", "entry", "least", "met"]).to_pylist()]
                else:
                    ahead, size = [*ahead, part.select(["x", "a", "b", "ids"])], size + hi - lo
        if ahead:
            meet()
        yield results()

    by = ("span", "block")
    both = asked.unionByName(there, allowMissingColumns=True).select("span", "block", "chunk", "x", "entry", "least", "met", "a", "b", "ids")
    found = both.repartition(2 * tasks, *by).sortWithinPartitions(*by, "chunk").mapInArrow(rank, "entry long, vec_id long, score double")
    order = W.partitionBy("entry").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    pairs = ids.join(best, "entry").filter(F.col("vec_id") != F.col("query_id"))
    own = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
