"""Kernels where a sequence is: its own windows are all that its self-kernel needs, and of
vectors that are few, a table of each l-mer's kernel with each of them. Sequences are read in
Arrow batches, and a row per result is all that leaves a task; nothing is shuffled.

The table has 4^l rows and a column per vector, so it serves where that comes to at most
DENSE numbers; the joins of `kernel` serve the rest.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.sequence import BASES, DIGITS, forward
from ..functions.tables import Kernel, masks
from ..plans.shared import spread
from .windows import lmers

#: Most numbers of a table that goes to the workers.
DENSE = 1 << 21
#: Numbers of a block of working memory.
BLOCK = 1 << 20
#: Sums by key are arrays over all l-mers up to this length, else sorted.
DIRECT = 8


def packed(text: str | None, l: int) -> np.ndarray:
    """The windows of digits, first base most significant."""
    code = np.frombuffer((text or "").encode(), np.uint8).astype(np.int64) - 48
    if len(code) and not 0 <= code.min() <= code.max() <= 3:
        raise ValueError(f"invalid bases in sequence: {text[:40]}")
    n = max(len(code) - l + 1, 0)
    out = np.zeros(n, np.int64)
    for i in range(l):
        out = out << 2 | code[i : i + n]
    return out


def packed_all(texts: list[str | None], l: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts, one text after the other, and how many each has."""
    size = np.array([len(s or "") for s in texts], np.int64)
    code = np.frombuffer("".join(s or "" for s in texts).encode(), np.uint8).astype(np.int64) - 48
    if len(code) and not 0 <= code.min() <= code.max() <= 3:
        for s in texts:
            packed(s, l)
    n = np.maximum(size - l + 1, 0)
    at = np.arange(n.sum()) + np.repeat(np.cumsum(size) - size - np.cumsum(n) + n, n)
    out = np.zeros(len(at), np.int64)
    for i in range(l):
        out = out << 2 | code[at + i]
    return out, n


def weights(kernel: Kernel, n: int) -> np.ndarray:
    if not kernel.weighted:
        return np.ones(n)
    far = np.abs(n // 2 - np.arange(n))
    return np.minimum(kernel.M, np.floor(np.exp(far * (-0.6931471805599453 / kernel.H)) * kernel.M + 1))


def reversed_lmers(p: np.ndarray, l: int) -> np.ndarray:
    if l <= DIRECT and p.size:
        return _every_reversed(l)[p]
    out = np.zeros_like(p)
    for i in range(l):
        out = out << 2 | (p >> 2 * i & 3 ^ 3)
    return out


@lru_cache
def _every_reversed(l: int) -> np.ndarray:
    p = np.arange(4**l)
    return sum((p >> 2 * i & 3 ^ 3) << 2 * (l - 1 - i) for i in range(l))


def of_pair(kernel: Kernel, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    x = p ^ q
    return np.array(kernel.h)[np.bitwise_count((x | x >> 1) & sum(4**i for i in range(kernel.l)))]


def strands(kernel: Kernel, p: np.ndarray, wt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not kernel.include_rc:
        return p, wt
    return np.concatenate([p, reversed_lmers(p, kernel.l)]), np.concatenate([wt, wt])


def against(kernel: Kernel, p: np.ndarray, q: np.ndarray, wt: np.ndarray) -> np.ndarray:
    """For each l-mer p, the weighted sum over the l-mers q."""
    subsets = masks(kernel.h)
    out = np.zeros(len(p))
    if len(p) * len(q) <= 4 * len(subsets) * (len(p) + len(q)):
        return of_pair(kernel, p[:, None], q) @ wt
    for mask, a in subsets:
        if kernel.l <= DIRECT:
            out += a * np.bincount(q & mask, wt, 4**kernel.l)[p & mask]
        else:
            keys, place = np.unique(q & mask, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, p & mask), len(keys) - 1)
            out += a * np.where(keys[at] == p & mask, np.bincount(place, wt)[at], 0.0)
    return out


def own(kernel: Kernel, p: np.ndarray) -> float:
    """The self-kernel of the sequence with these windows."""
    wt = weights(kernel, len(p))
    return float(wt @ against(kernel, p, *strands(kernel, p, wt))) if len(p) else 0.0


def _weights_all(kernel: Kernel, n: np.ndarray) -> np.ndarray | None:
    """None where all are 1."""
    return np.concatenate([weights(kernel, x) for x in n]) if kernel.weighted and len(n) else None


@lru_cache
def _places(l: int, mask: int) -> tuple[np.ndarray, int]:
    """Each l-mer's place among the keys of the mask, and how many there are."""
    p, fixed = np.arange(4**l), [i for i in range(l) if mask >> 2 * i & 3]
    return sum(((p >> 2 * i & 3) << 2 * j for j, i in enumerate(fixed)), np.zeros_like(p)), 4 ** len(fixed)


def owns(kernel: Kernel, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The self-kernels of sequences with these windows, counted by sequence and key at once."""
    if kernel.l > DIRECT:
        return np.array([own(kernel, x) for x in np.split(p, np.cumsum(n)[:-1])], float) if len(n) else np.zeros(0)
    wt, row, q, out = _weights_all(kernel, n), np.repeat(np.arange(len(n)), n), reversed_lmers(p, kernel.l), np.zeros(len(n))
    for mask, a in masks(kernel.h):
        place, keys = _places(kernel.l, mask)
        first = np.bincount(place[p] + row * keys, wt, len(n) * keys)
        both = first + np.bincount(place[q] + row * keys, wt, len(n) * keys) if kernel.include_rc else first
        out += a * (first * both).reshape(-1, keys).sum(1)
    return out


def counted(kernel: Kernel, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row per sequence, a column per l-mer."""
    keys = p + np.repeat(np.arange(len(n)) * 4**kernel.l, n)
    return np.bincount(keys, _weights_all(kernel, n), len(n) * 4**kernel.l).reshape(len(n), -1).astype(float, copy=False)


def summed(kernel: Kernel, x: np.ndarray) -> np.ndarray:
    """For all l-mers (rows), the weighted sums over the columns of x, rows by l-mer."""
    cube, out = x.reshape((4,) * kernel.l + (-1,)), np.zeros(x.shape)
    for mask, a in masks(kernel.h):
        free = tuple(i for i in range(kernel.l) if not mask >> 2 * (kernel.l - 1 - i) & 3)
        out.reshape(cube.shape)[...] += a * cube.sum(axis=free, keepdims=True)
    return out


class Vectors:
    """ids, coef, table (l-mer by vector: kernel) and own (self-kernels) of sv(id, seq, coef?)."""

    def __init__(self, sv: DataFrame, kernel: Kernel):
        held = sv.select("id", (F.coalesce(F.col("coef").cast("double"), F.lit(0.0)) if "coef" in sv.columns else F.lit(1.0)).alias("coef")).toArrow()
        self.ids, self.coef = held.column("id").combine_chunks(), held.column("coef").to_numpy()
        place = {x: i for i, x in enumerate(self.ids.to_pylist())}
        rows = lmers(sv, kernel).toArrow()  # at most DENSE rows
        x = np.zeros((4**kernel.l, len(self.ids)))
        x[rows.column("p").to_numpy(), [place[i] for i in rows.column("id").to_pylist()]] = rows.column("wt").to_numpy()
        self.table = summed(kernel, x + x[_every_reversed(kernel.l)] if kernel.include_rc else x)
        self.own = (x * self.table).sum(0)


def few(sv: DataFrame, kernel: Kernel) -> bool:
    """Whether a table of the vectors serves: they are few, and have ids of their own."""
    most = DENSE // 4**kernel.l
    n = sv.select("id").limit(most + 1).count() if most else 1
    return n <= most and sv.select("id").distinct().count() == n


def fits(model) -> bool:
    """Whether the model is scored where sequences are: its sums are of normalised kernels or
    of functions of them, over few vectors."""
    return (model.kernel.normalize or model.kernel.rbf) and few(model.sv, model.kernel)


def _mapped(seqs: DataFrame, fields: list[StructField], make) -> DataFrame:
    """make(ids, texts) of parts of Arrow batches, as rows."""
    schema = StructType(fields)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            yield from make(ids, texts)

    rows = spread(seqs.select("id", F.translate(forward(F.col("seq")), BASES, DIGITS).alias("s")))
    return rows.mapInArrow(run, schema)


def _blocks(n: int, width: int):
    step = max(1, BLOCK // width)
    return ((at, min(at + step, n)) for at in range(0, n, step))


def _parts(texts: list[str | None], width: int):
    """Blocks of texts that come to at most BLOCK / 4 letters, or of a single longer one."""
    for lo, hi in _blocks(len(texts), width):
        size = 0
        for i in range(lo, hi):
            size += len(texts[i] or "")
            if size > BLOCK // 4 and i > lo:
                yield lo, i
                lo, size = i, len(texts[i] or "")
        yield lo, hi


def _batch(columns: dict) -> pa.RecordBatch:
    arrays = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _id(df: DataFrame, name: str = "id") -> StructField:
    return StructField(name, df.schema["id"].dataType)


def diagonal(seqs: DataFrame, kernel: Kernel) -> DataFrame:
    """id, k: each sequence's kernel with itself, where it has windows."""

    def make(ids, texts):
        for lo, hi in _parts(texts, 4 ** min(kernel.l, DIRECT)):
            p, n = packed_all(texts[lo:hi], kernel.l)
            at = np.flatnonzero(n)
            yield _batch({"id": ids.take(pa.array(at + lo)), "k": owns(kernel, p, n[at])})

    return _mapped(seqs, [_id(seqs), StructField("k", DoubleType())], make)


def pairwise(x: DataFrame, y: DataFrame, kernel: Kernel) -> DataFrame:
    """a_id, b_id, k: kernel values with few vectors y, where not 0 before the radial function.
    For kernels whose weights are never below 0."""
    held = Vectors(y, kernel)

    def make(ids, texts):
        for lo, hi in _parts(texts, max(4**kernel.l, 4 * len(held.ids))):
            p, n = packed_all(texts[lo:hi], kernel.l)
            k = counted(kernel, p, n) @ held.table
            i, j = np.nonzero(k)
            k = k[i, j]
            if kernel.normalize or kernel.rbf:
                k = k / np.maximum(np.sqrt(owns(kernel, p, n)[i] * held.own[j]), 1e-10)
            if kernel.rbf:
                k = np.exp((k - 1) * kernel.gamma)
            yield _batch({"a_id": ids.take(pa.array(i + lo)), "b_id": held.ids.take(pa.array(j)), "k": k})

    return _mapped(x, [_id(x, "a_id"), _id(y, "b_id"), StructField("k", DoubleType())], make)


def _radial(kernel: Kernel, held: Vectors, k: np.ndarray, ka: np.ndarray) -> np.ndarray:
    """Sums over the vectors (last axis of k)."""
    if kernel.rbf:
        return np.exp((k / np.maximum(np.sqrt(ka[..., None] * held.own), 1e-10) - 1) * kernel.gamma) @ held.coef
    return k[..., 0] / np.maximum(np.sqrt(ka), 1e-10)


def _head(model) -> Vectors:
    """Without a radial function the vectors are one: their sum."""
    held, kernel = Vectors(model.sv, model.kernel), model.kernel
    if not kernel.rbf:
        held.table = (held.table @ (held.coef / np.maximum(np.sqrt(held.own), 1e-10)))[:, None]
    return held


def score(model, seqs: DataFrame) -> DataFrame:
    """id, score; NaN for sequences shorter than l."""
    kernel, bias, held = model.kernel, model.bias, _head(model)

    def make(ids, texts):
        value = np.empty(len(texts))
        for lo, hi in _parts(texts, max(4**kernel.l, held.table.shape[1])):
            p, n = packed_all(texts[lo:hi], kernel.l)
            value[lo:hi] = _radial(kernel, held, counted(kernel, p, n) @ held.table, owns(kernel, p, n)) + bias
        value[[s is not None and len(s) < kernel.l for s in texts]] = np.nan
        yield _batch({"id": ids, "score": value})

    return _mapped(seqs, [_id(seqs), StructField("score", DoubleType())], make)


def mutants(kernel: Kernel, held: Vectors, text: str) -> np.ndarray:
    """f(mutant) - f(sequence) by position and base, each under its own norm. A mutant is its
    sequence and the l-mers that the change takes and adds."""
    l, p = kernel.l, packed(text, kernel.l)
    if not len(p):
        return np.full((len(text), 4), np.nan)
    wt, letters, out = weights(kernel, len(p)), np.frombuffer(text.encode(), np.uint8).astype(np.int64) - 48, np.zeros((len(text), 4))
    both, heavy = strands(kernel, p, wt)
    ka, raw = np.array(own(kernel, p)), wt @ held.table[p]
    before = _radial(kernel, held, raw, ka)
    for lo, hi in _blocks(len(text), 3 * max(held.table.shape[1], 4 * l * l)):
        at = np.arange(lo, hi)[:, None] - np.arange(l)  # windows over the position
        weight = np.where((at >= 0) & (at < len(p)), wt[np.clip(at, 0, len(p) - 1)], 0.0)
        old = p[np.clip(at, 0, len(p) - 1)]
        new = old[:, None, :] ^ np.array([1, 2, 3])[:, None] << 2 * (l - 1 - np.arange(l))
        q = np.concatenate([np.broadcast_to(old[:, None, :], new.shape), new], 2)
        d = np.broadcast_to(np.concatenate([-weight, weight], 1)[:, None, :], q.shape)
        kinds, place = np.unique(q, return_inverse=True)
        cross = (d * against(kernel, kinds, both, heavy)[place.reshape(q.shape)]).sum(2)
        pair = of_pair(kernel, q[..., None], q[..., None, :])
        if kernel.include_rc:
            pair = pair + of_pair(kernel, q[..., None], reversed_lmers(q, l)[..., None, :])
        kb = np.maximum(ka + 2 * cross + (d * (pair * d[..., None, :]).sum(3)).sum(2), 0.0)
        k = np.broadcast_to(raw, kb.shape + raw.shape).copy()
        for i in range(2 * l):
            k += d[..., i, None] * held.table[q[..., i]]
        out[np.arange(lo, hi)[:, None], letters[lo:hi, None] ^ np.array([1, 2, 3])] = _radial(kernel, held, k, kb) - before
    return out


def ism(model, seqs: DataFrame) -> DataFrame:
    """id, pos, base, value as effects.ism has them. Equal sequences of a batch are one."""
    kernel, held = model.kernel, _head(model)

    def make(ids, texts):
        done, out, size = {}, [], 0

        def flush():
            n = [len(texts[i]) for i, _ in out]
            pos = np.concatenate([np.repeat(np.arange(x, dtype=np.int32), 4) for x in n])
            base = pa.DictionaryArray.from_arrays(np.tile(np.arange(4, dtype=np.int8), len(pos) // 4), list(BASES)).cast(pa.string())
            rows = np.repeat([i for i, _ in out], [4 * x for x in n])
            return _batch({"id": ids.take(pa.array(rows)), "pos": pos, "base": base, "value": np.concatenate([v.ravel() for _, v in out])})

        for i, s in enumerate(texts):
            if not s:
                continue
            value = done.get(s)
            if value is None:
                value = mutants(kernel, held, s)
                if len(done) < 1024 and len(s) <= 256:
                    done[s] = value
            out.append((i, value))
            size += value.size
            if size >= BLOCK // 16:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    return _mapped(seqs, [_id(seqs), StructField("pos", IntegerType()), StructField("base", StringType()), StructField("value", DoubleType())], make)
