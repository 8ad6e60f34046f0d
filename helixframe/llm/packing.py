"""Best-fit packing of token sequences through a configuration linear program.

Documents are cut into pieces of at most `capacity` tokens. Only the histogram of piece
lengths (at most `capacity` numbers, however large the corpus) comes to the driver, where
the configuration LP - as few bins as possible, each a multiset of lengths that fits - is
solved by multiplicative weights: lengths have prices, an unbounded knapsack over the
capacity finds the configurations worth most or nearly so, each is used for a part of its
scarcest length, and the prices of what is covered fall, until every length is covered. The
solution is rounded down, configurations get one bin more by their fractions while pieces
last, and only what rounding leaves is packed best-fit on the histogram. Configurations are
then dealt to the pieces by their place among the pieces of their length, without moving the
documents.

Ids are those of the `tokenizers` file given. Byte-level BPE whose merges are in the order
of their ids is equal to BPE by rank, which is checked when the file is loaded; the ids are
then made by rank, and those of space-separated chunks are remembered. Other files go
through the `tokenizers` library.

Defined results: a null or empty text is the closing id alone; equal rows are packed as so
many documents; an empty table gives an empty result; very long texts give many pieces; a
null doc_id is kept; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONGEST, copy_numbers, materialize, worker_cache

#: Fixed value: how byte-level BPE of this kind cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 300_000
#: Most pieces of a length that are numbered in one task.
RANKED = 1 << 16
#: Part of a length that a round may cover, fall of the prices, share of the best worth: from coarse to fine.
LEVELS = ((1 / 8, 0.5, 0.97), (1 / 16, 8.0, 0.97), (1 / 32, 16.0, 0.99))
CLOSE = 0.001
#: Where a space isn't surely the start of a chunk of its own.
UNSURE = re.compile(r" [^\S ]|  |[\x1c-\x1f\x85]")


class _Ids(dict):
    """Chunk -> its ids as 32-bit numbers, remembered up to CACHED chunks of ordinary length."""

    def __init__(self, encode, prefix: str):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.encode(self.prefix + chunk)).tobytes()
        if len(self) < CACHED and len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids


def _byte_of() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_encoder(path: str):
    """A function text -> ids as bytes (little-endian, 32 bits each)."""
    spec = json.load(open(path, encoding="utf-8"))
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    vocab, added = model["vocab"], {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
    made = [vocab.get(a + b, -1) for a, b in merges]
    plain = all(not spec.get(k) for k in ("normalizer", "truncation", "padding")) and model["type"] == "BPE"
    plain = plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    plain = plain and all(not a.get(k) for a in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
    plain = plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or made != sorted(set(made)) or len(made) + 256 != len(set(vocab) - set(added)):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda text: np.asarray(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    import tiktoken

    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
    bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    first, later, names = _Ids(bpe.encode_ordinary, ""), _Ids(bpe.encode_ordinary, " "), set(added)

    def encode(text: str) -> bytes:
        if UNSURE.search(text) or any(x in text for x in names):
            return np.asarray(bpe.encode(text, allowed_special=names), "<u4").tobytes()
        head, *rest = text.split(" ")
        return b"".join([first[head], *map(later.__getitem__, rest)])

    return encode


def _tokenizer_file(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the first piece takes what is over."""

    def cut(batches):
        name = _tokenizer_file(path)
        encode, end = worker_cache(("ids", name), lambda: load_encoder(name)), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + end)
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    length = (n - at) % capacity or capacity
                    for column, value in zip(out, (doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])), strict=True):
                        column.append(value)
                    at, k = at + length, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, PIECES.types, strict=True)], schema=PIECES)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def near_best(price: np.ndarray, lengths: np.ndarray, capacity: int, share: float) -> list[tuple[tuple[int, int], ...]]:
    """Unbounded knapsack: for each length the fitting multiset worth most among those that
    hold it, if worth `share` of the best at least; worth most first."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := ends[c]:
            worth = price[:k] + best[c - lengths[:k]]
            i = int(worth.argmax())
            if worth[i] > best[c]:
                best[c], last[c] = worth[i], i
    filled = np.maximum.accumulate(np.where(last >= 0, np.arange(capacity + 1), 0))
    value = price + best[capacity - lengths]
    first = np.flatnonzero(value >= share * best[capacity])
    found = [[int(i)] for i in first]
    room = filled[capacity - lengths[first]]
    live = np.flatnonzero(room > 0)
    while len(live):
        item = last[room[live]]
        for x, i in zip(live.tolist(), item.tolist(), strict=True):
            found[x].append(i)
        room[live] = filled[room[live] - lengths[item]]
        live = live[room[live] > 0]
    made = {tuple(sorted(Counter(x).items())): v for x, v in zip(found, value[first].tolist(), strict=True)}
    return sorted(made, key=lambda c: (-made[c], c))


def cover(need: np.ndarray, lengths: np.ndarray, capacity: int, part: float, step: float, share: float) -> dict[tuple[tuple[int, int], ...], float]:
    """Configuration -> bins, a fractional cover of every length, exactly as often as needed.
    A round covers at most `part` of a length's need; lengths leave when they are covered."""
    rest, price, used = need.copy(), lengths / capacity, defaultdict(float)
    while len(live := np.flatnonzero(rest > 1e-9 * need)):
        ids = live.tolist()
        full = np.minimum(rest, need * part)[live]
        limit = full.tolist()
        for n, found in enumerate(near_best(price[live], lengths[live], capacity, share)):
            bins = min(limit[i] / a for i, a in found)
            # those that others of the round have left little for would be slivers
            if bins > 0 and (n == 0 or bins >= min(full[i] / a for i, a in found) / 2):
                used[tuple((ids[i], a) for i, a in found)] += bins
                for i, a in found:
                    limit[i] -= bins * a
        covered = np.zeros(len(need))
        covered[live] = full - limit
        rest -= covered
        price = price * np.exp(-step * covered / need)
    return used


def programme(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """[(length -> copies, bins)] of the linear programme in whole bins, and the pieces that
    rounding leaves over. Steps get finer until the programme is CLOSE to the tokens' bound."""
    left = {length: n for length, n in histogram.items() if n > 0}
    out = [({length: 1}, left.pop(length)) for length in list(left) if length == capacity]
    if not left:
        return out, left
    lengths = np.array(sorted(left), dtype=np.int64)
    need = np.array([left[int(x)] for x in lengths], dtype=float)
    used: dict = {}
    for level in LEVELS:
        found = cover(need, lengths, capacity, *level)
        if not used or sum(found.values()) < sum(used.values()):
            used = found
        if sum(used.values()) <= (1 + CLOSE) * float(need @ lengths) / capacity:
            break
    whole: Counter = Counter()
    rest = need.astype(np.int64).tolist()

    def take(key, bins: int) -> None:
        if bins := min([bins] + [rest[i] // a for i, a in key]):
            whole[key] += bins
            for i, a in key:
                rest[i] -= bins * a

    for key, bins in sorted(used.items(), key=lambda x: (-x[1], x[0])):
        take(key, int(bins + 1e-6))
    for key, _ in sorted(used.items(), key=lambda x: (-(x[1] % 1), x[0])):
        take(key, 1)
    out += [({int(lengths[i]): a for i, a in key}, bins) for key, bins in whole.items()]
    return out, {int(x): n for x, n in zip(lengths, rest, strict=True) if n}


def configurations(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(length -> copies, bins)], covering the histogram exactly."""
    out, left = programme(histogram, capacity)
    return out + best_fit(left, capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over whole groups of equal bins; as much work as there are
    different lengths and fills, not pieces."""
    groups: dict[int, Counter] = defaultdict(Counter)  # room -> configuration -> bins
    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        n = histogram[length]
        while n:
            room = min((r for r in groups if r >= length), default=None)
            if room is None:
                fit = capacity // length
                full, rest = divmod(n, fit)
                if full:
                    groups[capacity - fit * length][((length, fit),)] += full
                if rest:
                    groups[capacity - rest * length][((length, rest),)] += 1
                break
            key, bins = groups[room].popitem()
            fit = min(room // length, n)
            take = min(bins, n // fit)
            if take < bins:
                groups[room][key] = bins - take
            if not groups[room]:
                del groups[room]
            groups[room - fit * length][(*key, (length, fit))] += take
            n -= fit * take
    found: Counter = Counter()
    for by_key in groups.values():
        found.update(by_key)
    return [(dict(key), bins) for key, bins in found.items()]


def _slots(plan: list[tuple[dict[int, int], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which place on, copies to a bin, first bin, offset of the first copy."""
    rows: dict[int, list] = defaultdict(list)
    used: Counter = Counter()
    first = 0
    for config, bins in plan:
        at = 0
        for length, a in sorted(config.items(), reverse=True):
            rows[length].append((used[length], a, first, at))
            used[length] += a * bins
            at += a * length
        first += bins
    return {length: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for length, r in rows.items()}


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, capacity, end_id), "pack-pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = F.col("length") == capacity
    # a full piece is a sequence of its own: its row's number will do, and is below those of the plan
    alone = cut.filter(full).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    histogram = {r["length"]: r["n"] for r in cut.filter(~full).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # fewer than `capacity` rows
    if not histogram:
        return alone
    slots = spark.sparkContext.broadcast(_slots(configurations(histogram, capacity), capacity))  # bounded by the capacity
    # so that a task gets a part of a frequent length only
    share = max(256, min(RANKED, sum(histogram.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    ranked = copy_numbers(cut.filter(~full), ["length"], "place", share)
    schema = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def deal(batches):
        table = slots.value
        for batch in batches:
            length, place = batch.column(3).to_numpy(), batch.column(5).to_numpy() - 1
            sequence, offset = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                since, copies, first, at = table[int(x)]
                i = np.searchsorted(since, place[rows], "right") - 1
                nth = place[rows] - since[i]
                sequence[rows] = first[i] + nth // copies[i]
                offset[rows] = at[i] + nth % copies[i] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=schema)

    dealt = ranked.select(*names, "place").mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return dealt.unionByName(alone)
