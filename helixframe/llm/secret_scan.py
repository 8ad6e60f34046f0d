"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Base spans are found by three patterns. The method looks at every candidate value - those
of the base spans, and long mixed tokens besides - and counts over the whole corpus by how
many distinct repositories and owners it is written. Values with `copied` owners or more
are examples that are copied around; values of one owner that look random are live, and
live tokens outside the base spans are added as spans of kind `owned`.

Positions are code points. Where a pattern occurs in a text, its matches and the gaps between
them are taken by one pass each; the lengths become rows, and running sums over a text's rows
give the starts, so the work grows with the number of matches and no more. Texts are read
once; what is shuffled are matches, and for the ownership counts one row per value and owner
after each task's own aggregation.

Defined results: a null text counts as empty and has no spans; a very long text is scanned
whole; a null source counts as one owner; equal rows each have a result; spans of one start
are in the order of their kinds; an empty table gives an empty result; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, sized

#: The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"  # the runs of [0-9a-f]+ that are long enough: a run starts where no hex digit stands before
MIXED = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+"
KINDS = ("assign", "access", "hex", "owned")
HIT = "array<struct<kind:int,nth:int,gap:int,size:int,value:string>>"


def _hits(text: Column, pattern: str, kind: int, value=lambda hit: hit) -> Column:
    """The matches of a pattern: code points since the one before, own code points, value."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def one(x: Column, i: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), value(x["hit"]).alias("value"))

    # one gap more than matches: the text after the last
    rows = F.filter(F.transform(found, one), lambda x: x["size"].isNotNull())
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast(HIT))


def _joined(spans: Column) -> Column:
    """spans (start, kind, end), in order, as text."""
    name = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def _random(value: Column) -> Column:
    """Looks like a generated key: 10 different characters or more, and no long run of one."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= 10) & ~value.rlike(r"(.)\1{5}|(?i:example|sample|dummy|xxxx|test)")


def scan(docs: DataFrame, copied: int = 3, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_example."""
    text = F.coalesce(F.col("text"), F.lit(""))
    clear = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    names = [c for c in repository if c in docs.columns]
    rows = docs.select("doc_id", clear(owner).alias("owner"), F.concat_ws("\x00", *[clear(c) for c in names]).alias("repository"), text.alias("text"))
    written = lambda hit: F.regexp_extract(hit, ASSIGN, 1)
    hits = F.concat(_hits(F.col("text"), ASSIGN, 0, written), _hits(F.col("text"), ACCESS, 1), _hits(F.col("text"), HEX, 2), _hits(F.col("text"), MIXED, 3))
    rows = rows.select(F.monotonically_increasing_id().alias("rk"), "doc_id", "owner", "repository", hits.alias("hits"))
    rows = materialize(rows, "secrets-found")
    spans = _spans(rows.filter(F.size("hits") > 0).select("rk", "owner", "repository", F.inline("hits")))
    spans = materialize(spans.withColumn("hash", F.sha2("value", 256)).withColumn("random", _random(F.col("value"))).drop("value"), "secrets-spans")
    owned = spans.select("hash", "owner", "repository").distinct().groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    # from a table both sides of the join are plain shuffles, of which Spark can split a value that is everywhere
    judged = spans.join(sized(materialize(owned, "secrets-owned")), "hash").select(
        "rk", "kind", F.struct("start", "kind", "end").alias("span"), ((F.col("owners") == 1) & F.col("random")).alias("live"), (F.col("owners") >= copied).alias("example")
    )
    kind = F.col("kind")
    by_row = judged.groupBy("rk").agg(
        *[F.count_if(kind == k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])], F.count_if((kind == 3) & F.col("live")).alias("n_owned"),
        F.collect_list(F.when(kind < 3, F.col("span"))).alias("base"), F.collect_list(F.when((kind < 3) | F.col("live"), F.col("span"))).alias("every"),
        F.count_if("live").alias("n_live"), F.count_if("example").alias("n_example"),
    ).select("rk", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"), "n_owned", "n_live", "n_example")
    out = rows.select("rk", "doc_id").join(sized(materialize(by_row, "secrets-rows")), "rk", "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        "doc_id", none("n_assign"), none("n_access"), none("n_hex"), F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), none("n_owned"), none("n_live"), none("n_example"),
    )


def _spans(hits: DataFrame) -> DataFrame:
    """hits (rk, kind, nth, gap, size, value, ...) -> rk, kind, start, end, value, ...: matches
    that fail their kind's condition are gone, and mixed tokens that a base span overlaps."""
    upto = W.partitionBy("rk", "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    rows = hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    value, kind = F.col("value"), F.col("kind")
    mixed = value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]") & _random(value)
    rows = rows.filter((kind == 0) & (F.length(value) >= 6) | (kind == 1) & (F.length(value) >= 20) | (kind == 2) | (kind == 3) & mixed).drop("nth", "gap", "size")
    # in the order of where a base span starts and a mixed token ends, the farthest end of base
    # spans so far tells whether one that starts before the token's end reaches into it
    base = kind < 3
    before = W.partitionBy("rk").orderBy(F.when(base, F.col("start")).otherwise(F.col("end")), base).rowsBetween(W.unboundedPreceding, -1)
    far = F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(0))
    return rows.withColumn("far", far).filter(base | (F.col("far") <= F.col("start"))).drop("far")
