"""Queries over the test tables, each over whole tables and whole texts, and the same in SQL
by another formulation (all pairs of l-mers compared) where SQL can express it.

The tables hold no DNA: texts are read as DNA-like strings (functions.sequence.dna_of_text).
"""

from __future__ import annotations

import math
import uuid
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequence as S
from .functions.tables import Kernel, importance_weights, perturbation_weights
from .operators import effects, evaluate, kernel, loci, train, windows
from .operators.deltasvm import DeltaSVM, ensemble
from .operators.explain import completeness, explain
from .operators.model import GkmModel
from .plans.shared import shared_dir
from .sources import models, text

L, K = 6, 4
PLAIN = Kernel(0, L, K, None, normalize=False)
NORMAL = Kernel(0, L, K, None)
RADIAL = Kernel(6, L, K, None, gamma=2.0)
TRUNCATED = Kernel(2, L, K, 2, normalize=False)
CENTRED = Kernel(4, L, K, 2, M=20, H=10.0, normalize=False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), S.dna_of_text(F.col("text")).alias("seq"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), S.dna_of_text(F.col("text")).alias("seq"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), S.dna_of_text(F.col("text")).alias("seq"))


def model(spark: SparkSession, d: str, kern: Kernel = PLAIN) -> GkmModel:
    coef = ((F.col("id") % 7 - 3) / 4.0).alias("coef")
    return GkmModel(items(spark, d).select("id", "seq", coef), kern, 0.25)


def mutated(seqs: DataFrame) -> DataFrame:
    """The central letter replaced by its complement."""
    at = F.floor(F.length("seq") / 2).cast("int") + 1
    return seqs.select("id", F.overlay("seq", F.translate(F.substring(F.col("seq"), at, F.lit(1)), "ACGT", "TGCA"), at, F.lit(1)).alias("seq"))


def linear(spark: SparkSession, k: int = K, l: int = L, step: int = 37, include_rc: bool = True) -> DeltaSVM:
    rows = spark.range(4**k).select(S.kmer_of(F.col("id"), k).alias("kmer"), (((F.col("id") * step) % 101 - 50) / 16.0).alias("w"))
    return DeltaSVM(rows, l, k, include_rc, 0.5)


def intervals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("chrom"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 7).alias("end"))
    right = table(spark, d, "supplier").select(F.when(F.col("s_nationkey") < 12, "F").otherwise("O").alias("chrom"), (F.col("s_suppkey") * 900).alias("start"), (F.col("s_suppkey") * 900 + 250).alias("end"))
    return left, right


def genome(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("id").cast("string").alias("chrom"), "seq")


def places(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 997).cast("string").alias("chrom"), F.col("o_custkey").alias("start"))
    return rows.withColumn("end", F.col("start") + 20)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id").select("doc_id", "score", F.col("quality").alias("label"))


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/helixframe/{name}-{uuid.uuid4().hex}"


def seq_encode(spark, d):
    return documents(spark, d).select("id", F.length("seq").alias("n"), F.md5(F.array_join(S.codes(F.col("seq")).cast("array<string>"), "")).alias("codes"))


def reverse_complement(spark, d):
    return documents(spark, d).select("id", S.reverse_complement(F.col("seq")).alias("rc"))


def one_hot_round_trip(spark, d):
    code = documents(spark, d).select("id", S.one_hot(F.col("seq")).alias("x"))
    return code.select("id", S.is_one_hot(F.col("x")).alias("valid"), S.one_hot_decode(F.col("x")).alias("seq"))


def code_round_trip(spark, d):
    return turns(spark, d).select("id", S.decode_codes(S.codes(F.col("seq"))).alias("seq"))


def kmer_index_round_trip(spark, d):
    rows = spark.range(4**K).select(F.col("id").alias("place"), S.kmer_of(F.col("id"), K).alias("kmer"))
    return rows.select("place", "kmer", S.kmer_index(F.col("kmer")).alias("again"))


def center_crop(spark, d):
    return turns(spark, d).select("id", S.center_crop(F.col("seq"), 51).alias("seq"))


def window_explode(spark, d):
    rows = windows.windows(turns(spark, d), PLAIN)
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pos").cast("long") * F.col("p")).alias("total"))


def lmer_count(spark, d):
    return windows.lmers(turns(spark, d), PLAIN, True)


def canonical_lmers(spark, d):
    rows = windows.kmers(documents(spark, d), L).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(F.least("kmer", S.reverse_complement(F.col("kmer"))).alias("kmer")).agg(F.sum("n").alias("n"))


def distinct_lmers(spark, d):
    return windows.windows(documents(spark, d), PLAIN).agg(F.count_distinct("p").alias("n"))


def mismatch_hist(spark, d):
    a = windows.windows(items(spark, d), PLAIN).groupBy("p").agg(F.count(F.lit(1)).alias("x"))
    b = windows.windows(items(spark, d), PLAIN, "-").groupBy(F.col("p").alias("q")).agg(F.count(F.lit(1)).alias("y"))
    pairs = a.join(b).withColumn("m", S.mismatches(F.col("p"), F.col("q"), L))  # at most 4 ** L l-mers on a side
    return pairs.groupBy("m").agg(F.sum(F.col("x") * F.col("y")).alias("pairs"))


def gkm_cnt_raw(spark, d):
    return kernel.raw_kernel(items(spark, d), items(spark, d), PLAIN)


def gkm_cnt_norc(spark, d):
    return kernel.raw_kernel(items(spark, d), items(spark, d), Kernel(0, L, K, None, include_rc=False))


def gkm_cnt_d_cutoff(spark, d):
    return kernel.raw_kernel(items(spark, d), items(spark, d), Kernel(0, L, K, 1))


def gkm_neighbour_join(spark, d):
    return kernel.raw_kernel(items(spark, d), items(spark, d), Kernel(0, L, K, 1), "neighbour")


def gkm_diag(spark, d):
    return kernel.diagonal(turns(spark, d), PLAIN)


def gkm_norm(spark, d):
    return r6(kernel.pairwise(turns(spark, d), items(spark, d), NORMAL), "k")


def gkm_rbf(spark, d):
    return r6(kernel.pairwise(items(spark, d), items(spark, d), RADIAL), "k")


def gkm_esttrunc(spark, d):
    return r6(kernel.raw_kernel(items(spark, d), items(spark, d), TRUNCATED), "k")


def gkm_estfull(spark, d):
    return r6(kernel.raw_kernel(items(spark, d), items(spark, d), Kernel(1, L, K, 2)), "k")


def window_weights(spark, d):
    return windows.windows(items(spark, d), CENTRED).groupBy("id", "pos").agg(F.max("wt").alias("wt"))


def wgkm_raw(spark, d):
    return r6(kernel.raw_kernel(items(spark, d), items(spark, d), CENTRED), "k")


def gram_upper(spark, d):
    return r6(kernel.gram(items(spark, d), NORMAL), "k")


def gram_topk(spark, d):
    return r6(kernel.nearest(items(spark, d), NORMAL, 5), "k")


def sv_lmer_weights(spark, d):
    return model(spark, d).lmer_sums()


def lmer_marginals(spark, d):
    return model(spark, d).marginals().groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("s")).alias("total"))


def score_linear(spark, d):
    return r6(model(spark, d).score(documents(spark, d)), "score")


def score_normalized(spark, d):
    return r6(model(spark, d, NORMAL).score(turns(spark, d)), "score")


def score_rbf(spark, d):
    return r6(model(spark, d, RADIAL).score(turns(spark, d)), "score")


def deltasvm_score(spark, d):
    return linear(spark, L).score(documents(spark, d))


def deltasvm_gapped_score(spark, d):
    return linear(spark).score(turns(spark, d))


def deltasvm_ensemble(spark, d):
    return ensemble([linear(spark, L), linear(spark, L, step=41)]).score(turns(spark, d))


def deltasvm_variants(spark, d):
    return linear(spark, L).score_variants(turns(spark, d), mutated(turns(spark, d)))


def score_sum(spark, d):
    return evaluate.sum_scores([linear(spark, L).score(turns(spark, d)), linear(spark, L, step=41).score(turns(spark, d))])


def to_deltasvm(spark, d):
    return r6(model(spark, d).to_deltasvm().weights, "w")


def to_deltasvm_rbf(spark, d):
    return r6(model(spark, d, Kernel(6, 4, 2, None)).to_deltasvm().weights, "w")


def variant_delta(spark, d):
    ref = turns(spark, d)
    return r6(model(spark, d).score_variants(ref, mutated(ref)), "score")


def mutation_impact_linear(spark, d):
    ref = items(spark, d)
    return r6(effects.mutation_impact(model(spark, d, NORMAL), ref, mutated(ref)), "score")


def mutation_impact_rbf(spark, d):
    ref = items(spark, d)
    return r6(effects.mutation_impact(model(spark, d, RADIAL), ref, mutated(ref)), "score")


def ism(spark, d):
    return r6(effects.ism(model(spark, d), items(spark, d)), "value")


def explain_hypothetical(spark, d):
    return r6(explain(model(spark, d), items(spark, d), "hypothetical"), "value")


def explain_importance(spark, d):
    return r6(explain(model(spark, d), items(spark, d)), "value")


def explain_top_positions(spark, d):
    return evaluate.top_positions(explain_importance(spark, d), 5)


def explain_perturbation(spark, d):
    return r6(explain(model(spark, d), items(spark, d), "perturbation"), "value")


def explain_completeness(spark, d):
    return r6(completeness(model(spark, d, RADIAL), items(spark, d)), "scored", "explained")


def loci_window(spark, d):
    return loci.extract(places(spark, d), genome(spark, d), 30).select("o_orderkey", "win_start", "seq", "kept")


def allele_windows(spark, d):
    rows = places(spark, d).select("o_orderkey", "chrom", F.col("start").alias("pos"), F.lit("A").alias("ref"), F.lit("g").alias("alt"))
    return loci.allele_windows(rows, genome(spark, d), 21).select("o_orderkey", "ref_seq", "alt_seq")


def interval_anti_join(spark, d):
    left, right = intervals(spark, d)
    return loci.overlapping(left, right, "left_anti").select("o_orderkey")


def chromosome_split(spark, d):
    kept, held = loci.split_chromosomes(intervals(spark, d)[0], ["F"])
    return kept.groupBy(F.lit("train").alias("part")).agg(F.count(F.lit(1)).alias("n")).unionByName(held.groupBy(F.lit("test").alias("part")).agg(F.count(F.lit(1)).alias("n")))


def gc_bin_counts(spark, d):
    return documents(spark, d).groupBy(evaluate.gc_bin(F.col("seq")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def gc_bin_match(spark, d):
    pool = documents(spark, d).withColumn("bin", evaluate.gc_bin(F.col("seq")))
    like = turns(spark, d).withColumn("bin", evaluate.gc_bin(F.col("seq")))
    return evaluate.matched_sample(pool, like, ["bin"], fill=False).select("id", "bin")


def auroc(spark, d):
    return r6(evaluate.auroc(labelled(spark, d)), "auroc")


def average_precision(spark, d):
    return r6(evaluate.average_precision(labelled(spark, d)), "average_precision")


def variant_evaluation(spark, d):
    rows = labelled(spark, d).withColumn("score", F.col("score") - 1000).withColumn("significant", F.col("label") == 1)
    return r6(evaluate.variant_evaluation(rows), "auroc", "average_precision")


def pearson_spearman(spark, d):
    return r6(evaluate.correlations(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), "pearson", "spearman")


def agreement_stats(spark, d):
    rows = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    return r6(evaluate.agreement(rows, "net", "l_extendedprice"), "max_abs", "max_rel", "corr")


def best_effect(spark, d):
    effects_ = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_discount").alias("p"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    return evaluate.best_effect(table(spark, d, "orders").select("o_orderkey"), effects_, ["o_orderkey"])


def allele_check(spark, d):
    rows = documents(spark, d).withColumn("allele", F.lit("a")).filter("length(seq) > 0")
    return r6(evaluate.allele_mismatch(rows, "seq", "allele", F.lit(0)), "mismatch")


def longest_prefix(spark, d):
    parts = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    words = parts.select(F.split("name", " ")[0].alias("prefix")).union(parts.select(F.substring("name", 1, 2))).distinct()
    return evaluate.longest_prefix(parts, words)


def fasta_round_trip(spark, d):
    path = shared_path(spark, "fasta")
    text.write_fasta(documents(spark, d).select(F.concat(F.lit("doc "), F.col("id").cast("string")).alias("name"), "seq"), path)
    return text.read_fasta(spark, path).select("name", "seq")


def bed_round_trip(spark, d):
    path = shared_path(spark, "bed")
    intervals(spark, d)[0].select(F.concat_ws("\t", "chrom", "start", "end", F.lit(".")).alias("value")).write.text(path)
    return text.read_loci(spark, path)


def model_round_trip(spark, d):
    path = shared_path(spark, "model")
    models.save(model(spark, d), path)
    return r6(models.load(spark, path).score(items(spark, d)), "score")


def train_svc(spark, d):
    pos = items(spark, d)
    found = train.train_svc(pos, pos.select("id", F.reverse("seq").alias("seq")), Kernel(2, L, K, 2, include_rc=False))
    return r6(found.score(pos), "score")


def train_svr(spark, d):
    rows = items(spark, d).withColumn("y", F.length("seq") / 100.0)
    return r6(train.train_svr(rows, Kernel(2, L, K, 2)).score(rows), "score")


def train_nystrom(spark, d):
    pos = items(spark, d)
    found = train.train_svc(pos, pos.select("id", F.reverse("seq").alias("seq")), Kernel(2, L, K, 2, include_rc=False), solver="nystrom", landmarks=40)
    return r6(found.score(pos), "score")


QUERIES = {
    f.__name__: f
    for f in (
        seq_encode, reverse_complement, one_hot_round_trip, center_crop, window_explode, lmer_count, canonical_lmers, distinct_lmers, mismatch_hist, gkm_cnt_raw, gkm_cnt_norc,
        gkm_cnt_d_cutoff, gkm_neighbour_join, gkm_diag, gkm_norm, gkm_rbf, gkm_esttrunc, gkm_estfull, window_weights, wgkm_raw, gram_upper, gram_topk, sv_lmer_weights, lmer_marginals,
        score_linear, score_normalized, score_rbf, deltasvm_score, deltasvm_gapped_score, deltasvm_ensemble, to_deltasvm, to_deltasvm_rbf, variant_delta, mutation_impact_linear,
        mutation_impact_rbf, ism, explain_hypothetical, explain_importance, explain_perturbation, explain_completeness, loci_window, allele_windows, interval_anti_join, chromosome_split,
        gc_bin_counts, gc_bin_match, auroc, average_precision, pearson_spearman, agreement_stats, best_effect, allele_check, longest_prefix, fasta_round_trip, bed_round_trip,
        model_round_trip, train_svc, train_svr, train_nystrom, code_round_trip, kmer_index_round_trip, deltasvm_variants, score_sum, explain_top_positions, variant_evaluation,
    )
}


# SQL ------------------------------------------------------------------------------------

_DNA = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
_FROM = {"items": f"SELECT item_id AS id, {_DNA} AS seq FROM benchmark", "documents": f"SELECT doc_id AS id, {_DNA} AS seq FROM documents", "turns": f"SELECT conv_id * 1000 + turn AS id, {_DNA} AS seq FROM conversations"}
_RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
_MUTATED = "SELECT id, substr(seq, 1, length(seq) // 2) || translate(substr(seq, length(seq) // 2 + 1, 1), 'ACGT', 'TGCA') || substr(seq, length(seq) // 2 + 2) AS seq FROM {0}"


def _code(w: str, l: int = L) -> str:
    return "CAST(" + " + ".join(f"(instr('ACGT', substr({w}, {i}, 1)) - 1) * {4 ** (l - i)}" for i in range(1, l + 1)) + " AS BIGINT)"


def _m(p: str, q: str, l: int = L) -> str:
    return f"CAST(bit_count(((xor({p}, {q}) >> 1) | xor({p}, {q})) & {sum(4**i for i in range(l))}) AS INT)"


def _list(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]"


def _weight(pos: str, n: str, kern: Kernel) -> str:
    return f"least({float(kern.M)}, floor(exp(abs({n} // 2 - {pos}) * {-0.6931471805599453 / kern.H!r}) * {kern.M} + 1))" if kern.weighted else "1.0"


def _windows(name: str, source: str, kern: Kernel) -> str:
    """CTEs: source_w (id, pos, p, wt) of the forward strand, source_r of the reverse."""
    l = kern.l
    n = f"(length(seq) - {l - 1})"
    at = f"unnest(range(CAST({n} AS BIGINT))) AS u(i)"
    fwd = f"{name}_w AS (SELECT id, i AS pos, {_code(f'substr(seq, CAST(i AS INT) + 1, {l})', l)} AS p, CAST({_weight('i', n, kern)} AS DOUBLE) AS wt FROM {source}, {at} WHERE {n} > 0)"
    rev = f"{name}_r AS (SELECT id, i AS pos, {_code(f'substr(rc, CAST(i AS INT) + 1, {l})', l)} AS p, CAST({_weight(f'({n} - 1 - i)', n, kern)} AS DOUBLE) AS wt FROM (SELECT id, seq, {_RC} AS rc FROM {source}), {at} WHERE {n} > 0)"
    one = f"{name}_f AS (SELECT id, p, sum(wt) AS wt FROM {name}_w GROUP BY id, p)"
    both = f"{name}_b AS (SELECT id, p, sum(wt) AS wt FROM (SELECT * FROM {name}_w{f' UNION ALL SELECT * FROM {name}_r' if kern.include_rc else ''}) GROUP BY id, p)"
    return ", ".join((fwd, rev, one, both))


def _raw(a: str, b: str, kern: Kernel, where: str = "TRUE") -> str:
    m = _m("a.p", "b.p", kern.l)
    return f"SELECT a.id AS a_id, b.id AS b_id, sum(list_extract({_list(kern.h)}, {m} + 1) * a.wt * b.wt) AS k FROM {a}_f a JOIN {b}_b b ON {m} <= {kern.reach} AND {where} GROUP BY a.id, b.id"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _tables(kern: Kernel, *names: str) -> list[str]:
    return [x for n in names for x in (f"{n} AS ({_FROM[n]})", _windows(n, n, kern))]


_SV = "sv AS (SELECT id, (id % 7 - 3) / 4.0 AS coef FROM items)"


def _vector_sums(kern: Kernel) -> str:
    return f"v AS (SELECT p, CAST(sum(coef * wt) AS DOUBLE) AS v FROM items_b JOIN sv USING (id) GROUP BY p)"


def _lmer_weights(kern: Kernel) -> str:
    m = _m("a.p", "v.p", kern.l)
    return f"every AS (SELECT range AS p FROM range({4**kern.l})), w AS (SELECT a.p, sum(list_extract({_list(kern.h)}, {m} + 1) * v.v) AS w FROM every a JOIN v ON {m} <= {kern.reach} GROUP BY a.p)"


def _scores(source: str, kern: Kernel, name: str) -> str:
    """CTE name(id, score) of sequences `source`, whose windows exist, by all pairs."""
    return f"{name}_p AS ({_pairs(source, kern)}), {name} AS (SELECT s.id, CASE WHEN length(s.seq) < {kern.l} THEN 'NaN'::DOUBLE ELSE coalesce(f, {_rest(kern)}) + 0.25 END AS score FROM {source} s LEFT JOIN (SELECT a_id, sum(coef * {_value(kern)}) + {_rest(kern)} AS f FROM {name}_p GROUP BY a_id) p ON s.id = p.a_id)"


def _rest(kern: Kernel) -> str:
    return f"(SELECT sum(coef) FROM sv) * {math.exp(-kern.gamma)!r}" if kern.rbf else "0.0"


def _value(kern: Kernel) -> str:
    return f"(exp({kern.gamma} * (kn - 1)) - {math.exp(-kern.gamma)!r})" if kern.rbf else "kn"


def _pairs(source: str, kern: Kernel, norm: str | None = None) -> str:
    """a_id, s_id, coef, kn."""
    if not (kern.normalize or kern.rbf):
        return f"SELECT a_id, b_id AS s_id, coef, k AS kn FROM ({_raw(source, 'items', kern)}) x JOIN sv ON sv.id = b_id"
    da, db = (f"(SELECT a_id AS id, k FROM ({_raw(n, n, kern, 'a.id = b.id')}) y)" for n in (norm or source, "items"))
    return f"SELECT x.a_id, x.b_id AS s_id, coef, x.k / greatest(sqrt(da.k * db.k), 1e-10) AS kn FROM ({_raw(source, 'items', kern)}) x JOIN {da} da ON da.id = x.a_id JOIN {db} db ON db.id = x.b_id JOIN sv ON sv.id = x.b_id"


def _kernel_sql(kern: Kernel, digits: bool = True) -> str:
    k = "round(k, 6)" if digits else "k"
    return _with(*_tables(kern, "items")) + f"SELECT a_id, b_id, {k} AS k FROM ({_raw('items', 'items', kern)}) x"


def _norm_sql(a: str, kern: Kernel, where: str = "TRUE") -> str:
    da, db = (f"(SELECT a_id AS id, k FROM ({_raw(n, n, kern, 'a.id = b.id')}) y)" for n in (a, "items"))
    v = "x.k / greatest(sqrt(da.k * db.k), 1e-10)"
    v = f"exp({kern.gamma} * ({v} - 1))" if kern.rbf else v
    return f"SELECT x.a_id, x.b_id, {v} AS k FROM ({_raw(a, 'items', kern)}) x JOIN {da} da ON da.id = x.a_id JOIN {db} db ON db.id = x.b_id WHERE {where}"


def _impact_sql(kern: Kernel) -> str:
    parts = [*_tables(kern, "items"), _SV, f"alt AS ({_MUTATED.format('items')})", _windows("alt", "alt", kern), f"o AS ({_pairs('items', kern)})", f"n AS ({_pairs('alt', kern, 'items')})"]
    change = "(coalesce(n.kn, 0) - coalesce(o.kn, 0))"
    if kern.rbf:
        change = f"CASE WHEN coalesce(o.kn, 0) > 0 THEN {change} * (exp({kern.gamma} * (o.kn - 1)) - {math.exp(-kern.gamma)!r}) / o.kn ELSE 0 END"
    return _with(*parts) + f"SELECT coalesce(o.a_id, n.a_id) AS id, round(sum(coalesce(o.coef, n.coef) * {change}), 6) AS score FROM o FULL JOIN n ON o.a_id = n.a_id AND o.s_id = n.s_id GROUP BY 1"


def _linear_cte(k: int, step: int = 37, name: str = "lw") -> str:
    return f"{name} AS (SELECT range AS p, ((range * {step}) % 101 - 50) / 16.0 AS w FROM range({4**k}))"


def _explain_sql(mode: str) -> str:
    match, other = perturbation_weights(PLAIN.h) if mode == "perturbation" else importance_weights(PLAIN.h, PLAIN.d)
    reach = max(m for m in range(L + 1) if match[m] or other[m])
    parts = [*_tables(PLAIN, "items"), _SV, _vector_sums(PLAIN), f"near AS (SELECT a.p, v.p AS q, v.v, {_m('a.p', 'v.p')} AS m FROM (SELECT DISTINCT p FROM items_w) a JOIN v ON {_m('a.p', 'v.p')} <= {reach})"]
    digit = "(({0} >> CAST(2 * (5 - k) AS INT)) & 3)"
    parts.append(f"share AS (SELECT p, k, {digit.format('p')} AS x, {digit.format('q')} AS y, sum(v * CASE WHEN {digit.format('p')} = {digit.format('q')} THEN list_extract({_list(match)}, m + 1) ELSE list_extract({_list(other)}, m + 1) END) AS s FROM near, range({L}) r(k) GROUP BY 1, 2, 3, 4)")
    at_base = "y = b" if mode != "perturbation" else "((x = y AND b <> x) OR (x <> y AND y = b))"
    parts.append(f"found AS (SELECT id, pos + k AS pos, b, sum(s * wt) AS value FROM items_w JOIN share USING (p), range(4) r(b) WHERE {at_base} GROUP BY 1, 2, 3)")
    parts.append("grid AS (SELECT id, u.i AS pos, b, instr('ACGT', substr(seq, CAST(u.i AS INT) + 1, 1)) - 1 AS own FROM items, unnest(range(CAST(length(seq) AS BIGINT))) u(i), range(4) r(b))")
    value = "CASE WHEN g.b = own THEN coalesce(value, 0) ELSE 0 END" if mode == "importance" else "coalesce(value, 0)"
    return _with(*parts) + f"SELECT g.id, CAST(g.pos AS INT) AS pos, substr('ACGT', CAST(g.b AS INT) + 1, 1) AS base, round({value}, 6) AS value FROM grid g LEFT JOIN found USING (id, pos, b)"


def _linear_scores(source: str, name: str, weights: str = "lw", k: int = L) -> str:
    """CTE name(id, score) of sequences `source` by a table of k-mer weights."""
    places = [" + ".join(f"((p >> {2 * (L - 1 - at)}) & 3) * {4 ** (k - 1 - i)}" for i, at in enumerate(c)) for c in combinations(range(L), k)]
    return f"{name} AS (SELECT s.id, coalesce(f, 0) + 0.5 AS score FROM {source} s LEFT JOIN (SELECT id, sum(w) AS f FROM (SELECT id, unnest([{', '.join(places)}]) AS p FROM {source}_s) JOIN {weights} USING (p) GROUP BY id) USING (id))"


_STRANDS = "{0}_s AS (SELECT * FROM {0}_w UNION ALL SELECT * FROM {0}_r)"
_WINDOW_OF = "SELECT o_orderkey, CAST(o_orderkey % 997 AS VARCHAR) AS chrom, o_custkey AS start FROM orders"

ORACLE_SQL = {
    "seq_encode": _with(f"documents_ AS ({_FROM['documents']})") + "SELECT id, CAST(length(seq) AS INT) AS n, md5(translate(seq, 'ACGT', '0123')) AS codes FROM documents_",
    "reverse_complement": _with(f"documents_ AS ({_FROM['documents']})") + f"SELECT id, {_RC} AS rc FROM documents_",
    "one_hot_round_trip": _with(f"documents_ AS ({_FROM['documents']})") + "SELECT id, TRUE AS valid, seq FROM documents_",
    "code_round_trip": _with(f"turns AS ({_FROM['turns']})") + "SELECT id, seq FROM turns",
    "kmer_index_round_trip": "SELECT range AS place, " + " || ".join(f"substr('ACGT', CAST((range >> {2 * (K - 1 - i)}) & 3 AS INT) + 1, 1)" for i in range(K)) + f" AS kmer, range AS again FROM range({4**K})",
    "center_crop": _with(f"turns AS ({_FROM['turns']})") + "SELECT id, CASE WHEN length(seq) >= 51 THEN substr(seq, (length(seq) - 51) // 2 + 1, 51) END AS seq FROM turns",
    "window_explode": _with(*_tables(PLAIN, "turns")) + "SELECT id, count(*) AS n, CAST(sum(pos * p) AS BIGINT) AS total FROM turns_w GROUP BY id",
    "lmer_count": _with(*_tables(PLAIN, "turns")) + "SELECT * FROM turns_b",
    "canonical_lmers": f"WITH d AS ({_FROM['documents']}), k AS (SELECT substr(seq, CAST(i AS INT) + 1, {L}) AS seq FROM d, unnest(range(CAST(length(seq) - {L - 1} AS BIGINT))) u(i) WHERE length(seq) >= {L}) SELECT least(seq, {_RC}) AS kmer, count(*) AS n FROM k GROUP BY 1",
    "distinct_lmers": f"WITH d AS ({_FROM['documents']}) SELECT count(DISTINCT substr(seq, CAST(i AS INT) + 1, {L})) AS n FROM d, unnest(range(CAST(length(seq) - {L - 1} AS BIGINT))) u(i) WHERE length(seq) >= {L}",
    "mismatch_hist": _with(*_tables(PLAIN, "items")) + f"SELECT {_m('a.p', 'b.p')} AS m, CAST(sum(a.n * b.n) AS BIGINT) AS pairs FROM (SELECT p, count(*) n FROM items_w GROUP BY p) a, (SELECT p, count(*) n FROM items_r GROUP BY p) b GROUP BY 1",
    "gkm_cnt_raw": _kernel_sql(PLAIN, False),
    "gkm_cnt_norc": _kernel_sql(Kernel(0, L, K, None, include_rc=False), False),
    "gkm_cnt_d_cutoff": _kernel_sql(Kernel(0, L, K, 1), False),
    "gkm_neighbour_join": _kernel_sql(Kernel(0, L, K, 1), False),
    "gkm_diag": _with(*_tables(PLAIN, "turns")) + f"SELECT a_id AS id, k FROM ({_raw('turns', 'turns', PLAIN, 'a.id = b.id')}) x",
    "gkm_rbf": _with(*_tables(RADIAL, "items")) + f"SELECT a_id, b_id, round(k, 6) AS k FROM ({_norm_sql('items', RADIAL)}) z",
    "gkm_esttrunc": _kernel_sql(TRUNCATED),
    "gkm_estfull": _kernel_sql(Kernel(1, L, K, 2)),
    "window_weights": _with(*_tables(CENTRED, "items")) + "SELECT id, CAST(pos AS INT) AS pos, max(wt) AS wt FROM items_w GROUP BY 1, 2",
    "wgkm_raw": _kernel_sql(CENTRED),
    "gram_upper": _with(*_tables(NORMAL, "items")) + f"SELECT a_id, b_id, round(k, 6) AS k FROM ({_norm_sql('items', NORMAL, 'a_id <= b_id')}) z",
    "gram_topk": _with(*_tables(NORMAL, "items"))
    + f"SELECT a_id, b_id, round(k, 6) AS k, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY round(k, 9) DESC, b_id) AS rank FROM ({_norm_sql('items', NORMAL, 'a_id <> b_id')}) z) WHERE rank <= 5",
    "sv_lmer_weights": _with(*_tables(PLAIN, "items"), _SV, _vector_sums(PLAIN)) + "SELECT p, v FROM v",
    "score_linear": _with(*_tables(PLAIN, "items"), f"docs AS ({_FROM['documents']})", _windows("docs", "docs", PLAIN), _SV, _vector_sums(PLAIN), _lmer_weights(PLAIN))
    + "SELECT s.id, round(CASE WHEN length(seq) < 6 THEN 'NaN'::DOUBLE ELSE coalesce(f, 0) + 0.25 END, 6) AS score FROM docs s LEFT JOIN (SELECT id, sum(wt * w) AS f FROM docs_f JOIN w USING (p) GROUP BY id) USING (id)",
    "deltasvm_score": _with(f"docs AS ({_FROM['documents']})", _windows("docs", "docs", PLAIN), _STRANDS.format("docs"), _linear_cte(L))
    + "SELECT s.id, coalesce(f, 0) + 0.5 AS score FROM docs s LEFT JOIN (SELECT id, sum(n * w) AS f FROM (SELECT id, p, count(*) AS n FROM docs_s GROUP BY id, p) JOIN lw USING (p) GROUP BY id) USING (id)",
    "deltasvm_ensemble": _with(f"turns AS ({_FROM['turns']})", _windows("turns", "turns", PLAIN), _STRANDS.format("turns"), _linear_cte(L), _linear_cte(L, 41, "lx"))
    + "SELECT s.id, coalesce(f, 0) + 0.5 AS score FROM turns s LEFT JOIN (SELECT id, sum((lw.w + lx.w) / 2) AS f FROM turns_s JOIN lw USING (p) JOIN lx USING (p) GROUP BY id) USING (id)",
    "deltasvm_gapped_score": _with(*_tables(PLAIN, "turns"), _STRANDS.format("turns"), _linear_cte(K), _linear_scores("turns", "f", k=K)) + "SELECT id, score FROM f",
    "deltasvm_variants": _with(*_tables(PLAIN, "turns"), f"alt AS ({_MUTATED.format('turns')})", _windows("alt", "alt", PLAIN), _STRANDS.format("turns"), _STRANDS.format("alt"), _linear_cte(L), _linear_scores("turns", "f"), _linear_scores("alt", "g"))
    + "SELECT id, g.score - f.score AS score FROM f JOIN g USING (id)",
    "score_sum": _with(*_tables(PLAIN, "turns"), _STRANDS.format("turns"), _linear_cte(L), _linear_cte(L, 41, "lx"), _linear_scores("turns", "f"), _linear_scores("turns", "g", "lx"))
    + "SELECT id, f.score + g.score AS score FROM f JOIN g USING (id)",
    "to_deltasvm": _with(*_tables(PLAIN, "items"), _SV, _vector_sums(PLAIN), _lmer_weights(PLAIN))
    + "SELECT " + " || ".join(f"substr('ACGT', CAST((every.p >> {2 * (L - 1 - i)}) & 3 AS INT) + 1, 1)" for i in range(L)) + " AS kmer, round(coalesce(w, 0), 6) AS w FROM every LEFT JOIN w USING (p)",
    "variant_delta": _with(*_tables(PLAIN, "items"), _SV, _vector_sums(PLAIN), _lmer_weights(PLAIN), f"turns AS ({_FROM['turns']})", _windows("turns", "turns", PLAIN), f"alt AS ({_MUTATED.format('turns')})", _windows("alt", "alt", PLAIN))
    + "SELECT t.id, round(CASE WHEN length(seq) < 6 THEN 'NaN'::DOUBLE ELSE b.f - a.f END, 6) AS score FROM turns t LEFT JOIN (SELECT id, sum(wt * w) AS f FROM turns_f JOIN w USING (p) GROUP BY id) a USING (id) LEFT JOIN (SELECT id, sum(wt * w) AS f FROM alt_f JOIN w USING (p) GROUP BY id) b USING (id)",
    "mutation_impact_linear": _impact_sql(NORMAL),
    "mutation_impact_rbf": _impact_sql(RADIAL),
    "ism": _with(*_tables(PLAIN, "items"), _SV, _vector_sums(PLAIN), _lmer_weights(PLAIN))
    + f"SELECT id, CAST(pos + k AS INT) AS pos, substr('ACGT', CAST(b AS INT) + 1, 1) AS base, round(sum(wt * (coalesce(n.w, 0) - coalesce(o.w, 0))), 6) AS value FROM (SELECT *, p + (b - ((p >> CAST(2 * ({L - 1} - k) AS INT)) & 3)) * CAST(pow(4, {L - 1} - k) AS BIGINT) AS q FROM items_w, range({L}) r(k), range(4) t(b)) x LEFT JOIN w o ON o.p = x.p LEFT JOIN w n ON n.p = x.q GROUP BY 1, 2, 3",
    "explain_hypothetical": _explain_sql("hypothetical"),
    "explain_importance": _explain_sql("importance"),
    "explain_perturbation": _explain_sql("perturbation"),
    "explain_top_positions": f"SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, pos, base) AS INT) AS rank FROM ({_explain_sql('importance')}) x QUALIFY rank <= 5",
    "variant_evaluation": "WITH s AS (SELECT abs(n_chars - 1000) AS s, quality AS y FROM labels JOIN documents USING (doc_id)), t AS (SELECT s, sum(y) AS pos, count(*) AS n FROM s GROUP BY s), c AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) / sum(n) OVER (ORDER BY s DESC) AS precision FROM t) SELECT (SELECT round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*), 6) FROM s a, s b WHERE a.y = 1 AND b.y = 0) AS auroc, round(CAST(sum(pos * precision) / sum(pos) AS DOUBLE), 6) AS average_precision FROM c",
    "loci_window": f"WITH g AS ({_FROM['documents']}), p AS ({_WINDOW_OF}) SELECT o_orderkey, start + 10 - 15 AS win_start, CASE WHEN start - 5 >= 0 AND start + 25 <= length(seq) THEN substr(seq, CAST(start - 4 AS INT), 30) END AS seq, coalesce(start - 5 >= 0 AND start + 25 <= length(seq), FALSE) AS kept FROM p LEFT JOIN g ON CAST(g.id AS VARCHAR) = chrom",
    "allele_windows": f"WITH g AS ({_FROM['documents']}), p AS ({_WINDOW_OF}), s AS (SELECT o_orderkey, CASE WHEN start - 10 >= 0 AND start + 11 <= length(seq) THEN substr(seq, CAST(start - 9 AS INT), 21) END AS s FROM p LEFT JOIN g ON CAST(g.id AS VARCHAR) = chrom) SELECT o_orderkey, substr(s, 1, 10) || 'A' || substr(s, 12) AS ref_seq, substr(s, 1, 10) || 'G' || substr(s, 12) AS alt_seq FROM s",
    "interval_anti_join": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE (CASE WHEN s_nationkey < 12 THEN 'F' ELSE 'O' END) = o_orderstatus AND s_suppkey * 900 < o_orderkey * 10 + 7 AND s_suppkey * 900 + 250 > o_orderkey * 10)",
    "chromosome_split": "SELECT CASE WHEN o_orderstatus = 'F' THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM orders GROUP BY 1",
    "gc_bin_counts": f"WITH d AS ({_FROM['documents']}) SELECT CAST(least(floor(length(regexp_replace(seq, '[^GC]', '', 'g')) / greatest(length(seq), 1) * 20), 19) AS INT) AS bin, count(*) AS n FROM d GROUP BY 1",
    "auroc": "WITH s AS (SELECT n_chars AS s, quality AS y FROM labels JOIN documents USING (doc_id)) SELECT round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*), 6) AS auroc FROM s a, s b WHERE a.y = 1 AND b.y = 0",
    "average_precision": "WITH s AS (SELECT n_chars AS s, quality AS y FROM labels JOIN documents USING (doc_id)), t AS (SELECT s, sum(y) AS pos, count(*) AS n FROM s GROUP BY s), c AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) / sum(n) OVER (ORDER BY s DESC) AS precision FROM t) SELECT round(CAST(sum(pos * precision) / sum(pos) AS DOUBLE), 6) AS average_precision FROM c",
    "pearson_spearman": "WITH r AS (SELECT l_quantity AS a, l_extendedprice AS b, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rb FROM lineitem) SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r",
    "agreement_stats": "WITH r AS (SELECT l_extendedprice * (1 - l_discount) AS a, l_extendedprice AS b FROM lineitem) SELECT count(*) AS n, round(max(abs(a - b)), 6) AS max_abs, round(max(CASE WHEN abs(b) >= 1e-3 THEN abs(a - b) / abs(b) END), 6) AS max_rel, round(corr(a, b), 6) AS corr FROM r",
    "best_effect": "SELECT o_orderkey, p, line, part FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, l_discount AS p, l_linenumber AS line, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_linenumber, l_partkey) AS place FROM lineitem) e USING (o_orderkey) WHERE place = 1 OR place IS NULL",
    "allele_check": f"WITH d AS ({_FROM['documents']}) SELECT round(avg(CASE WHEN substr(seq, 1, 1) <> 'A' THEN 1.0 ELSE 0.0 END), 6) AS mismatch FROM d WHERE length(seq) > 0",
    "longest_prefix": "WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT split_part(name, ' ', 1) AS prefix FROM n UNION SELECT substr(name, 1, 2) FROM n) SELECT name, arg_max(prefix, length(prefix)) AS prefix FROM n JOIN w ON starts_with(name, prefix) GROUP BY name",
    "fasta_round_trip": f"WITH d AS ({_FROM['documents']}) SELECT 'doc ' || id AS name, seq FROM d",
    "bed_round_trip": "SELECT o_orderstatus AS chrom, o_orderkey * 10 AS start, o_orderkey * 10 + 7 AS \"end\", o_orderstatus || ':' || (o_orderkey * 10) || '-' || (o_orderkey * 10 + 7) AS name, (o_orderkey * 20 + 7) // 2 AS summit FROM orders",
    "model_round_trip": _with(*_tables(PLAIN, "items"), _SV, _scores("items", PLAIN, "f")) + "SELECT id, round(score, 6) AS score FROM f",
    "score_normalized": _with(*_tables(NORMAL, "items", "turns"), _SV, _scores("turns", NORMAL, "f")) + "SELECT id, round(score, 6) AS score FROM f",
    "score_rbf": _with(*_tables(RADIAL, "items", "turns"), _SV, _scores("turns", RADIAL, "f")) + "SELECT id, round(score, 6) AS score FROM f",
    "gkm_norm": _with(*_tables(NORMAL, "items", "turns")) + f"SELECT a_id, b_id, round(k, 6) AS k FROM ({_norm_sql('turns', NORMAL)}) z",
}
