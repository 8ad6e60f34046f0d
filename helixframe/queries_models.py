"""More queries over the test tables: effects of changes, model files, sampling, training.
SQL rescores each changed sequence in full; training is held against its optimality
conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequence as S
from .functions.tables import KERNELS, Kernel, masks, resolve_kernel_type
from .operators import effects, evaluate, kernel, train
from .operators.explain import explain
from .queries import _FROM, _MUTATED, _SV, _STRANDS, CENTRED, L, NORMAL, ORACLE_SQL as FIRST, PLAIN, RADIAL, TRUNCATED, _code, _linear_cte, _linear_scores, _list, _m, _pairs, _raw, _rest, _scores, _tables, _vector_sums, _windows, _with, documents, items, linear, model, mutated, r6, shared_path, table, turns
from .sources import models, text

SMALL = Kernel(6, 4, 2, None)
SVC = Kernel(2, L, 4, 2, include_rc=False)


def names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.dna_of_text(F.col("p_name")).alias("seq"))


def shortened(seqs: DataFrame) -> DataFrame:
    """Without the central letter."""
    at = F.floor(F.length("seq") / 2).cast("int") + 1
    return seqs.select("id", F.overlay("seq", F.lit(""), at, F.lit(1)).alias("seq"))


def rounded(df: DataFrame, column: str) -> DataFrame:
    """To six places; no minus zero."""
    return r6(df, column).withColumn(column, F.col(column) + 0.0)


def gkm_brute(spark, d):
    return kernel.raw_kernel(items(spark, d), items(spark, d), PLAIN, "brute")


def gkm_rc_of_rows(spark, d):
    return r6(kernel.raw_kernel(items(spark, d), items(spark, d), CENTRED, rc_of="x"), "k")


def ism_normalized(spark, d):
    return rounded(effects.ism(model(spark, d, NORMAL), names(spark, d)), "value")


def ism_rbf(spark, d):
    return rounded(effects.ism(model(spark, d, RADIAL), names(spark, d)), "value")


def variants_normalized(spark, d):
    ref = turns(spark, d)
    return rounded(model(spark, d, NORMAL).score_variants(ref, mutated(ref)), "score")


def variants_rbf(spark, d):
    ref = turns(spark, d)
    return rounded(model(spark, d, RADIAL).score_variants(ref, mutated(ref)), "score")


def deletions_normalized(spark, d):
    ref = turns(spark, d)
    return rounded(model(spark, d, NORMAL).score_variants(ref, shortened(ref)), "score")


def deletions_linear(spark, d):
    ref = turns(spark, d)
    return linear(spark, L).score_variants(ref, shortened(ref))


def explain_rbf_total(spark, d):
    """Importances under an RBF kernel add up to the score without its constants."""
    return rounded(explain(model(spark, d, RADIAL), items(spark, d)).groupBy("id").agg(F.sum("value").alias("value")), "value")


def gc_bin_fill(spark, d):
    pool = turns(spark, d).withColumn("bin", evaluate.gc_bin(F.col("seq")))
    like = items(spark, d).withColumn("bin", F.lit(0)).unionByName(items(spark, d).withColumn("bin", evaluate.gc_bin(F.col("seq"))))
    return evaluate.matched_sample(pool, like, ["bin"], seed=3).select("id", "bin")


def subsample(spark, d):
    return evaluate.subsample(documents(spark, d), 100, seed=5).select("id")


def subset_vectors(spark, d):
    return evaluate.subset_vectors(model(spark, d).sv, 20, seed=7).select("id", "coef")


def polya_floor(spark, d):
    return linear(spark).polya_floor().weights


def kernel_names(spark, d):
    known = [(str(x), resolve_kernel_type(x)) for number, own in KERNELS.items() for x in (number, *own)]
    return spark.createDataFrame(known, "name string, number int")


def model_facts(spark, d):
    m = model(spark, d, CENTRED)
    p = m.kernel_params
    return spark.createDataFrame([(m.num_support_vectors, p["L"], p["k"], p["d"], p["M"], p["H"], p["include_rc"], linear(spark).num_kmers)], "vectors long, l int, k int, d int, m int, h double, rc boolean, kmers long")


def fasta_one_hot_round_trip(spark, d):
    path = shared_path(spark, "fasta")
    rows = items(spark, d)
    text.write_fasta_one_hot(rows.select("id", S.one_hot(F.col("seq")).alias("one_hot")), path)
    return text.read_fasta(spark, path).select("name", "seq")


def scores_round_trip(spark, d):
    path = shared_path(spark, "scores")
    text.write_scores(table(spark, d, "supplier").select(F.col("s_name").alias("name"), (F.col("s_acctbal") / 7).alias("score")), path)
    return text.read_table(spark, path)


def notes_round_trip(spark, d):
    path = shared_path(spark, "notes")
    rows = table(spark, d, "nation").select("n_nationkey", "n_name")
    text.write_table(rows, path, {"table": "nation", "made by": "a query: this one"})
    read = text.read_table(spark, path).select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("value"))
    return read.unionByName(text.read_notes(spark, path))


def labels_round_trip(spark, d):
    path = shared_path(spark, "labels")
    table(spark, d, "customer").orderBy("c_custkey").select(F.col("c_acctbal").cast("string").alias("value")).coalesce(1).write.text(path)
    return text.read_labels(spark, path)


def _through(spark, d, name: str):
    m = model(spark, d, TRUNCATED)
    path = shared_path(spark, "model") + name
    models.save_model(m, path)
    return r6(models.load_model(spark, path).score(items(spark, d)), "score")


def lsgkm_round_trip(spark, d):
    return _through(spark, d, ".model.gz")


def npz_round_trip(spark, d):
    return _through(spark, d, ".npz")


def deltasvm_npz_round_trip(spark, d):
    path = shared_path(spark, "weights") + ".npz"
    models.save_npz(linear(spark), path)
    return models.load_model(spark, path).weights


def weights_round_trip(spark, d):
    path = shared_path(spark, "weights") + ".txt"
    models.write_deltasvm(linear(spark, L, include_rc=False), path)
    return models.load_deltasvm(spark, path, L).weights


def _pair(spark, d) -> tuple[str, str]:
    """Identifiers with coefficients, and FASTA with gaps, as the classic tools write them."""
    alphas, seqs = shared_path(spark, "alphas"), shared_path(spark, "vectors")
    rows = model(spark, d).sv
    rows.select(F.concat(F.lit("v"), F.col("id").cast("string"), F.lit("\t"), F.col("coef").cast("string")).alias("value")).write.text(alphas)
    name = F.concat(F.lit("v"), F.col("id").cast("string"), F.lit(" more"))
    text.write_fasta(rows.select(name.alias("name"), F.concat(F.substring("seq", 1, 5), F.lit("nnn"), F.lower(F.expr("substring(seq, 6)"))).alias("seq")), seqs)
    return alphas, seqs


def classic_load(spark, d):
    return r6(models.load_classic(spark, *_pair(spark, d), l=L, k=4, d=2, kernel_filter=2).score(items(spark, d)), "score")


def r_load(spark, d):
    return r6(models.load_r(spark, *_pair(spark, d), L=L, K=4, maxnmm=2, useTgkm=1).score(items(spark, d)), "score")


def _classes(spark, d) -> tuple[DataFrame, DataFrame]:
    pos = items(spark, d)
    return pos, pos.select("id", F.reverse("seq").alias("seq"))


def _svc_conditions(spark, d, solver: str, C: float = 1.0):
    """Rows that break the conditions of the optimum by more than 0.001, and the sum of the
    coefficients."""
    pos, neg = _classes(spark, d)
    found = train.train_svc(pos, neg, SVC, C=C, solver=solver, tolerance=1e-6)
    every = pos.withColumn("y", F.lit(1.0)).unionByName(neg.withColumn("y", F.lit(-1.0))).withColumn("id", F.struct("y", "id"))
    rows = found.score(every.select("id", "seq")).join(every, "id").join(found.sv.select("seq", "coef"), "seq", "left")
    a, margin = F.abs(F.coalesce("coef", F.lit(0.0))), F.col("score") * F.col("y")
    broken = ((a < C - 1e-6) & (margin < 1 - 1e-3)) | ((a > 1e-6) & (margin > 1 + 1e-3))
    return rows.agg(F.count_if(broken).alias("broken"), (F.round(F.sum("coef"), 5) + 0.0).alias("balance"), F.count(F.lit(1)).alias("n"))


def svc_conditions(spark, d):
    return _svc_conditions(spark, d, "auto")


def svc_conditions_by_columns(spark, d):
    return _svc_conditions(spark, d, "smo")


def svr_conditions(spark, d):
    C, epsilon = 1.0, 0.1
    rows = items(spark, d).withColumn("y", F.length("seq") / 100.0)
    found = train.train_svr(rows, SVC, C=C, epsilon=epsilon, tolerance=1e-6)
    rows = found.score(rows.select("id", "seq")).join(rows, "id").join(found.sv.select("seq", "coef"), "seq", "left")
    a, over = F.coalesce("coef", F.lit(0.0)), F.col("y") - F.col("score")
    broken = ((a < C - 1e-6) & (over > epsilon + 1e-3)) | ((a > -C + 1e-6) & (over < -epsilon - 1e-3)) | ((a > 1e-6) & (over < epsilon - 1e-3)) | ((a < -1e-6) & (over > -epsilon + 1e-3))
    return rows.agg(F.count_if(broken).alias("broken"), (F.round(F.sum("coef"), 5) + 0.0).alias("balance"), F.count(F.lit(1)).alias("n"))


def nystrom_of_all(spark, d):
    """With every sequence a landmark, the approximate features give the exact model."""
    pos, neg = _classes(spark, d)
    exact, near = (train.train_svc(pos, neg, SVC, solver=s, landmarks=1 << 20, tolerance=1e-6) for s in ("auto", "nystrom"))
    rows = exact.score(pos).join(near.score(pos).withColumnRenamed("score", "near"), "id")
    return rows.agg(F.count_if(F.abs(F.col("score") - F.col("near")) > 1e-3).alias("different"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        gkm_brute, gkm_rc_of_rows, ism_normalized, ism_rbf, variants_normalized, variants_rbf, deletions_normalized, deletions_linear, explain_rbf_total, gc_bin_fill, subsample, subset_vectors,
        polya_floor, kernel_names, model_facts, fasta_one_hot_round_trip, scores_round_trip, notes_round_trip, labels_round_trip, lsgkm_round_trip, npz_round_trip, deltasvm_npz_round_trip,
        weights_round_trip, classic_load, r_load, svc_conditions, svc_conditions_by_columns, svr_conditions, nystrom_of_all,
    )
}

# SQL ------------------------------------------------------------------------------------

_NAMES = "SELECT p_partkey AS id, translate(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM part"
_SHORTENED = "SELECT id, substr(seq, 1, length(seq) // 2) || substr(seq, length(seq) // 2 + 2) AS seq FROM {0}"


def _draw(seed: int, key: str = "id") -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 13) AS BIGINT)"


def _gc(seq: str = "seq") -> str:
    return f"CAST(least(floor(length(regexp_replace({seq}, '[^GC]', '', 'g')) / greatest(length({seq}), 1) * 20), 19) AS INT)"


def _kmer(p: str, l: int) -> str:
    return " || ".join(f"substr('ACGT', CAST(({p} >> {2 * (l - 1 - i)}) & 3 AS INT) + 1, 1)" for i in range(l))


def _ism_sql(kern: Kernel) -> str:
    """Every letter at every place, the own one too, rescored from its windows: kernels of
    single l-mers with the vectors first."""
    m = _m("e.p", "b.p", kern.l)
    parts = [*_tables(kern, "items"), _SV, f"t AS (SELECT e.range AS p, b.id AS s_id, sum(list_extract({_list(kern.h)}, {m.replace('e.p', 'e.range')} + 1) * b.wt) AS k FROM range({4**kern.l}) e JOIN items_b b ON {m.replace('e.p', 'e.range')} <= {kern.reach} GROUP BY 1, 2)"]
    parts.append(f"sd AS (SELECT a_id AS s_id, k FROM ({_raw('items', 'items', kern, 'a.id = b.id')}) y)")
    parts.append(f"x AS (SELECT id AS of, CAST(u.i AS INT) AS pos, b, substr('ACGT', CAST(b AS INT) + 1, 1) = substr(seq, CAST(u.i AS INT) + 1, 1) AS own, substr(seq, 1, CAST(u.i AS INT)) || substr('ACGT', CAST(b AS INT) + 1, 1) || substr(seq, CAST(u.i AS INT) + 2) AS seq FROM ({_NAMES}), unnest(range(CAST(length(seq) AS BIGINT))) u(i), range(4) r(b))")
    parts.append("y AS (SELECT row_number() OVER () AS id, * FROM x)")
    parts.append(_windows("y", "y", kern))
    parts.append(f"xd AS (SELECT a_id AS id, k FROM ({_raw('y', 'y', kern, 'a.id = b.id')}) z)")
    value = "exp({g} * (k / greatest(sqrt(xd.k * sd.k), 1e-10) - 1))" if kern.rbf else "k / greatest(sqrt(xd.k * sd.k), 1e-10)"
    value = value.replace("k / greatest", "raw.k / greatest").format(g=kern.gamma) + (f" - {2.718281828459045 ** -kern.gamma!r}" if kern.rbf else "")
    parts.append("raw AS (SELECT id, s_id, sum(wt * k) AS k FROM y_f JOIN t USING (p) GROUP BY 1, 2)")
    parts.append(f"f AS (SELECT raw.id, sum(coef * ({value})) AS f FROM raw JOIN xd ON xd.id = raw.id JOIN sd ON sd.s_id = raw.s_id JOIN sv ON sv.id = raw.s_id GROUP BY 1)")
    parts.append("g AS (SELECT y.*, coalesce(f, 0) AS f FROM y LEFT JOIN f USING (id))")
    return _with(*parts) + f"SELECT g.of AS id, g.pos, substr('ACGT', CAST(g.b AS INT) + 1, 1) AS base, CASE WHEN length(g.seq) < {kern.l} THEN 'NaN'::DOUBLE ELSE round(g.f - o.f, 6) + 0.0 END AS value FROM g JOIN g o ON o.of = g.of AND o.pos = g.pos AND o.own"


def _difference_sql(kern: Kernel, changed: str) -> str:
    parts = [*_tables(kern, "items", "turns"), _SV, f"alt AS ({changed.format('turns')})", _windows("alt", "alt", kern), _scores("turns", kern, "f"), _scores("alt", kern, "g")]
    return _with(*parts) + "SELECT id, round(g.score - f.score, 6) + 0.0 AS score FROM f JOIN g USING (id)"


def _matched(pool: str, like: str, seed: int, fill: bool) -> str:
    rest = f" UNION ALL SELECT * FROM (SELECT id, bin FROM pool ANTI JOIN picked USING (id) ORDER BY {_draw(seed)}, id LIMIT (SELECT (SELECT count(*) FROM alike) - (SELECT count(*) FROM picked)))" if fill else ""
    return f"WITH pool AS ({pool}), alike AS ({like}), want AS (SELECT bin, count(*) AS want FROM alike GROUP BY bin), picked AS (SELECT id, bin FROM (SELECT id, bin, want, row_number() OVER (PARTITION BY bin ORDER BY {_draw(seed)}, id) AS place FROM pool JOIN want USING (bin)) WHERE place <= want) SELECT id, bin FROM picked{rest}"


_LIKE = Kernel(2, L, 4, 2)
_COUNTS = Kernel(0, L, 4, 2)
_NORMED = f"SELECT a_id AS id, sum(coef * kn) AS f FROM p GROUP BY 1"
_MASKS = ", ".join(f"({t}, {mask})" for t, (mask, _) in enumerate(masks(PLAIN.h)))


def _loaded_sql(kern: Kernel, bias: float) -> str:
    return _with(*_tables(kern, "items"), _SV, f"p AS ({_pairs('items', kern)})") + f"SELECT i.id, round(coalesce(f, 0) + {bias}, 6) AS score FROM items i LEFT JOIN ({_NORMED}) USING (id)"


_RBF_TOTAL = _with(*_tables(RADIAL, "items"), _SV, _scores("items", RADIAL, "f"))
_OPTIMAL = "SELECT 0::BIGINT AS broken, 0.0::DOUBLE AS balance, {0} * count(*) AS n FROM benchmark"

ORACLE_SQL = {
    "gkm_brute": FIRST["gkm_cnt_raw"],
    "gkm_rc_of_rows": FIRST["wgkm_raw"],
    "ism_normalized": _ism_sql(NORMAL),
    "ism_rbf": _ism_sql(RADIAL),
    "variants_normalized": _difference_sql(NORMAL, _MUTATED),
    "variants_rbf": _difference_sql(RADIAL, _MUTATED),
    "deletions_normalized": _difference_sql(NORMAL, _SHORTENED),
    "deletions_linear": _with(*_tables(PLAIN, "turns"), f"alt AS ({_SHORTENED.format('turns')})", _windows("alt", "alt", PLAIN), _STRANDS.format("turns"), _STRANDS.format("alt"), _linear_cte(L), _linear_scores("turns", "f"), _linear_scores("alt", "g"))
    + "SELECT id, g.score - f.score AS score FROM f JOIN g USING (id)",
    "explain_rbf_total": _RBF_TOTAL + f"SELECT id, round(score - 0.25 - {_rest(RADIAL)}, 6) + 0.0 AS value FROM f",
    "explain_completeness": _RBF_TOTAL + f"SELECT id, round(score - 0.25 - {_rest(RADIAL)}, 6) AS scored, round(score - 0.25 - {_rest(RADIAL)}, 6) AS explained FROM f",
    "lmer_marginals": _with(*_tables(PLAIN, "items"), _SV, _vector_sums(PLAIN), f"masks(t, mask) AS (VALUES {_MASKS})", "s AS (SELECT t, p & mask AS key, sum(v) AS s FROM v, masks GROUP BY 1, 2)") + "SELECT t, count(*) AS n, sum(abs(s)) AS total FROM s GROUP BY t",
    "to_deltasvm_rbf": _with(*_tables(SMALL, "items"), _SV, f"lm AS (SELECT range AS id, {_kmer('range', 4)} AS seq FROM range(256))", _windows("lm", "lm", SMALL), _scores("lm", SMALL, "f")) + "SELECT seq AS kmer, round(score - 0.25, 6) AS w FROM f JOIN lm USING (id)",
    "gc_bin_match": _matched(f"SELECT id, {_gc()} AS bin FROM ({_FROM['documents']})", f"SELECT id, {_gc()} AS bin FROM ({_FROM['turns']})", 0, False),
    "gc_bin_fill": _matched(f"SELECT id, {_gc()} AS bin FROM ({_FROM['turns']})", f"SELECT id, 0 AS bin FROM ({_FROM['items']}) UNION ALL SELECT id, {_gc()} AS bin FROM ({_FROM['items']})", 3, True),
    "subsample": f"SELECT doc_id AS id FROM documents ORDER BY {_draw(5, 'doc_id')}, doc_id LIMIT 100",
    "subset_vectors": f"WITH sv AS (SELECT item_id AS id, (item_id % 7 - 3) / 4.0 AS coef FROM benchmark), n AS (SELECT CAST(round_even(20 * count(*) FILTER (WHERE coef > 0) / count(*), 0) AS INT) AS take FROM sv) SELECT id, CAST(coef AS DOUBLE) AS coef FROM (SELECT *, row_number() OVER (PARTITION BY coef > 0 ORDER BY {_draw(7)}, id) AS place FROM sv), n WHERE place <= CASE WHEN coef > 0 THEN take ELSE 20 - take END",
    "polya_floor": f"SELECT {_kmer('range', 4)} AS kmer, CASE WHEN range IN (0, 255) THEN -0.5 ELSE CAST(((range * 37) % 101 - 50) / 16.0 AS DOUBLE) END AS w FROM range(256)",
    "kernel_names": "SELECT * FROM (VALUES " + ", ".join(f"('{x}', {number})" for number, own in KERNELS.items() for x in (number, *own)) + ") t(name, number)",
    "model_facts": "SELECT count(*) AS vectors, 6 AS l, 4 AS k, 2 AS d, 20 AS m, 10.0::DOUBLE AS h, TRUE AS rc, (SELECT count(*) FROM range(256) WHERE (range * 37) % 101 <> 50) AS kmers FROM benchmark",
    "fasta_one_hot_round_trip": f"SELECT 'seq_' || id AS name, seq FROM ({_FROM['items']})",
    "scores_round_trip": "SELECT s_name AS name, round(s_acctbal / 7, 6) AS score FROM supplier",
    "notes_round_trip": "SELECT CAST(n_nationkey AS VARCHAR) AS name, n_name AS value FROM nation UNION ALL VALUES ('table', 'nation'), ('made by', 'a query: this one')",
    "labels_round_trip": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS id, CAST(c_acctbal AS DOUBLE) AS y FROM customer",
    "lsgkm_round_trip": _with(*_tables(_LIKE, "items"), _SV, _scores("items", _LIKE, "f")) + "SELECT id, round(score, 6) AS score FROM f",
    "npz_round_trip": _with(*_tables(TRUNCATED, "items"), _SV, _scores("items", TRUNCATED, "f")) + "SELECT id, round(score, 6) AS score FROM f",
    "deltasvm_npz_round_trip": f"SELECT {_kmer('range', 4)} AS kmer, CAST(((range * 37) % 101 - 50) / 16.0 AS DOUBLE) AS w FROM range(256) WHERE (range * 37) % 101 <> 50",
    "weights_round_trip": f"SELECT {_kmer('range', L)} AS kmer, CAST(((range * 37) % 101 - 50) / 16.0 AS DOUBLE) AS w FROM range({4**L}) WHERE (range * 37) % 101 <> 50",
    "classic_load": _loaded_sql(_COUNTS, 0.0),
    "r_load": _loaded_sql(_LIKE, 0.0),
    "svc_conditions": _OPTIMAL.format(2),
    "svc_conditions_by_columns": _OPTIMAL.format(2),
    "svr_conditions": _OPTIMAL.format(1),
    "nystrom_of_all": "SELECT 0::BIGINT AS different, count(*) AS n FROM benchmark",
}
