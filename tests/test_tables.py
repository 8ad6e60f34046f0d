"""Training, formats, loci, metrics, and the SQL of a few queries."""

import gzip

import duckdb
import numpy as np
import pytest

import __spark_entry__
from helixframe.functions.tables import Kernel
from helixframe.operators import evaluate, loci, train
from helixframe.sources import models, text

SF = "/root/testdata/sf0.001"


def seqs(spark, n, seed, motif=""):
    draw = np.random.default_rng(seed)
    return spark.createDataFrame([(i, "".join(draw.choice(list("ACGT"), 24)) + motif) for i in range(n)], "id long, seq string")


def test_svc_meets_the_optimality_conditions(spark):
    k = Kernel(2, 5, 3, 2)
    pos, neg = seqs(spark, 12, 1, "GATTACA"), seqs(spark, 12, 2, "CCCCGGG")
    m = train.train_svc(pos, neg, k, C=1.0, tolerance=1e-6)
    assert abs(sum(r.coef for r in m.sv.collect())) < 1e-6
    for rows, y in ((pos, 1), (neg, -1)):
        used = {r.seq: r.coef for r in m.sv.collect()}
        for r in m.score(rows).join(rows, "id").collect():
            a = abs(used.get(r.seq, 0.0))
            if a < 1e-9:
                assert y * r.score > 1 - 1e-3
            elif a < 1 - 1e-9:
                assert y * r.score == pytest.approx(1, abs=1e-3)
    stored = train.train_svc(pos, neg, k, solver="smo", tolerance=1e-6)
    assert stored.bias == pytest.approx(m.bias, abs=1e-4)


def test_lsgkm_npz_and_native_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([(0, "ACGTACGT", 0.5), (1, "GGGTTTACC", -0.5)], "id long, seq string, coef double")
    m = models.GkmModel(rows, Kernel(4, 4, 2, 1, M=5, H=2.5, include_rc=False), 0.75)
    for name in ("m.txt", "m.model.gz", "m.npz", "m.native"):
        models.save_model(m, str(tmp_path / name))
        back = models.load_model(spark, str(tmp_path / name))
        assert back.kernel == m.kernel and back.bias == m.bias
        assert sorted(back.sv.collect()) == sorted(rows.collect())
    (tmp_path / "bad.txt").write_text("kernel_type 2\nL 4\nSV\n1.0 ACGT\n")
    with pytest.raises(ValueError, match="total_sv"):
        models.load_lsgkm(spark, str(tmp_path / "bad.txt"))


def test_weights_files(spark, tmp_path):
    (tmp_path / "w.gz").write_bytes(gzip.compress(b"# note\nAC\tGT\t0.5\nAA\tTT\t-1\nAC\tGT\t0.25\n"))
    m = models.load_deltasvm(spark, str(tmp_path / "w.gz"), 2)
    assert not m.include_rc and {r.kmer: r.w for r in m.weights.collect()} == {"AC": 0.25, "GT": 0.25, "AA": -1, "TT": -1}
    models.write_deltasvm(m, str(tmp_path / "out.txt"))
    assert (tmp_path / "out.txt").read_text().splitlines() == ["# include_rc=false", "AA\t-1", "AC\t0.25", "GT\t0.25", "TT\t-1"]


def test_odd_weights_files(spark, tmp_path):
    def load(data, l=2, **more):
        (tmp_path / "w.txt").write_bytes(data if isinstance(data, bytes) else data.encode())
        m = models.load_deltasvm(spark, str(tmp_path / "w.txt"), l, **more)
        return m.include_rc, {r.kmer: r.w for r in m.weights.collect()}

    assert load("xyz 1\nac 0.5\n\n gt  2 \nAC 3\n") == (True, {"AC": 3.0, "GT": 2.0})
    assert load("# include_RC=False\nAC\t1\n") == (False, {"AC": 1.0})
    assert load("# include_RC=False\nAC\t1\n", include_rc=True)[0]
    assert load(gzip.compress(b"AC\t1\n")) == (True, {"AC": 1.0})  # packed under another name
    for bad, what in (("", "no weights"), ("AC 1\nNN 2\n", "bases"), ("AC 1\nACG 1\n", "letters"), ("AC\n", "columns"), ("AC x\n", "columns"), ("ACG 1\n", "less than")):
        with pytest.raises(ValueError, match=what):
            load(bad)


def test_lsgkm_header_and_errors(spark, tmp_path):
    head = "svm_type c_svc\nkernel_type 4\nL 4\nk 2\nd 1\nM 5\nH 2.5\nnr_class 2\ntotal_sv 2\nrho -0.75 1\nlabel 1 -1\nnote free text\n"
    assert models.parse_lsgkm_header(head + "SV\nx 1\n") == {
        "svm_type": "c_svc", "kernel_type": 4, "L": 4, "k": 2, "d": 1, "M": 5, "H": 2.5, "nr_class": 2, "total_sv": 2, "rho": [-0.75, 1], "label": [1, -1], "note": ["free", "text"], "norc": 0,
    }
    path = tmp_path / "m.txt"
    path.write_text(head + "SV\n0.5 ACGTA\n\n-0.5\tACGTC \n")
    m = models.load_lsgkm(spark, str(path))
    assert m.bias == 0.75 and m.kernel.kind == 4 and m.kernel.include_rc and [tuple(r) for r in m.sv.orderBy("id").collect()] == [(0, "ACGTA", 0.5), (1, "ACGTC", -0.5)]
    for text_, kind in ((head, ValueError), (head + "SV\n0.5 ACGTA\n", ValueError), (head + "SV\n0.5\n1 AC\n", ValueError), (head.replace("nr_class 2", "nr_class 3") + "SV\n", NotImplementedError)):
        path.write_text(text_)
        with pytest.raises(kind):
            models.load_lsgkm(spark, str(path))


def test_fasta_and_bed(spark, tmp_path):
    (tmp_path / "a.fa").write_text("junk\n>one two\nAC\nGT\n\n>x>y\r\nTT\r\n>empty\n")
    assert [(r.id, r.name, r.seq) for r in text.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("id").collect()] == [(0, "one two", "ACGT"), (1, "x>y", "TT"), (2, "empty", "")]
    peak = "\t".join(["chr1", "10", "20", "p", "0", ".", "0", "0", "0", "3"])
    (tmp_path / "a.bed").write_text(f"track x\n#c\nchr1\t4\t9\n{peak}\n")
    assert [tuple(r) for r in text.read_loci(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 4, 9, "chr1:4-9", 6), ("chr1", 10, 20, "p", 13)]


def test_loci_across_chunks(spark):
    genome = spark.createDataFrame([("c", "ACGTTGCANN" * 3)], "chrom string, seq string")
    rows = spark.createDataFrame([("c", i, i + 2) for i in range(30)] + [("d", 3, 5)], "chrom string, start long, end long")
    for r in loci.extract(rows, genome, 6, chunk=4).collect():
        at = (r.start + r.end) // 2 - 3
        inside = r.chrom == "c" and at >= 0 and at + 6 <= 30
        assert (r.kept, r.seq) == (inside, ("ACGTTGCANN" * 3)[at : at + 6] if inside else None)


def test_overlaps(spark):
    a = spark.createDataFrame([(i, "c", i * 7, i * 7 + 5) for i in range(40)], "id long, chrom string, start long, end long")
    b = spark.createDataFrame([("c", 20, 60), ("c", 100, 101), ("d", 0, 500)], "chrom string, start long, end long")
    want = {r.id for r in a.collect() if any(r.start < e and s < r.end for s, e in ((20, 60), (100, 101)))}
    assert {r.id for r in loci.overlapping(a, b, bin_size=16).collect()} == want


def test_matched_sampling_fills_short_strata(spark):
    pool = spark.createDataFrame([(i, i % 10) for i in range(3000)] + [(9000 + i, 50) for i in range(3)], "id long, bin int")
    like = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(500 + i, 50) for i in range(10)] + [(600, 77)], "id long, bin int")
    got = evaluate.matched_sample(pool, like, ["bin"], seed=4).collect()
    counts = {b: sum(r.bin == b for r in got) for b in (0, 1, 50)}
    assert len(got) == 411 == len({r.id for r in got}) and counts[50] == 3 and min(counts[0], counts[1]) >= 200
    assert got == evaluate.matched_sample(pool, like, ["bin"], seed=4).collect()
    bare = evaluate.matched_sample(pool, like, ["bin"], fill=False)
    assert {r["bin"]: r["count"] for r in bare.groupBy("bin").count().collect()} == {0: 200, 1: 200, 50: 3}


def test_support_vectors_missing_from_the_fasta(spark, tmp_path):
    (tmp_path / "a.out").write_text("p0\t0.5\np1\t-0.25\n\n")
    (tmp_path / "s.fa").write_text(">p0 x\nACGTNNAC\nGTAC\n>p1\nggttaaccgg\n")
    m = models.load_classic(spark, str(tmp_path / "a.out"), str(tmp_path / "s.fa"))
    assert [tuple(r) for r in m.sv.orderBy("id").collect()] == [(0, "ACGTACGTAC", 0.5), (1, "GGTTAACCGG", -0.25)] and m.kernel.kind == 2
    (tmp_path / "a.out").write_text("p0 1\np9 2\n")
    with pytest.raises(ValueError, match="p9"):
        models.load_classic(spark, str(tmp_path / "a.out"), str(tmp_path / "s.fa"))


def test_metrics_with_ties(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1), (0.2, 1)], "score double, label int")
    assert evaluate.auroc(rows).first()[0] == pytest.approx(4.5 / 6)
    assert evaluate.average_precision(rows).first()[0] == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)


@pytest.mark.parametrize("name", ["gram_topk", "score_linear", "explain_importance", "auroc", "interval_anti_join"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
