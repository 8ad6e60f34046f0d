"""The command line on small files, and streams."""

import numpy as np
import pytest

from helixframe import cli
from helixframe.functions.tables import Kernel
from helixframe.operators import effects
from helixframe.operators.model import GkmModel
from helixframe.sources import models, text
from helixframe.streaming.scoring import score_stream

SEQS = ["ACGTTGCATGCAACGT", "GATTACATTACAGATT", "CCCGTAACGTACCCCG"]


@pytest.fixture
def files(spark, tmp_path):
    rows = [(0, "ACGTTGCATGCA", 1.5), (1, "GATTACATTACA", -0.75), (2, "CCCGTAACGTAC", 0.5)]
    m = GkmModel(spark.createDataFrame(rows, "id long, seq string, coef double"), Kernel(2, 4, 3, 2), 0.125)
    models.save_model(m, str(tmp_path / "m.npz"))
    (tmp_path / "x.fa").write_text("".join(f">s{i} more\n{s}\n" for i, s in enumerate(SEQS)))
    (tmp_path / "y.fa").write_text("".join(f">s{i}\n{s[:7]}T{s[8:]}\n" for i, s in enumerate(SEQS)))
    return tmp_path, m, spark.createDataFrame(list(enumerate(SEQS)), "id long, seq string")


def run(spark, *args):
    return cli.main([str(a) for a in args], spark)


def table(path):
    lines = path.read_text().splitlines()
    assert lines[0] == "name\tscore"
    return dict(x.split("\t") for x in lines[1:])


def test_predict_and_import(spark, files, capsys):
    at, m, seqs = files
    want = {f"s{r.id} more": f"{r.score:.6f}" for r in m.score(seqs).collect()}
    assert run(spark, "predict", "-m", at / "m.npz", "-i", at / "x.fa", "-o", at / "out.tsv", "--variable-length") == 0
    assert table(at / "out.tsv") == want
    models.save_model(m, str(at / "m.txt"))
    run(spark, "import", "-f", "lsgkm", "-i", at / "m.txt", "-o", at / "again.npz")
    capsys.readouterr()
    run(spark, "predict", "-m", at / "again.npz", "-i", at / "x.fa", "--variable-length")
    assert dict(x.split("\t") for x in capsys.readouterr().out.splitlines()[1:]) == want
    with pytest.raises(SystemExit, match="shorter than"):
        run(spark, "predict", "-m", at / "m.npz", "-i", at / "x.fa", "--length", 99)
    assert cli.main([]) == 1


def test_ism_and_explain_files(spark, files):
    at, m, seqs = files
    run(spark, "ism", "-m", at / "m.npz", "-i", at / "x.fa", "-o", at / "ism.npz", "--variable-length")
    run(spark, "explain", "-m", at / "m.npz", "-i", at / "x.fa", "-o", at / "attr.npz", "-s", at / "seqs.npz", "--variable-length")
    ism, attr, one_hot = (np.load(at / f"{n}.npz") for n in ("ism", "attr", "seqs"))
    assert ism["scores"].shape == attr["arr_0"].shape == one_hot["arr_0"].shape == (3, 4, 16) and "lengths" not in ism
    assert ism["names"].tolist() == ["s0 more", "s1 more", "s2 more"] and attr["arr_0"].dtype == np.float32
    letters = ["".join("ACGT"[j] for j in one_hot["arr_0"][i].argmax(0)) for i in range(3)]
    assert letters == SEQS and (one_hot["arr_0"] == ism["one_hot"]).all()
    got = {(r.id, r.pos, r.base): r.value for r in effects.ism(m, seqs).collect()}
    for (i, pos, base), v in got.items():
        assert ism["scores"][i, "ACGT".index(base), pos] == pytest.approx(v)
    # hypothetical scores of the sequence's own letters add up to the score
    own = (attr["arr_0"] * one_hot["arr_0"]).sum((1, 2))
    assert own == pytest.approx([r.score - 0.125 for r in m.score(seqs).orderBy("id").collect()], abs=1e-5)


def test_variants_and_linear_models(spark, files):
    at, m, seqs = files
    run(spark, "score-variants", "-m", at / "m.npz", "--ref", at / "x.fa", "--alt", at / "y.fa", "-o", at / "v.tsv", "--variable-length")
    ref = {r.id: r.score for r in m.score(seqs).collect()}
    alt = {r.id: r.score for r in m.score(spark.createDataFrame([(i, f"{s[:7]}T{s[8:]}") for i, s in enumerate(SEQS)], "id long, seq string")).collect()}
    for name, v in table(at / "v.tsv").items():
        i = int(name[1])
        assert float(v) == pytest.approx(alt[i] - ref[i], abs=2e-6)
    run(spark, "to-deltasvm", "-m", at / "m.npz", "-o", at / "w.txt", "--query-norm")
    assert (at / "w.txt").read_text().startswith("# include_rc=false\n")
    run(spark, "deltasvm", "-w", at / "w.txt", "-i", at / "x.fa", "-o", at / "d.tsv", "-l", 4, "--variable-length")
    weights = dict(x.split("\t") for x in (at / "w.txt").read_text().splitlines()[1:])
    for name, v in table(at / "d.tsv").items():
        s = SEQS[int(name[1])]
        assert float(v) == pytest.approx(sum(float(weights.get(s[i : i + 4], 0)) for i in range(13)), abs=1e-5)


def test_training_commands(spark, files):
    at, _, _ = files
    draw = np.random.default_rng(2)
    for name, motif in (("p", "GATTACA"), ("n", "CCCCGGG")):
        (at / f"{name}.fa").write_text("".join(f">{i}\n{''.join(draw.choice(list('ACGT'), 14))}{motif}\n" for i in range(8)))
    options = ("-l", 4, "-k", 3, "-d", 2, "--variable-length")
    run(spark, "train", "-p", at / "p.fa", "-n", at / "n.fa", "-o", at / "svc.txt", *options)
    run(spark, "predict", "-m", at / "svc.txt", "-i", at / "p.fa", "-o", at / "p.tsv", "--variable-length")
    assert all(float(v) > 0 for v in table(at / "p.tsv").values())
    (at / "labels.txt").write_text("".join(f"{i / 4}\n" for i in range(8)))
    run(spark, "trainsvr", "-i", at / "p.fa", "--labels", at / "labels.txt", "-o", at / "svr.npz", "-C", 10, *options)
    run(spark, "predict", "-m", at / "svr.npz", "-i", at / "p.fa", "-o", at / "r.tsv", "--variable-length")
    assert all(abs(float(v) - int(n) / 4) < 0.11 for n, v in table(at / "r.tsv").items())


def test_scores_of_a_stream(spark, files):
    at, m, seqs = files
    seqs.write.parquet(str(at / "in"))
    got = {}
    stream = spark.readStream.schema("id long, seq string").parquet(str(at / "in"))
    query = score_stream(m, stream, lambda rows, epoch: got.update((r.id, r.score) for r in rows.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert got == pytest.approx({r.id: r.score for r in m.score(seqs).collect()})


def test_notes_above_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    text.write_table(rows, str(tmp_path / "t"), {"seed": "7", "made by": "x: y"})
    assert [tuple(r) for r in text.read_table(spark, str(tmp_path / "t")).orderBy("n").collect()] == [(1, "a"), (2, None)]
    assert {tuple(r) for r in text.read_notes(spark, str(tmp_path / "t")).collect()} == {("seed", "7"), ("made by", "x: y")}
