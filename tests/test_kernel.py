"""Kernels, models, effects and attributions against a naive form of their definitions."""

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.functions.tables import Kernel, mask_levels, masks, neighbour_bits, resolve_kernel_type
from helixframe.operators import effects, kernel, local
from helixframe.operators.explain import completeness, explain
from helixframe.operators.model import GkmModel

RC = str.maketrans("ACGT", "TGCA")
SEQS = [(0, "ACGTACGTTGCA"), (1, "AAAAAAAANAAAAA"), (2, "GATTACAGATTACA"), (3, "ccgtaacgtgacg")]


def rc(s):
    return s.upper().replace("N", "A").translate(RC)[::-1]


def naive(x, y, k):
    x, y = x.upper().replace("N", "A"), y.upper().replace("N", "A")
    cut = lambda s: [s[i : i + k.l] for i in range(len(s) - k.l + 1)]
    wx, fwd, rev = cut(x), cut(y), cut(rc(y))
    a, b = ([k.window_weight(i, len(w)) for i in range(len(w))] for w in (wx, fwd))
    h = lambda u, v: k.h[sum(p != q for p, q in zip(u, v))]
    total = sum(a[i] * b[j] * h(u, v) for i, u in enumerate(wx) for j, v in enumerate(fwd))
    if k.include_rc:
        total += sum(a[i] * b[len(b) - 1 - j] * h(u, v) for i, u in enumerate(wx) for j, v in enumerate(rev))
    return total


def normal(x, y, k):
    if not (k.normalize or k.rbf):
        return naive(x, y, k)
    v = naive(x, y, k) / max(math.sqrt(naive(x, x, k) * naive(y, y, k)), 1e-10)
    return math.exp(k.gamma * (v - 1)) if k.rbf else v


def frame(spark, rows=SEQS):
    return spark.createDataFrame(rows, "id long, seq string")


def model(spark, k):
    rows = [(0, "ACGTTGCATGCA", 1.5), (1, "GATTACATTACA", -0.75), (2, "CCCGTAACGTAC", 0.5)]
    return rows, GkmModel(spark.createDataFrame(rows, "id long, seq string, coef double"), k, 0.125)


def score(x, rows, k, bias=0.125):
    return sum(c * normal(x, s, k) for _, s, c in rows) + bias


KERNELS = [Kernel(0, 5, 3, None), Kernel(1, 5, 3, 2), Kernel(2, 5, 3, 2, include_rc=False), Kernel(4, 5, 3, 2, M=5, H=2.0), Kernel(3, 5, 3, 2, gamma=2.0)]


def test_tables():
    assert np.allclose(Kernel(2, 11, 7, 3).h[:4], [0.22000499, 0.06041188, 0.01331924, 0.00177483], atol=1e-8)
    assert np.allclose(Kernel(1, 11, 7, 3).h[:4], [0.28669548, 0.06257057, 0.00417137, -0.00231743], atol=1e-8)
    assert Kernel(0, 3, 2, None).h == (3, 1, 0, 0)
    assert len(masks(Kernel(2, 11, 7, 3).h)) == 232 and len(masks(Kernel(0, 11, 7, None).h)) == 330
    for k in KERNELS:
        for m in range(k.l + 1):
            assert abs(sum(a * math.comb(k.l - m, j) for j, a in mask_levels(k.h).items()) - k.h[m]) < 1e-9
    assert len(neighbour_bits(5, 2)) == 1 + 5 * 3 + 10 * 9
    assert resolve_kernel_type("wgkm") == resolve_kernel_type(4) == resolve_kernel_type("weighted") == 4
    with pytest.raises(ValueError):
        resolve_kernel_type("other")


@pytest.mark.parametrize("k", KERNELS[:4])
def test_strategies_agree_with_the_definition(spark, k):
    x = frame(spark)
    for strategy in ("masked", "neighbour", "brute"):
        got = {(r.a_id, r.b_id): r.k for r in kernel.raw_kernel(x, x, k, strategy).collect()}
        for (i, a), (j, b) in ((p, q) for p in SEQS for q in SEQS):
            assert got.get((i, j), 0.0) == pytest.approx(naive(a, b, k), abs=1e-9), (strategy, i, j)


@pytest.mark.parametrize("k", KERNELS)
def test_scores(spark, k):
    rows, m = model(spark, k)
    got = {r.id: r.score for r in m.score(frame(spark, [*SEQS, (9, "ACG")])).collect()}
    assert math.isnan(got.pop(9))
    for i, s in SEQS:
        assert got[i] == pytest.approx(score(s, rows, k), abs=1e-9)


@pytest.mark.parametrize("k", [KERNELS[1], KERNELS[4]])
def test_effects_and_attributions(spark, k):
    rows, m = model(spark, k)
    x = frame(spark, SEQS[:1])
    s = SEQS[0][1]
    for r in effects.ism(m, x).collect():
        mutant = s[: r.pos] + r.base + s[r.pos + 1 :]
        assert r.value == pytest.approx(score(mutant, rows, k) - score(s, rows, k), abs=1e-9)
    done = completeness(m, x).first()
    assert done.scored == pytest.approx(done.explained, abs=1e-9)
    assert {r.value for r in explain(m, x, "perturbation").collect() if r.base == s[r.pos]} == {0.0}
    alt = frame(spark, [(0, s[:5] + "T" + s[6:])])
    assert m.score_variants(x, alt).first().score == pytest.approx(score(s[:5] + "T" + s[6:], rows, k) - score(s, rows, k), abs=1e-9)


@pytest.mark.parametrize("k", [*KERNELS, Kernel(5, 5, 3, 2, M=5, H=2.0, gamma=1.5), Kernel(0, 5, 3, None, normalize=False)])
def test_changes_of_any_kind_equal_rescoring(spark, k):
    """Substitutions, insertions, deletions at both ends and inside, equal and short sequences."""
    rows, m = model(spark, k)
    s = SEQS[3][1]
    pairs = [(s, s), (s, s[:6] + "gg" + s[6:]), (s, s[:4] + s[7:]), (s, "t" + s), (s, s + "ac"), (s, s[2:]), (s, s[:-3]), (s, "ACGTACGTAC"), (s, "ACG"), ("AC", s), ("aaaaaaaaaa", "aaaaaaaaaaaaa"), (s, s[:5] + "n" + s[6:])]
    ref, alt = (frame(spark, [(i, p[j]) for i, p in enumerate(pairs)]) for j in (0, 1))
    got = {r.id: r.score for r in m.score_variants(ref, alt).collect()}
    for i, (a, b) in enumerate(pairs):
        want = math.nan if min(len(a), len(b)) < k.l else score(b, rows, k) - score(a, rows, k)
        assert got[i] == pytest.approx(want, abs=1e-9, nan_ok=True), (a, b)


def test_reverse_complements_of_either_side(spark):
    k = KERNELS[3]
    x, y = frame(spark, SEQS[:2]), frame(spark, SEQS[1:])
    both = [{(r.a_id, r.b_id): r.k for r in kernel.raw_kernel(x, y, k, rc_of=side).collect()} for side in ("x", "y")]
    assert both[0] == pytest.approx(both[1])


def test_unnormalised_ism_equals_rescoring(spark):
    k = Kernel(0, 4, 2, None, normalize=False)
    rows, m = model(spark, k)
    for r in effects.ism(m, frame(spark, SEQS[2:3])).collect():
        s = SEQS[2][1]
        assert r.value == pytest.approx(score(s[: r.pos] + r.base + s[r.pos + 1 :], rows, k) - score(s, rows, k), abs=1e-9)


def test_export_to_linear_model(spark):
    k = Kernel(6, 3, 2, None)
    rows, m = model(spark, k)
    got = {r.kmer: r.w for r in m.to_deltasvm().weights.collect()}
    assert len(got) == 64
    assert all(w == pytest.approx(score(u, rows, k, 0.0), abs=1e-9) for u, w in got.items())


def test_gapped_linear_scores(spark):
    from helixframe.operators.deltasvm import DeltaSVM

    weights = {a + b: i / 8 for i, (a, b) in enumerate((a, b) for a in "ACGT" for b in "ACGT")}
    m = DeltaSVM(spark.createDataFrame(list(weights.items()), "kmer string, w double"), 4, 2, True, 0.5)
    for r in m.score(frame(spark)).collect():
        s = dict(SEQS)[r.id].upper().replace("N", "A")
        want = sum(weights[w[i] + w[j]] for t in (s, rc(s)) for p in range(len(t) - 3) for w in [t[p : p + 4]] for i, j in combinations(range(4), 2))
        assert r.score == pytest.approx(want + 0.5)


def test_codec(spark):
    row = frame(spark, [(0, "acgtn")]).select(S.one_hot_decode(S.one_hot(F.col("seq"))).alias("d"), S.reverse_complement(F.col("seq")).alias("r"), S.is_one_hot(S.one_hot(F.col("seq"))).alias("v"), S.codes(F.col("seq")).alias("c"), S.center_crop(F.col("seq"), 3).alias("m")).first()
    assert (row.d, row.r, row.v, list(row.c), row.m) == ("ACGTA", "TACGT", True, [0, 1, 2, 3, 0], "cgt")
    with pytest.raises(Exception, match="invalid bases"):
        frame(spark, [(0, "ACX")]).select(S.letters(F.col("seq"))).collect()


def test_one_hot_of_nothing(spark):
    x = frame(spark, [(0, ""), (1, None), (2, "gan")])
    code = S.one_hot(F.col("seq"))
    rows = x.select(S.is_one_hot(code).alias("v"), S.one_hot_decode(code).alias("d"), S.decode_codes(S.codes(F.col("seq"))).alias("c")).collect()
    assert [tuple(r) for r in rows] == [(True, "", ""), (True, None, None), (True, "GAA", "GAA")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k", [Kernel(0, 5, 3, None), Kernel(6, 5, 3, None, gamma=2.0), Kernel(5, 5, 3, 2, M=5, H=2.0, gamma=2.0)], ids=str)
def test_kernels_in_place(spark, k, monkeypatch):
    """Nothing but small rows of vectors is broadcast, nothing is shuffled by window, and the joins give the same."""
    x = frame(spark, [*SEQS, (4, "ACG"), (5, "TTTTTTTTTTTTTTTTTTTTTTTT")])
    short = x.select("id", F.expr("substring(seq, 1, length(seq) - 1)").alias("seq"))
    _, m = model(spark, k)
    calls = (lambda: m.score(x), lambda: m.score_variants(x, short), lambda: effects.ism(m, x), lambda: kernel.pairwise(x, m.sv, k))
    here = [f() for f in calls]
    for df in (here[0], here[2], kernel.diagonal(x, k)):
        assert "Broadcast" not in plan(df) and "hashpartitioning" not in plan(df)
    assert "Broadcast" not in plan(kernel.raw_of(kernel.lmers(x, k), kernel.lmers(x, k), k, "masked"))
    here = [df.collect() for df in here]
    monkeypatch.setattr(local, "DENSE", 0)
    for rows, f in zip(here, calls, strict=True):
        got, want = ({tuple(r)[:-1]: r[-1] for r in y} for y in (rows, f().collect()))
        assert len(got) == len(rows) and got.keys() == want.keys()
        assert all(np.isclose(got[i], want[i], rtol=1e-7, atol=1e-7, equal_nan=True) for i in want)


def test_self_kernels_of_any_length(spark):
    for k in (Kernel(2, 11, 7, 3), Kernel(4, 9, 5, 2, M=5, H=2.0), Kernel(0, 4, 2, None)):
        for s in ("GATTACAGATTACAGGTACC", "ACGTTGCA" * 40, "A" * 300, "ACG"):
            p = local.packed(s.translate(str.maketrans("ACGT", "0123")), k.l)
            by_masks = float(local.weights(k, len(p)) @ sum((a * np.array([((q[None] & mask) == (p[:, None] & mask)) @ w for q, w in [local.strands(k, p, local.weights(k, len(p)))]][0]) for mask, a in masks(k.h)), np.zeros(len(p))))
            assert np.isclose(local.own(k, p), by_masks, rtol=1e-7) and (len(s) > 40 or np.isclose(local.own(k, p), naive(s, s, k)))
    with pytest.raises(ValueError):
        local.packed("01-2", 2)


@pytest.mark.parametrize("k", [Kernel(0, 6, 4, None), Kernel(2, 4, 2, 1), Kernel(4, 5, 3, 2, M=20, H=4.0), Kernel(1, 4, 2, None, include_rc=False), Kernel(0, 9, 7, 2)])
def test_self_kernels_of_blocks(k):
    digits = ["", None, "012", "0" * 30, "0123012303210", "33", "3210" * 300, "010203"]
    p, n = local.packed_all(digits, k.l)
    rows = [local.packed(s, k.l) for s in digits]
    assert n.tolist() == [len(x) for x in rows] and p.tolist() == np.concatenate(rows).tolist()
    assert np.allclose(local.owns(k, p, n), [local.own(k, x) for x in rows], rtol=1e-9)
    if k.l <= local.DIRECT:
        each = [np.bincount(x, local.weights(k, len(x)), 4**k.l) for x in rows]
        assert np.array_equal(local.counted(k, p, n), each)
    with pytest.raises(ValueError, match="invalid bases in sequence: 01-2"):
        local.packed_all(["0123", "01-2"], 2)


def test_blocks_are_bounded_by_letters(monkeypatch):
    monkeypatch.setattr(local, "BLOCK", 400)
    texts = ["0" * n for n in (10, 90, 1, 500, 0, 60, 50)] + [None]
    parts = list(local._parts(texts, 100))
    assert [i for lo, hi in parts for i in range(lo, hi)] == list(range(len(texts)))
    assert all(hi - lo <= 4 and (hi - lo == 1 or sum(len(t or "") for t in texts[lo:hi]) <= 100) for lo, hi in parts)


def test_scores_make_no_self_kernel_alone(spark, monkeypatch):
    """A batch's self-kernels are made at once (one by one they took most of the time)."""

    def alone(*_):
        raise AssertionError

    held = {}
    monkeypatch.setattr(local, "_mapped", lambda seqs, fields, make: held.update(make=make))
    sv = spark.createDataFrame([(0, "ACGTACGT", 1.0), (1, "GATTACA", -0.5)], "id int, seq string, coef double")
    for k in (Kernel(0, 4, 2, None), Kernel(6, 4, 2, None, gamma=2.0)):
        local.score(GkmModel(sv, k, 0.25), sv)
        with monkeypatch.context() as m:
            m.setattr(local, "own", alone)
            out = pa.Table.from_batches(held["make"](pa.array([7, 8, 9]), ["01230123", "2033010", "012"])).to_pydict()
        seqs = ["ACGTACGT", "GATTACA"]
        want = [sum(c * normal(s, v, k) for v, c in zip(seqs, (1.0, -0.5))) + 0.25 for s in seqs]
        assert out["id"] == [7, 8, 9] and np.allclose(out["score"][:2], want) and math.isnan(out["score"][2])
