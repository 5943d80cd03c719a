import math

import numpy as np
import pytest

from packspark.operators import trend as tr

COLS = "doe_number string, instance_number string, cycle int, norm_discharge_energy double"


def sequential_jumps(cycles, x, thr_pc, start, closest, n):
    """Straightforward sequential re-derivation of the jump rule (test oracle)."""
    x = list(map(float, x))
    pct = [math.nan] + [abs(x[i] / x[i - 1] - 1) for i in range(1, len(x))]
    cand = [i for i in range(len(x)) if pct[i] > thr_pc / 100 and cycles[i] >= start]
    kept = []
    for i in cand:
        if kept and cycles[i] - cycles[kept[-1]] < closest:
            kept[-1] = i
        else:
            kept.append(i)
    out = x[:]
    details = []
    for i in kept:
        c = cycles[i]
        details.append((c, out[i], abs(out[i] / out[i - 1] - 1) * 100))
        win = [out[k] for k in range(len(x)) if c - 2 <= cycles[k] <= c + n]
        if len(win) > 1:
            length = max(w - win[0] for w in win[1:])
            out = [v - length if cycles[k] >= c else v for k, v in enumerate(out)]
    return out, details


@pytest.mark.parametrize("closest,n", [(1, 5), (1, 2), (2, 5), (3, 5), (5, 2), (50, 5)])
def test_closed_form_matches_sequential(spark, closest, n):
    rng = np.random.default_rng(closest * 10 + n)
    rows, series = [], {}
    for s in range(12):
        length = int(rng.integers(3, 80))
        cycles = sorted(set(int(c) for c in np.cumsum(rng.integers(1, 3, length))))
        x = 1.0 - 0.0005 * np.array(cycles) + rng.normal(0, 0.0005, len(cycles))
        for pos in rng.choice(len(cycles), size=min(4, len(cycles)), replace=False):
            x[pos:] += rng.choice([-1, 1]) * 0.02
        series[str(s)] = (cycles, x)
        rows += [("D", str(s), c, float(v)) for c, v in zip(cycles, x)]
    df = spark.createDataFrame(rows, COLS)
    out = tr.energy_jump_removed(df, 0.2, 2, closest, n).toPandas()
    det = tr.energy_jump_details(df, 0.2, 2, closest, n).toPandas()
    for s, (cycles, x) in series.items():
        ref, ref_det = sequential_jumps(cycles, x, 0.2, 2, closest, n)
        got = out[out.instance_number == s].sort_values("cycle").norm_discharge_energy.to_numpy()
        assert np.allclose(got, ref, atol=1e-12), s
        d = det[det.instance_number == s].sort_values("cycle")
        assert d.cycle.tolist() == [c for c, _, _ in ref_det]
        assert np.allclose(d.energy.to_numpy(), [e for _, e, _ in ref_det], atol=1e-12)
        assert np.allclose(d.jump_energy_pct.to_numpy(), [p for _, _, p in ref_det], atol=1e-9)


def test_adjacent_jumps_equal_the_sequential_rule(spark):
    rng = np.random.default_rng(99)
    rows, series = [], {}
    for s in range(6):
        cycles = list(range(1, 40))
        x = 1.0 - 0.0005 * np.array(cycles) + rng.normal(0, 0.0005, len(cycles))
        for pos in rng.choice(len(cycles), size=5, replace=False):
            x[pos:] += rng.choice([-1, 1]) * 0.02
        series[str(s)] = (cycles, x)
        rows += [("D", str(s), c, float(v)) for c, v in zip(cycles, x)]
    df = spark.createDataFrame(rows, COLS)
    out = tr.energy_jump_removed(df, 0.2, 2, 1, 5).toPandas()
    det = tr.energy_jump_details(df, 0.2, 2, 1, 5).toPandas()
    for s, (cycles, x) in series.items():
        ref, ref_det = sequential_jumps(cycles, x, 0.2, 2, 1, 5)
        got = out[out.instance_number == s].sort_values("cycle").norm_discharge_energy.to_numpy()
        assert np.allclose(got, ref, atol=1e-12)
        d = det[det.instance_number == s].sort_values("cycle")
        assert d.cycle.tolist() == [c for c, _, _ in ref_det]
        assert np.allclose(d.jump_energy_pct.to_numpy(), [p for _, _, p in ref_det], atol=1e-9)


def test_linear_fit_target_cycle(spark):
    rows = [("D", "1", c, 1.0 - 0.001 * c) for c in range(1, 61)] + [("D", "2", c, 0.9) for c in range(1, 5)]
    df = spark.createDataFrame(rows, COLS)
    f = tr.fade_target_cycle(df, 0.64, 30).orderBy("instance_number").toPandas()
    assert f.slope.iloc[0] == pytest.approx(-0.001)
    assert f.r2_score.iloc[0] == pytest.approx(1.0)
    assert f.target_cycle.iloc[0] in (359, 360)   # truncation of (0.64-1)/-0.001 = 360 within float noise
    assert f.n_points.iloc[0] == 30 and f.n_points.iloc[1] == 4
    assert math.isnan(f.target_cycle.iloc[1]) or f.target_cycle.iloc[1] is None
    seg = tr.extrapolation_segments(df, tr.fade_target_cycle(df, 0.64, 30), 0.9).toPandas()
    seg = seg.sort_values("instance_number")
    # a flat series fits perfectly (r2 = 1) but never reaches the target: no end cycle
    assert seg.instance_number.tolist() == ["1", "2"]
    assert seg.start_cycle.iloc[0] == 55 and seg.start_energy.iloc[0] == pytest.approx(0.94)
    assert seg.end_cycle.isna().iloc[1]


def test_single_pass_segments_equal_two_step(spark):
    rng = np.random.default_rng(4)
    rows = [("D", str(s), c, 1.0 - 0.002 * c + rng.normal(0, 0.0005 * (1 + s)))
            for s in range(8) for c in range(1, 45)]
    df = spark.createDataFrame(rows, COLS)
    a = tr.fit_segments(df, 0.64, 30, 0.9).toPandas().sort_values("instance_number").reset_index(drop=True)
    b = tr.extrapolation_segments(df, tr.fade_target_cycle(df, 0.64, 30), 0.9).toPandas() \
        .sort_values("instance_number").reset_index(drop=True)
    assert a.instance_number.tolist() == b.instance_number.tolist() and len(a) > 0
    for c in ("start_cycle", "end_cycle"):
        assert a[c].tolist() == b[c].tolist()
    assert np.allclose(a.start_energy, b.start_energy) and np.allclose(a.r2_score, b.r2_score)
