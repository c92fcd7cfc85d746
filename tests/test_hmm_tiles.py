"""Hidden Markov models by tiles against the same over whole arrays."""

import itertools

import numpy as np
import pytest

from strandlake.operators import hmm

T3 = np.array([[0.9, 0.06, 0.04], [0.1, 0.85, 0.05], [0.02, 0.08, 0.9]])
INIT = np.array([0.5, 0.3, 0.2])


def groups(rng, sizes, states=3):
    """(key, sub, positions, emissions); some sites say nothing, and some rule a state out."""
    for g, n in enumerate(sizes):
        pos = np.cumsum(rng.integers(1, 12, n))
        emit = rng.dirichlet(np.ones(states), n)
        emit[rng.random(n) < 0.05] = 0
        emit[rng.random(n) < 0.05, 0] = 0
        yield (f"g{g}", g % 2), pos, emit


def whole(pos, emit, t, init):
    emit = np.where(emit.sum(1, keepdims=True) > 0, emit, 1.0)
    return hmm.viterbi(pos, emit, t, init), hmm.posterior(pos, emit, t, init)


@pytest.fixture(scope="module")
def data(spark):
    made = list(groups(np.random.default_rng(3), [1, 2, 7, 60, 200, 333]))
    rows = [(*k, int(p), *map(float, e)) for k, pos, emit in made for p, e in zip(pos, emit)]
    return made, spark.createDataFrame(rows, "k string, sub int, at long, e0 double, e1 double, e2 double").repartition(5)


@pytest.mark.parametrize("width,rows", [(1 << 20, 50_000), (50, 40), (3, 1000)])
def test_any_width(spark, data, monkeypatch, width, rows):
    monkeypatch.setattr(hmm, "ROWS", rows)
    made, df = data
    out = hmm.decode(df, ["k", "sub"], "at", ["e0", "e1", "e2"], T3.tolist(), INIT.tolist(), width=width)
    assert out.columns == ["k", "sub", "at", "state", "prob"]
    got = {(r["k"], r["at"]): (r["state"], r["prob"]) for r in out.collect()}
    assert len(got) == sum(len(p) for _, p, _ in made)
    for (k, _), pos, emit in made:
        path, post = whole(pos, emit, T3, INIT)
        assert [got[k, int(p)][0] for p in pos] == path.tolist()
        assert np.allclose([got[k, int(p)][1] for p in pos], post[np.arange(len(pos)), path], atol=1e-9)


def test_best_of_all_paths(spark):
    """Equal to going through all paths, also over the seams of tiles of one or two sites."""
    rng = np.random.default_rng(9)
    pos, emit = np.array([1, 2, 5, 6, 9, 14, 15]), rng.dirichlet(np.ones(3), 7)
    step = [np.linalg.matrix_power(T3, int(g)) for g in np.diff(pos)]
    score = lambda path: INIT[path[0]] * np.prod([emit[i, s] for i, s in enumerate(path)]) * np.prod([m[a, b] for m, a, b in zip(step, path, path[1:])])
    all_ = {p: score(p) for p in itertools.product(range(3), repeat=7)}
    df = spark.createDataFrame([("g", int(p), *map(float, e)) for p, e in zip(pos, emit)], "k string, at long, e0 double, e1 double, e2 double")
    rows = sorted(hmm.decode(df, ["k"], "at", ["e0", "e1", "e2"], T3.tolist(), INIT.tolist(), width=3).collect(), key=lambda r: r["at"])
    path = tuple(r["state"] for r in rows)
    assert path == max(all_, key=all_.get)
    for i, r in enumerate(rows):
        assert r["prob"] == pytest.approx(sum(v for p, v in all_.items() if p[i] == path[i]) / sum(all_.values()))


def test_ties_do_not_break_at_seams(spark):
    """Two equally good paths: the whole of one is taken, whatever the width."""
    rows = [("g", p, 0.5, 0.5) for p in range(1, 9)] + [("h", p, 1.0, 0.0) for p in range(1, 4)] + [("h", p, 0.0, 1.0) for p in range(4, 7)]
    df = spark.createDataFrame(rows, "k string, at long, a double, b double")
    t = [[0.7, 0.3], [0.3, 0.7]]
    paths = []
    for width in (1, 2, 3, 100):
        out = hmm.decode(df, ["k"], "at", ["a", "b"], t, [0.5, 0.5], width=width).collect()
        paths.append([r["state"] for r in sorted(out, key=lambda r: (r["k"], r["at"]))])
    assert all(p == [0] * 8 + [0, 0, 0, 1, 1, 1] for p in paths)


def test_crossover(spark):
    """Changes of state can be made rarer site by site."""
    rows = [("g", 1, 0.9, 0.1, 1.0), ("g", 2, 0.2, 0.8, 0.0), ("g", 3, 0.2, 0.8, 0.0), ("h", 1, 0.9, 0.1, 1.0), ("h", 2, 0.1, 0.9, 1.0), ("h", 3, 0.1, 0.9, 1.0)]
    df = spark.createDataFrame(rows, "k string, at long, a double, b double, c double")
    for width in (1, 100):
        out = hmm.decode(df, ["k"], "at", ["a", "b"], [[0.6, 0.4], [0.4, 0.6]], [0.9, 0.1], "c", width).collect()
        got = {k: [r["state"] for r in sorted(out, key=lambda r: r["at"]) if r["k"] == k] for k in "gh"}
        assert got == {"g": [0, 0, 0], "h": [0, 1, 1]}


def test_training(spark):
    """Recovers the transitions that made the sites, alike for any width."""
    rng, t = np.random.default_rng(1), np.array([[0.95, 0.05], [0.2, 0.8]])
    rows = []
    for g in range(8):
        state = 0
        for p in range(1, 401):
            state = int(rng.random() < t[state, 1])
            x = rng.normal(3 * state)
            rows.append((g, p, float(np.exp(-(x**2) / 2)), float(np.exp(-((x - 3) ** 2) / 2))))
    df = spark.createDataFrame(rows, "k int, at long, a double, b double")
    a = np.array(hmm.train(df, ["k"], "at", ["a", "b"], [[0.7, 0.3], [0.3, 0.7]], [0.5, 0.5], 6, width=1 << 20))
    b = np.array(hmm.train(df, ["k"], "at", ["a", "b"], [[0.7, 0.3], [0.3, 0.7]], [0.5, 0.5], 6, width=37))
    assert np.allclose(a, b, atol=1e-9) and np.abs(a - t).max() < 0.05


def test_nothing(spark, data):
    assert hmm.decode(data[1].limit(0), ["k", "sub"], "at", ["e0", "e1", "e2"], T3.tolist(), INIT.tolist()).count() == 0
