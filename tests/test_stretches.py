"""Stretches of lines that may be tables, of many runs at once."""

import numpy as np

from lodestack.operators import passages as A


def some_runs(seed, n=60):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 40, n)
    lines = sizes.sum()
    x = {"head": rng.random(lines) < 0.6, "stop": rng.random(lines) < 0.05, "words": rng.integers(1, 9, lines), "n": rng.integers(1, 100, lines), "like": rng.choice([0.0, 0.1, 0.6, 0.5, 1.0], lines)}
    return np.cumsum(sizes), x | {name: rng.integers(0, 2, lines) for name in ("digit", "long", "prose", "narrative", "marked")}


def test_runs_are_worked_on_at_once(monkeypatch):
    """Each run went through a hundred steps of its own."""
    ends, x = some_runs(1)
    whole = {}
    for p, start, end, columns, *rest in A._stretches(ends, x["head"], x["stop"], x):
        whole |= {(a, b, c): r for a, b, c, *r in zip(start.tolist(), end.tolist(), columns.tolist(), *[y.tolist() for y in rest])}
        assert (p == start).all()
    alone = {}
    for a, b in zip([0, *ends[:-1]], ends):
        own = {name: v[a:b] for name, v in x.items()}
        for _, start, end, columns, *rest in A._stretches(np.array([b - a]), own["head"], own["stop"], own):
            alone |= {(s + a, e + a, c): r for s, e, c, *r in zip(start.tolist(), end.tolist(), columns.tolist(), *[y.tolist() for y in rest])}
    assert whole == alone and len(whole) > 20


def test_stretches_are_the_plain_ones():
    ends, x = some_runs(2)
    found = {}
    for _, start, end, columns, data, likeness, mean, numbers, *_ in A._stretches(ends, x["head"], x["stop"], x):
        found |= {(s, c): (e, d, round(v, 9), round(m, 9), round(u, 9)) for s, e, c, d, v, m, u in zip(start.tolist(), end.tolist(), columns.tolist(), data.tolist(), likeness.tolist(), mean.tolist(), numbers.tolist())}
    want = {}
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        for c in range(2, 7):
            for p in range(a, b - c):
                q = p + c
                end = next((i for i in range(q, b) if x["stop"][i]), b)
                end = min(end, q + c * A.STACKED_ROWS)
                if x["head"][p:q].all() and end - q >= c * A.STACKED_LEAST and (end - q) % c == 0:
                    want[p, c] = (end - 1, end - q, round(x["like"][p:q].sum() / c, 9), round(x["n"][p:end].sum() / (end - p), 9), round(x["digit"][q:end].mean(), 9))
    assert found == want and len(found) > 20
