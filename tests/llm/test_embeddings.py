"""Embedding links against brute force; the estimator's bias and bounds."""

import numpy as np
import pytest

from tallyfs.llm import embeddings as emb


def brute(rows, threshold=0.93):
    """{row number: (n_links, component)} over (vec_id, embedding, label)."""
    ok = [i for i, (_, v, l) in enumerate(rows) if l is not None and v and all(c is not None and np.isfinite(c) for c in v)
          and any(v)]
    links = {i: set() for i in range(len(rows))}
    for n, i in enumerate(ok):
        for j in ok[n + 1:]:
            a, b = np.array(rows[i][1], dtype=np.float64), np.array(rows[j][1], dtype=np.float64)
            if rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None))
    return out


def family(rnd, n, dim, spread):
    base = rnd.standard_normal(dim)
    return [(base / np.linalg.norm(base) + spread * rnd.standard_normal(dim) / dim ** 0.5).tolist() for _ in range(n)]


@pytest.mark.parametrize("cell_rows,block", [(4096, 2048), (40, 16)])
def test_equals_brute_force(spark, monkeypatch, cell_rows, block):
    monkeypatch.setattr(emb, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(emb, "BLOCK", block)
    rnd = np.random.default_rng(3)
    vs = [(v, k % 2) for k in range(40) for v in family(rnd, int(rnd.integers(1, 4)), 64, rnd.choice([0.05, 0.2, 0.27]))]
    vs += [(v, 0) for v in family(rnd, 60, 64, 0.2)]
    vs += [(rnd.standard_normal(64).tolist(), int(rnd.integers(0, 2))) for _ in range(250)]
    vs += [vs[0]] * 25 + [(vs[0][0], 1 - vs[0][1])]
    rows = [(i * 3 % 1009, np.float32(v).tolist(), l) for i, (v, l) in enumerate(vs)]
    odd = [None, [], [0.0] * 64, [1.0, None], [float("nan")] * 3, [float("inf"), 1.0], [1.0], [2.0], [-1.0], [1e-30, 1e-30], [1e30, 1e30]]
    rows += [(5000 + i, v, 0) for i, v in enumerate(odd)] + [(6000, vs[0][0], None), (None, [1.0], 0), (5006, [1.0], 0)]
    df = spark.createDataFrame([(a, b, c, 1, "x") for a, b, c in rows], "vec_id long, embedding array<float>, label int, rep int, v string")
    got = emb.embedding_dedup(spark, df).collect()
    assert len(got) == len(rows)
    expect = brute(rows)
    want = sorted((rows[i][0] or -1, *e) for i, e in expect.items())
    have = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id) for r in got)
    want = sorted((-1 if rows[i][0] is None else rows[i][0], *e) for i, e in expect.items())
    if cell_rows == 4096:
        assert have == want
    else:  # several cells: links may be missed, never invented
        total, kept = sum(w[1] for w in want), sum(h[1] for h in have)
        assert 0.99 * total <= kept <= total


@pytest.mark.parametrize("dim", [128, 768])
def test_links_between_neighbouring_families_in_other_cells(spark, monkeypatch, dim):
    """Two dense families with centres at cosine 0.95, several cells each."""
    monkeypatch.setattr(emb, "CELL_ROWS", 50)
    rnd = np.random.default_rng(dim)
    one, side = np.linalg.qr(rnd.standard_normal((dim, 2)))[0].T
    centres = [one, 0.95 * one + (1 - 0.95 ** 2) ** 0.5 * side]
    x = np.concatenate([c + 0.05 * rnd.standard_normal((150, dim)) / dim ** 0.5 for c in centres])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in emb.embedding_dedup(spark, df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert links.min() > 150
    assert got == {i: (int(n), 0) for i, n in enumerate(links)}


def test_cells_within_reach_hold_every_neighbour():
    """Pivots that are data points, neighbours straight towards another pivot."""
    import pandas as pd

    rnd = np.random.default_rng(8)
    one, side = np.linalg.qr(rnd.standard_normal((768, 2)))[0].T
    pivots = np.array([one, 0.95 * one + (1 - 0.95 ** 2) ** 0.5 * side])
    pdf = pd.DataFrame({"label": 0, "dim": 768, "rep": [0], "v": [one.tolist()], "n": 1})
    out = next(emb._cells({(0, 768): pivots}, 0.93)(iter([pdf])))
    assert sorted(out[~out["base"]]["cell"]) == [0, 1]
    far = next(emb._cells({(0, 768): np.array([one, side])}, 0.93)(iter([pdf])))
    assert list(far[~far["base"]]["cell"]) == [0]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert emb.embedding_dedup(spark, df).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rnd = np.random.default_rng(1)
    base, near = rnd.standard_normal((1, 64)), None
    q = emb.unit(base)
    near = emb.unit(q + 0.4 * rnd.standard_normal((1, 64)) / 8)
    diffs, out = [], 0
    for seed in range(800):
        turn = emb.rotation(64, seed)
        signs, f, _ = emb.encode(near, turn)
        est, err = emb.estimate(signs, f, q @ turn)
        diffs.append(est[0, 0] - float((near @ q.T)[0, 0]))
        out += abs(diffs[-1]) > emb.ERRORS * err[0]
    assert abs(np.mean(diffs)) < 4 * np.std(diffs) / len(diffs) ** 0.5
    assert out == 0
