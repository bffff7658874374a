"""Lattice hashing against all pairs."""

import numpy as np
import pytest

from strandline.llm.lattice import STEPS, decode, embedding_groups


def all_pairs(ids, vectors, threshold=0.9):
    n = len(ids)
    fine = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    component = [None] * n
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        component[i] = min((ids[k] for k in seen if ids[k] is not None), default=None)
    return [len(x) for x in links], component


def test_decoding_is_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(scale=2, size=(200, 8))
    p = decode(x)
    assert len(STEPS) == 240 and np.allclose((STEPS**2).sum(axis=1), 2)
    own = ((x - p) ** 2).sum(axis=1)
    around = (((x - p)[:, None, :] - STEPS) ** 2).sum(axis=2).min(axis=1)
    assert (own <= around + 1e-9).all()


@pytest.mark.parametrize("block", [1024, 5])
def test_groups_equal_all_pairs(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 32))
    vectors = [(c + rng.normal(scale=0.08, size=32) * (k % 4)).astype(np.float32).tolist() for c in centres for k in range(6)]
    ids = list(range(len(vectors)))
    odd = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [float("inf")] * 32, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    vectors += odd + [vectors[0], vectors[3]]
    ids += list(range(1000, 1000 + len(odd))) + [0, None]
    rows = [(i, v, "x") for i, v in zip(ids, vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_groups(df, block=block).collect()), key=str)
    n, c = all_pairs(ids, vectors)
    assert got == sorted(((i, a, b, i == b) for i, a, b in zip(ids, n, c)), key=str)


def test_recall_at_the_threshold_and_no_rows(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.905 * a + np.sqrt(1 - 0.905**2) * noise
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    linked = embedding_groups(df).where("n_links > 0").count()
    assert linked >= 0.95 * 600
    assert embedding_groups(df.limit(0)).count() == 0
