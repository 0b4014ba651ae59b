import numpy as np
import pytest

from findrift.llm import pivots as V


def brute(rows, threshold=V.THRESHOLD):
    ok, n = [], {}
    for k, (_, v, label) in enumerate(rows):
        good = label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(good)
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            (_, x, lx), (_, y, ly) = rows[a], rows[b]
            if ok[a] and ok[b] and lx == ly and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    return links


def reach(links, ids):
    out = {}
    for k in links:
        if k in out:
            continue
        todo, seen = [k], {k}
        while todo:
            for y in links[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        low = min((ids[x] for x in seen if ids[x] is not None), default=None)
        out.update(dict.fromkeys(seen, low))
    return out


def near(rng, x, cosine):
    y = rng.normal(size=len(x))
    y -= y @ x * x
    y /= np.linalg.norm(y)
    return cosine * x + np.sqrt(1 - cosine * cosine) * y


def test_recall_close_to_the_threshold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        rows.append((3 * i, x.tolist(), i % 4))
        for k, c in enumerate(rng.uniform(0.931, 0.96, i % 3)):
            rows.append((3 * i + 1 + k, near(rng, x, c).tolist(), i % 4))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    real = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    x = np.array([r[1] for r in real])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in real])
    cos = (x @ x.T >= V.THRESHOLD) & (label[:, None] == label[None, :])
    want = dict(zip([r[0] for r in real], (cos.sum(1) - 1).tolist()))
    got = {r["vec_id"]: r["n_links"] for r in V.link(df).collect()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.95 * sum(want.values()) > 1000


@pytest.mark.parametrize("block", [8, 1024])
def test_hot_lists_copies_and_components(spark, block):
    rng = np.random.default_rng(8)
    x = rng.normal(size=16)
    x /= np.linalg.norm(x)
    rows = [(i, near(rng, x, rng.uniform(0.96, 1)).tolist(), 1) for i in range(60)]  # one hot place
    rows += [(100 + i, x.tolist(), 1) for i in range(40)]  # copies
    rows += [(200 + i, rng.normal(size=16).tolist(), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    links = brute(rows)
    low = reach(links, [r[0] for r in rows])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in V.link(df, shared=1, block=block).collect()}
    for k, r in enumerate(rows):
        assert got[r[0]] == (len(links[k]), low[k], low[k] == r[0])


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1),
        (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [1.0, -0.0], 1), (9, [1.0, 0.0], 1), (None, [2.0, 0.0], 1),
        (10, [1.0, 0.0, 0.0], 1), (11, [3e300, 1e290], 1), (12, [1e-300, 0.0], 1), (13, [0.0, 1.0], 1), (None, [1.0], 9),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, label int, node int, x int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in V.link(df).collect()), key=str)
    alone = {1, 2, 3, 4, 5, 6, 7, 10, 13}
    want = [(i, 0, i, True) if i in alone else (None, 0, None, False) if label == 9 else (i, 5, 8, i == 8) for i, _, label in rows]
    assert got == sorted(want, key=str)
    assert V.link(df.where("1 = 0")).count() == 0
