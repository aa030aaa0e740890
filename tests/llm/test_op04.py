import numpy as np

from foliant.llm import op04_embeddings as op


def brute(rows, t=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, (v, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(rows[j][0] for j in seen)
        out.append((v, len(links[i]), least, v == least))
    return sorted(out)


def rows(n=260, d=10, seed=1):
    r = np.random.RandomState(seed)
    centres = r.normal(size=(6, d))
    out = [(i, (centres[i % 6] + r.normal(scale=0.15 + 0.3 * (i % 3), size=d)).astype(np.float32).tolist()) for i in range(n)]
    out += [(1000 + i, out[3][1]) for i in range(30)]  # equal vectors
    out += [(2000, None), (2001, []), (2002, [0.0] * d), (2003, [float("nan")] * d), (2004, [1.0, None]), (2005, [float("inf")] * d), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (7, out[7][1])]
    return out


def test_tiles_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([[*r, "x"] for r in data], "vec_id long, embedding array<float>, node string")
    for p in (op.Tiles(), op.Tiles(block=16, tile=5, steps=(2, 4)), op.Tiles(block=3, tile=2, steps=(1, 3, 9))):
        got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in op.near_vectors(df, p).collect())
        assert got == brute(data)


def test_empty(spark):
    assert op.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_never_drop_a_link():
    r = np.random.RandomState(2)
    x = r.normal(size=(200, 12))
    x[100:] = x[:100] + r.normal(scale=0.25, size=(100, 12))
    u, norm = op._unit(x)
    y = u @ np.linalg.qr(r.normal(size=(12, 12)))[0]
    tail = np.sqrt(np.maximum(np.cumsum((y * y)[:, ::-1], 1)[:, ::-1], 0))
    p = op.Tiles(steps=(2, 4, 8))
    got = op.linked(x, y, slice(0, 100), slice(100, 200), norm, {k: tail[:, k] for k in p.steps}, p)
    assert (got == (u[:100] @ u[100:].T >= 0.95)).all()
