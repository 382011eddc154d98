"""Near-duplicate vectors and vector codes against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from cellframe.llm import near_vectors, vector_codes

EDGES = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] * 4), (904, [math.inf] * 8), (905, [math.nan] * 8), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, [3.0, 6.0]), (908, [5.0]), (909, [-5.0])]


def brute_near(rows, threshold):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v) / max(map(abs, v)) if g else None for (_, v), g in zip(rows, ok)]
    unit = [None if u is None else u / np.sqrt((u * u).sum()) for u in unit]
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, links[i], least.get(root(i)), d == least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("width,rows,threshold", [(8, 40, 0.95), (20, 1000, 0.95), (3, 25, 0.99), (16, 64, 0.5)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, width, rows, threshold):
    monkeypatch.setattr(near_vectors, "TILE_ROWS", 16)
    draw = random.Random(width)
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    given = [(i, [x + draw.gauss(0, 0.16) for x in centres[i % 6]]) for i in range(200)]
    # A third of all rows near each other, equal rows, scaled ones, very large and small ones, one id twice.
    given += [(200 + i, [x + draw.gauss(0, 0.01) for x in centres[0]]) for i in range(100)]
    given += [(300 + i, given[7][1]) for i in range(30)] + [(5, given[5][1]), (5, given[9][1])]
    given += [(400, [x * 2.0**900 for x in given[11][1]]), (401, [x * 2.0**-900 for x in given[11][1]]), *EDGES]
    docs = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in given], "vec_id long, embedding array<double>, node long, key string, label int").repartition(5)
    found = sorted((tuple(r) for r in near_vectors.near_vectors(docs, threshold, rows=rows).collect()), key=str)
    assert found == brute_near(given, threshold)


def test_no_vectors(spark):
    docs = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors.near_vectors(docs).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, near_vectors.near_vectors(nulls).collect()), key=str) == [(1, 0, 1, True), (None, 0, None, True)]


@pytest.mark.parametrize("most", [1, 40_000])
def test_rounds_keep_few_vectors_on_disk(spark, monkeypatch, most):
    draw = random.Random(11)
    given = [(i, [draw.gauss(0, 1) + (i % 9 == 0) * 6 for _ in range(20)]) for i in range(300)]
    docs = spark.createDataFrame([*given, (7, given[7][1]), *EDGES], "vec_id long, embedding array<double>").repartition(3)
    written, dropped, make, drop = [], [], near_vectors.scratch.Table.__init__, near_vectors.scratch.Table.drop

    def made(self, df, *args, **kw):
        make(self, df, *args, **kw)
        # Those with vectors: each is gone before the next one is made.
        if "payload" in self.df.columns:
            assert set(written) <= set(dropped)
            written.append(self.path)
            assert most > 1 or self.df.groupBy("block").count().count() == 1
        elif self.df.columns == ["node", "label", "links"]:
            rounds.append(self.path)

    def gone(self):
        dropped.append(self.path)
        drop(self)

    rounds = []
    monkeypatch.setattr(near_vectors, "ROUND_BYTES", most)
    monkeypatch.setattr(near_vectors.scratch.Table, "__init__", made)
    monkeypatch.setattr(near_vectors.scratch.Table, "drop", gone)
    found = sorted((tuple(r) for r in near_vectors.near_vectors(docs, 0.9, rows=40).collect()), key=str)
    assert found == brute_near([*given, (7, given[7][1]), *EDGES], 0.9)
    assert len(rounds) > len(written) > 1


@pytest.mark.parametrize("shape", [(3, 5), (16, 8), (1, 7), (40, 21)])
def test_places_of_what_is_true(shape):
    for share in (0, 0.02, 0.7):
        at = np.random.default_rng(3).random(shape) < share
        assert near_vectors._where(at).tolist() == np.flatnonzero(at).tolist()


def brute_codes(rows, parts, entries, rounds, scale):
    """Product codes by plain Python integers; rows of (vec_id, vector, label)."""
    kept = [(i, [math.floor(scale * x) if abs(x) < 1e300 else int(x) * scale for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, by_label = [], {}
    for width in {len(v) for _, v, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cut = [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]
        books = [[v[a:z] for _, v, _ in own[:entries]] for a, z in cut]

        def near(p, x):
            far = [sum((s - t) ** 2 for s, t in zip(x, e)) for e in books[p]]
            return far.index(min(far)), min(far)

        for _ in range(rounds):
            for p, (a, z) in enumerate(cut):
                of = {}
                for _, v, _ in own:
                    of.setdefault(near(p, v[a:z])[0], []).append(v[a:z])
                books[p] = [[sum(c) // len(of[e]) for c in zip(*of[e])] if e in of else old for e, old in enumerate(books[p])]
        sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for i, v, k in own:
            found = [near(p, v[a:z]) for p, (a, z) in enumerate(cut)]
            error = sum(d for _, d in found)
            by_label[k] = by_label.get(k, 0) + error
            out.append((i, "".join(f"{c:02x}" for c, _ in found), error, k, sha))
    most = 2**63 - 1
    return sorted(((i, c, min(e, most), min(by_label[k], most), sha) for i, c, e, k, sha in out), key=str)


@pytest.mark.parametrize("width,scale,block", [(16, 1.0, 64), (16, 1e6, 100), (21, 0.2, 8192), (16, 1e15, 50)])
def test_codes_equal_brute_force(spark, monkeypatch, width, scale, block):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block)
    monkeypatch.setattr(vector_codes, "CHUNK_ROWS", 64)
    draw = random.Random(width)
    rows = [(i * 3, [draw.gauss(0, scale) for _ in range(width)], draw.choice([1, 2, None])) for i in range(150)]
    rows += [(1000 + i, rows[4][1], 7) for i in range(60)] + [(3, rows[4][1], None), (3, rows[5][1], 1), (None, rows[6][1], 2)]
    rows += [(2000, None, 1), (2001, [1.0, None], 1), (2002, [math.inf] * width, 1), (2003, [math.nan] * width, 2), (2004, [], None), (2005, [1.5, -2.5], 1), (2006, [1.5, -3.5], 1)]
    docs = spark.createDataFrame([(i, v, k, "x", 1, 2) for i, v, k in rows], "vec_id long, embedding array<double>, label int, code string, width int, block long").repartition(4)
    found = sorted((tuple(r) for r in vector_codes.vector_codes(docs, 8, 20, 2, 256).collect()), key=str)
    assert found == brute_codes(rows, 8, 20, 2, 256)
    assert vector_codes.vector_codes(docs.where("vec_id < 0")).count() == 0


def test_codes_of_mixed_sizes():
    rows = np.array([[1, 2**40], [3, -4], [10**12, 0]], object)
    assert (vector_codes.decode(vector_codes.encode(rows), 2) == rows).all()
    assert vector_codes.encode(np.array([[3, -4]])) == vector_codes.encode(rows)[1:2]
