"""Elkan's bounds against a plain Lloyd that computes every distance, on real and on odd vectors."""

import hashlib
import math
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import op12_codes as op

KIND = "vec_id long, embedding array<float>, label int"


def plain_lloyd(rows, parts, entries, rounds):
    """rows (id, ints): (codes, errors, codebooks) in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in rows[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((dist(cut(v, p), c), e) for e, c in enumerate(books[p])) for p in range(parts)] for _, v in rows]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            held = defaultdict(list)
            for (_, v), f in zip(rows, found, strict=True):
                held[f[p][1]].append(cut(v, p))
            for e, vs in held.items():
                books[p][e] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = assign()
    return {r[0]: ("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for r, f in zip(rows, found, strict=True)}, books


def ints(v):
    return [math.floor(256 * x) for x in v]


def test_codes_are_plain_lloyd(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, ints(r.embedding)) for r in df.collect()]
    want, books = plain_lloyd(rows, 16, 64, 2)
    found = op.train(df)
    assert {r.id: (r.code, r.error) for r in found.rows.collect()} == want
    assert found.books.tolist() == books
    assert found.digest() == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    n = len(rows) * 16 * 64
    assert found.computed[0] == n and all(c < 0.6 * n for c in found.computed[1:])  # most distances are pruned
    one = found.rows.first()
    v = dict(rows)[one.id]
    assert sum((a - b) ** 2 for a, b in zip(v, found.decode(one.code), strict=True)) == one.error


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=4, max_size=4), min_size=1, max_size=40), st.integers(1, 9), st.integers(1, 4))
def test_bounds_never_lose_a_tie(vectors, entries, rounds):
    """Small integers tie all the time; bounds go through their stored form between rounds."""
    want, books = plain_lloyd(list(enumerate(vectors)), 2, entries, rounds)
    parts = np.array(vectors, np.int64).reshape(-1, 2, 2)
    book = parts[:entries].transpose(1, 0, 2).copy()
    state, best = op.first_bounds(parts, book)
    for i in range(rounds):
        new = book.copy()
        for p in range(2):
            for e in range(book.shape[1]):
                held = parts[state.assigned[:, p] == e, p]
                if len(held):
                    new[p, e] = held.sum(0) // len(held)
        moved = np.sqrt(((new - book) ** 2).sum(2).astype(float)) * (1 + 1e-9)
        book = new
        a, u, low, step = op.pack(state)
        shape = (len(vectors), *book.shape[:2])
        assert (low.reshape(shape) * step[:, None, None].astype(float) * (1 - 1e-6) <= state.lower + 1e-12).all() and (u >= state.upper).all()
        state = op.Bounds(a.astype(np.int64), u.astype(float), low.reshape(shape) * step[:, None, None].astype(float) * (1 - 1e-6))
        state, best, _ = op.next_bounds(parts, book, moved, state, i == rounds - 1)
    got = {i: ("".join(f"{e:02x}" for e in c), int(b.sum())) for i, (c, b) in enumerate(zip(state.assigned.tolist(), best, strict=True))}
    assert got == want and book.tolist() == books


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float((i * k) % 7) / 9 for k in range(1, 9)], i % 2) for i in range(30)]
    rows = good + [(3, good[3][1], 1), (None, good[4][1], None), (None, [0.5] * 8, None)]
    bad = [(100, None, 1), (101, [nan] * 8, 1), (102, [inf] + [0.0] * 7, 1), (103, [None] + [0.0] * 7, 1), (104, [], 1), (105, [1.0] * 7, 1), (106, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows + bad, KIND).withColumn("code", F.lit("clash"))
    got = op.compress(df, parts=4, entries=5).collect()
    assert sorted(r.vec_id if r.vec_id is not None else -1 for r in got) == sorted(r[0] if r[0] is not None else -1 for r in rows)
    assert len({r.code for r in got if r.vec_id == 3}) == 1 and len([r for r in got if r.vec_id == 3]) == 2
    want, books = plain_lloyd([(i if i is not None else 1000 + j, ints(np.float32(v).tolist())) for j, (i, v, _) in enumerate(rows)], 4, 5, 2)
    assert all((r.code, r.error) == want[r.vec_id] for r in got if r.vec_id is not None)
    by = defaultdict(int)
    for j, (i, _, label) in enumerate(rows):
        by[label] += want[i if i is not None else 1000 + j][1]
    assert all(r.label_error == by[r.vec_id % 2] for r in got if r.vec_id is not None)
    assert {r.label_error for r in got if r.vec_id is None} == {by[None]}
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}
    few = op.compress(df.where("vec_id < 3"), parts=4, entries=64).collect()
    assert len(few) == 3 and {r.error for r in few} == {0}
    assert op.compress(df.where("false")).collect() == []
    assert op.compress(spark.createDataFrame(bad, KIND).where("vec_id < 105")).collect() == []
    huge = spark.createDataFrame([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)], KIND)
    assert [r.error for r in op.compress(huge, parts=4, entries=3).collect()] == [0, 0, 0]


def test_state_goes_with_the_rounds(spark, sf):
    from foliant.scale import made

    before = made()
    op.train(spark.read.parquet(f"{sf}/embeddings.parquet"), rounds=3)
    assert len(made()) == len(before) + 1  # only the last assignment is left
