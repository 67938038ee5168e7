"""Arrays against specification values, numpy, and gradients against finite differences."""

import math

import numpy as np
import pytest

from gridloom.operators.lifecycle import Frame, no_grad
from gridloom.operators.tensor import Tensor, cat, shuffle, stack

A = np.arange(6.0).reshape(2, 3)


def same(t, want):
    want = np.asarray(want, dtype=float)
    assert t.shape == want.shape
    assert np.allclose(t.numpy(), want, equal_nan=True)


def test_creation(spark):
    same(Tensor.zeros(spark, (2, 3)), np.zeros((2, 3)))
    same(Tensor.ones(spark, (4,)), np.ones(4))
    same(Tensor.fill(spark, (2, 2), 7), np.full((2, 2), 7))
    same(Tensor.scalar(spark, 42), 42)
    same(Tensor.of(spark, A), A)
    r = Tensor.rand(spark, (50, 2), 1).numpy()
    assert (0 <= r).all() and (r < 1).all() and np.array_equal(r, Tensor.rand(spark, (50, 2), 1).numpy())
    u = Tensor.uniform(spark, (100,), -2, 3, 5).numpy()
    assert (-2 <= u).all() and (u < 3).all()
    assert abs(Tensor.normal(spark, (2000,), 5, 2, 3).numpy().mean() - 5) < 0.3 and abs(Tensor.randn(spark, (2000,), 3).numpy().std() - 1) < 0.1
    t = Tensor.of(spark, np.zeros((2, 3, 4)))
    assert (t.ndim, t.numel, t.stride) == (3, 24, (12, 4, 1))
    with pytest.raises(ValueError):
        Tensor.zeros(spark, (2, 0))


def test_movement(spark):
    x, a = Tensor.of(spark, np.arange(6.0)), Tensor.of(spark, A)
    same(x.slice(0, 1, 4), [1, 2, 3])
    same(x.slice(0, step=-1), [5, 4, 3, 2, 1, 0])
    same(x.slice(0, -4, -2), [2, 3])
    same(a.select(0, -1), A[1])
    same(a.reshape(3, -1), A.reshape(3, 2))
    same(a.flatten(), A.reshape(-1))
    same(a.transpose(0, 1), A.T)
    same(a.unsqueeze(1).squeeze(), A)
    same(Tensor.of(spark, [[1, 2, 3]]).expand(2, 3), [[1, 2, 3]] * 2)
    same(cat([a, Tensor.of(spark, A[:, :1])], 1), np.concatenate([A, A[:, :1]], 1))
    same(stack([x, x]), [np.arange(6)] * 2)
    rows = Tensor.of(spark, [[i, i] for i in range(5)])
    y, z = shuffle([rows, Tensor.of(spark, range(5))], 0, 9)
    y, z = y.numpy(), z.numpy()
    assert (y[:, 0] == z).all() and (y[:, 1] == z).all() and sorted(z) == list(range(5))
    for bad in (lambda: x.slice(0, 4, 2), lambda: a.reshape(4, 2), lambda: a.permute(0, 0), lambda: a.squeeze(0), lambda: a.expand(3, 3), lambda: cat([a, x], 0)):
        with pytest.raises(ValueError):
            bad()


def test_elementwise(spark):
    of = lambda *v: Tensor.of(spark, v)
    inf, nan = math.inf, math.nan
    same(of(-1, 0, 2).neg(), [1, 0, -2])
    same(of(-5, 0, 3, nan).sign(), [-1, 0, 1, 0])
    same(of(-2, 3).square(), [4, 9])
    same(of(0, 1, 4, -1).sqrt(), [0, 1, 2, nan])
    same(of(1, 4, 0).rsqrt(), [1, 0.5, inf])
    same(of(1, math.e, 0, -1).log(), [0, 1, -inf, nan])
    same(of(-1, 0, 2, nan).relu(), [0, 0, 2, 0])
    same(of(0, 1e6).sigmoid(), [0.5, 1])
    same(of(0, 1e6).tanh(), [0, 1])
    same(of(-2, 0, 3).abs(), [2, 0, 3])
    same(of(1, 2, 3).div(of(4, 5, 0)), [0.25, 0.4, inf])
    same(of(0, -1).div(0.0), [nan, -inf])
    same(of(2, 3, 4).pow(2.0), [4, 9, 16])
    same(of(1, 2, 3).add(of(10)), [11, 12, 13])
    same(Tensor.of(spark, A).add(of(10, 20, 30)), A + [10, 20, 30])
    same(Tensor.of(spark, A[:, :1]).mul(of(1, 2, 3)), A[:, :1] * [1, 2, 3])
    same(of(1, 0, nan).where(of(10, 20, 30), of(40, 50, 60)), [10, 50, 30])
    same(of(-2, 0, 3, nan).clamp(-1.0, 2.0), [-1, 0, 2, 2])
    with pytest.raises(ValueError):
        of(1, 2).add(of(1, 2, 3))


def test_reduce(spark):
    x = np.array([[3.0, 1, 4], [1, 5, 9]])
    t = Tensor.of(spark, x)
    for f, g in (("min", np.min), ("max", np.max), ("sum", np.sum), ("mean", np.mean), ("var", np.var), ("std", np.std), ("norm", lambda a, axis=None: np.sqrt((a * a).sum(axis)))):
        same(getattr(t, f)(), g(x))
        same(getattr(t, f)(1), g(x, axis=1))
        same(getattr(t, f)(0, keepdim=True), g(x, axis=0)[None, :])
    same(Tensor.of(spark, [math.nan, 1, 2]).max(), 2)
    assert [r.idx for r in t.argmax(1).orderBy("i0").collect()] == [2, 2] and [r.idx for r in t.argmin(0).orderBy("i0").collect()] == [1, 0, 0]
    assert t.argmin().first().idx == 1 and t.argmax().first().idx == 5
    assert np.allclose(t.softmax(1).numpy().sum(1), 1)


def test_products_and_losses(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 3, 4)), rng.normal(size=(4, 5))
    same(Tensor.of(spark, a).matmul(Tensor.of(spark, b)), a @ b)
    same(Tensor.of(spark, [[1, 2, 3], [4, 5, 6]]).matmul(Tensor.of(spark, [[7, 8], [9, 10], [11, 12]])), [[58, 64], [139, 154]])
    src, ker = np.arange(1.0, 10).reshape(1, 1, 3, 3), np.array([[[[1.0, 0], [0, 1]]]])
    s, k = Tensor.of(spark, src), Tensor.of(spark, ker)
    same(s.conv2d(k), [[[[6, 8], [12, 14]]]])
    same(s.conv2d(k, Tensor.of(spark, [1.0])), [[[[7, 9], [13, 15]]]])
    same(s.conv2d(k, stride=2), [[[[6]]]])
    assert s.conv2d(k, padding=3).numpy()[0, 0, 0, 0] == 0 and s.conv2d(k, padding=1).shape == (1, 1, 4, 4)
    same(Tensor.of(spark, [1, 2, 3, 4]).mse(Tensor.ones(spark, (4,))), 3.5)
    same(Tensor.zeros(spark, (1, 3)).cross_entropy(Tensor.of(spark, [0.0])), math.log(3))
    same(Tensor.of(spark, [[2, 0], [0, 2]]).cross_entropy(Tensor.of(spark, [0, 1])), math.log(1 + math.exp(-2)))
    with pytest.raises(ValueError):
        Tensor.zeros(spark, (1, 3)).cross_entropy(Tensor.of(spark, [3.0]))


GRADS = {
    "unary": lambda x: x.abs().sqrt().add(x.exp()).add(x.tanh()).add(x.sigmoid()).add(x.relu()).sum(),
    "rational": lambda x: x.square().add(1.0).rsqrt().add(x.abs().add(1.0).log()).div(x.square().add(2.0)).mean(),
    "move": lambda x: cat([x.transpose(0, 1).reshape(2, 3), x.slice(1, None, None, -1)], 0).mul(x.select(0, 1)).sum(),
    "reduce": lambda x: x.var(1).add(x.max(1)).mul(x.mean(1)).sub(x.min(0).norm()).sum(),
    "power": lambda x: x.abs().add(0.5).pow(x.mul(0.3)).clamp(0.2, 1.4).sum(),
    "where": lambda x: x.relu().where(x.mul(x), x.neg()).expand(2, 2, 3).sum(),
    "matmul": lambda x: x.matmul(x.transpose(0, 1)).square().mean(),
}


@pytest.mark.parametrize("name", GRADS)
def test_gradients(spark, name):
    x0 = np.array([[0.7, -0.4, 1.3], [-1.1, 0.9, 0.35]])
    x = Tensor.of(spark, x0).requires_grad()
    GRADS[name](x).backward()
    got = x.grad.numpy()
    # finite differences, all perturbed copies in one job each way would need batching; a few elements are enough
    for at in ((0, 1), (1, 2)):
        d = np.zeros_like(x0)
        d[at] = 1e-5
        up, down = (GRADS[name](Tensor.of(spark, x0 + s * d)).item() for s in (1, -1))
        assert got[at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-6)


def test_gradient_rules(spark):
    x = Tensor.of(spark, [1.0, 2.0, 2.0]).requires_grad()
    x.max().backward()
    same(x.grad, [0, 0.5, 0.5])
    x.max().backward()
    same(x.grad, [0, 1, 1])
    x.zero_grad()
    assert x.grad is None
    with no_grad():
        assert not x.add(x).needs_grad
    assert not x.detach().needs_grad and not x.sign().needs_grad
    s = Tensor.of(spark, np.arange(9.0).reshape(1, 1, 3, 3)).requires_grad()
    k = Tensor.of(spark, np.ones((1, 1, 2, 2))).requires_grad()
    b = Tensor.of(spark, [0.0]).requires_grad()
    s.conv2d(k, b).sum().backward()
    same(s.grad, [[[[1, 2, 1], [2, 4, 2], [1, 2, 1]]]])
    same(k.grad, [[[[8, 12], [20, 24]]]])
    same(b.grad, [4])


def test_frames(spark):
    seen = []
    with Frame() as f:
        df = f.cache(spark.range(5))
        mark = f.mark()
        f.push(seen.append, "a")
        f.rollback(mark)
        f.push(seen.append, "b")
        f.push(seen.append, "c")
        f.cancel("c")
        f.cancel("never")
        assert df.is_cached
    assert seen == ["a", "b"] and not df.is_cached


def test_products_over_all_rows(spark, tmp_path):
    from gridloom.plans import queries as core

    x = np.random.default_rng(11).normal(size=(130, 64))
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    gram = {(r.i0, r.i1): r.v for r in core.queries()["matmul_gram_whole"](spark, str(tmp_path)).collect()}
    assert len(gram) == 64 * 64 and all(abs(v - x[:, i] @ x[:, j]) < 1e-5 for (i, j), v in gram.items())
    grad = {(r.i0, r.i1): r.v for r in core.queries()["grad_matmul_whole"](spark, str(tmp_path)).collect()}
    assert len(grad) == 130 * 64 and all(abs(v - 2 * x[i].sum()) < 1e-5 for (i, _), v in grad.items())


def test_gradients_of_element_wise_functions_need_no_join(spark):
    x0 = np.random.default_rng(5).normal(size=(40, 64))
    x = Tensor.of(spark, x0).requires_grad()
    for part in (x.exp(), x.tanh(), x.relu(), x.abs(), x.sigmoid(), x.square().mul(3.0)):
        part.sum().backward()
    plan = x.grad.df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Aggregate" not in plan
    s = 1 / (1 + np.exp(-x0))
    same(x.grad, np.exp(x0) + 1 - np.tanh(x0) ** 2 + (x0 > 0) + np.sign(x0) + s * (1 - s) + 6 * x0)


def test_no_large_side_is_broadcast(spark, monkeypatch):
    """The planner takes a repeated row for a small table; sizes go by the shapes."""
    from gridloom.operators import tensor

    monkeypatch.setattr(tensor, "BROADCAST_ELEMENTS", 100)
    x, row = Tensor.of(spark, np.arange(640.0).reshape(10, 64)), Tensor.of(spark, np.ones((1, 64)))
    a, b = Tensor.rand(spark, (10, 64), 1), Tensor.rand(spark, (10, 64), 2)
    assert "Broadcast" not in a.add(b).df._jdf.queryExecution().executedPlan().toString()
    same(a.add(b), a.numpy() + b.numpy())
    same(row.expand(10, 64).mul(2.0), np.full((10, 64), 2.0))
    same(row.expand(10, 64).transpose(0, 1).add(row.transpose(0, 1)), np.full((64, 10), 2.0))
    same(x.mul(row.expand(10, 64)), x.numpy())


def test_products_with_repeated_factors_are_sums(spark):
    """A factor that repeats along an axis is never spread; gradients go to the elements that the leaf has."""
    x0 = np.random.default_rng(7).normal(size=(30, 6))
    x = Tensor.of(spark, x0).requires_grad()
    x.matmul(x.transpose(0, 1)).sum().backward()
    assert "FlatMap" not in (plan := x.grad.df._jdf.queryExecution().executedPlan().toString()) and "MapInArrow" not in plan and "CartesianProduct" not in plan
    same(x.grad, np.tile(2 * x0.sum(0), (30, 1)))
    row, column, a = np.arange(1.0, 7)[None, :], np.arange(1.0, 31)[:, None], Tensor.of(spark, x0)
    wide, tall = Tensor.of(spark, row).expand(30, 6), Tensor.of(spark, column).expand(30, 6)
    for t, want in ((wide, np.tile(row, (30, 1))), (tall, np.tile(column, (1, 6)))):
        same(t.transpose(0, 1).matmul(a), want.T @ x0)
        same(a.transpose(0, 1).matmul(t), x0.T @ want)
        same(t.matmul(a.transpose(0, 1)), want @ x0.T)
        same(t.transpose(0, 1).matmul(t), want.T @ want)
    same(Tensor.of(spark, row).expand(4, 30, 6).matmul(Tensor.of(spark, x0.T)), np.tile(row @ x0.T, (4, 30, 1)))
    sparse = Tensor(Tensor.of(spark, x0).df.where("i0 != 3"), (30, 6)).requires_grad()
    sparse.matmul(sparse.transpose(0, 1)).sum().backward()
    assert sparse.grad.df.count() == 29 * 6


def test_binary_functions_on_odd_numbers(spark, tmp_path):
    from gridloom.plans import queries as core

    inf, nan = math.inf, math.nan
    rows = [(0.0, 0.0), (-2.0, 0.0), (nan, 0.0), (None, 0.0), (1.0, nan), (-1.0, inf), (1.0, -inf), (1.0, None), (4.0, 0.5)]
    spark.createDataFrame([(k, 1, *r) for k, r in enumerate(rows)], "l_orderkey long, l_linenumber int, l_quantity double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.l_orderkey: r for r in core.queries()["elementwise_binary"](spark, str(tmp_path)).collect()}
    assert [got[k].div for k in range(4)] == [inf] * 4 and got[8].div == 8
    assert [got[k].pow for k in (0, 1, 2, 4, 5, 6, 8)] == [1, 1, 1, 1, 1, 1, 2] and got[7].pow is None and got[3].pow is None


def test_powers_of_large_numbers_have_the_bits_of_their_sql(spark, tmp_path):
    import duckdb

    from gridloom.plans import queries as core

    inf, nan = math.inf, math.nan
    some = np.random.default_rng(5)
    rows = [(40371.48882376883, 1.3826206220303918), (40337.14030176712, 3.7430162325009073), (-0.0, 3.0), (-0.0, 1.0), (0.0, -1.0), (-0.0, -3.0), (-2.0, 0.5), (-1e300, 3.0), (nan, 0.0), (nan, 1.0), (1.0, nan), (-1.0, inf), (inf, -1.0), (None, 0.0), (1.0, None), (0.5, 1.0), (2.5e-9, 1.0), (-1.5e-9, 1.0)]
    rows += zip(some.uniform(1, 50000, 2000).tolist(), some.uniform(0, 8, 2000).tolist())
    spark.createDataFrame([(k, 1, *r) for k, r in enumerate(rows)], "l_orderkey long, l_linenumber int, l_quantity double, l_tax double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = core.queries()["elementwise_binary"](spark, str(tmp_path)).orderBy("l_orderkey").collect()
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sql.sql(core.oracle_sql()["elementwise_binary"] + " ORDER BY l_orderkey").fetchall()
    assert [tuple(map(repr, r)) for r in got] == [tuple(map(repr, r)) for r in want]


def test_products_of_large_matrices_are_dealt(spark, monkeypatch):
    from gridloom.operators import tensor

    monkeypatch.setattr(tensor, "BROADCAST_ELEMENTS", 100)
    x0 = np.random.default_rng(3).normal(size=(200, 5))
    x = Tensor.of(spark, x0)
    t = x.matmul(x.transpose(0, 1))
    assert "SortMergeJoin [linner" in (plan := t.df._jdf.queryExecution().executedPlan().toString()) and ", la#" in plan
    same(t, x0 @ x0.T)


def test_blocks_of_matrices_are_dealt_as_bytes(spark, monkeypatch):
    """4 bytes an element that single precision holds, else 8, none beyond the matrix; products over several inner blocks stay right."""
    from gridloom.operators import tensor

    x0 = np.random.default_rng(4).normal(size=(70, 67))
    short = x0.astype(np.float32).astype(float)
    for x, size in ((x0, 8), (short, 4)):
        blocks = {(r.louter, r.linner): len(r.le) for r in tensor._blocks(Tensor.of(spark, x), 0, "l", False).collect()}
        assert blocks == {(i, j): size * a * b for i, a in enumerate((64, 6)) for j, b in enumerate((64, 3))}
    monkeypatch.setattr(tensor, "BROADCAST_ELEMENTS", 100)
    same(Tensor.of(spark, x0).matmul(Tensor.of(spark, short.T)), x0 @ short.T)
