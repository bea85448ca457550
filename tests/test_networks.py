"""Networks against finite differences, and their training: partitions, causality, early stopping, committed epochs."""

import numpy as np
import pytest

from tidemark.operators import networks as N
from tidemark.operators import training as T

SMALL = {"rnn": N.rnn(3, 4), "lstm": N.lstm(3, 4), "gru": N.gru(3, 4), "wide_gru": N.wide_gru(3, 4, head=5), "tcn": N.tcn(3, 4)}


@pytest.mark.parametrize("name", SMALL)
def test_gradients_equal_finite_differences(name):
    net, rng = SMALL[name], np.random.default_rng(1)
    w, x, y = net.start(3) + 0.1 * rng.normal(size=net.size), rng.normal(size=(5, 20, 3)), rng.normal(size=5)
    loss, gradient = net.gradient(w, x, y)
    assert loss == pytest.approx(((net.predict(w, x) - y) ** 2).sum())
    for i in range(net.size):
        step = np.zeros(net.size)
        step[i] = 1e-5
        slope = (net.gradient(w + step, x, y)[0] - net.gradient(w - step, x, y)[0]) / 2e-5
        assert gradient[i] == pytest.approx(slope, abs=1e-5, rel=1e-5), net.names


def test_no_day_sees_a_later_one():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2, 40, 4))
    changed = x.copy()
    changed[:, 25] += 1
    blocks = N.Chain(*[N.Chain(N.CausalConv(4, 3, d), N.LayerNorm(4), N.Gelu(), residual=True) for d in (1, 2, 4, 8)])
    for layer in (blocks, N.Gru(4, 4), N.Lstm(4, 4)):
        p = layer.start(rng)
        a, b = layer.forward(p, x)[0], layer.forward(p, changed)[0]
        assert (a[:, :25] == b[:, :25]).all() and (a[:, 25] != b[:, 25]).any()
    reach = np.flatnonzero((blocks.forward(blocks.start(rng), x)[0] != blocks.forward(blocks.start(rng), changed)[0]).any(axis=(0, 2)))
    assert len(reach), "later days do see it"


def rows(spark, n=120, days=6, seed=0, snapshot="a"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, days, 2)).astype(np.float32)
    y = x[:, -3:, 0].sum(axis=1) - x[:, :, 1].mean(axis=1)
    return spark.createDataFrame([(i, x[i].tolist(), float(y[i]), snapshot) for i in range(n)], "user_id long, tensor array<array<float>>, target double, snapshot_name string")


def test_each_user_is_dealt_once_into_even_batches(spark):
    users = spark.range(1003).withColumnRenamed("id", "user_id")
    one, other, later = (T.dealt(u, size=100, epoch=e, seed=5) for u, e in ((users.repartition(2), 1), (users.repartition(7), 1), (users, 2)))
    a, b, c = ({r.user_id: (r.place, r.batch) for r in d.collect()} for d in (one, other, later))
    assert a == b and a != c and sorted(p for p, _ in a.values()) == list(range(1003))
    sizes = np.bincount([batch for _, batch in a.values()])
    assert len(sizes) == 11 and sizes.max() - sizes.min() <= 1
    assert T.dealt(users.limit(0), size=10).count() == 0


def test_weights_do_not_depend_on_partitions_and_the_loss_falls(spark):
    net = N.gru(2, 6, layers=1)
    o = {"epochs": 4, "batch": 20, "rate": 0.05, "unit": 16, "seed": 1}
    one, other = (T.fit(net, rows(spark).repartition(p), **o) for p in (1, 5))
    assert (one.weights == other.weights).all() and one.train_loss == other.train_loss
    target = np.array([r.target for r in rows(spark).select("target").collect()])
    after = T.predict(net, one.best, rows(spark)).toPandas()
    assert ((after["prediction"] - after["target"]) ** 2).mean() < target.var()


def test_sums_go_up_a_tree(spark):
    net, w = N.rnn(2, 3), N.rnn(2, 3).start(1)
    data = rows(spark)
    units = T.packed(data, T.dealt(data, 1), unit=2)
    wide, narrow = T.summed(units.repartition(40), net, w), T.summed(units.coalesce(1), net, w)
    assert wide[:2] == narrow[:2] and (wide[2] == narrow[2]).all() and wide[0] == 120
    got = np.array([(r.tensor, r.target) for r in data.collect()], dtype=object)
    loss, gradient = net.gradient(w, np.array(got[:, 0].tolist()), got[:, 1].astype(float))
    assert wide[1] == pytest.approx(loss / 120) and wide[2] == pytest.approx(gradient / 120, abs=1e-6)


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    net = N.tcn(2, 4, dilations=(1, 2))
    o = {"train": rows(spark), "valid": rows(spark, 40, seed=9), "batch": 60, "rate": 0.01, "epochs": 3, "patience": 5}
    whole = T.fit(net, **o, store=T.Epochs(spark, f"file://{tmp_path}/whole"))
    store = T.Epochs(spark, f"file://{tmp_path}/stopped")
    T.fit(net, **o, store=store, stop=lambda s: s.epoch == 1)
    (tmp_path / "stopped" / "new-left-by-a-killed-run").mkdir()
    assert store.numbers() == [1]
    again = T.fit(net, **o, store=store)
    assert store.numbers() == [1, 2, 3] and (again.weights == whole.weights).all() and (again.best == whole.best).all()
    losses = store.losses().orderBy("epoch").collect()
    assert min(losses, key=lambda r: r.valid_loss).epoch == again.best_epoch and again.best_loss == min(r.valid_loss for r in losses)
    with pytest.raises(ValueError, match="committed already"):
        store.commit(again)


def test_training_ends_without_a_better_epoch(spark):
    net = N.rnn(2, 3)
    state = T.fit(net, rows(spark, 30), rows(spark, 20, seed=3), epochs=6, batch=30, rate=0.0, patience=2)
    assert (state.epoch, state.best_epoch) == (3, 1)


def test_out_of_fold_predictions_see_earlier_snapshots_alone(spark):
    both = rows(spark, 40).unionByName(rows(spark, 40, seed=4, snapshot="b"))
    net, o = N.rnn(2, 3), {"epochs": 1, "batch": 50}
    found = {r.user_id: r.residual_prediction for r in T.out_of_fold(net, both, ["a", "b"], **o).collect()}
    spoiled = both.selectExpr("user_id", "tensor", "if(snapshot_name = 'b', 1e6, target) as target", "snapshot_name")
    assert len(found) == 40 and found == {r.user_id: r.residual_prediction for r in T.out_of_fold(net, spoiled, ["a", "b"], **o).collect()}


def test_a_network_goes_through_its_rows_in_strips():
    """No array has more rows than a strip, and the sums are those over all rows."""
    net, rng = N.tcn(3, 4), np.random.default_rng(6)
    w, x, y = net.start(3), rng.normal(size=(3 * N.STRIP + 5, 20, 3)), rng.normal(size=3 * N.STRIP + 5)
    out, held = net.chain.forward(net.named(w), x)
    grads = net.chain.backward(net.named(w), held, 2 * (out[:, 0] - y)[:, None])[1]
    seen, forward = [], net.chain.forward
    net.chain.forward = lambda p, rows: seen.append(len(rows)) or forward(p, rows)
    loss, gradient = net.gradient(w, x, y)
    assert net.predict(w, x) == pytest.approx(out[:, 0])
    assert max(seen) <= N.STRIP and sum(seen) == 2 * len(x)
    assert loss == pytest.approx(((out[:, 0] - y) ** 2).sum())
    assert gradient == pytest.approx(np.concatenate([grads[n].ravel() for n in net.names]))
    assert net.predict(w, x[:0]).shape == (0,)


def test_the_units_of_a_small_batch_are_shared_by_the_cores(spark):
    """A step over a table that Spark would put into one partition has several tasks."""
    data = rows(spark, 128)
    units = T.settle(T.packed(data, T.dealt(data, 2), unit=4), "units", "batch")
    assert units.count() == 32
    for b in range(2):
        step = units.where(units["batch"] == b)
        assert step.select("_metadata.file_path").distinct().count() >= 3
        assert step.rdd.getNumPartitions() >= 3
