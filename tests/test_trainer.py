"""The mini-batch trainer against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalis.operators import trainer


def made(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 4))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(int)
    return [(i, int(y[i]), "valid" if i % 4 == 0 else "test" if i % 4 == 1 else "train", x[i].tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    odd = [(1000, None, "train", [1.0] * 4), (1001, 1, "train", []), (1002, 1, "train", None)]
    return spark.createDataFrame(made() + odd, "id long, label int, split string, mean array<double>").repartition(5)


def test_gradient():
    rng = np.random.default_rng(2)
    x, y, p = rng.normal(0, 1, (7, 3)), rng.integers(0, 2, 7).astype(float), rng.normal(0, 1, trainer.n_params(3, 5))
    loss, g = trainer.loss_and_gradient(p, x, y, 5)
    for i in range(len(p)):
        d = np.zeros_like(p)
        d[i] = 1e-6
        ahead, behind = (trainer.loss_and_gradient(p + s * d, x, y, 5)[0] for s in (1, -1))
        assert g[i] == pytest.approx((ahead - behind) / 2e-6, abs=1e-6)
    z = trainer.margins(p, x, 5)
    assert loss == pytest.approx(float(np.mean(np.log(1 + np.exp(-z * (2 * y - 1))))))


def test_optimizer_steps():
    p, g, s = np.array([1.0, -2.0]), np.array([0.5, 0.25]), np.zeros((2, 2))
    trainer.step("Adam", 0.1, 0.0, p, g, s, 1)
    assert p == pytest.approx([0.9, -2.1], abs=1e-6)  # the first step is the rate, whatever the gradient
    p, s = np.array([1.0, -2.0]), np.zeros((2, 2))
    trainer.step("Adagrad", 0.1, 0.5, p, g, s, 1)
    assert p == pytest.approx([0.9, -1.9]) and s[1] == pytest.approx([1.0, 0.5625])  # decay joins the gradient
    trainer.step("Adagrad", 0.1, 0.0, p, np.array([1.0, 0.0]), s, 2)
    assert p == pytest.approx([0.9 - 0.1 / 2**0.5, -1.9])
    for bad in ({"optimizer": "SGD"}, {"rate": 0.0}, {"decay": -1.0}, {"epochs": 0}):
        with pytest.raises(ValueError):
            trainer.Setting(**bad)


def test_epochs_equal_a_loop(rows):
    """Parts, batches, averages and the table, recomputed from the dealt rows."""
    setting = trainer.Setting("Adam", 0.05, 0.01, 3)
    networks, table = trainer.train_networks(rows, [setting], ["id"], parts=3, hidden=5, batch=16)
    data = trainer.dealt(rows, ["id"], "mean", 3).collect()
    assert len(data) == 300
    p, state, t, seen = trainer.initial(4, 5), np.zeros((2, trainer.n_params(4, 5))), 0, []
    for epoch in range(4):
        valid = [r for r in data if r["valid"]]
        x, y = np.array([r["vector"] for r in valid]), np.array([r["label"] for r in valid])
        z = trainer.margins(p, x, 5)
        seen.append((epoch, len(valid), np.mean(np.logaddexp(0, z) - y * z), np.mean((z > 0) == (y == 1))))
        if epoch == 3:
            break
        sums, weight, most = np.zeros((3, len(p))), 0, 0
        for part in range(3):
            own = [r for r in data if r["part"] == part]
            x, y = np.array([r["vector"] for r in own]), np.array([r["label"] for r in own])
            order = np.random.default_rng([epoch, part]).permutation(np.flatnonzero([not r["valid"] for r in own]))
            q, s, k = p.copy(), state.copy(), t
            for at in range(0, len(order), 16):
                k += 1
                some = order[at : at + 16]
                trainer.step("Adam", 0.05, 0.01, q, trainer.loss_and_gradient(q, x[some], y[some], 5)[1], s, k)
            sums, weight, most = sums + len(order) * np.vstack([q, s]), weight + len(order), max(most, k)
        p, state, t = sums[0] / weight, sums[1:] / weight, most
    assert networks[setting].params == pytest.approx(p, abs=1e-9)
    got = [(r["epoch"], r["valid_rows"], r["valid_loss"], r["valid_accuracy"]) for r in table.orderBy("epoch").collect()]
    assert got == [pytest.approx(r, abs=1e-9) for r in seen]


def test_sweep(rows):
    grid = {"optimizer": ["Adam", "Adagrad"], "rate": [0.1, 0.001], "decay": [0.0, 0.01], "epochs": [2, 8]}
    network, table, epochs = trainer.sweep_networks(rows, grid, ["id"], parts=2)
    assert table.count() == 16 and epochs.count() == 8 * 9
    best = table.agg(F.max("valid_accuracy")).first()[0]
    assert best > 0.8
    scored = trainer.score_network(network, rows, "id", "split", "label")
    assert scored.count() == 403 and scored.columns == ["id", "split", "label", "prediction_raw", "prediction_class"]
    hit = scored.where("split = 'valid'").agg(F.avg((F.col("label") == F.col("prediction_class")).cast("int"))).first()[0]
    assert hit == pytest.approx(best)
    # A setting alone and among others is the same, however the rows arrive.
    alone = trainer.Setting("Adam", 0.1, 0.0, 2)
    one = trainer.train_networks(rows.repartition(7), [alone], ["id"], parts=2)[0][alone]
    both = trainer.train_networks(rows, [trainer.Setting("Adagrad", 0.1, 0.0, 3), alone], ["id"], parts=2)[0][alone]
    assert one.params == pytest.approx(both.params, abs=1e-9)


def test_without_rows(rows):
    setting = trainer.Setting(epochs=1)
    networks, table = trainer.train_networks(rows.limit(0), [setting], ["id"])
    assert table.count() == 0 and networks[setting].inputs == 0
    assert {r["prediction_class"] for r in trainer.score_network(networks[setting], rows.limit(0), "id").collect()} == set()
    networks, table = trainer.train_networks(rows.where("split <> 'train'"), [setting], ["id"])
    assert networks[setting].params == pytest.approx(trainer.initial(4)) and table.count() == 2
