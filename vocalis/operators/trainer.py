"""Mini-batch training of a small network on text vectors, and the sweep over its settings.

The network is one hidden tanh layer and a sigmoid on the mean vector of a text.  Rows are dealt once
over parts by the hash of their ids and stored, so a part is the same set in the
same order in every epoch and on every retry.  An epoch is one job: every part runs mini-batches
over its rows from the parameters it is given, for all settings at once, and the parameters and
the optimizer's state are averaged over the parts by their rows.  Only these averages, whose number is
that of the parameters, reach the driver.  The same pass scores the validation rows with the
parameters it started from, which gives the table of epochs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.functions.rows import threshold
from vocalis.operators.models import settings as all_settings
from vocalis.session import materialize

PARTS, PART_ROWS, BATCH, HIDDEN, SEED = 8, 100_000, 64, 16, 1234
# --- fixed values: constants of the optimizers --------------------------------------------
ADAM = {"beta1": 0.9, "beta2": 0.999, "eps": 1e-8}
ADAGRAD_EPS = 1e-10
# ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Setting:
    """One way to train; ``epochs`` only tells when to stop, so settings that differ in nothing
    else share a run."""

    optimizer: str = "Adam"
    rate: float = 0.01
    decay: float = 0.0
    epochs: int = 5

    def __post_init__(self):
        if self.optimizer not in ("Adam", "Adagrad"):
            raise ValueError(f"unknown optimizer {self.optimizer!r}; known: Adam, Adagrad")
        if self.rate <= 0 or self.decay < 0 or self.epochs < 1:
            raise ValueError("a positive rate, no negative decay and at least one epoch are needed")

    @property
    def run(self) -> tuple[str, float, float]:
        return self.optimizer, self.rate, self.decay

    @property
    def name(self) -> str:
        return f"optimizer={self.optimizer}, rate={self.rate}, decay={self.decay}, epochs={self.epochs}"


@dataclass(frozen=True)
class Network:
    """Flat parameters: hidden weights, hidden bias, output weights, output bias."""

    params: np.ndarray
    inputs: int
    hidden: int = HIDDEN


def n_params(inputs: int, hidden: int) -> int:
    return inputs * hidden + 2 * hidden + 1


def _parts(p: np.ndarray, inputs: int, hidden: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    a = inputs * hidden
    return p[:a].reshape(inputs, hidden), p[a : a + hidden], p[a + hidden : a + 2 * hidden], p[-1]


def initial(inputs: int, hidden: int = HIDDEN, seed: int = SEED) -> np.ndarray:
    rng, p = np.random.default_rng(seed), np.zeros(n_params(inputs, hidden))
    p[: inputs * hidden] = rng.uniform(-1, 1, inputs * hidden) / np.sqrt(max(inputs, 1))
    p[inputs * hidden + hidden : -1] = rng.uniform(-1, 1, hidden) / np.sqrt(hidden)
    return p


def margins(p: np.ndarray, x: np.ndarray, hidden: int = HIDDEN) -> np.ndarray:
    w, b, v, c = _parts(p, x.shape[1], hidden)
    return np.tanh(x @ w + b) @ v + c


def loss_and_gradient(p: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN) -> tuple[float, np.ndarray]:
    """Mean logistic loss of a batch and its gradient."""
    w, b, v, c = _parts(p, x.shape[1], hidden)
    h = np.tanh(x @ w + b)
    z = h @ v + c
    error = (0.5 * (1 + np.tanh(z / 2)) - y) / len(y)
    back = np.outer(error, v) * (1 - h * h)
    gradient = np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), h.T @ error, [error.sum()]])
    return float(np.mean(np.logaddexp(0, z) - y * z)), gradient


def step(optimizer: str, rate: float, decay: float, p: np.ndarray, g: np.ndarray, state: np.ndarray, t: int) -> None:
    """One update in place.  ``state`` (2, n): first and second moments; Adagrad uses the second
    as its sum of squares.  ``decay`` adds the parameters to the gradient."""
    g = g + decay * p
    if optimizer == "Adagrad":
        state[1] += g * g
        p -= rate * g / (np.sqrt(state[1]) + ADAGRAD_EPS)
        return
    state[0] += (1 - ADAM["beta1"]) * (g - state[0])
    state[1] += (1 - ADAM["beta2"]) * (g * g - state[1])
    p -= rate * (state[0] / (1 - ADAM["beta1"] ** t)) / (np.sqrt(state[1] / (1 - ADAM["beta2"] ** t)) + ADAM["eps"])


def dealt(rows: DataFrame, ids: Sequence[str], vector: str, parts: int | None) -> DataFrame:
    """``part, label, valid, vector``, every part stored in one place and in the order of the
    hash; without a number of parts, as many as hold ``PART_ROWS`` rows each."""
    order = F.xxhash64(*[F.col(i).cast("string") for i in ids])
    used = rows.where(F.col("label").isNotNull() & (F.size(vector) > 0) & F.col("split").isin("train", "valid"))
    parts = parts or max(PARTS, -(-used.count() // PART_ROWS))
    keyed = used.select(
        F.pmod(order, F.lit(parts)).cast("int").alias("part"), F.shiftright(order, 8).alias("_order"), F.col("label").cast("double").alias("label"),
        (F.col("split") == "valid").alias("valid"), F.col(vector).cast("array<double>").alias("vector"))
    return materialize(keyed.repartitionByRange(parts, "part").sortWithinPartitions("part", "_order", "label", "vector").drop("_order"))


def _epoch(data: DataFrame, runs: Sequence[tuple], params: np.ndarray, state: np.ndarray, steps: Sequence[int], epoch: int, hidden: int, batch: int, train: bool):
    """One pass: ``(params, state, steps, table)`` averaged over the parts; the table holds, per
    run, rows, hits and summed loss of the validation rows under the given parameters."""
    size = params.shape[1]

    def work(frames):
        # The rows of a part stand together; no part spans two tasks.
        for part, rows in _by_part(frames):
            x, y = np.stack(rows["vector"].to_numpy()), rows["label"].to_numpy(float)
            valid = rows["valid"].to_numpy(bool)
            order = np.random.default_rng([epoch, int(part)]).permutation(np.flatnonzero(~valid))
            for i, (optimizer, rate, decay) in enumerate(runs):
                p, s, t = params[i].copy(), state[i].copy(), steps[i]
                z = margins(p, x[valid], hidden)
                loss = float((np.logaddexp(0, z) - y[valid] * z).sum())
                hits = int(((z > 0) == (y[valid] == 1)).sum())
                for at in range(0, len(order) if train else 0, batch):
                    some, t = order[at : at + batch], t + 1
                    step(optimizer, rate, decay, p, loss_and_gradient(p, x[some], y[some], hidden)[1], s, t)
                values = np.concatenate([p, s.ravel()]) * len(order)
                yield pd.DataFrame({"run": [i], "n": [len(order)], "t": [t], "valid": [int(valid.sum())], "hits": [hits], "loss": [loss], "values": [values]})

    out = materialize(data.mapInPandas(work, "run int, n long, t long, valid long, hits long, loss double, values array<double>"))
    sums = out.groupBy("run").agg(*[F.sum(c).alias(c) for c in ("n", "valid", "hits", "loss")], F.max("t").alias("t")).collect()
    table = {r["run"]: r for r in sums}
    if train:
        total = out.select("run", F.posexplode("values").alias("at", "v")).groupBy("run", "at").agg(F.sum("v").alias("v")).toPandas()
        flat = np.zeros((len(runs), 3 * size))
        flat[total["run"], total["at"]] = total["v"]
        for i in table:
            if table[i]["n"]:
                params[i], state[i] = flat[i, :size] / table[i]["n"], flat[i, size:].reshape(2, size) / table[i]["n"]
        steps = [table[i]["t"] if i in table else steps[i] for i in range(len(runs))]
    return params, state, steps, table


def _by_part(frames):
    """Whole parts out of a task's frames."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        for part, rows in frame.groupby("part", sort=False):
            if held and held[0]["part"].iloc[0] != part:
                yield held[0]["part"].iloc[0], pd.concat(held, ignore_index=True)
                held = []
            held.append(rows)
    if held:
        yield held[0]["part"].iloc[0], pd.concat(held, ignore_index=True)


def train_networks(
    rows: DataFrame, wanted: Sequence[Setting], ids: Sequence[str], vector: str = "mean", parts: int | None = None, hidden: int = HIDDEN,
    batch: int = BATCH, seed: int = SEED,
) -> tuple[dict[Setting, Network], DataFrame]:
    """A network per setting, each trained on its own from the same start, and the table
    ``optimizer, rate, decay, epoch, valid_rows, valid_loss, valid_accuracy``.

    ``rows`` has ``label`` (0/1), ``split`` (train, valid; other rows take no part), the id columns
    and the vector; rows without a label or with an empty vector take no part.  Without training
    rows the networks stay at their start."""
    data = dealt(rows, ids, vector, parts)
    runs = list(dict.fromkeys(s.run for s in wanted))
    first = data.select(F.size("vector").alias("n")).first()
    inputs = first["n"] if first else 0
    size = n_params(inputs, hidden)
    params, state, steps = np.stack([initial(inputs, hidden, seed)] * len(runs)), np.zeros((len(runs), 2, size)), [0] * len(runs)
    done: dict[Setting, Network] = {}
    table = []
    for epoch in range(max(s.epochs for s in wanted) + 1):
        alive = [any(s.run == r and s.epochs > epoch for s in wanted) for r in runs]
        # Scores the epoch before and trains this one; the last pass only scores.
        for s in wanted:
            if s.epochs == epoch:
                done[s] = Network(params[runs.index(s.run)].copy(), inputs, hidden)
        params, state, steps, seen = _epoch(data, runs, params, state, steps, epoch, hidden, batch, any(alive)) if inputs else (params, state, steps, {})
        for i, r in seen.items():
            n = r["valid"]
            table.append((*runs[i], epoch, n, r["loss"] / n if n else None, r["hits"] / n if n else None))
    kinds = "optimizer string, rate double, decay double, epoch int, valid_rows long, valid_loss double, valid_accuracy double"
    return done, rows.sparkSession.createDataFrame(table, kinds)


def sweep_networks(rows: DataFrame, grid: Mapping[str, Sequence[object]], ids: Sequence[str], vector: str = "mean", **options) -> tuple[Network, DataFrame, DataFrame]:
    """Train every setting of the grid (``optimizer``, ``rate``, ``decay``, ``epochs``); the network of
    the best accuracy on the validation rows (the first of equals), the table of settings
    ``params, valid_loss, valid_accuracy`` and that of all epochs."""
    wanted = [Setting(**o) for o in all_settings(grid)]
    networks, epochs = train_networks(rows, wanted, ids, vector, **options)
    found = {(r["optimizer"], r["rate"], r["decay"], r["epoch"]): r for r in epochs.collect()}
    scored = [(s, found.get((*s.run, s.epochs))) for s in wanted]
    best = max(scored, key=lambda x: -1.0 if x[1] is None or x[1]["valid_accuracy"] is None else x[1]["valid_accuracy"])[0]
    table = [(s.name, r and r["valid_loss"], r and r["valid_accuracy"]) for s, r in scored]
    return networks[best], rows.sparkSession.createDataFrame(table, "params string, valid_loss double, valid_accuracy double"), epochs


def score_network(network: Network, df: DataFrame, *keep: str, vector: str = "mean") -> DataFrame:
    """``keep, prediction_raw, prediction_class`` of every row; a missing vector counts as zeros."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    own = network

    def work(frames):
        for frame in frames:
            x = np.zeros((len(frame), own.inputs))
            for i, v in enumerate(frame["_vector"]):
                if v is not None and len(v):
                    x[i] = v
            z = margins(own.params, x, own.hidden)
            yield frame.drop(columns="_vector").assign(prediction_raw=0.5 * (1 + np.tanh(z / 2)))

    rows = df.select(*keep, F.col(vector).cast("array<double>").alias("_vector"))
    scored = rows.mapInPandas(work, f"{kinds}{', ' if keep else ''}prediction_raw double")
    return scored.withColumn("prediction_class", threshold(F.col("prediction_raw")))
