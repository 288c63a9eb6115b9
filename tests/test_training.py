import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.operators import models, training

from helpers import rows

CLASSES, WIDTH = 3, 4


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(3)
    y = draw.integers(0, CLASSES, 240)
    x = draw.normal(size=(240, WIDTH)) + 2 * np.eye(CLASSES, WIDTH)[y]
    return x, y


def table(spark, data):
    x, y = data
    listed = [(k, [float(v) for v in a], int(b)) for k, (a, b) in enumerate(zip(x, y))]
    odd = [(1000, None, 1), (1001, [0.0] * WIDTH, None)]
    return spark.createDataFrame(listed + odd, "vec_id long, embedding array<double>, label int").repartition(5)




def by_hand(data, epochs, rate):
    x, y = data
    x = np.c_[x, np.ones(len(x))]
    ids = np.arange(len(x))
    w, losses, every = np.zeros((CLASSES, WIDTH + 1)), [], []

    def p(rows):
        z = np.exp(x[rows] @ w.T)
        return z / z.sum(axis=1, keepdims=True)

    for _ in range(epochs):
        for b in (0, 1):
            own = (ids % 5 != 0) & (ids % 2 == b)
            w = w - rate * (p(own) - np.eye(CLASSES)[y[own]]).T @ x[own] / own.sum()
        held = ids % 5 == 0
        losses.append(-np.log(p(held)[np.arange(held.sum()), y[held]]).mean())
        every.append(w)
    return losses, every


def run(spark, data, path, **options):
    options = {"epochs": 6, "batches": 2, "rate": 0.5, "held_out": F.expr("vec_id % 5 = 0"), "batch_of": F.expr("vec_id % 2")} | options
    return training.train(table(spark, data), str(path), CLASSES, **options)


def test_log_and_weights_equal_the_loop_by_hand(spark, data, tmp_path):
    losses, every = by_hand(data, 6, 0.5)
    log = run(spark, data, tmp_path / "run").orderBy("step").collect()
    assert [r.step for r in log] == list(range(1, 7))
    assert np.allclose([r.val_loss for r in log], losses, atol=1e-12)
    kept = training.Run(spark, str(tmp_path / "run"), "run")
    assert sorted(r.step for r in kept.checkpoints().collect()) == [2, 3, 4, 5, 6]
    step, weights = kept.restore()
    assert step == 6 and np.allclose(weights, every[-1], atol=1e-12)
    report = training.evaluate_latest(table(spark, data), str(tmp_path / "run")).first()
    guess = (np.c_[data[0], np.ones(240)] @ weights.T).argmax(axis=1)
    assert (report.step, report.n) == (6, 240) and report.accuracy > 0.7
    assert report.accuracy == pytest.approx((guess == data[1]).mean())
    scored = models.score(table(spark, data).filter("vec_id < 240"), training.predictor(weights), "embedding", [WIDTH], T.DoubleType())
    assert [r.prediction for r in scored.orderBy("vec_id").collect()] == guess.tolist()


def test_a_run_cut_short_ends_like_a_whole_one(spark, data, tmp_path):
    whole = rows(run(spark, data, tmp_path / "whole"))
    run(spark, data, tmp_path / "cut", epochs=3)
    # an epoch whose log was written but whose weights were not is run again
    spark.createDataFrame([("run", 4, 99.0)], training.LOG).write.parquet(str(tmp_path / "cut" / "log" / "4"))
    again = rows(run(spark, data, tmp_path / "cut"))
    assert [r[:2] for r in again] == [r[:2] for r in whole]
    assert np.allclose([r[2] for r in again], [r[2] for r in whole], atol=1e-12)
    assert rows(run(spark, data, tmp_path / "cut")) == again


def test_training_stops_when_the_loss_does(spark, data, tmp_path):
    log = run(spark, data, tmp_path / "run", epochs=20, rate=60.0, patience=2).orderBy("step").collect()
    losses = [r.val_loss for r in log]
    assert len(log) < 20 and min(losses) <= min(losses[-2:]) and losses.index(min(losses)) == len(log) - 3
    assert len(run(spark, data, tmp_path / "run", epochs=20, rate=60.0, patience=2).collect()) == len(log)


def test_nothing_to_train_on(spark, data, tmp_path):
    empty = table(spark, data).filter("vec_id > 999")
    assert training.train(empty, str(tmp_path / "run"), CLASSES).count() == 0
    with pytest.raises(ValueError, match="no checkpoint"):
        training.evaluate_latest(empty, str(tmp_path / "run"))
