import random

import pytest

from rinkspark.operators import runs

from helpers import rows

NAN = float("nan")


def stop_rule(losses, patience):
    best, wait, best_step = float("inf"), 0, None
    for step, loss in losses:
        wait += 1
        if loss is not None and loss < best:
            best, wait, best_step = loss, 0, step
        if wait >= patience:
            return best_step, step
    return best_step, None


@pytest.mark.parametrize("chunk", [1, 5, 4096])
def test_early_stop_equals_the_sequential_rule(spark, chunk):
    rng = random.Random(chunk)
    logs = {}
    for run in range(40):
        steps = sorted(rng.sample(range(60), rng.randint(1, 40)))
        level = rng.choice([0.02, 0.2, 1.0])
        logs[run] = [(s, rng.choice([1 - level * i / 40 + 0.1 * rng.random(), None, NAN] if rng.random() < 0.1 else [round(1 - level * i / 40 + 0.05 * rng.random(), 2)])) for i, s in enumerate(steps)]
    logs[99] = [(s, 1.0 / (s + 1)) for s in range(30)]
    data = [(run, s, v) for run, log in logs.items() for s, v in log]
    random.Random(0).shuffle(data)
    log = spark.createDataFrame(data, "run_id long, step long, val_loss double")
    got = rows(runs.early_stop(log, 3, chunk))
    want = sorted(((run, *stop_rule(entries, 3)) for run, entries in logs.items()), key=repr)
    assert got == want
    assert any(r[2] is None for r in want) and any(r[2] is not None for r in want)


def test_equal_loss_is_no_improvement(spark):
    log = spark.createDataFrame([(1, s, 0.5) for s in range(6)], "run_id long, step long, val_loss double")
    assert rows(runs.early_stop(log)) == [(1, 0, 3)]


def test_checkpoints(spark):
    data = [(r, s, f"ckpt-{s}") for r in (1, 2) for s in range(10 if r == 1 else 3)]
    checkpoints = spark.createDataFrame(data, "run_id long, step long, path string")
    kept = rows(runs.keep_latest(checkpoints), "run_id", "step")
    assert kept == [(1, s) for s in range(5, 10)] + [(2, s) for s in range(3)]
    assert rows(runs.latest(checkpoints)) == [(1, 9, "ckpt-9"), (2, 2, "ckpt-2")]
