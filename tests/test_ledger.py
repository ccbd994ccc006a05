"""The ledger of finished calls and the lanes of providers."""

import os
import time
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clipwright.config import RuleBook
from clipwright.operators.inference import attempt_rounds
from clipwright.operators.ledger import Lanes, Ledger

GOOD = "A small boat crosses the quiet bay at dawn. Gulls circle above the wooden mast."
MODELS = ["gemma-2", "vendor/some-model", "plain"]


def logged(folder, kill=lambda r: False, answer=lambda r: f"{r['model']}: {r['prompt']}", pause=0.0):
    """A model that leaves a file for each call, so calls are counted across processes and runs; ``kill`` ends its task as a lost executor does."""

    class Stop(BaseException):
        pass

    def call(rows):
        for r in rows:
            name = f"{r['task_id']}|{r['style']}|{r['pool_index']}|{r['model'].replace('/', '~')}|{r['attempt']}"
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{name}\n{time.time()}\n")
            if kill(r):
                raise Stop
            time.sleep(pause)
            with open(f"{folder}/{uuid.uuid4().hex}.end", "w") as f:
                f.write(f"{name}\n{time.time()}\n")
        return [(answer(r), "stop") for r in rows]

    return call


def calls(folder):
    return Counter(open(f"{folder}/{f}").readline().strip() for f in os.listdir(folder) if not f.endswith(".end"))


@pytest.fixture
def prompts(spark):
    rows = [(f"t{k}", "formal", 0, MODELS[k % 3], 1, f"p{k}") for k in range(60)]
    return spark.createDataFrame(rows, "task_id string, style string, pool_index int, model string, attempt int, prompt string")


def test_every_call_once(spark, tmp_path, prompts):
    ledger, log = Ledger(spark, f"file://{tmp_path}/ledger"), tmp_path / "log"
    log.mkdir()
    lanes = Lanes({"direct": 2, "router": 1, "default": 2}, 1, calls=4)
    part = ledger.call(prompts.where("pool_index = 0 AND substr(task_id, 2) < 30"), logged(log), lanes).count()
    before = calls(log).total()
    rows = ledger.call(prompts.unionByName(prompts.limit(5)), logged(log), lanes).collect()
    assert 0 < part == before < 60 and len(rows) == 65 and set(calls(log).values()) == {1} and len(calls(log)) == 60
    assert all(r.raw == f"{r.model}: {r.prompt}" and r.error is None for r in rows)
    changed = prompts.withColumn("prompt", F.when(F.col("task_id") == "t3", "new").otherwise(F.col("prompt")))
    assert {r.raw for r in ledger.call(changed, logged(log), lanes).where("task_id = 't3'").collect()} == {"gemma-2: new"} and calls(log).total() == 61


def test_failed_batches_are_finished_calls(spark, tmp_path, prompts):
    def call(rows):
        raise TimeoutError

    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    assert {(r.raw, r.error) for r in ledger.call(prompts.limit(3), call).collect()} == {(None, "TimeoutError")}
    assert ledger.call(prompts.limit(0), call).count() == 0 and ledger.finished().count() == 3


def test_a_run_killed_in_round_two_repeats_no_finished_call(spark, tmp_path):
    """Round 1 fails for half of the prompts; a call of round 2 kills the run; the next run makes what is missing only."""
    ledger, log = Ledger(spark, f"file://{tmp_path}/ledger"), tmp_path / "log"
    log.mkdir()
    rows = [(f"t{k}", "formal", 0, MODELS[k % 3], f"p{k}") for k in range(40)]
    prompts = spark.createDataFrame(rows, "task_id string, style string, pool_index int, model string, prompt string")
    answer = lambda r: GOOD if int(r["task_id"][1:]) % 4 < r["attempt"] * 2 else "bad"
    lanes = Lanes({"direct": 1, "router": 1, "default": 1}, 1, calls=3)

    def run(kill):
        call = logged(log, kill, answer)
        return attempt_rounds(prompts, None, RuleBook(), 1, ask=lambda asked: ledger.call(asked, call, lanes, batch=1)).collect()

    with pytest.raises(Exception, match="Stop"):
        run(lambda r: r["attempt"] == 2 and r["task_id"] == "t22")
    done = {"|".join([r.task_id, r.style, str(r.pool_index), r.model.replace("/", "~"), str(r.attempt)]) for r in ledger.finished().collect()}
    first = calls(log)
    assert {f"t{k}|formal|0|{MODELS[k % 3].replace('/', '~')}|1" for k in range(40)} <= done
    result = {r.task_id: (r.attempt, r.reason) for r in run(lambda r: False)}
    again = calls(log)
    assert all(again[k] == 1 for k in done) and sum(again.values()) - sum(first.values()) == 60 - len(done)
    assert result == {f"t{k}": (1 + (k % 4 >= 2), "") for k in range(40)}


def test_tasks_that_ended_before_the_kill_are_kept(spark, tmp_path, prompts):
    """In one wave of several tasks the last dies: the replies of those that ended stay."""
    ledger, log = Ledger(spark, f"file://{tmp_path}/ledger"), tmp_path / "log"
    log.mkdir()

    def kill(r):
        if r["model"] == "plain":
            time.sleep(4)
            return True
        return False

    with pytest.raises(Exception, match="Stop"):
        ledger.call(prompts, logged(log, kill), Lanes({"direct": 1, "router": 1, "default": 1}, 1))
    assert {r.model for r in ledger.finished().collect()} == {"gemma-2", "vendor/some-model"} and ledger.finished().count() == 40


def test_calls_in_flight_are_bounded(spark, tmp_path, prompts):
    """However many rows one provider has, no more calls of it overlap than it has lanes, and a hot provider uses all of them."""
    log = tmp_path / "log"
    log.mkdir()
    hot = prompts.withColumn("model", F.when(F.substring("task_id", 2, 9).cast("int") < 40, "gemma-2").otherwise("plain"))
    Ledger(spark, f"file://{tmp_path}/ledger").call(hot, logged(log, pause=0.03), Lanes({"direct": 2, "default": 1}, 1), batch=1)
    times = {}
    for f in os.listdir(log):
        name, at = (log / f).read_text().split()
        times.setdefault(name, []).append(float(at))
    for model, most in (("gemma-2", 2), ("plain", 1)):
        events = sorted(e for name, (a, b) in ((n, sorted(t)) for n, t in times.items() if n.split("|")[3] == model) for e in ((a, 1), (b, -1)))
        flying = top = 0
        for _, step in events:
            flying += step
            top = max(top, flying)
        assert top == most
    with pytest.raises(ValueError, match="lane"):
        Lanes({"direct": 0})
