"""The repair loop against a plain loop over rows, with a stand-in client."""

import json
import os

import pytest

from pyspark.sql import functions as F
from sparkquarry.operators import repair


def generator(calls):
    """A client that makes a fair question only at an attempt that the prompt's id tells; every call leaves a file."""

    def answer(prompts):
        os.makedirs(calls, exist_ok=True)
        out = []
        for p in prompts:
            key, attempt, feedback = p.split("|", 2)
            open(f"{calls}/{key}-{attempt}", "a").write("x")
            good = int(attempt) > int(key) % 4
            out.append(json.dumps({"question": f"Which of the cities has number {key} on its old walls?" if good else "too short"}))
        return out

    return answer


def verifier(prompts):
    out = []
    for p in prompts:
        key, attempt = map(int, p.split("|"))
        fine = (key + attempt) % 3 > 0
        out.append(json.dumps({"decision_schema": {"answerable": fine, "single_answer": True, "grounded": True, "leaks_title": False, "verdict": "repair", "reason": f"no {attempt}"}}))
    return out


def issues(rows):
    return F.when(F.length("question") < 25, F.array(F.lit("question_too_short"))).otherwise(F.array().cast("array<string>"))


def task(**more):
    return repair.Task(issues, F.concat_ws("|", "question_id", "attempt", "feedback"), F.concat_ws("|", "question_id", "attempt"), **more)


def plain(key, most):
    """One row, one attempt after the other."""
    if key % 10 == 9:
        return ("drop", 0, "Candidate cannot satisfy subtype constraints: bad", "preflight_drop", ["bad"])
    verdict = ""
    for attempt in range(1, most + 1):
        if not attempt > key % 4:
            found, notes = ["question_too_short"], "Deterministic checks failed: question_too_short"
            continue
        found = []
        if (key + attempt) % 3 > 0:
            return ("accepted", attempt, "", "accept", [])
        verdict, notes = "repair", f"no {attempt}"
    return ("needs_review", most, notes, verdict, found)


@pytest.mark.parametrize("most", [1, 3])
def test_against_a_plain_loop(spark, tmp_path, most):
    rows = spark.range(60).select(F.col("id").alias("question_id"), F.lit("old").alias("question"), F.lit("kept").alias("more"))
    bad = F.when(F.col("question_id") % 10 == 9, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>"))
    got = repair.repair(rows, task(preflight=bad), generator(str(tmp_path / "calls")), verifier, str(tmp_path / "run"), most).collect()
    assert {r.question_id: (r.status, r.attempts, r.notes, r.verdict, r.issues) for r in got} == {k: plain(k, most) for k in range(60)}
    assert all(r.more == "kept" for r in got)
    asked = {tuple(map(int, f.split("-"))) for f in os.listdir(tmp_path / "calls")}
    assert asked == {(r["question_id"], r["round"]) for r in repair.log(spark, str(tmp_path / "run")).collect()}


def test_goes_on_behind_the_last_whole_round(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("question_id"), F.lit("old").alias("question"))
    calls, run = str(tmp_path / "calls"), str(tmp_path / "run")
    fair = generator(calls)

    def stopped(prompts):
        if any(p.split("|")[1] == "2" for p in prompts):
            raise OSError("the service is away")
        return fair(prompts)

    with pytest.raises(Exception, match="the service is away"):
        repair.repair(rows, task(), stopped, verifier, run, tries=2, wait=0.01)
    got = repair.repair(rows, task(), fair, verifier, run).collect()
    assert {r.question_id: (r.status, r.attempts) for r in got} == {k: plain(k, 3)[:2] if k % 10 != 9 else (r_of(k)) for k in range(20)}
    assert all(open(f"{calls}/{f}").read() == "x" for f in os.listdir(calls))  # nothing is asked twice


def r_of(key):
    for attempt in range(1, 4):
        if attempt > key % 4 and (key + attempt) % 3 > 0:
            return ("accepted", attempt)
    return ("needs_review", 3)


def test_retries_and_wrong_counts(spark, tmp_path):
    mark = str(tmp_path / "failed")

    def shaky(prompts):
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise TimeoutError
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, p string").coalesce(1)
    assert [r.a for r in repair.ask(rows.filter("p is not null"), shaky, "p", "a", wait=0.01).orderBy("id").collect()] == ["A", "B"]
    with pytest.raises(Exception, match="prompts were given"):
        repair.ask(rows, lambda p: [], "p", "a", tries=1).collect()


def test_tasks_that_are_only_verified(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Which of the cities has walls of stone?"), (2, "short"), (3, "Which of the rivers has no bridges at all?")], "question_id long, question string")
    only = repair.Task(issues, None, F.col("question_id").cast("string"))
    said = {"1": '{"answerable": true, "single_answer": true, "grounded": true}', "3": '{"verdict": "Reject", "reason": "wrong"}'}
    got = repair.repair(rows, only, None, lambda p: [said[x] for x in p], str(tmp_path / "run")).collect()
    assert {r.question_id: (r.status, r.attempts) for r in got} == {1: ("accepted", 1), 2: ("needs_review", 0), 3: ("drop", 1)}
