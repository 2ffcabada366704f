"""The stream of two-stage answers against the batch plan: out of order, repeated, late and restarted input."""

import random
from datetime import datetime, timedelta

import pytest

from sparkquarry.streaming import two_stage

START = datetime(2024, 1, 1)


def event(question, turn, minute, wants=True, docs=()):
    documents = [{"rank": i + 1, "doc_id": d, "title": d.upper()} for i, d in enumerate(docs)]
    return (question, turn, START + timedelta(minutes=minute), wants, 1.2, 1.35, question % 3, documents)


def made(seed):
    rng = random.Random(seed)
    out = []
    for q in range(40):
        pick = lambda: rng.sample("abcdefgh", 5)
        wants = q % 4 != 0
        out.append(event(q, 0, q, wants, pick()))
        if wants and q % 5 != 1:  # of the others the second list never comes
            out.append(event(q, 1, q + rng.randrange(5), wants, pick()))
    return out


def rows_of(frame):
    return sorted((r.question_id, r["rank"], r.doc_id, r.title, round(r.score, 9), r.rounds, r.complete) for r in frame.collect())


@pytest.mark.parametrize("files", [1, 5])
def test_same_as_the_batch(spark, tmp_path, files):
    rows = made(files)
    want = rows_of(two_stage.batch_answers(spark.createDataFrame(rows, two_stage.EVENTS)))
    assert len({r[5:] for r in want}) == 3  # both rounds, one round, one round for want of the second
    rng = random.Random(9)
    rows = rows + rng.sample(rows, 15)  # repeated
    rows.sort(key=lambda e: e[2] + timedelta(minutes=rng.randrange(-4, 5)))  # out of order, within the time that is waited
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    stream = lambda: spark.readStream.schema(two_stage.EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    size = -(-len(rows) // files)
    for i in range(files):  # each start goes on where the one before it ended
        spark.createDataFrame(rows[i * size : (i + 1) * size], two_stage.EVENTS).coalesce(1).write.mode("append").parquet(source)
        got = two_stage.run_available(stream(), out, check)
    # Later events move the time past all deadlines.
    for minute in (600, 601):
        spark.createDataFrame([event(1_000 + minute, 0, minute, False, "a")], two_stage.EVENTS).coalesce(1).write.mode("append").parquet(source)
        got = two_stage.run_available(stream(), out, check)
    # What comes again for questions that were answered changes nothing, early or late.
    spark.createDataFrame(rows[:10], two_stage.EVENTS).coalesce(1).write.mode("append").parquet(source)
    got = two_stage.run_available(stream(), out, check)
    assert [r for r in rows_of(got) if r[0] < 1_000] == want


def test_second_before_first(spark, tmp_path):
    source = str(tmp_path / "in")
    for turn in (1, 0):
        spark.createDataFrame([event(7, turn, 1, True, "ab" if turn else "bc")], two_stage.EVENTS).coalesce(1).write.mode("append").parquet(source)
        got = two_stage.run_available(spark.readStream.schema(two_stage.EVENTS).parquet(source), str(tmp_path / "out"), str(tmp_path / "check"))
    assert [(r.doc_id, r.rounds) for r in got.orderBy("rank").collect()] == [("b", 2), ("a", 2), ("c", 2)]
