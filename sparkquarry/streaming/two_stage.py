"""The two-stage run as a stream: first and second results of a question arrive as events, in any order, and are merged once both are there.

State is kept by question: the lists that have come and the decision whether a second one is wanted.  A question is answered when all that is
wanted has come; one whose second list does not come is answered with the first when the watermark has passed its deadline.  Events may be
late, repeated, or come again after a restart: a turn counts once, and an answered question stays answered.  What remains of it is a mark that it was
answered, which goes when its time has passed twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkquarry.operators.fusion import RRF_K

#: Events: ``turn`` is 0 or 1; the decision comes with turn 0.
EVENTS = (
    "question_id long, turn int, ts timestamp, wants_second boolean, first_weight double, second_weight double, protect int, "
    "documents array<struct<rank: int, doc_id: string, title: string>>"
)
ANSWERS = "question_id long, rank int, doc_id string, title string, score double, rounds int, complete boolean"
_STATE = "answered boolean, wants_second boolean, first_weight double, second_weight double, protect int, first string, second string, until long"


def merged(question_id: int, first: list, second: list | None, decision: tuple, top_k: int, complete: bool) -> pd.DataFrame:
    """The answer of one question: its first list, or both by the rule of ``fusion.protected_merge`` (ten documents or so)."""
    first_weight, second_weight, protect = decision
    if second is None:
        rows = [(question_id, r, d, t, 1.0 / (RRF_K + r), 1, complete) for r, d, t in sorted(first) if r <= top_k]
    else:
        found: dict[str, list] = {}
        for turn, weight, own in ((0, first_weight, first), (1, second_weight, second)):
            for r, d, t in own:
                if r > 0:
                    held = found.setdefault(d, [0.0, t, None])
                    held[0] += weight / (RRF_K + r)
                    if turn == 0:
                        held[2] = r
        kept = lambda x: x[2] is not None and x[2] <= protect
        order = sorted(found.items(), key=lambda kv: (0 if kept(kv[1]) else 1, kv[1][2] if kept(kv[1]) else 0, -round(kv[1][0], 12), kv[1][1], kv[0]))
        rows = [(question_id, i, d, x[1], x[0], 2, complete) for i, (d, x) in enumerate(order[:top_k], 1)]
    return pd.DataFrame(rows, columns=["question_id", "rank", "doc_id", "title", "score", "rounds", "complete"])


def answers(events: DataFrame, wait: str = "10 minutes", wait_ms: int = 600_000, top_k: int = 5) -> DataFrame:
    """``ANSWERS`` of a stream of ``EVENTS``; ``wait`` and ``wait_ms`` say the same: how late an event may be, and how long a second list is waited for."""
    import json

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (question_id,) = key
        answered, wants, w1, w2, protect, first, second, until = state.get if state.exists else (False, None, None, None, None, None, None, 0)
        if state.hasTimedOut:
            if answered or first is None:
                state.remove()  # answered long ago, or a second list that nothing was asked with
                return
            yield merged(question_id, json.loads(first), None, (w1, w2, protect), top_k, False)
            state.update((True, wants, w1, w2, protect, None, None, until))
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs()) + wait_ms)
            return
        for part in parts:
            for row in part.itertuples():
                until = max(until, int(row.ts.timestamp() * 1000) + wait_ms)
                own = json.dumps([[int(d["rank"]), d["doc_id"], d["title"]] for d in row.documents])
                if row.turn == 0 and first is None:
                    first, wants, w1, w2, protect = own, bool(row.wants_second), float(row.first_weight), float(row.second_weight), int(row.protect)
                elif row.turn == 1 and second is None:
                    second = own
        if not answered and first is not None and (not wants or second is not None):
            yield merged(question_id, json.loads(first), json.loads(second) if wants else None, (w1, w2, protect), top_k, True)
            answered = True
        state.update((answered, wants, w1, w2, protect, None if answered else first, None if answered else second, until))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    timed = events.withWatermark("ts", wait)
    return timed.groupBy("question_id").applyInPandasWithState(step, ANSWERS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(events: DataFrame, out: str, checkpoint: str, **how) -> DataFrame:
    """Answer all events that are there, appended to the files of ``out``; started again with the same checkpoint it goes on."""
    query = answers(events, **how).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return events.sparkSession.read.parquet(out)


def batch_answers(events: DataFrame, top_k: int = 5) -> DataFrame:
    """What the stream comes to in the end, as one plan over all events: of each turn the earliest event counts."""
    from sparkquarry.operators import fusion

    one = events.groupBy("question_id", "turn").agg(F.min_by(F.struct("wants_second", "first_weight", "second_weight", "protect", "documents"), "ts").alias("e")).select("question_id", "turn", "e.*")
    lists = lambda turn: one.filter(F.col("turn") == turn).select("question_id", F.explode("documents").alias("d")).select("question_id", "d.rank", "d.doc_id", "d.title")
    head = one.filter("turn = 0").select("question_id", "wants_second", "first_weight", "second_weight", "protect")
    there = one.filter("turn = 1").select("question_id", F.lit(True).alias("there"))
    head = head.join(there, "question_id", "left").withColumn("two", F.col("wants_second") & F.coalesce("there", F.lit(False)))
    both = head.filter("two").select("question_id", "first_weight", "second_weight", "protect")
    merged_ = fusion.protected_merge(lists(0), lists(1), both, top_k).withColumns({"rounds": F.lit(2), "complete": F.lit(True)})
    alone = lists(0).join(head.filter("not two").select("question_id", (~F.col("wants_second")).alias("complete")), "question_id").filter(F.col("rank") <= top_k)
    alone = alone.select("question_id", "rank", "doc_id", "title", (1.0 / (RRF_K + F.col("rank"))).alias("score"), F.lit(1).alias("rounds"), "complete")
    return merged_.select(alone.columns).union(alone)
