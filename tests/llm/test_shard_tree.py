import math
import zlib
from collections import Counter

import pytest
import xxhash

from pyspark.sql import functions as F
from sparkquarry.llm import shard_tree
from tests.llm.odd import ODD, frame


def brute_place(key, tree):
    node = tree
    while node.children:
        live = [c for c in node.children if c.weight > 0]
        draw = lambda c: -math.log(((xxhash.xxh64_intdigest(f"{key}@{c.name}".encode(), 42) >> 11) + 0.5) / 2**53) / c.weight
        node = live[0] if len(live) == 1 else min(live, key=draw)
    return node.shard


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in ODD] + [(5, "again"), (5, "again")]
    got = shard_tree.report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.shard, r.grown_shard, r.law) == (brute_place(r.doc_id, shard_tree.even(8)), brute_place(r.doc_id, shard_tree.even(9)), "key")
        assert r.grown_shard in (r.shard, 8)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for s in range(8):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


@pytest.mark.parametrize("bucket_rows", [1, 7, 10_000])
def test_slots_without_gaps(spark, bucket_rows):
    rows = spark.range(500).withColumn("shard", (F.col("id") % 3 * F.col("id") % 2).cast("int"))
    got = shard_tree.with_slots(rows, "shard", "id", 500, bucket_rows).collect()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def place_all(spark, tree, n=20_000):
    return {r.id: r.s for r in spark.range(n).select("id", shard_tree.place(F.col("id"), tree).alias("s")).collect()}


def test_weights_and_confined_movement(spark):
    regions = [[[(0, 1.0), (1, 3.0)], [(2, 2.0)]], [[(3, 1.0)], [(4, 1.0), (5, 0.0)]]]
    before = place_all(spark, shard_tree.build(regions))
    share = Counter(before.values())
    assert share[5] == 0
    for s, w in ((0, 1), (1, 3), (2, 2), (3, 1), (4, 1)):
        assert share[s] / len(before) == pytest.approx(w / 8, abs=0.02)
    regions[0][0][0] = (0, 2.0)
    after = place_all(spark, shard_tree.build(regions))
    rack = {0: "a", 1: "a", 2: "b", 3: "c", 4: "d", 5: "d"}
    for i, s in before.items():
        if after[i] != s and rack[after[i]] not in ("a", "b"):
            raise AssertionError("moved into a region whose weight did not grow")
    # Regions: keys only enter the grown one; within the other nothing moves.
    assert all(after[i] == s for i, s in before.items() if s in (3, 4) and after[i] in (3, 4))


def test_no_weight_is_refused(spark):
    with pytest.raises(ValueError, match="no weight"):
        shard_tree.place(F.lit("1"), shard_tree.build([[[(0, 0.0)], [(1, 0.0)]]]))


def test_empty_table(spark):
    assert shard_tree.report(frame(spark, [])).count() == 0
