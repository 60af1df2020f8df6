"""Runs of rows packed into bytes: same rows, a fraction of the memory and disk."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from softcluster.functions import sparse as FS
from softcluster.operators import blocks as BL
from softcluster.operators import packed as PK
from softcluster.operators import sparse
from softcluster.operators import topics as TP
from softcluster.sources import bags


@pytest.mark.parametrize("rows", [
    [(1, [3, 7, 2_000_000_000], [1.0, 0.5, -0.0]), (None, [], []), (3, [-5], [float("inf")])],
    [(1, None, [1.0]), (2, [1, None], [None, 2.0]), (3, [1, 2], [1.0])],
    [],
])
def test_runs_keep_rows(rows):
    kinds = {"id": pa.int64(), "indices": pa.list_(pa.int32()), "values": pa.list_(pa.float64())}
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))
    for part in (batch, batch.slice(1)):
        assert PK.unpack(PK.pack(part)).to_pylist() == part.to_pylist()
    assert PK.unpack(PK.pack(batch), ["indices"]).to_pylist() == batch.select(["indices"]).to_pylist()


def words_of(spark, n=400):
    rng = np.random.default_rng(3)
    rows = [(int(d), " ".join(f"w{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}{chr(97 + x // 676 % 26)}" for x in rng.zipf(1.3, 600) % 9000)) for d in range(n)]
    return spark.createDataFrame(rows + [(7, "again wbaa"), (None, "lost words wbaa lost")], "doc_id long, text string").repartition(3)


def test_blocks_are_kept_packed_on_disk(spark, monkeypatch):
    """Before, 12 bytes an entry lay in the executors' memory, twice."""
    dealt, _ = bags.bag_blocks(words_of(spark))
    entries = dealt.rows.agg(F.sum(F.size("terms"))).first()[0]
    assert dealt.packed.storageLevel == dealt.wanted.storageLevel == StorageLevel.DISK_ONLY
    assert dealt.packed.agg(F.sum(F.octet_length("run"))).first()[0] < 4 * entries
    # A bag is in the block of its id already, so training deals it no more.
    held = dealt.rows.select("block", BL.block_of(F.col("doc_id"), dealt.n).alias("want"), F.spark_partition_id().alias("at")).distinct().collect()
    assert held and all(r["block"] == r["want"] == r["at"] for r in held)
    assert TP.train_em(dealt, k=2, max_iter=1, init="hash").dealt is dealt
    # Points are packed before they are dealt, some at a time.
    monkeypatch.setattr(PK, "RUN_ENTRIES", 50)
    monkeypatch.setattr(BL, "HELD_ENTRIES", 200)
    pts = spark.createDataFrame([(i, [i % 7, 10 + i % 50, 100 + i], [1.0, 2.0, 0.5]) for i in range(400)], "id long, indices array<int>, values array<double>")
    got = sparse.deal(pts).rows.drop("block").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, pts.collect()))


def test_hash_start_over_blocks_as_by_tokens(spark):
    dealt, _ = bags.bag_blocks(words_of(spark, 60))
    tokens = TP.token_table(bags.entries(dealt.rows))
    for got, want in zip(TP.init_hash_blocks(dealt, 3), TP.init_hash(tokens, 3)):
        got, want = ({r[0]: list(r)[1:] for r in df.collect()} for df in (got, want))
        assert got.keys() == want.keys() and any(None in v for v in want.values())
        assert all(v == want[i] if None in v else np.allclose(v, want[i]) for i, v in got.items())


def test_full_centres_as_by_place(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pts = spark.createDataFrame([(i, np.sort(rng.choice(40, 9, replace=False)).tolist(), rng.random(9).tolist()) for i in range(200)],
                                "id long, indices array<int>, values array<double>")
    start = pts.where("id < 30").persist()
    # The centres miss some places of the rows.
    table, k = sparse.group_means(start.where(~F.array_contains("indices", 3)), F.pmod("id", F.lit(3)))
    found, added = [], []
    for cells in (1 << 23, 0):
        monkeypatch.setattr(FS, "FULL_CELLS", cells)
        hard = sparse.train_kmeans(pts, k, init=table, max_iter=2, epsilon=0.0)
        soft = sparse.train_fuzzy(pts, k, 1.8, init=table, max_iter=2, epsilon=0.0)
        found.append([{(r["cluster"], r["index"]): r["value"] for r in m.centers_df(spark).collect()} for m in (hard, soft)])
        added.append([t["value"] for m in (hard, soft) for t in m.trace])
    for one, other in zip(*found):
        assert one.keys() == other.keys() and all(np.isclose(v, other[p]) for p, v in one.items())
    assert np.allclose(*added)


def test_sums_of_blocks_are_combined_after_the_shuffle(spark):
    """A task has a place once: a combine before the shuffle would hold all its places for nothing."""
    pts = spark.createDataFrame([(i, [i % 4, 10 + i], [1.0, 0.5]) for i in range(40)], "id long, indices array<int>, values array<double>")
    init = spark.createDataFrame([(j, j, 1.0) for j in range(4)], "cluster int, index int, value double")
    plan = sparse.step_sums(sparse.deal(pts), FS.CenterTable(4, init))._jdf.queryExecution().executedPlan().toString()
    top = plan[:plan.index("Exchange hashpartitioning(cluster")]
    assert top.count("HashAggregate") == 2 and "FlatMapCoGroupsInArrow" in plan
