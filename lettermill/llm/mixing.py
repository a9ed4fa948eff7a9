"""Mixing sources to target weights (problem 9).

Records get a token count once.  Each source is cut by hash into at most
``BLOCKS`` blocks, whose sizes alone reach the driver (sources x BLOCKS rows,
whatever the corpus).  The quotas in tokens follow from the target shares and the
caps on repeats: whole passes over a source, then blocks in a seeded permutation,
the last one in part.  The block instances of all sources are parted among the
output shards by a multivariate-hypergeometric splitting tree, so that each shard
is an exact random draw without replacement; a leaf takes the next disjoint
blocks of each source's permutation and is shuffled within itself.  Where shards
outnumber blocks, each leaf is parted further by hash, so that a shard keeps its size.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._batch import cut_lineage, load, map_batches

BLOCKS, DOCS_PER_BLOCK, SHARD_TOKENS, SEED = 1 << 13, 32, 1 << 20, 42
#: Rows that the table of targets may have: one a source.
MOST_SOURCES = 10_000
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict = {}


def encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(df: DataFrame, record_id: str, source: str, text: str, ranks: str = RANKS) -> DataFrame:
    """record_id, source, n_tokens; null texts count as empty, null sources stay null, a repeated id counts once."""
    src = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        e = encoder(ranks)
        return {"record_id": batch.column(0).to_pylist(), "source": batch.column(1).to_pylist(), "n_tokens": [len(e.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]}

    return map_batches(src, run, "record_id bigint, source string, n_tokens bigint").dropDuplicates(["record_id"])


def split_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Block counts (shard, source): at each node the left half's share is drawn without replacement."""
    out = np.zeros((shards, len(counts)), np.int64)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        take = int(have.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if have.sum() else have
        node(lo, mid, left)
        node(mid, hi, have - left)

    node(0, shards, np.asarray(counts, np.int64))
    return out


def plan(blocks: pd.DataFrame, targets: pd.DataFrame, shards: int | None = None, seed: int = SEED) -> pd.DataFrame:
    """source, copy, block, shard, parts (shards from this one on that share its records), quota (tokens of the block to take; null: all) from source, block, n_tokens and source, target_share, max_repeats."""
    targets = targets[(targets["target_share"] > 0) & targets["source"].notna()].sort_values("source").reset_index(drop=True)
    size = blocks.groupby("source")["n_tokens"].sum()
    have = targets["source"].map(size).fillna(0).to_numpy(np.float64)
    empty = pd.DataFrame({"source": pd.Series(dtype=str), "copy": pd.Series(dtype="int64"), "block": pd.Series(dtype="int64"), "shard": pd.Series(dtype="int64"), "parts": pd.Series(dtype="int64"), "quota": pd.Series(dtype="float64")})
    if not len(targets) or not (have > 0).any():
        return empty
    share, cap = targets["target_share"].to_numpy(np.float64), targets["max_repeats"].clip(lower=0).to_numpy(np.float64)
    usable = (have > 0) & (cap > 0)  # a source without records leaves its share to the others
    total = float((have * cap / np.where(share > 0, share, 1))[usable].min())
    rows = []
    for k, source in enumerate(targets["source"]):
        if not usable[k]:
            continue
        own = blocks[blocks["source"] == source].sort_values("block")
        rng = np.random.Generator(np.random.PCG64([seed, 1, k]))
        order = rng.permutation(len(own))
        ids, tokens = own["block"].to_numpy(np.int64)[order], own["n_tokens"].to_numpy(np.int64)[order]
        quota = share[k] * total
        full = min(int(math.floor(quota / have[k] + 1e-9)), int(cap[k]))
        rest = quota - full * have[k]
        for c in range(full):
            rows.append(pd.DataFrame({"source": source, "k": k, "copy": c, "block": ids, "quota": np.nan}))
        if rest > 0.5 and full < cap[k]:
            ends = np.cumsum(tokens)
            n = int(np.searchsorted(ends, rest + 1e-6, "right"))
            part = np.full(n, np.nan)
            if n < len(ids):
                part = np.append(part, rest - (ends[n - 1] if n else 0))
            rows.append(pd.DataFrame({"source": source, "k": k, "copy": full, "block": ids[: len(part)], "quota": part}))
    if not rows:
        return empty
    inst = pd.concat(rows, ignore_index=True)
    shards = shards or max(1, math.ceil(total / SHARD_TOKENS))
    leaves = min(shards, len(inst))
    counts = split_tree(inst.groupby("k").size().reindex(range(len(targets)), fill_value=0).to_numpy(), leaves, seed)
    inst["shard"] = -1
    for k in range(len(targets)):
        at = np.flatnonzero(inst["k"].to_numpy() == k)
        at = np.random.Generator(np.random.PCG64([seed, 2, k])).permutation(at)
        inst.loc[at, "shard"] = np.repeat(np.arange(leaves), counts[:, k])
    # Leaf k has the shards from first[k] to first[k + 1].
    first = np.arange(leaves + 1) * shards // leaves
    inst["parts"] = (first[1:] - first[:-1])[inst["shard"]]
    inst["shard"] = first[inst["shard"]]
    return inst[["source", "copy", "block", "shard", "parts", "quota"]]


def mixture(df: DataFrame, targets: DataFrame, record_id: str = "doc_id", source: str = "source", text: str = "text", shards: int | None = None, seed: int = SEED, ranks: str = RANKS) -> DataFrame:
    """record_id, source, copy, shard, order_key, n_tokens - one row per use of a record.

    Records of sources without a target are left out; an empty side gives an
    empty mixture.  Within a shard, order_key is a random order.
    """
    spark = df.sparkSession
    want = targets.select(F.col("source").cast("string"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("source is not null").dropDuplicates(["source"]).limit(MOST_SOURCES + 1).toPandas()
    if len(want) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources with a target")
    counted = cut_lineage(token_counts(df, record_id, source, text, ranks))
    n = {r["source"]: r["n"] for r in counted.where(F.col("source").isin(want["source"].tolist())).groupBy("source").agg(F.count("*").alias("n")).collect()}
    parts = {s: max(1, min(BLOCKS, c // DOCS_PER_BLOCK)) for s, c in n.items()}
    width = F.lit(1)
    for s, p in parts.items():
        width = F.when(F.col("source") == s, F.lit(p)).otherwise(width)
    placed = counted.where(F.col("source").isin(list(parts))).withColumn("block", F.pmod(F.xxhash64("record_id", F.lit(seed)), width).cast("bigint"))
    sizes = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("n_tokens")).toPandas()  # sources x BLOCKS rows at most
    todo = plan(sizes, want, shards, seed)
    schema = "source string, copy bigint, block bigint, shard bigint, parts bigint, quota double"
    instances = spark.createDataFrame(todo, schema) if len(todo) else spark.createDataFrame([], schema)
    instances = instances.withColumn("quota", F.when(F.isnan("quota"), F.lit(None)).otherwise(F.col("quota")))
    # Bounded as the plan is: sources x BLOCKS x repeats rows.
    used = placed.join(F.broadcast(instances) if len(todo) <= 1_000_000 else instances, ["source", "block"])
    # At most one block of a source is taken in part: its records in hash order while the quota lasts.
    run = F.sum("n_tokens").over(Window.partitionBy("source", "copy", "block").orderBy(F.xxhash64("record_id", F.lit(seed + 1)), "record_id"))
    partial = used.where("quota is not null").withColumn("run", run).where("run <= quota").drop("run")
    used = used.where("quota is null").unionByName(partial)
    used = used.withColumn("shard", F.col("shard") + F.pmod(F.xxhash64("record_id", "copy", F.lit(seed + 3)), F.col("parts")))
    used = used.withColumn("order_key", F.xxhash64("record_id", "copy", F.lit(seed + 2)))
    out = used.select("record_id", "source", "copy", "shard", "order_key", "n_tokens")
    return out.repartition("shard").sortWithinPartitions("shard", "order_key")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    total = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_uses"), F.countDistinct("record_id").alias("n_records"), (F.max("copy") + 1).alias("most_repeats"))
    # One row a source: the whole is their sum.
    total = total.withColumn("all_tokens", F.sum("n_tokens").over(Window.partitionBy(F.lit(0))))
    wanted = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
    return wanted.join(total, "source", "left").select(
        "source", "target_share", F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), "n_tokens", "n_uses", "n_records", "most_repeats", "max_repeats"
    )


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets")).withColumnRenamed("record_id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = load(spark, sf_dir, "mix_targets")
    return shares(mixture(load(spark, sf_dir, "documents"), targets), targets)


def p9_promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target: whether the mixture's share is within half a point of it, or two records where these are more, no record is used too often or twice in one copy, and only the source's own records are used."""
    docs, targets = load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets")
    mixed = mixture(docs, targets)
    own = docs.select(F.col("doc_id").alias("record_id"), F.col("source").alias("of")).dropDuplicates(["record_id"])
    uses = mixed.groupBy("record_id", "source").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("n_copies"), F.sum("n_tokens").alias("n_tokens"), F.max("copy").alias("last"))
    kept = uses.join(own, "record_id", "left").groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.max("n").alias("most"), F.max(F.col("n_tokens") / F.col("n")).alias("largest"), F.bool_and((F.col("n") == F.col("n_copies")) & F.coalesce(F.col("of") == F.col("source"), F.lit(False))).alias("own"))
    kept = kept.withColumn("all_tokens", F.sum("n_tokens").over(Window.partitionBy(F.lit(0))))  # one row a source
    return targets.join(kept, "source", "left").select(
        "source", "target_share", (F.abs(F.col("n_tokens") - F.col("target_share") * F.col("all_tokens")) <= F.greatest(0.005 * F.col("all_tokens"), 2 * F.col("largest"))).alias("share_met"), (F.col("most") <= F.col("max_repeats")).alias("cap_met"), F.col("own").alias("records_own")
    )


def promises_sql() -> str:
    return "SELECT source, target_share, true AS share_met, true AS cap_met, true AS records_own FROM mix_targets"
