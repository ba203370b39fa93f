"""Isolation forest over window metrics.

The model is data: a node table (one row per tree node, at most trees * (2 * sample - 1)
rows), the feature scaling and the contamination threshold. All trees grow one level at a time, as one aggregate
over (tree, node); every draw is a hash of seed, tree and node or row key, so a forest depends on its rows alone.
Training stays in the JVM. Scoring walks all trees over Arrow batches of the five features; no other column leaves the JVM.
"""

from __future__ import annotations

import hashlib
import json
import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import rules
from tidegauge.functions.scalars import settled
from tidegauge.operators.latest import newest_n
from tidegauge.operators.sharding import VALUE_LIMIT, grouped_quantiles
from tidegauge.runtime import cut
from tidegauge.schemas import FEATURES, FOREST_NODE

# Functions of this module travel to the Python workers by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Forest size, contamination share, seed, rows per tree, least training rows.
TREES = 100
CONTAMINATION = 0.05
SEED = 42
SAMPLE = 256
MIN_ROWS = 20

DRAW = (1 << 31) - 1  # a prime: draws are numbers below it
_SPARE = 4           # a tree is offered this many times its sample
SCORE_DIGITS = 9     # scores are settled to so many, whatever the order of their sums


@dataclass(frozen=True)
class Forest:
    """A fitted forest. `threshold` is the isolation score above which a row is an outlier."""

    nodes: DataFrame
    means: tuple[float, ...]
    scales: tuple[float, ...]
    sample: int
    threshold: float | None = None

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        settings = json.dumps({"means": self.means, "scales": self.scales, "sample": self.sample,
                               "threshold": self.threshold})
        spark.createDataFrame([(settings,)], "settings STRING").write.mode("overwrite").parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> Forest | None:
    """The saved forest, or None when there is none: the detector is then switched off."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/settings/_SUCCESS")
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return None
    kept = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    return Forest(spark.read.schema(FOREST_NODE).parquet(f"{path}/nodes"), tuple(kept["means"]),
                  tuple(kept["scales"]), kept["sample"], kept["threshold"])


def training_rows(metrics: DataFrame, window_size: str = "5m", per_symbol: int = 500,
                  symbols: Sequence[str] | None = None) -> DataFrame:
    """The newest `per_symbol` metric rows of each symbol, of one window size."""
    chosen = metrics.filter((F.col("window_size") == window_size) & F.col("symbol").isNotNull())
    if symbols is not None:
        chosen = chosen.filter(F.col("symbol").isin(list(symbols)))
    return newest_n(chosen, "symbol", [F.col("window_start").desc(), *[F.col(c).desc() for c in ("id",) if c in chosen.columns]], per_symbol)


def features(rows: DataFrame) -> DataFrame:
    """Model features as doubles, 0 for missing."""
    return rows.withColumns({name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in FEATURES})


def scaling(rows: DataFrame) -> DataFrame:
    """Mean and population deviation of each feature, one row per feature; deviation 0 counts as 1."""
    one_row = features(rows).agg(
        *[F.avg(f).alias(f"{f}_mean") for f in FEATURES], *[F.stddev_pop(f).alias(f"{f}_scale") for f in FEATURES])
    entry = [F.struct(F.lit(f).alias("feature"), F.col(f"{f}_mean").alias("mean"),
                      F.coalesce(F.nullif(F.col(f"{f}_scale"), F.lit(0.0)), F.lit(1.0)).alias("scale"))
             for f in FEATURES]
    return one_row.select(F.inline(F.array(*entry)))


def _scaled(rows: DataFrame, means: Sequence[float], scales: Sequence[float]) -> DataFrame:
    return features(rows).withColumns({f: (F.col(f) - m) / s for f, m, s in zip(FEATURES, means, scales)})


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def row_hash(rows: DataFrame, keys: Sequence[str]) -> Column:
    """A number below DRAW from the row's key; a time counts by its microseconds."""
    kinds = dict(rows.dtypes)
    parts = [F.coalesce((F.unix_micros(k) if kinds[k].startswith("timestamp") else F.col(k)).cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint") % DRAW


def draw_line(tree: int) -> tuple[int, int]:
    """Factor and offset, modulo DRAW, of a tree's draws: each is a line over the rows' hashes."""
    return 1 + _digest(f"{SEED}|factor|{tree}") % (DRAW - 1), _digest(f"{SEED}|offset|{tree}") % DRAW


def _tree_samples(rows: DataFrame, keys: Sequence[str], total: int, trees: int, sample: int) -> DataFrame:
    """Rows offered to each tree with their draw. Every row's chance depends on its key only.

    A first draw shrinks a large input to a pool (one hash per row); the per-tree draws
    then run over the pool.
    """
    pool_size = min(total, _SPARE * trees * sample)
    share = min(1.0, _SPARE * sample / pool_size)

    def draw(line: tuple[int, int]) -> Column:
        return (F.col("_hash") * line[0] + line[1]) % DRAW

    hashed = rows.select(*keys, *FEATURES, row_hash(rows, keys).alias("_hash"))
    pool = hashed.filter(draw(draw_line(-1)) < int(DRAW * (pool_size / total)) + 1)
    lines = F.expr(f"array({', '.join('named_struct("tree", {}, "a", {}L, "b", {}L)'.format(t, *draw_line(t)) for t in range(trees))})")
    draws = F.transform(lines, lambda t: F.struct(t["tree"].alias("tree"), ((F.col("_hash") * t["a"] + t["b"]) % DRAW).alias("draw")))
    offered = F.filter(draws, lambda d: d["draw"] < int(DRAW * share) + 1)
    return pool.select(*keys, *FEATURES, F.inline(offered))


def _uniform(what: str) -> str:
    """A number in [0, 1) from the hash of seed, tree and node."""
    return f"CAST(conv(substring(md5(concat('{SEED}|{what}|', tree, '|', node)), 1, 13), 16, 10) AS BIGINT) / {float(1 << 52)}D"


def _level(rows: str, depth: int, limit: int) -> str:
    """Rows after one more level: their node's split is added to their way, and they move to a child.

    A row that has reached its leaf goes no further: its node is null from there on.
    """
    ends = {how: ", ".join(f"{how}(x[{i}]) OVER w" for i in range(len(FEATURES))) for how in ("min", "max")}
    inner = "size(usable) > 0" if depth < limit else "false"
    return f"""
SELECT tree, x, CASE WHEN feature >= 0 THEN node * 2 + CASE WHEN get(x, feature) > split THEN 2 ELSE 1 END END AS node,
       CASE WHEN node IS NULL THEN way ELSE concat(way, array(named_struct(
            'node', node, 'feature', feature, 'split', split, 'size', size, 'depth', {depth}))) END AS way
FROM (SELECT *, CASE WHEN feature >= 0 THEN get(low, feature) + {_uniform("split")} * (get(high, feature) - get(low, feature)) ELSE 0D END AS split
FROM (SELECT *, CASE WHEN {inner} THEN get(usable, CAST(floor({_uniform("feature")} * size(usable)) AS INT)) ELSE -1 END AS feature
FROM (SELECT *, filter(sequence(0, {len(FEATURES) - 1}), i -> get(high, i) > get(low, i)) AS usable
FROM (SELECT *, array({ends["min"]}) AS low, array({ends["max"]}) AS high, CAST(count(1) OVER w AS INT) AS size
FROM ({rows}) WINDOW w AS (PARTITION BY tree, node)))))"""


def _grown(samples: DataFrame, limit: int) -> DataFrame:
    """Nodes of all trees. Node i has children 2i+1 (at or below the split) and 2i+2; leaves have feature -1.

    Each level is one aggregate over (tree, node), as a window, so that rows learn their node's split without a join; rows are
    dealt out by tree once, a tree's rows being at most a sample. A row's list of nodes is its way down the tree.
    """
    spark = samples.sparkSession
    rows = samples.selectExpr("tree", f"array({', '.join(FEATURES)}) AS x", "0 AS node", (
        "CAST(array() AS ARRAY<STRUCT<node: INT, feature: INT, split: DOUBLE, size: INT, depth: INT>>) AS way"))
    # A few levels a statement: fewer statements are analysed faster, and one alone would be too deep.
    for first in range(0, limit + 1, 3):
        text = "SELECT * FROM {rows}"
        for depth in range(first, min(first + 3, limit + 1)):
            text = _level(text, depth, limit)
        rows = spark.sql(text, rows=rows)
    return rows.selectExpr("tree", "inline(way)").distinct()


def path_correction(size: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among `size` rows."""
    n = np.asarray(size, dtype=float)
    wide = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, wide, np.where(n == 2, 1.0, 0.0))


def fit(rows: DataFrame, keys: Sequence[str], trees: int = TREES, sample: int = SAMPLE,
        contamination: float = CONTAMINATION, group_limit: int = VALUE_LIMIT) -> Forest | None:
    """Fit on metric rows identified by `keys`; None below the least number of rows."""
    rows = cut(rows.select(*keys, *FEATURES))
    total = rows.count()
    if total < MIN_ROWS:
        return None
    by_feature = {r["feature"]: r for r in scaling(rows).collect()}      # five rows
    means = tuple(by_feature[f]["mean"] for f in FEATURES)
    scales = tuple(by_feature[f]["scale"] for f in FEATURES)
    sample = min(sample, total)

    # As many rows as the sample holds, by draw; ties go by key.
    place = F.row_number().over(Window.partitionBy("tree").orderBy("draw", *keys))
    offered = _tree_samples(_scaled(rows, means, scales), keys, total, trees, sample)
    # A stated number, as the samples are small and growing them is not: adaptive execution would merge all into a task or two.
    spread = min(trees, rows.sparkSession.sparkContext.defaultParallelism)
    samples = offered.repartition(spread, "tree").withColumn("_place", place).filter(F.col("_place") <= sample)
    nodes = cut(_grown(samples, math.ceil(math.log2(max(sample, 2)))))
    forest = Forest(nodes, means, scales, sample)
    scored = isolation_scores(rows, forest).withColumn("_all", F.lit(1))
    border = grouped_quantiles(scored, ["_all"], "iso_score", (1 - contamination,), ("border",), group_limit)
    return Forest(nodes, means, scales, sample, border.first()["border"])


def _node_arrays(nodes: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Dense per-tree arrays: feature, split, first child and path length of every node.

    A leaf is its own child and has an infinite split, so a walk may take spare steps.
    """
    shape = (int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1)
    feature, split, length = np.zeros(shape, dtype=np.int64), np.full(shape, np.inf), np.zeros(shape)
    child = np.broadcast_to(np.arange(shape[1]), shape).copy()
    tree, node, inner = nodes["tree"].to_numpy(), nodes["node"].to_numpy(), nodes["feature"].to_numpy() >= 0
    at = (tree[inner], node[inner])
    feature[at], split[at], child[at] = nodes["feature"][inner], nodes["split"][inner], 2 * node[inner] + 1
    length[tree, node] = nodes["depth"].to_numpy() + path_correction(nodes["size"].to_numpy())
    return feature, split, child, length


def isolation_scores(rows: DataFrame, forest: Forest) -> DataFrame:
    """Add `iso_score` in [0, 1], settled to SCORE_DIGITS; higher is more isolated.

    The node table is bounded by the forest's size, so all trees travel with the function. A walk over whole Arrow batches
    takes about 16 microseconds a row; the same walk by higher-order functions in the JVM took 800.
    """
    nodes = forest.nodes.toPandas()
    arrays, levels = _node_arrays(nodes), int(nodes["depth"].max())
    norm = float(path_correction(np.array([forest.sample]))[0]) or 1.0
    scaled = [(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - m) / s
              for f, m, s in zip(FEATURES, forest.means, forest.scales)]

    @F.pandas_udf("double")
    def walk(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        feature, split, child, length = arrays
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            flat, row, total = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
            for f, s, c, path in zip(feature, split, child, length):
                node = np.zeros(len(x), dtype=np.int64)
                for _ in range(levels):
                    node = c[node] + (flat[row + f[node]] > s[node])
                total += path[node]
            yield pd.Series(np.exp2(-total / len(feature) / norm))

    # Marked so that the optimizer keeps one evaluation instead of copying it into later filters.
    return (rows.withColumn("iso_score", walk.asNondeterministic()(*scaled))
            .withColumn("iso_score", settled(F.col("iso_score"), SCORE_DIGITS)))


def isolation_verdicts(metrics: DataFrame, forest: Forest | None) -> DataFrame:
    """One verdict per metric row; without a forest every row is unflagged."""
    value = F.coalesce(F.col("avg_price").cast("double"), F.lit(0.0))
    if forest is None:
        scored = metrics.withColumn("iso_score", F.lit(None).cast("double"))
        hit = F.lit(False)
    else:
        scored = isolation_scores(metrics, forest)
        hit = F.col("iso_score") > forest.threshold
    raw = -F.col("iso_score")
    context = F.to_json(F.struct(
        F.round(raw, 6).alias("raw_isolation_score"), F.col("window_size"),
        F.struct(*[F.col(f) for f in FEATURES]).alias("features")))
    made = rules.isolation(value, hit, raw, context)
    return scored.select(*metrics.columns, "iso_score", F.inline(F.array(made)))
