"""Gradient boosting of Spark ML's kind, on rows of a byte per feature.

Spark's own fit keeps some 200 bytes of objects for each training row, twice; beyond the memory of the
executors every pass over them is read from disk again. Here a row is the number of its bin for each
feature, its label and its margin so far (17 bytes), in blocks of numpy arrays. The method and the model are Spark's: bins between the same thresholds, regression
trees on the residuals of the logistic loss, variance as impurity. A pass sends one histogram per task to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession

from .split import checkpointed, ensure_checkpoint_dir

#: Bins of a feature, as Spark's default; rows that find the thresholds; rows of a block; trees between checkpoints.
BINS, SAMPLE, BLOCK, EVERY = 32, 10_000, 100_000, 10
_EPSILON = 2.0**-52
#: Rows of a block that are counted together.
_CACHED = 16_384


class Node(NamedTuple):
    count: float
    total: float
    squares: float
    gain: float = 0.0
    feature: int = -1
    bin: int = -1

    @property
    def mean(self) -> float:
        return self.total / self.count

    @property
    def impurity(self) -> float:
        return (self.squares - self.total * self.total / self.count) / self.count


#: A tree: nodes by their place in a heap.
Tree = dict[int, Node]


def thresholds(values: np.ndarray, expected: float) -> np.ndarray:
    """Cuts between bins of about equal weight. As in Spark, zeros are what the ``expected`` rows have besides the other values."""
    distinct, counts = np.unique(values[values != 0.0], return_counts=True)
    counts = counts.astype(float)
    zeros = expected - counts.sum()
    if zeros > _EPSILON * len(values) * 100:
        at = int(np.searchsorted(distinct, 0.0))
        distinct, counts = np.insert(distinct, at, 0.0), np.insert(counts, at, zeros)
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if len(distinct) <= BINS:
        return middles
    stride = expected / BINS
    cuts, target, upto = [], stride, np.cumsum(counts)
    for i in range(1, len(distinct)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            cuts.append(middles[i - 1])
            target += stride
    return np.array(cuts)


def _sampled(train: DataFrame, columns: Sequence[str], rows: int, seed: int) -> tuple[np.ndarray, float]:
    """The rows that Spark takes for its thresholds (some ``SAMPLE``), and how many it expects."""
    spark, slim = train.sparkSession, train.select(*columns)
    share = min(1.0, SAMPLE / rows)
    draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    drawn = slim._jdf.javaRDD().sample(False, share, draw)
    frame = DataFrame(spark._jsparkSession.createDataFrame(drawn, slim._jdf.schema()), spark)
    return frame.toPandas().to_numpy(dtype=float), share * rows


def _packed(train: DataFrame, columns: Sequence[str], cuts: list[np.ndarray]) -> DataFrame:
    """Blocks of rows: bins, one line per feature, and labels of -1 and 1."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def block() -> pa.RecordBatch:
            bins, labels = np.concatenate([b for b, _ in held], axis=1), np.concatenate([y for _, y in held])
            return pa.RecordBatch.from_pydict({"bins": [bins.tobytes()], "labels": [labels.tobytes()]})

        for batch in batches:
            values = [batch.column(name).to_numpy(zero_copy_only=False).astype(float) for name in columns]
            if any(np.isnan(v).any() for v in values):
                raise ValueError("a feature is missing")
            bins = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, values, strict=True)]).astype(np.uint8)
            held.append((bins, (2 * batch.column("y").to_numpy(zero_copy_only=False) - 1).astype(np.int8)))
            rows += len(batch)
            if rows >= BLOCK:
                yield block()
                held, rows = [], 0
        if rows:
            yield block()

    return train.select(*columns, "y").mapInArrow(pack, "bins binary, labels binary")


def _places(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node of a tree that each row has reached."""
    at = np.zeros(bins.shape[1], dtype=np.int16)
    for place, node in sorted(tree.items()):
        if node.feature >= 0:
            # on to 2 * place + 1, or + 2
            down = (bins[node.feature] > node.bin).astype(np.int16)
            down += np.int16(place + 1)
            down *= at == place
            at += down
    return at


def _histograms(
    bins: np.ndarray, labels: np.ndarray, margin: np.ndarray, first: bool, tree: Tree, nodes: list[int], width: int, last: bool
) -> np.ndarray:
    """By node, feature and bin: rows, and the sums of residuals and of their squares (for the first feature, and all at the ``last`` level)."""
    size = len(nodes) * width
    out = np.zeros((3, len(bins), size))
    numbers = np.full(max([*tree, *nodes]) + 1, -1, dtype=np.int16)
    numbers[nodes] = np.arange(len(nodes)) * width
    for start in range(0, len(labels), _CACHED):
        at = slice(start, start + _CACHED)
        part, y = bins[:, at], labels[at].astype(float)
        wanted = y if first else 4.0 * y / (1.0 + np.exp(2.0 * y * margin[at]))
        slot = numbers[_places(tree, part)]
        mine = slot >= 0
        if not mine.all():
            part, wanted, slot = part[:, mine], wanted[mine], slot[mine]
        squares = wanted * wanted
        for feature, line in enumerate(part):
            cell = (slot + line).astype(np.intp)
            out[0, feature] += np.bincount(cell, minlength=size)
            out[1, feature] += np.bincount(cell, wanted, size)
            if last or not feature:
                out[2, feature] += np.bincount(cell, squares, size)
    return out.reshape(3, len(bins), len(nodes), width).swapaxes(1, 2)


def _split(stats: np.ndarray, widths: list[int]) -> Node:
    """The best split of a node; the first of equal ones."""
    count, total, squares = stats[0, 0].sum(), stats[1, 0].sum(), stats[2, 0].sum()
    node = Node(count, total, squares)
    if node.impurity < _EPSILON or not any(widths):
        return node
    n, s = np.cumsum(stats[0], axis=1)[:, :-1], np.cumsum(stats[1], axis=1)[:, :-1]
    valid = (n > 0) & (n < count) & (np.arange(n.shape[1]) < np.array(widths)[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        gains = np.where(valid, (s * s / n + (total - s) ** 2 / (count - n) - total * total / count) / count, -np.inf)
    feature, cut = np.unravel_index(int(gains.argmax()), gains.shape)
    gain = float(gains[feature, cut])
    return node._replace(gain=gain, feature=int(feature), bin=int(cut)) if gain > 0 else node


def _children(stats: np.ndarray, node: Node) -> tuple[Node, Node]:
    """The leaves below a split of the last level."""
    left = Node(*stats[:, node.feature, : node.bin + 1].sum(axis=1))
    return left, Node(node.count - left.count, node.total - left.total, node.squares - left.squares)


def boosted_trees(
    train: DataFrame, columns: Sequence[str], trees: int, depth: int, rate: float, seed: int
) -> tuple[list[Tree], list[np.ndarray]]:
    """Trees on the residuals of the trees before them (the first counts whole, the others ``rate``), and the cuts of each feature."""
    spark = train.sparkSession
    rows = train.count()
    if not rows:
        raise ValueError("no rows to train on")
    sample, expected = _sampled(train, columns, rows, seed)
    cuts = [thresholds(line, expected) for line in sample.T]
    widths = [len(c) for c in cuts]
    # a sample that came out larger than expected may give a cut more
    width = max(widths) + 1
    packed = checkpointed(_packed(train, columns, cuts))
    ensure_checkpoint_dir(spark)
    shape = (len(columns), -1)

    def opened(row) -> tuple[bytes, bytes, bytes]:
        return bytes(row["bins"]), bytes(row["labels"]), np.zeros(len(row["labels"])).tobytes()

    def arrays(block: tuple[bytes, bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bins, labels, margin = block
        return np.frombuffer(bins, np.uint8).reshape(shape), np.frombuffer(labels, np.int8), np.frombuffer(margin)

    def moved(tree: Tree, weight: float):
        def move(block: tuple[bytes, bytes, bytes]) -> tuple[bytes, bytes, bytes]:
            bins, _, margin = arrays(block)
            means = np.zeros(max(tree) + 1)
            for place, node in tree.items():
                means[place] = node.mean
            return block[0], block[1], (margin + weight * means[_places(tree, bins)]).tobytes()

        return move

    def counted(state, first: bool, tree: Tree, nodes: list[int], last: bool) -> np.ndarray:
        def count(blocks) -> list[np.ndarray]:
            total = None
            for block in blocks:
                one = _histograms(*arrays(block), first, tree, nodes, width, last)
                total = one if total is None else total + one
            return [] if total is None else [total]

        # a histogram per task, some thousand numbers each
        return sum(state.mapPartitions(count).collect())

    state = packed.rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)
    before, kept, grown = None, None, []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for number in range(trees):
        tree: Tree = {}
        nodes = [0]
        for level in range(depth):
            stats = counted(state, number == 0, dict(tree), nodes, level == depth - 1)
            if before is not None:
                before.unpersist()
                before = None
            tree |= {place: _split(stats[:, i], widths) for i, place in enumerate(nodes)}
            if level == depth - 1:
                for i, place in enumerate(nodes):
                    if tree[place].feature >= 0:
                        tree[2 * place + 1], tree[2 * place + 2] = _children(stats[:, i], tree[place])
            nodes = [child for place in nodes if tree[place].feature >= 0 for child in (2 * place + 1, 2 * place + 2)]
            if not nodes:
                break
        grown.append(tree)
        if number + 1 < trees:
            before, state = state, state.map(moved(tree, rate if number else 1.0)).persist(StorageLevel.MEMORY_AND_DISK)
            if (number + 1) % EVERY == 0:
                state.checkpoint()
                state.count()
                if kept:
                    path = hadoop.Path(kept)
                    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
                kept = state.getCheckpointFile()
    state.unpersist()
    return grown, cuts


def spark_model(spark: SparkSession, grown: list[Tree], cuts: list[np.ndarray], rate: float) -> GBTClassificationModel:
    """The trees as a model of Spark ML, which scores and saves itself."""
    sc = spark.sparkContext
    jvm, array = sc._jvm, sc._gateway.new_array
    ml, double = jvm.org.apache.spark.ml, jvm.double

    def numbers(values: list[float]):
        out = array(double, len(values))
        for i, value in enumerate(values):
            out[i] = float(value)
        return out

    def node(tree: Tree, place: int):
        n = tree[place]
        stats = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(numbers([n.count, n.total, n.squares]), int(n.count))
        if n.feature < 0:
            return ml.tree.LeafNode(float(n.mean), float(n.impurity), stats)
        split = ml.tree.ContinuousSplit(n.feature, float(cuts[n.feature][n.bin]))
        children = node(tree, 2 * place + 1), node(tree, 2 * place + 2)
        return ml.tree.InternalNode(float(n.mean), float(n.impurity), float(n.gain), *children, split, stats)

    uid = lambda kind: jvm.org.apache.spark.ml.util.Identifiable.randomUID(kind)
    forest = array(ml.regression.DecisionTreeRegressionModel, len(grown))
    for i, tree in enumerate(grown):
        forest[i] = ml.regression.DecisionTreeRegressionModel(uid("dtr"), node(tree, 0), len(cuts))
    weights = numbers([1.0] + [rate] * (len(grown) - 1))
    return GBTClassificationModel(ml.classification.GBTClassificationModel(uid("gbtc"), forest, weights, len(cuts), 2))
