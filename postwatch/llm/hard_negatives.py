"""Hard negatives of anchors, by bounds along a spanning tree of the anchors.

Anchors close to each other score a candidate alike: scores differ by at most the distance of the
anchors times the candidate's norm. Anchors are joined into minimum spanning trees of bounded size.
Down a tree every candidate has an interval that holds its score, exact at the root; only candidates
whose interval meets what an anchor looks for (the window of its positives, or more than its weakest
positive so far) are scored again, and their intervals become exact.

Anchors are a stated query set. A bounded share of them goes to all tasks at a time, and the table of
candidates is read twice for each: for the positives, and for the negatives in their windows. A
task sends on no more than the best few of each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postwatch.llm import common
from postwatch.session import fresh_dir

POSITIVES, NEGATIVES = 5, 3
#: A negative scores at least and at most these hundredths of its positive.
LOW, HIGH = 50, 95
#: An entry c counts as the integer floor(SCALE * c).
SCALE = 256
#: Anchors of one tree, about; bytes of anchors that go to all tasks at a time; candidates at once.
TREE_ANCHORS = 2_048
SHARED_BYTES = 64_000_000
BLOCK_ROWS = 8_192
#: Pairs for which a task is worth starting, and rows of a task of a large table.
TASK_PAIRS = 5_000_000
TASK_ROWS = 50_000
EXACT_FLOAT, FITS = 2.0**53, 2.0**62
#: Relative room for rounding in the bounds, which are floating-point numbers.
ROOM = 1e-9


def usable(rows: DataFrame, relabel: Column | None = None) -> DataFrame:
    """``(vec_id, label, x array<long>)`` of the rows that take part.

    Rows without an id or a label, without a vector or with null or non-finite entries do not, nor do
    rows whose vector is not as long as most are (of equally common lengths the longest counts) or
    empty. An entry too large for 64 bits is an error.
    """
    infinite = float("inf")
    held = rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
             & (F.size("v") > 0)
             & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite)))
    usual = (held.groupBy(F.size("v").alias("d")).count()
             .orderBy(F.desc("count"), F.desc("d")).first())
    return held.filter(F.size("v") == (usual["d"] if usual else 0)).select(
        "vec_id", (F.col("label") if relabel is None else relabel).cast("bigint").alias("label"),
        F.transform("v", lambda c: F.floor(c * SCALE).cast("bigint")).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


# --- trees -----------------------------------------------------------------------------------------


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, parent, edge)``: nodes of a minimum spanning tree from its root down, each one's
    parent by its place in that order (-1 for the root) and the distance to it.

    Of a node's children the one with the largest subtree comes last, so that few nodes at a time
    wait for children.
    """
    count = len(points)
    held = points.astype(np.float64)
    nearest = np.full(count, np.inf)
    above = np.full(count, -1)
    joined, found = np.zeros(count, bool), []
    at = 0
    for _ in range(count):
        joined[at] = True
        found.append(at)
        away = ((held - held[at]) ** 2).sum(1)
        closer = ~joined & (away < nearest)
        nearest[closer], above[closer] = away[closer], at
        at = int(np.where(joined, np.inf, nearest).argmin())
    below: list[list[int]] = [[] for _ in range(count)]
    weight = np.ones(count, np.int64)
    for node in reversed(found[1:]):
        below[above[node]].append(node)
        weight[above[node]] += weight[node]
    order, place, stack = [], np.zeros(count, np.int64), found[:1]
    while stack:
        node = stack.pop()
        place[node] = len(order)
        order.append(node)
        stack += sorted(below[node], key=lambda x: -weight[x])
    chosen = np.array(order, np.int64)
    parent = np.where(above[chosen] < 0, -1, place[above[chosen]])
    return chosen, parent, np.sqrt(np.where(parent < 0, 0, nearest[chosen]))


TREE_SCHEMA = ("g int, at int, parent int, edge double, vec_id long, label long, copies long, "
               "x array<long>")


def forest(anchors: DataFrame, count: int) -> DataFrame:
    """Distinct anchors in trees ``g``: place, parent's place, edge, and how often each row occurs."""
    trees = max(ceil(count / TREE_ANCHORS), 1)

    def grow(table: pa.Table) -> pa.Table:
        order, parent, edge = spanning_tree(matrix(table.column("x")))
        table = table.take(pa.array(order))
        return pa.table({
            "g": table.column("g").cast(pa.int32()), "at": pa.array(range(len(order)), pa.int32()),
            "parent": pa.array(parent, pa.int32()), "edge": pa.array(edge),
            **{name: table.column(name) for name in ("vec_id", "label", "copies", "x")}})

    return (anchors.groupBy("vec_id", "label", "x").agg(F.count("*").alias("copies"))
            .withColumn("g", F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(trees)))
            .groupBy("g").applyInArrow(grow, TREE_SCHEMA))


class Anchors:
    """Trees of anchors, one after the other, as arrays; ``first`` is the number of the first one."""

    def __init__(self, table: pa.Table):
        self.ids, self.labels = (np.asarray(table.column(x), np.int64) for x in ("vec_id", "label"))
        self.x = matrix(table.column("x"))
        tree = np.asarray(table.column("g"))
        begins = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
        offset = np.repeat(begins, np.diff(np.append(begins, len(tree))))
        parent = np.asarray(table.column("parent"), np.int64)
        self.parent = np.where(parent < 0, -1, parent + offset)
        self.edge = np.asarray(table.column("edge")) * (1 + ROOM)
        self.last_child = np.full(len(tree), -1)
        child = np.flatnonzero(self.parent >= 0)
        np.maximum.at(self.last_child, self.parent[child], child)
        self.most = float(np.abs(self.x).max())
        self.floats = self.x.astype(np.float64)
        self.norms = np.sqrt((self.floats**2).sum(1))


class Block:
    """Candidates of one block with exact scores on demand."""

    def __init__(self, batch: pa.RecordBatch, anchors: Anchors):
        self.ids, self.labels = (np.asarray(batch.column(x), np.int64) for x in ("vec_id", "label"))
        self.x = matrix(batch.column("x"))
        self.anchors = anchors
        most = float(np.abs(self.x).max()) * anchors.most * self.x.shape[1]
        self.floats = self.x.astype(np.float64)
        self.norms = np.sqrt((self.floats**2).sum(1)) * (1 + ROOM)
        self.kind = float if most < EXACT_FLOAT else int if most < FITS else object
        self.held = self.floats if self.kind is float else self.x.astype(self.kind)

    def score(self, anchor: int, rows: np.ndarray | None) -> np.ndarray:
        point = self.anchors.floats[anchor] if self.kind is float else self.anchors.x[anchor].astype(self.kind)
        found = (self.held if rows is None else self.held[rows]) @ point
        if self.kind is object:
            if max(map(abs, found), default=0) >= FITS:
                raise OverflowError("a score does not fit 64 bits")
            found = found.astype(np.int64)
        return found

    def walk(self, low: np.ndarray, high: np.ndarray, alike: bool) -> Iterator[tuple]:
        """``(anchor, rows, scores)`` of candidates of the anchor's label (or of others) whose interval
        meets what it looks for. ``low`` and ``high`` may change between steps."""
        anchors, held = self.anchors, {}
        for at, up in enumerate(anchors.parent.tolist()):
            wanted = (self.labels == anchors.labels[at]) == alike
            if up < 0:
                scores = self.score(at, None)
                least, most = scores.astype(np.float64), scores.astype(np.float64)
                rows = np.flatnonzero(wanted)
                scores = scores[rows]
            else:
                away = anchors.edge[at] * self.norms
                above = held[up]
                least, most = above[0] - away, above[1] + away
                if at == anchors.last_child[up]:
                    del held[up]
                rows = np.flatnonzero(wanted & (most >= low[at]) & (least <= high[at]))
                if 4 * len(rows) > len(wanted):  # most of them: one product without copying rows
                    scores = self.score(at, None)
                    least, most = scores.astype(np.float64), scores.astype(np.float64)
                    scores = scores[rows]
                else:
                    scores = self.score(at, rows)
                    least[rows] = most[rows] = scores
            if anchors.last_child[at] >= 0:
                if self.kind is not float:  # scores were rounded
                    room = ROOM * anchors.norms[at] * self.norms + 1
                    least, most = least - room, most + room
                held[at] = least, most
            yield at, rows, scores


def best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` by falling score, then id."""
    rows = np.arange(len(scores))
    if len(rows) > 8 * count:
        rows = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
    return rows[np.lexsort((ids[rows], -scores[rows]))[:count]]


class Leaders:
    """The best few candidates of each of many lists."""

    def __init__(self, lists: int, count: int):
        self.count = count
        self.scores = np.zeros((lists, count), np.int64)
        self.ids = np.zeros((lists, count), np.int64)
        self.own = np.zeros((lists, count), bool)
        self.filled = np.zeros(lists, np.int64)

    def add(self, at: int, scores, ids, own) -> None:
        n = self.filled[at]
        scores = np.concatenate((self.scores[at, :n], scores.astype(np.int64)))
        ids, own = np.concatenate((self.ids[at, :n], ids)), np.concatenate((self.own[at, :n], own))
        rows = best(scores, ids, self.count)
        self.filled[at] = n = len(rows)
        self.scores[at, :n], self.ids[at, :n], self.own[at, :n] = scores[rows], ids[rows], own[rows]

    def weakest(self, at: int) -> float:
        """What a candidate must reach: nothing while there is room."""
        return float(self.scores[at, -1]) if self.filled[at] == self.count else -np.inf


def rows_of(leaders: Leaders, width: int) -> Iterator[pa.RecordBatch]:
    """``(anchor, k, score, id, own)`` rows; list number = anchor x width + k."""
    place = np.arange(leaders.count)
    for start in range(0, len(leaders.filled), 4_096):
        part = slice(start, start + 4_096)
        lists, at = np.nonzero(place < leaders.filled[part, None])
        whole = lists + start
        yield common.record_batch(LEADERS, [
            whole // width, whole % width, leaders.scores[part][lists, at],
            leaders.ids[part][lists, at], leaders.own[part][lists, at]])


LEADERS = pa.schema([("anchor", pa.int32()), ("k", pa.int32()), ("score", pa.int64()),
                     ("id", pa.int64()), ("own", pa.bool_())])
LEADERS_DDL = "anchor int, k int, score long, id long, own boolean"


def candidate_blocks(batches: Iterator[pa.RecordBatch], anchors: Anchors) -> Iterator[Block]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            yield Block(batch.slice(start, BLOCK_ROWS), anchors)


def positives_of(candidates: DataFrame, shared, count: int) -> DataFrame:
    """``(anchor, k, score, id)``: the first ``count`` other rows of each anchor's label, k from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        size = len(anchors.ids)
        leaders = Leaders(size, count + 1)  # one may be the anchor itself
        low, high = np.full(size, -np.inf), np.full(size, np.inf)
        for block in candidate_blocks(batches, anchors):
            for at, rows, scores in block.walk(low, high, alike=True):
                rows = rows[reached := scores >= low[at]]
                if len(rows):
                    ids = block.ids[rows]
                    own = ids == anchors.ids[at]
                    if own.any():
                        own &= (block.x[rows] == anchors.x[at]).all(1)
                    leaders.add(at, scores[reached], ids, own)
                    low[at] = leaders.weakest(at)
        yield from rows_of(leaders, 1)

    found = candidates.mapInArrow(run, LEADERS_DDL)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", F.desc("own"))
    ranked = found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= count + 1)
    itself = F.min(F.when(F.col("own"), F.col("k"))).over(Window.partitionBy("anchor"))
    ranked = ranked.withColumn("itself", itself).filter(
        F.col("itself").isNull() | (F.col("k") != F.col("itself")))
    return ranked.select(
        "anchor", (F.col("k") - F.coalesce((F.col("k") > F.col("itself")).cast("int"), F.lit(0)) - 1)
        .cast("int").alias("k"), "score", "id").filter(F.col("k") < count)


def negatives_of(candidates: DataFrame, shared, windows, width: int, count: int) -> DataFrame:
    """``(anchor, k, score, id, rank)``: the first ``count`` rows of other labels in each window.

    ``windows`` shares two arrays of the least and the greatest score, by anchor and k.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        least, most = windows.value
        leaders = Leaders(least.size, count)
        floor = least.astype(np.float64)  # rises with the weakest of a full list
        low, high = floor.min(1), most.max(1).astype(np.float64)
        for block in candidate_blocks(batches, anchors):
            for at, rows, scores in block.walk(low, high, alike=False):
                if not len(rows):
                    continue
                for k in range(width):
                    chosen = np.flatnonzero((scores >= floor[at, k]) & (scores <= most[at, k]))
                    if len(chosen):
                        held = at * width + k
                        leaders.add(held, scores[chosen], block.ids[rows[chosen]], np.zeros(len(chosen), bool))
                        floor[at, k] = max(floor[at, k], leaders.weakest(held))
                low[at] = floor[at].min()
        yield from rows_of(leaders, width)

    order = Window.partitionBy("anchor", "k").orderBy(F.desc("score"), "id")
    return (candidates.mapInArrow(run, LEADERS_DDL).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= count).select("anchor", "k", "score", "id", "rank"))


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of the rows of :func:`usable` that ``is_anchor`` names, against all rows.

    ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each anchor
    and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of other
    labels whose score s has ``low * positive_score <= 100 * s <= high * positive_score``. Every row
    counts: a repeated anchor gives its rows again and has its copy as a positive, and a repeated
    candidate takes several places. No anchors, or no rows, give none. Runs jobs; each share of the
    anchors is finished in a table of the shared folder before the next.
    """
    spark = rows.sparkSession
    path = fresh_dir(spark, "negatives")
    rows.write.parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/rows")
    total, asked = held.agg(F.count("*"), F.count_if(is_anchor)).first()
    forest(held.filter(is_anchor), asked).write.parquet(f"{path}/forest")
    trees = spark.read.parquet(f"{path}/forest")
    tasks = min(ceil(total * asked / TASK_PAIRS), max(16, ceil(total / TASK_ROWS)))
    candidates = held.repartition(max(tasks, 1))
    sizes = trees.groupBy("g").agg(F.sum(F.size("x") * 16).alias("bytes")).orderBy("g").collect()
    shares: list[list[int]] = []
    room = 0
    for tree in sizes:
        if not shares or room < tree["bytes"]:
            shares.append([])
            room = SHARED_BYTES
        shares[-1].append(tree["g"])
        room -= tree["bytes"]
    out = [_mined(spark, candidates, trees, share, (positives, negatives, low, high), f"{path}/share-{i}")
           for i, share in enumerate(shares)]
    if not out:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*out)


RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
          "negative_score long")


def _mined(spark, candidates, trees, share, numbers, path: str) -> str:
    """The result for some trees of anchors, as a table."""
    positives, negatives, low, high = numbers
    chosen = trees.filter(F.col("g").between(share[0], share[-1])).orderBy("g", "at").toArrow()
    anchors = Anchors(chosen)
    shared = spark.sparkContext.broadcast(anchors)
    positives_of(candidates, shared, positives).write.parquet(f"{path}-positives")
    friends = spark.read.parquet(f"{path}-positives")
    found = friends.toArrow()
    least = np.full((len(anchors.ids), positives), np.iinfo(np.int64).max)
    most = np.full(least.shape, np.iinfo(np.int64).min)
    anchor, k = np.asarray(found.column("anchor")), np.asarray(found.column("k"))
    for a, b, score in zip(anchor.tolist(), k.tolist(), found.column("score").to_pylist(), strict=True):
        least[a, b], most[a, b] = -(-low * score // 100), high * score // 100
    windows = spark.sparkContext.broadcast((least, most))
    names = spark.createDataFrame(pa.table({
        "anchor": pa.array(range(len(anchors.ids)), pa.int32()), "anchor_id": pa.array(anchors.ids),
        "copies": chosen.column("copies")}))
    (negatives_of(candidates, shared, windows, positives, negatives)
     .withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
     .join(friends.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}), ["anchor", "k"])
     .join(names, "anchor")
     .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
     .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
             "positive_score", "negative_score").write.parquet(path))
    return path


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(common.table(spark, sf_dir, "embeddings"), shifted)
    return mine(rows, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH held AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
         CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NOT NULL AND NOT isnan(c) AND NOT isinf(c)))
        = len(embedding)
), numbered AS (
  SELECT *, row_number() OVER () AS r FROM held
), scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS alike,
         CAST(list_dot_product(CAST(a.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM numbered a JOIN numbered c ON a.r <> c.r AND a.vec_id % 50 = 0
), positive AS (
  SELECT a, anchor_id, id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k
  FROM scored WHERE alike QUALIFY k <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.id) AS n
  FROM positive p JOIN scored s ON s.a = p.a AND NOT s.alike
   AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE n <= 3
"""
