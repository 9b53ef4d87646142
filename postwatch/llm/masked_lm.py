"""Scores of documents by masked pseudo-likelihood.

A small network sees two words on both sides of a place and gives a probability to every word class
there. A document's score is the sum of the log-probabilities of all its words, each predicted with
itself masked.

Word classes come from counts over all documents: the most frequent words have their own, the rest
share hashed ones, and there are more of both the more distinct words there are. A word of a shared
class has the probability of its class times its share of the class's words, from the counts of all
words. Training reads all documents too: every task trains a copy of the network on all places of its
documents, each masked once, and the copies are averaged by their number of places. Classes are
predicted in two steps, a group of classes and the class in it, so no step is wider than a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm import common
from postwatch.llm.words import words
from postwatch.session import fresh_dir

#: Own classes for each unit of the square root of the number of distinct words.
OWN_A_ROOT = 4


@dataclass(frozen=True)
class Shape:
    own: int = 1536  # words with a class of their own, at least
    shared: int = 511  # classes of other words, at least; class 0 is outside the text
    group: int = 64  # classes of a group, at least
    hidden: int = 24
    offsets: tuple[int, ...] = (-2, -1, 1, 2)
    masked_every: int = 8  # in training, a mask hides one place of so many; all masks take turns
    batch: int = 16_384
    rate: float = 0.1
    seed: int = 11

    @property
    def classes(self) -> int:
        return 1 + self.own + self.shared

    @property
    def groups(self) -> int:
        return -(-self.classes // self.group)

    def following(self, distinct: int) -> Shape:
        """This shape, or one of more classes, in about as many groups as a group has members."""
        own = max(self.own, OWN_A_ROOT * math.isqrt(distinct))
        if own == self.own:
            return self
        classes = 1 + own + own * self.shared // self.own
        group = max(self.group, math.isqrt(classes - 1) + 1)
        return replace(self, own=own, group=group, shared=-(-classes // group) * group - 1 - own)


#: The averaging of copies is cut into this many slices of the network.
SLICES = 16
FAN_IN = 64
#: Groups of places that are padded to one size, and the places of one product, at most.
ALIKE = 1.5
PADDED_PLACES = 8_192
#: Places of one product, at most, so that its rows stay in the cache.
CACHED_PLACES = 2_048
#: Runs of at most so many rows are summed row by row, all at once.
SHORT_RUN = 6
#: Words that are scored together.
SCORED_AT_ONCE = 32_768


class Network:
    """Embeddings for each offset, their tanh'd sum, and a two-step softmax, in one flat array.

    The biases of a softmax lie behind its weights as one more row, ``steps`` has both together: a
    hidden value that is always one adds them in the product and gets their slopes from it.
    """

    def __init__(self, shape: Shape, flat: np.ndarray | None = None):
        self.shape = shape
        v, h, g, m = shape.classes, shape.hidden, shape.groups, shape.group
        sizes = {"embedding": (len(shape.offsets), v, h), "bias": (h,), "groups": (h + 1, g),
                 "members": (g, h + 1, m)}
        total = sum(int(np.prod(x)) for x in sizes.values())
        if flat is None:
            flat = np.zeros(total, np.float32)
        self.flat, self.parts, at = flat, {}, 0
        for name, size in sizes.items():
            self.parts[name] = flat[at: at + int(np.prod(size))].reshape(size)
            at += int(np.prod(size))
        self.steps = {name: self.parts[name] for name in ("groups", "members")}
        for name, held in self.steps.items():
            self.parts[name], self.parts[f"{name}_bias"] = held[..., :h, :], held[..., h, :]

    @classmethod
    def drawn(cls, shape: Shape, frequency: np.ndarray | None = None) -> Network:
        """A network at the start of training, which gives classes the shares that they have in
        ``frequency``, so that no steps are spent on learning these."""
        net, draw = cls(shape), np.random.default_rng(shape.seed)
        for name in ("embedding", "groups", "members"):
            net.parts[name][...] = draw.normal(0, 0.1, net.parts[name].shape)
        if frequency is not None:
            counts = np.ones(shape.groups * shape.group)
            counts[: len(frequency)] += frequency
            counts = counts.reshape(shape.groups, shape.group)
            net.parts["groups_bias"][...] = np.log(counts.sum(1) / counts.sum())
            net.parts["members_bias"][...] = np.log(counts / counts.sum(1, keepdims=True))
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """Of (n, offsets) classes; the last value is one."""
        p = self.parts
        total = p["embedding"][0].take(context[:, 0], 0)
        for i in range(1, context.shape[1]):
            total += p["embedding"][i].take(context[:, i], 0)
        total += p["bias"]
        out = np.ones((len(total), self.shape.hidden + 1), total.dtype)
        np.tanh(total, out=out[:, :-1])
        return out

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order = sorted_places(target, self.shape.classes)
        hidden = self.hidden(context.take(order, 0))
        group, member = np.divmod(target[order], self.shape.group)
        found = np.empty(len(target), hidden.dtype)
        for at in pieces(len(target)):
            found[at] = chosen_log(hidden[at] @ self.steps["groups"], group[at])
        for numbers, rows, filled in padded(group):
            weights = self.steps["members"][numbers]
            for at in pieces(rows.shape[1], len(rows)):
                inside = np.matmul(hidden.take(rows[:, at], 0), weights)
                logs = chosen_log(inside.reshape(-1, self.shape.group), member[rows[:, at]].ravel())
                kept = np.flatnonzero(filled[:, at])
                found[rows[:, at].ravel()[kept]] += logs[kept]
        out = np.empty_like(found)
        out[order] = found
        return out

    def train(self, context: np.ndarray, target: np.ndarray, squares: Network) -> None:
        """One step of AdaGrad on a batch.

        Places are sorted by class, so those of a group are a slice, and each part of the network is
        moved once for all of its rows that the batch touches. Products are over pieces of the batch
        that stay in the processor's cache.
        """
        p, shape, rate = self.parts, self.shape, self.shape.rate
        order = sorted_places(target, shape.classes)
        context = context.take(order, 0)
        n, hidden = len(target), self.hidden(context)
        group, member = np.divmod(target[order], shape.group)
        back = np.empty((n, shape.hidden), hidden.dtype)
        slope = np.zeros_like(self.steps["groups"])
        for at in pieces(n):
            error = surplus(hidden[at] @ self.steps["groups"], group[at])
            np.matmul(error, p["groups"].T, out=back[at])
            slope += hidden[at].T @ error
        descend(self.steps["groups"], squares.steps["groups"], slice(None), slope / n, rate)
        for numbers, rows, filled in padded(group):
            # (groups, places of a group, hidden or member); places that only pad have no error.
            weights = self.steps["members"][numbers]
            slope = np.zeros_like(weights)
            for at in pieces(rows.shape[1], len(rows)):
                some = rows[:, at].ravel()
                own = hidden.take(rows[:, at], 0)
                inside = np.matmul(own, weights)
                flat = surplus(inside.reshape(-1, shape.group), member[some])
                flat[np.flatnonzero(~filled[:, at])] = 0
                inside = flat.reshape(inside.shape)
                slope += np.matmul(own.transpose(0, 2, 1), inside)
                kept = np.flatnonzero(filled[:, at])
                found = np.matmul(inside, weights[:, :-1].transpose(0, 2, 1)).reshape(-1, shape.hidden)
                back[some[kept]] += found.take(kept, 0)
            descend(self.steps["members"], squares.steps["members"], numbers, slope / n, rate)
        values = hidden[:, :-1]
        back *= 1 - values * values
        back /= n
        descend(p["bias"], squares.parts["bias"], slice(None), back.sum(0), rate)
        for i in range(context.shape[1]):
            order = sorted_places(context[:, i], shape.classes)
            ids = context[order, i]
            heads = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            descend(p["embedding"][i], squares.parts["embedding"][i], ids[heads],
                    sums_of_runs(back, order, heads), rate)


def descend(part: np.ndarray, squares: np.ndarray, at, slope: np.ndarray, rate: float) -> None:
    """Move the rows ``at``, each once, against their slope."""
    held = squares[at] if isinstance(at, slice) else squares.take(at, 0)
    held = held + slope * slope
    squares[at] = held
    np.sqrt(held, out=held)
    held += 1e-8
    slope = slope / held
    slope *= rate
    part[at] -= slope


def pieces(places: int, each: int = 1) -> Iterator[slice]:
    """Slices of ``each`` times as many places, of at most about ``CACHED_PLACES``."""
    step = max(1, CACHED_PLACES // each)
    for start in range(0, places, step):
        yield slice(start, start + step)


def sums_of_runs(values: np.ndarray, order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of ``values[order]`` over the runs that start at ``heads``.

    Most runs are short: their first, second, ... rows are added for all of them at once.
    """
    sizes = np.diff(np.append(heads, len(order)))
    out = values.take(order[heads], 0)
    short = sizes <= SHORT_RUN
    for place in range(1, SHORT_RUN):
        runs = np.flatnonzero(short & (sizes > place))
        out[runs] += values.take(order[heads[runs] + place], 0)
    runs = np.flatnonzero(~short)
    if len(runs):
        starts = np.cumsum(sizes[runs]) - sizes[runs]
        out[runs] = np.add.reduceat(values.take(order[np.repeat(~short, sizes)], 0), starts)
    return out


def sorted_places(classes: np.ndarray, most: int) -> np.ndarray:
    """Places in the order of their classes; narrow integers are sorted by radix."""
    return np.argsort(classes.astype(np.uint16) if most < 1 << 16 else classes, kind="stable")


def exponentials(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values``, less the greatest of all if that is large, their exponentials and the sums of rows.

    A row so far below the others that its sum would vanish is taken from its own greatest value.
    """
    most = values.max() if values.size else 0
    if abs(most) > 40:  # exponentials of less neither overflow nor vanish
        values -= most
    found = np.exp(values)
    total = found @ np.ones(values.shape[1], values.dtype)
    low = np.flatnonzero(total < 1e-25)
    if len(low):
        values[low] -= values[low].max(1, keepdims=True)
        found[low] = np.exp(values[low])
        total[low] = found[low].sum(1)
    return found, total


def surplus(values: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The softmax of each row, less one in its column: the slope of the loss by ``values``."""
    found, total = exponentials(values)
    found *= (1 / total)[:, None]
    found[np.arange(len(columns)), columns] -= 1
    return found


def chosen_log(values: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax of each row in its column."""
    _, total = exponentials(values)
    return values[np.arange(len(columns)), columns] - np.log(total)


def padded(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of a sorted array in sets of about equal size: ``(numbers, rows, filled)``.

    ``rows`` has a line of places for each group, padded with its first place where ``filled`` is not
    set. Sizes of a set differ by less than a factor of ``ALIKE``, so padding costs little, and one
    product serves all groups of a set.
    """
    if not len(group):
        return
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(heads, len(group)))
    kinds = np.ceil(np.log(sizes) / np.log(ALIKE)).astype(np.int64)
    for kind in np.unique(kinds).tolist():
        of = np.flatnonzero(kinds == kind)
        step = max(1, PADDED_PLACES // int(sizes[of].max()))
        for start in range(0, len(of), step):
            some = of[start: start + step]
            place = np.arange(int(sizes[some].max()))
            filled = place < sizes[some, None]
            yield group[heads[some]], heads[some, None] + np.where(filled, place, 0), filled


class Vocabulary:
    """Classes of word hashes: 0 outside a text, then frequent words, then hashed classes.

    ``path`` is where the counts of all words are, and ``totals`` has the sum of a shared class's.
    ``numbers`` are the counts of the frequent words.
    """

    def __init__(self, frequent: list[int], shape: Shape, path: str, numbers: list[int] | None = None):
        self.shape, self.path = shape, path
        self.totals = np.zeros(shape.classes)
        self.frequency = np.zeros(shape.classes)
        self.frequency[1: 1 + len(numbers or ())] = numbers or ()
        held = np.array(frequent, np.int64).view(np.uint64)
        self.own = common.Lookup(halved(held), 1 + np.arange(len(held)), missing=0)

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        out = self.own.find(halved(hashes))
        rest = np.flatnonzero(out == 0)
        out[rest] = 1 + self.shape.own + (
            common.mix(hashes[rest]) % np.uint64(self.shape.shared)).astype(np.int64)
        return out

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("word long, n long").parquet(self.path)


def halved(hashes: np.ndarray) -> np.ndarray:
    """Hashes of words, which are odd, as non-negative keys."""
    return (hashes >> np.uint64(1)).view(np.int64)


def laid_out(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all words, padded around each text, the places of words and their texts."""
    return hashed(texts, vocabulary)[:3]


def hashed(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """What ``laid_out`` gives, and the hashes of the words."""
    data, offsets = common.ragged(texts)
    hashes, starts = words(data, offsets)
    pad = max(map(abs, vocabulary.shape.offsets))
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    places = np.arange(len(hashes)) + pad * (owner + 1)
    sequence = np.zeros(len(hashes) + pad * len(starts), np.int64)
    sequence[places] = vocabulary.classes(hashes)
    return sequence, places, owner, hashes


def context_of(sequence: np.ndarray, places: np.ndarray, shape: Shape) -> np.ndarray:
    return np.stack([sequence[places + offset] for offset in shape.offsets], 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: how often each word hash stands in all documents."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            hashes, _ = words(*common.ragged(block.column("text")))
            found, count = np.unique(hashes, return_counts=True)
            yield common.record_batch(schema, [found.view(np.int64), count])

    return (common.documents(docs).mapInArrow(run, "word long, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary_of(docs: DataFrame, shape: Shape = Shape()) -> Vocabulary:
    spark = docs.sparkSession
    path = f"{fresh_dir(spark, 'words')}/counts"
    word_counts(docs).write.parquet(path)
    counts = spark.read.schema("word long, n long").parquet(path)
    shape = shape.following(counts.count())
    top = counts.orderBy(F.desc("n"), "word").limit(shape.own).select("word", "n").collect()
    vocabulary = Vocabulary([row[0] for row in top], shape, path, [row[1] for row in top])
    held = spark.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("class", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = held.value.classes(batch.column("word").to_numpy().view(np.uint64))
            found, at = np.unique(classes, return_inverse=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, at, batch.column("n").to_numpy())
            shared = found > shape.own
            yield common.record_batch(schema, [found[shared], sums[shared]])

    for row in counts.mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n")).collect():
        vocabulary.totals[row[0]] = vocabulary.frequency[row[0]] = row[1]
    return vocabulary


def masks(places: np.ndarray, shape: Shape, seed: int) -> Iterator[np.ndarray]:
    """Batches of places to mask: every place once, those of one mask in random order."""
    draw = np.random.default_rng(seed)
    for first in draw.permutation(shape.masked_every).tolist():
        masked = draw.permutation(places[first:: shape.masked_every])
        for start in range(0, len(masked), shape.batch):
            yield masked[start: start + shape.batch]


def train(docs: DataFrame, vocabulary: Vocabulary) -> Network:
    """The average of the networks that all tasks train, weighted by the places they saw."""
    shape, spark = vocabulary.shape, docs.sparkSession
    schema = pa.schema([("part", pa.int32()), ("slice", pa.int32()), ("places", pa.float64()),
                        ("weights", pa.binary())])
    held = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, squares, seen = Network.drawn(shape, held.value.frequency), Network(shape), 0
        part = TaskContext.get().partitionId()
        for number, block in enumerate(common.blocks(batches)):
            sequence, places, _ = laid_out(block.column("text"), held.value)
            for at in masks(places, shape, part * 1_000_003 + number):
                net.train(context_of(sequence, at, shape), sequence[at], squares)
            seen += len(places)
        if seen:
            slices = np.array_split(net.flat, SLICES)
            yield common.record_batch(schema, [
                np.full(SLICES, part, np.int32), np.arange(SLICES, dtype=np.int32),
                np.full(SLICES, float(seen)), [x.tobytes() for x in slices]])

    def add(group: pa.Table) -> pa.Table:
        places = group.column("places").to_pylist()
        total = 0.0
        for share, weights in zip(places, group.column("weights"), strict=True):
            total = total + share * np.frombuffer(weights.as_py(), np.float32).astype(np.float64)
        mean = (total / sum(places)).astype(np.float32)
        return pa.table({
            "part": pa.array([0], pa.int32()), "slice": group.column("slice").slice(0, 1),
            "places": pa.array([sum(places)], pa.float64()),
            "weights": pa.array([mean.tobytes()], pa.binary())}, schema=schema)

    columns = "part int, slice int, places double, weights binary"
    copies = common.documents(docs).mapInArrow(run, columns)
    # Averages of at most FAN_IN copies at first, then of those averages.
    partial = copies.groupBy("slice", F.floor(F.col("part") / FAN_IN).alias("some")).applyInArrow(add, columns)
    rows = partial.groupBy("slice").applyInArrow(add, columns).orderBy("slice").collect()
    if not rows:
        return Network.drawn(shape, vocabulary.frequency)
    return Network(shape, np.concatenate([np.frombuffer(row.weights, np.float32) for row in rows]))


def score(docs: DataFrame, vocabulary: Vocabulary, network: Network) -> DataFrame:
    """``(doc_id, n_words, log_likelihood, mean_log_likelihood)`` of every whole text.

    The sum and the mean of the natural log-probabilities of its words, one row for each row. Null
    texts and texts without words have no words, a sum of 0 and a null mean. Repeated rows and null
    ids pass through; other columns are not read. A word that was not counted has the share of one
    that was counted once. Rows are written once, numbered by task and place, and those of their
    words that share classes meet the counts by a join.
    """
    spark = docs.sparkSession
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("part", pa.float64()), ("rare", pa.list_(pa.int64()))])
    held: Broadcast = spark.sparkContext.broadcast((vocabulary, network.flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = held.value
        net, less = Network(known.shape, flat), np.log(np.maximum(known.totals, 1))
        row = TaskContext.get().partitionId() << 40
        for block in common.blocks(batches, limit=500_000):
            sequence, places, owner, hashes = hashed(block.column("text"), known)
            each = np.zeros(len(places))
            for start in range(0, len(places), SCORED_AT_ONCE):
                at = places[start: start + SCORED_AT_ONCE]
                each[start: start + len(at)] = net.log_probabilities(
                    context_of(sequence, at, known.shape), sequence[at])
            each -= less[sequence[places]]
            n = block.num_rows
            rare = sequence[places] > known.shape.own
            bounds = np.concatenate(([0], np.cumsum(np.bincount(owner[rare], minlength=n))))
            yield common.record_batch(schema, [
                np.arange(row, row + n), block.column("doc_id"), np.bincount(owner, minlength=n),
                np.bincount(owner, each, minlength=n),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), hashes[rare].view(np.int64))])
            row += n

    columns = "row long, doc_id long, n_words long, part double, rare array<long>"
    path = f"{fresh_dir(spark, 'scores')}/rows"
    common.documents(docs).mapInArrow(run, columns).write.parquet(path)
    rows = spark.read.schema(columns).parquet(path)
    shares = (rows.select("row", F.explode("rare").alias("word")).join(vocabulary.counts(spark), "word")
              .groupBy("row").agg(F.sum(F.log("n")).alias("share")))
    total = F.col("part") + F.coalesce("share", F.lit(0.0))
    return rows.join(shares, "row", "left").select(
        "doc_id", "n_words", total.alias("log_likelihood"),
        F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood"))


def pseudo_likelihood(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Count words, train on and score all rows of ``docs``."""
    vocabulary = vocabulary_of(docs, shape)
    return score(docs, vocabulary, train(docs, vocabulary))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(common.table(spark, sf_dir, "documents"))
