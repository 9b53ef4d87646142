"""Documents whose sets of word n-grams have a Jaccard similarity of at least 0.8.

Equal sets are one class. Classes meet in buckets of equal band hashes; in a bucket, signatures tell
apart what only looks alike, and what remains forms clusters. Every cluster is then compared on
full n-gram sets. Members of a bucket or cluster are dealt into blocks, and a task compares two
blocks: it gives counts and trees of links, never the pairs, so a large group of near copies is
spread over many tasks and its output grows with its members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postwatch.llm import common, shingles
from postwatch.llm.components import connected
from postwatch.llm.words import words
from postwatch.session import fresh_dir

#: Members of a block of a bucket or cluster.
BLOCK_ROWS = 256
#: Estimated similarity below which a bucket's members are not taken for candidates. For pairs of
#: 0.8, estimates from 90 hashes are that low less than once in 10 ** 11.
LIKELY = 0.5
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 4096
LOWEST = -(1 << 63)


def text_sets(texts: pa.Array) -> list[np.ndarray]:
    hashes, starts = words(*common.ragged(texts))
    return shingles.sets(hashes, starts)


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with what finds one again: the id, null as the lowest, and a hash of the text."""
    return common.documents(docs).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_key"),
        F.xxhash64("text").alias("text_key"))


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``(doc_id, doc_key, text_key, node, size, bands, signature)``; ``node`` is null without words."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("doc_key", pa.int64()), ("text_key", pa.int64()),
        ("node", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64())),
        ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = shingles.MinHash(bands, rows)
        for block in common.blocks(batches):
            node, size, hashes, signature = [], [], [], []
            for found in text_sets(block.column("text")):
                size.append(len(found))
                if not len(found):
                    node.append(None), hashes.append(None), signature.append(None)
                    continue
                best = rule.lowest(found)
                node.append(shingles.set_key(found))
                hashes.append(rule.band_hashes(best).view(np.int64))
                signature.append(rule.short(best).tobytes())
            yield common.record_batch(schema, [
                *(block.column(x) for x in ("doc_id", "doc_key", "text_key")), node, size, hashes,
                signature])

    return keyed(docs).mapInArrow(
        run, "doc_id long, doc_key long, text_key long, node binary, size long, bands array<long>, "
             "signature binary")


def dealt(members: DataFrame, key: str) -> DataFrame:
    """Members of groups ``(key, node, n, ...)`` as rows of pairs of blocks ``(key, p, q, own, ...)``.

    Each member goes to every pair of blocks that has its own; a group of one block is one pair.
    """
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    return (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
        .drop("other", "n").repartition(key, "p", "q").sortWithinPartitions(key, "p", "q", "node")
    )


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups of a sorted stream: as many as a batch ends, the last one held back."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key)
            change[1:] |= np.array(column.slice(1).to_pylist(), object) != np.array(
                column.slice(0, batch.num_rows - 1).to_pylist(), object)
        first = tuple(batch.column(key)[0].as_py() for key in keys)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        starts = np.flatnonzero(change)
        if len(starts):
            held.append(batch.slice(0, int(starts[-1])))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(int(starts[-1]) if len(starts) else 0))
        last = tuple(batch.column(key)[batch.num_rows - 1].as_py() for key in keys)
    if held:
        yield pa.Table.from_batches(held)


def group_numbers(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    change = np.zeros(table.num_rows, np.int64)
    for key in keys:
        column = np.array(table.column(key).to_pylist(), object)
        change[1:] |= column[1:] != column[:-1]
    return np.cumsum(change)


def heads(a: np.ndarray, b: np.ndarray, inside: np.ndarray, crossing: np.ndarray) -> np.ndarray:
    """The row that each row is tied to, so that ties keep what the links a - b connect.

    A block alone ties its members to the smallest of their component. Two blocks tie only those
    smallest ones, since the task of each block ties the rest: ``inside`` says which links are within
    a block, ``crossing`` which rows are of a pair of two blocks.
    """
    size = len(crossing)
    whole = shingles.components(size, a, b)
    within = shingles.components(size, a[inside], b[inside])
    return np.where(crossing & (within != np.arange(size)), np.arange(size), whole)


def likely_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees over the members of each bucket that signatures call alike."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    keys = ("bucket", "p", "q")
    for table in grouped(batches, keys):
        number = group_numbers(table, keys)
        own = table.column("own").to_numpy()
        crossing = table.column("p").to_numpy() != table.column("q").to_numpy()
        nodes = table.column("node").to_pylist()
        sign = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(
            len(nodes), -1)
        found_a, found_b = [], []
        distance, rows = 1, np.arange(len(nodes) - 1)
        while len(rows):  # all pairs of all groups, by how far apart they stand
            rows = rows[rows + distance < len(nodes)]
            rows = rows[number[rows] == number[rows + distance]]
            for start in range(0, len(rows), 20_000):
                some = rows[start: start + 20_000]
                alike = (sign[some] == sign[some + distance]).mean(1) >= LIKELY
                found_a.append(some[alike])
                found_b.append(some[alike] + distance)
            distance += 1
        if found_a:
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            head = heads(a, b, own[a] == own[b], crossing)
            tied = np.flatnonzero(head != np.arange(len(head)))
            yield common.record_batch(
                schema, [[nodes[i] for i in head[tied]], [nodes[i] for i in tied]])


def shared_counts(found: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets."""
    flat = np.concatenate(found)
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    several = count > 1  # what stands in one set only is in no intersection
    keep = several[column]
    owner, column = owner[keep], (np.cumsum(several) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(found), len(found)), np.float32)
    for start in range(0, int(several.sum()), COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        part = np.zeros((len(found), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        out += part @ part.T
    return out


def verified_links(least: float) -> Callable:
    """For each member of each pair of blocks: its links there, by documents, and what ties it."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])
    keys = ("cluster", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            number = group_numbers(table, keys)
            for start, stop in zip(*edges_of(number), strict=True):
                group = table.slice(start, stop - start)
                # A row of docs that repeats another with the same id comes twice.
                _, once = np.unique(np.array(group.column("node").to_pylist(), object),
                                    return_index=True)
                group = group.take(pa.array(once))
                found = text_sets(group.column("text").combine_chunks())
                size = np.array([len(x) for x in found], np.float64)
                shared = shared_counts(found).astype(np.float64)
                joint = size[:, None] + size[None] - shared
                alike = shared >= least * joint - 1e-9
                np.fill_diagonal(alike, False)
                own = group.column("own").to_numpy()
                crossing = group.column("p").to_numpy() != group.column("q").to_numpy()
                a, b = np.nonzero(alike)
                head = heads(a, b, own[a] == own[b], crossing)
                if crossing[0]:  # links within a block are counted by its own task
                    alike &= own[:, None] != own[None]
                links = alike @ group.column("copies").to_numpy()
                nodes = group.column("node").to_pylist()
                yield common.record_batch(schema, [[nodes[i] for i in head], nodes, links])

    return run


def edges_of(number: np.ndarray) -> tuple[list[int], list[int]]:
    heads = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    return heads.tolist(), [*heads[1:].tolist(), len(number)]


def near_duplicates(docs: DataFrame, least: float = shingles.LEAST_SIMILARITY,
                    recall: float = shingles.TARGET_RECALL) -> DataFrame:
    """``(doc_id, n_shingles, copy_id, class_id, n_links)``, one row for each row of ``docs``.

    A set holds all runs of five words (runs of letters, digits and non-ASCII characters, A to Z
    lower-cased), or all words if there are fewer. Documents are linked if their sets' Jaccard
    similarity is at least ``least``. ``copy_id`` is the smallest id with the same set, ``class_id``
    the smallest in the connected group of links, ``n_links`` the number of other documents that
    are linked directly, copies included. Null texts and texts without words are linked to
    nothing: their copy and class are their own id. Rows without an id count as documents but
    give no class its id unless no other does; then it is null. Repeated rows are copies.
    Other columns are not read. Bands are chosen so that a pair at just ``least`` is found with
    probability ``recall``; closer pairs are found more surely.
    """
    return labelled_rows(docs, least, recall).select("doc_id", "n_shingles", "copy_id", "class_id", "n_links")


def labelled_rows(docs: DataFrame, least: float, recall: float = shingles.TARGET_RECALL) -> DataFrame:
    """The rows of :func:`near_duplicates` with ``doc_key`` and ``text_key``, which find a row again, and
    ``label``, which is the same in a group and null without words."""
    spark = docs.sparkSession
    path = fresh_dir(spark, "ngrams")
    bands, rows = shingles.bands_for(least, recall)
    sketches(docs, bands, rows).write.parquet(f"{path}/sketches")
    sketch = spark.read.parquet(f"{path}/sketches").filter("node IS NOT NULL")
    nodes = sketch.groupBy("node").agg(
        F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"),
        F.min(F.struct("doc_key", "text_key")).alias("place"))

    # Buckets of several classes.
    band = sketch.select("node", F.explode("bands").alias("bucket")).distinct()
    full = band.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    signed = sketch.groupBy("node").agg(F.min("signature").alias("signature"))
    bucketed = band.join(full, "bucket").join(signed, "node")
    likely = dealt(bucketed, "bucket").mapInArrow(likely_links, "a binary, b binary")
    clusters = connected(likely).withColumnRenamed("label", "cluster")

    # Clusters, each member with its text.
    sized = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "cluster").join(
        nodes.select("node", "copies", "place.doc_key", "place.text_key"), "node")
    texts = keyed(docs).select("doc_key", "text_key", "text")
    members = texts.join(sized, ["doc_key", "text_key"]).drop("doc_key", "text_key")
    (dealt(members, "cluster").mapInArrow(verified_links(least), "a binary, b binary, links long")
     .write.parquet(f"{path}/links"))
    links = spark.read.parquet(f"{path}/links")

    counted = links.groupBy(F.col("b").alias("node")).agg(F.sum("links").alias("links"))
    joined = connected(links.filter("a <> b").select("a", "b"))
    labelled = (nodes.select("node", "copy_id", "copies").join(joined, "node", "left")
                .join(counted, "node", "left")
                .withColumn("label", F.coalesce("label", "node")))
    # A class's smallest id: classes of one node need no grouping, but they take part all the same.
    least_id = labelled.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    known = labelled.join(least_id, "label").select(
        "node", "label", "copy_id", "class_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    everything = spark.read.parquet(f"{path}/sketches").select("doc_id", "doc_key", "text_key", "node", "size")
    return everything.join(known, "node", "left").select(
        "doc_id", "doc_key", "text_key", "label", F.col("size").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def first_of_each(docs: DataFrame, least: float = shingles.LEAST_SIMILARITY) -> DataFrame:
    """Rows of ``docs`` with all their columns, one of each group of near duplicates.

    Of a group the row with the smallest id stays, one without an id only where none has any; of rows
    of one id the one whose text has the smallest hash, and of rows equal in both any one. Rows are
    judged by id and text together, so a row that repeats an id with another text is judged by its
    own text. Rows without words always stay.
    """
    *keys, order = common.free_names(docs, "doc_key", "text_key", "row_order")
    path = fresh_dir(docs.sparkSession, "first")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_key", "text_key")
    (labelled_rows(docs, least).filter("label IS NOT NULL").select("label", place.alias("place"))
     .groupBy("label", "place").agg(F.count("*").alias("n")).write.parquet(path))
    rows = docs.sparkSession.read.parquet(path)
    first = rows.groupBy("label").agg(F.min("place").alias("first"))
    judged = rows.join(first, "label")
    found = [F.col(f"place.{name}").alias(key) for name, key in zip(("doc_key", "text_key"), keys, strict=True)]
    lost = judged.filter("place <> first").select(*found)
    again = judged.filter("place = first AND n > 1").select(*found)
    marked = docs.withColumns(dict(zip(keys, (
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)), F.xxhash64(F.col("text").cast("string"))),
        strict=True)))
    kept = marked.join(lost, keys, "left_anti")
    single = kept.join(again, keys, "left_anti")
    several = kept.join(again, keys, "left_semi").withColumn(
        order, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    return single.select(*docs.columns).unionByName(several.filter(F.col(order) == 1).select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
