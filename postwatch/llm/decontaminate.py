"""Verbatim overlap of documents with a benchmark, found in suffix arrays of the documents.

A task lays a block of documents out as one array of word hashes and sorts its suffixes by prefix
doubling; later rounds only sort what is still tied. Every suffix of every benchmark item is then
looked up by binary search, one word deeper at a time, which gives where its window occurs and how
far each match goes on. Blocks are the shards: nothing is shuffled.

The benchmark is sent to the tasks in groups of a checked size; a larger one takes several passes
over the documents, which hand their findings on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm import common
from postwatch.llm.words import words
from postwatch.session import fresh_dir

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text that are sent to every executor at once.
GROUP_BYTES = 16_000_000


def suffix_array(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, up to ``depth`` words at least."""
    size = len(sequence)
    order = np.argsort(sequence)
    ordered = sequence[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(size, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(size), 0))
    length = 1
    while length < depth:
        # Places in the array that are still tied, group after group.
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            break
        found = order[tied]
        after = np.minimum(found + length, size)
        second = np.where(after < size, rank[np.minimum(after, size - 1)] + 1, 0)
        key = rank[found] * (size + 1) + second
        by = np.argsort(key)
        found, key = found[by], key[by]
        order[tied] = found
        head[tied] = np.concatenate(([True], key[1:] != key[:-1]))
        rank[found] = tied[np.maximum.accumulate(np.where(head[tied], np.arange(len(tied)), 0))]
        length *= 2
    return order


class Items:
    """Benchmark texts as word sequences; equal sequences are one."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int = WINDOW):
        names: dict[bytes, list[str]] = {}
        sequences = []
        for item, text in rows:
            held = np.frombuffer((text or "").encode(), np.uint8)
            found, _ = words(held, np.array([0, len(held)]))
            if not len(found):
                continue
            key = found.tobytes()
            if key not in names:
                names[key] = []
                sequences.append(found)
            if item is not None:
                names[key].append(item)
        self.names = [sorted(set(names[x.tobytes()])) for x in sequences]
        sizes = np.array([len(x) for x in sequences], np.int64)
        self.longest = int(sizes.max()) if len(sizes) else 0
        # All sequences after one another, with a 0 behind each.
        self.flat = np.concatenate([np.append(x, np.uint64(0)) for x in sequences] or
                                   [np.zeros(0, np.uint64)])
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        self.width = np.minimum(sizes, window)  # of an item's windows
        counts = sizes - self.width + 1
        self.item = np.repeat(np.arange(len(sizes)), counts)
        begin = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.suffix = starts[self.item] + begin  # where each window starts in ``flat``
        self.begin = begin


def locate(sequence: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the items, the range of the suffix array that starts with it."""
    low = np.zeros(len(items.suffix), np.int64)
    high = np.full(len(items.suffix), len(order), np.int64)
    wanted = items.width[items.item] if len(items.item) else low
    open_ = np.arange(len(items.suffix))
    size = len(sequence)
    for depth in range(int(wanted.max()) if len(wanted) else 0):
        open_ = open_[(low[open_] < high[open_]) & (wanted[open_] > depth)]
        if not len(open_):
            break
        word = items.flat[items.suffix[open_] + depth]
        bounds = []
        for right in (False, True):
            a, b = low[open_].copy(), high[open_].copy()
            while True:  # binary search, all windows at once
                live = np.flatnonzero(a < b)
                if not len(live):
                    break
                middle = (a[live] + b[live]) >> 1
                at = order[middle] + depth
                here = np.where(at < size, sequence[np.minimum(at, size - 1)], np.uint64(0))
                go = here <= word[live] if right else here < word[live]
                a[live[go]] = middle[go] + 1
                b[live[~go]] = middle[~go]
            bounds.append(a)
        low[open_], high[open_] = bounds
    return low, high


def occurrences(sequence: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a window and a position of ``sequence`` at which it occurs."""
    if not len(sequence) or not len(items.suffix):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = suffix_array(sequence, int(items.width.max()))
    low, high = locate(sequence, order, items)
    count = np.maximum(high - low, 0)
    window = np.repeat(np.arange(len(count)), count)
    place = np.repeat(low, count) + np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
    return window, order[place]


def match_lengths(sequence, items: Items, window, at) -> np.ndarray:
    """Words for which the texts behind each pair go on to agree."""
    length = items.width[items.item[window]].copy()
    open_ = np.arange(len(window))
    while len(open_):
        there = at[open_] + length[open_]
        here = items.suffix[window[open_]] + length[open_]
        inside = there < len(sequence)
        same = inside & (items.flat[here] != 0)
        same &= sequence[np.minimum(there, len(sequence) - 1)] == items.flat[here]
        open_ = open_[same]
        length[open_] += 1
    return length


class Found:
    """What a block of documents shares with a group of items."""

    def __init__(self, texts: pa.Array, items: Items):
        data, offsets = common.ragged(texts)
        hashes, starts = words(data, offsets)
        self.n_words = np.diff(starts)
        rows = len(self.n_words)
        # A 0 behind each document ends its suffixes.
        self.owner = np.repeat(np.arange(rows), self.n_words + 1)
        self.starts = starts[:-1] + np.arange(rows)
        sequence = np.zeros(len(hashes) + rows, np.uint64)
        sequence[np.arange(len(hashes)) + np.repeat(np.arange(rows), self.n_words)] = hashes
        self.sequence, self.items = sequence, items
        self.window, self.at = occurrences(sequence, items)

    def hit(self) -> np.ndarray:
        """Whether each place of the sequence is a word inside an occurrence."""
        width = self.items.width[self.items.item[self.window]] if len(self.window) else self.at
        change = np.bincount(self.at, minlength=len(self.sequence) + 1)
        change = change - np.bincount(self.at + width, minlength=len(self.sequence) + 1)
        return np.cumsum(change)[:-1] > 0

    def items_of(self) -> list[list[str]]:
        out: list[list[str]] = [[] for _ in self.n_words]
        if len(self.window):
            total = len(self.items.names)
            pairs = np.unique(self.owner[self.at] * total + self.items.item[self.window])
            for row, item in zip((pairs // total).tolist(), (pairs % total).tolist(), strict=True):
                out[row] += self.items.names[item]
        return out

    def matches(self) -> tuple[np.ndarray, ...]:
        """Longest matches: document row, word in it, item, word in that, words."""
        if not len(self.window):
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, empty, empty
        before_text = np.where(self.at > 0, self.sequence[np.maximum(self.at - 1, 0)], np.uint64(0))
        place = self.items.suffix[self.window]
        before_item = np.where(place > 0, self.items.flat[np.maximum(place - 1, 0)], np.uint64(0))
        heads = (before_text == 0) | (before_text != before_item)
        window, at = self.window[heads], self.at[heads]
        length = match_lengths(self.sequence, self.items, window, at)
        row = self.owner[at]
        return row, at - self.starts[row], self.items.item[window], self.items.begin[window], length


def groups(benchmark: DataFrame, limit: int = GROUP_BYTES) -> Iterator[list[tuple]]:
    """Rows ``(item_id, text)`` of the benchmark, in groups of about ``limit`` bytes at most."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                            F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Dealt by hash into groups of half the bound on average.
    count = 1 if size <= limit else -(-2 * size // limit)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for number in range(count):
        yield [tuple(row) for row in rows.filter(part == number).collect()]


def sent(docs: DataFrame, rows: list[tuple], window: int) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(Items(rows, window))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, items array<string>, longest)``, one row for each row of ``docs``.

    Words are runs of letters, digits and non-ASCII characters, A to Z lower-cased. A word is hit if
    it stands inside an occurrence of ten consecutive words of an item, or of all words of a shorter
    one. ``items`` are the sorted ids of items with such occurrences, ``longest`` the words of the
    longest verbatim match (0 without one). Null texts have no words; items without words match
    nothing; an item without an id hits words but is not listed; repeated ids are listed once.
    Repeated rows and null doc ids pass through, other columns are not read, and an empty benchmark
    hits nothing.
    """
    state = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("hits", pa.binary()),
                       ("items", pa.list_(pa.string())), ("longest", pa.int64())])
    schema = "doc_id long, text string, hits binary, items array<string>, longest long"
    frame, spark = common.documents(docs), docs.sparkSession
    passes = groups(benchmark, group_bytes)
    rows = next(passes)
    while True:
        following = next(passes, None)
        held = sent(docs, rows, window)
        if following is None:
            break
        frame = frame.mapInArrow(lambda batches, held=held: carried(batches, held.value, state), schema)
        path = fresh_dir(spark, "contamination")
        frame.write.parquet(path)  # a pass ends here, and its items leave the executors
        held.unpersist()
        frame, rows = spark.read.parquet(path), following
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                     ("items", pa.list_(pa.string())), ("longest", pa.int64())])
    return frame.mapInArrow(
        lambda batches: finished(batches, held.value, out),
        "doc_id long, n_words long, n_hit long, items array<string>, longest long",
    )


def judged(block: pa.RecordBatch, items: Items) -> tuple[Found, np.ndarray, list, np.ndarray]:
    """A block's findings together with those of passes before."""
    found = Found(block.column("text"), items)
    hit, names = found.hit(), found.items_of()
    longest = np.zeros(len(found.n_words), np.int64)
    row, _, _, _, length = found.matches()
    np.maximum.at(longest, row, length)
    if "hits" in block.schema.names:
        for i, (bits, more) in enumerate(zip(block.column("hits").to_pylist(),
                                             block.column("items").to_pylist(), strict=True)):
            start, size = found.starts[i], found.n_words[i]
            before = np.unpackbits(np.frombuffer(bits, np.uint8), count=size).astype(bool)
            hit[start: start + size] |= before
            names[i] = names[i] + more
        longest = np.maximum(longest, block.column("longest").to_numpy())
    return found, hit, [sorted(set(x)) for x in names], longest


def carried(batches, items: Items, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for block in common.blocks(batches):
        found, hit, names, longest = judged(block, items)
        bits = [np.packbits(hit[a: a + n]).tobytes()
                for a, n in zip(found.starts, found.n_words, strict=True)]
        yield common.record_batch(schema, [block.column("doc_id"), block.column("text"), bits,
                                           names, longest])


def finished(batches, items: Items, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for block in common.blocks(batches):
        found, hit, names, longest = judged(block, items)
        n_hit = np.bincount(found.owner[hit], minlength=len(found.n_words))
        yield common.record_batch(schema, [block.column("doc_id"), found.n_words, n_hit, names, longest])


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
            group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Longest verbatim matches and where they are.

    ``(doc_id, doc_word, item_id, item_word, n_words)``: positions count words from 0; a match is
    at least a window long and cannot be extended to either side. One row for each id of an item.
    Null and empty texts have no matches, repeated documents each have theirs, a null ``doc_id`` passes
    through, and a benchmark without words matches nothing. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("doc_word", pa.int64()), ("item_id", pa.string()),
                        ("item_word", pa.int64()), ("n_words", pa.int64())])

    def run(batches, held) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            found = Found(block.column("text"), held.value)
            ids = block.column("doc_id").to_pylist()
            rows = [(ids[row], place, name, begin, length)
                    for row, place, item, begin, length in zip(
                        *(x.tolist() for x in found.matches()), strict=True)
                    for name in held.value.names[item]]
            yield common.record_batch(schema, [list(x) for x in zip(*rows, strict=True)] or [[]] * 5)

    out = None
    for rows in groups(benchmark, group_bytes):
        held = sent(docs, rows, window)
        found = common.documents(docs).mapInArrow(
            lambda batches, held=held: run(batches, held),
            "doc_id long, doc_word long, item_id string, item_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                        group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Rows of ``docs`` without any hit word, with all the columns they had. Map-only.

    Null and empty texts have no words and stay; repeated rows stay or go together; a benchmark that is
    empty or has no words takes nothing away.
    """
    def run(batches, held) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            found = Found(block.column("text").cast(pa.string()), held.value)
            yield block.filter(pa.array(np.bincount(
                found.owner[found.hit()], minlength=block.num_rows) == 0))

    for number, rows in enumerate(groups(benchmark, group_bytes)):
        if number:
            path = fresh_dir(docs.sparkSession, "clean")
            docs.write.parquet(path)
            docs = docs.sparkSession.read.parquet(path)
        held = sent(docs, rows, window)
        docs = docs.mapInArrow(lambda batches, held=held: run(batches, held), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.table(spark, sf_dir, "documents"),
                          common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "longest",
    )


ORACLE = r"""
WITH item AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT item, least(len(w), 10) AS n, j, array_to_string(w[j:j + least(len(w), 10) - 1], ' ') AS body
  FROM item, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS t(j) WHERE len(w) > 0
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), place AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS body
  FROM doc, (SELECT DISTINCT n FROM win) AS size, unnest(generate_series(1, len(w) - n + 1)) AS t(i)
), hit AS (
  SELECT doc_id, i, j, n, item FROM place JOIN win USING (n, body)
), word AS (
  SELECT doc_id, count(DISTINCT k)::BIGINT AS n_hit
  FROM hit, unnest(generate_series(i, i + n - 1)) AS t(k) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
), run AS (
  SELECT doc_id, count(*) + any_value(n) - 1 AS size FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, i - j ORDER BY i) AS island FROM hit
  ) GROUP BY doc_id, item, i - j, island
), best AS (
  SELECT doc_id, max(size)::BIGINT AS longest FROM run GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated, coalesce(longest, 0) AS longest
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id)
"""
