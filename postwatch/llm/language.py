"""Language of a text by a small byte convolutional network, trained and applied in numpy.

A window of bytes is embedded, filters of several widths slide over it, each filter keeps its largest
response, and a softmax over those names the language. Training takes a bounded sample of labelled
windows; prediction cuts every whole text into windows and averages their probabilities by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postwatch.llm import common

#: Bytes of a window; padding is byte 0.
WINDOW = 256
#: Bounds of the training sample: documents of each language, languages, characters of each
#: document, which are cut out of it at a place drawn by its hash.
SAMPLE_PER_LANGUAGE = 600
MOST_LANGUAGES = 200
SAMPLE_CHARS = 1024
DRAWN = 1 << 40
FOLDS = 5
UNKNOWN = "und"


@dataclass(frozen=True)
class Shape:
    embedding: int = 6
    filters: int = 10
    widths: tuple[int, ...] = (2, 3, 4)
    steps: int = 400
    batch: int = 48
    rate: float = 0.01
    seed: int = 7


class ByteNet:
    """Embedding, filters of several widths laid side by side, max over positions, softmax."""

    def __init__(self, names: list[str], shape: Shape = Shape()):
        self.names, self.shape = names, shape
        draw = np.random.default_rng(shape.seed)
        e, f = shape.embedding, shape.filters
        self.reach = max(shape.widths)
        # One matrix for all widths: a narrower filter has zeros in its last rows.
        kernel = np.zeros((self.reach * e, f * len(shape.widths)), np.float32)
        self.mask = np.zeros_like(kernel)
        for i, width in enumerate(shape.widths):
            self.mask[: width * e, i * f: (i + 1) * f] = 1
            kernel[: width * e, i * f: (i + 1) * f] = draw.normal(0, (width * e) ** -0.5, (width * e, f))
        hidden = kernel.shape[1]
        self.weights = {
            "embedding": draw.normal(0, 1, (256, e)).astype(np.float32),
            "kernel": kernel,
            "bias": np.zeros(hidden, np.float32),
            "out": draw.normal(0, hidden ** -0.5, (hidden, len(names))).astype(np.float32),
            "prior": np.zeros(len(names), np.float32),
        }

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of (n, WINDOW) bytes: all filters at all positions, and what they were applied to."""
        embedded = self.weights["embedding"][windows]
        n, size, e = embedded.shape
        places = size - self.reach + 1
        strips = np.lib.stride_tricks.as_strided(
            embedded, (n, places, self.reach * e),
            (embedded.strides[0], embedded.strides[1], embedded.strides[2]), writeable=False)
        return (strips.reshape(n * places, -1) @ self.weights["kernel"]).reshape(n, places, -1), strips

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        return np.maximum(self.responses(windows)[0].max(1) + self.weights["bias"], 0)

    def probabilities(self, windows: np.ndarray, at_once: int = 64) -> np.ndarray:
        parts = [self.pooled(windows[i: i + at_once]) for i in range(0, len(windows), at_once)]
        hidden = np.concatenate(parts) if parts else np.zeros((0, len(self.weights["out"])), np.float32)
        return softmax(hidden @ self.weights["out"] + self.weights["prior"])

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        w, e = self.weights, self.shape.embedding
        response, strips = self.responses(windows)
        best = response.argmax(1)  # (n, hidden): where each filter responds most
        top = np.take_along_axis(response, best[:, None], 1)[:, 0] + w["bias"]
        hidden = np.maximum(top, 0)
        error = softmax(hidden @ w["out"] + w["prior"])
        error[np.arange(len(target)), target] -= 1
        error /= len(target)
        back = (error @ w["out"].T) * (top > 0)
        rows = np.arange(len(windows))[:, None]
        chosen = strips[rows, best]  # (n, hidden, reach * e): only these places have a gradient
        onto = back[..., None] * w["kernel"].T[None]
        embedding = np.zeros_like(w["embedding"])
        for step in range(self.reach):
            np.add.at(embedding, windows[rows, best + step], onto[..., step * e: (step + 1) * e])
        return {"embedding": embedding,
                "kernel": np.einsum("nh,nhk->kh", back, chosen) * self.mask,
                "bias": back.sum(0), "out": hidden.T @ error, "prior": error.sum(0)}

    def fit(self, windows: np.ndarray, target: np.ndarray) -> ByteNet:
        """Adam over random batches, every language drawn equally often."""
        shape, draw = self.shape, np.random.default_rng(self.shape.seed)
        by_language = [np.flatnonzero(target == i) for i in range(len(self.names))]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, shape.steps + 1):
            classes = draw.integers(0, len(self.names), shape.batch)
            rows = np.array([draw.choice(by_language[i]) for i in classes])
            rate = shape.rate * (1 - step / (shape.steps + 1))
            for key, slope in self.gradients(windows[rows], target[rows]).items():
                first[key] = 0.9 * first[key] + 0.1 * slope
                second[key] = 0.99 * second[key] + 0.01 * slope**2
                change = (first[key] / (1 - 0.9**step)) / (np.sqrt(second[key] / (1 - 0.99**step)) + 1e-8)
                self.weights[key] -= (rate * change).astype(np.float32)
        return self


def softmax(values: np.ndarray) -> np.ndarray:
    values = np.exp(values - values.max(-1, keepdims=True, initial=-np.inf))
    return values / values.sum(-1, keepdims=True)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of whole texts: (n, WINDOW) bytes, the text of each and its bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[owner] + number * WINDOW
    length = np.minimum(offsets[owner + 1] - begin, WINDOW)
    windows = np.zeros((len(owner), WINDOW), np.uint8)
    whole = length == WINDOW
    if whole.any():
        windows[whole] = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[begin[whole]]
    for row in np.flatnonzero(~whole).tolist():
        windows[row, : length[row]] = data[begin[row]: begin[row] + length[row]]
    return windows, owner, length


def sample(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """``(lang, part)``: a bounded, reproducible sample of ``(doc_id, text, lang)``.

    Of each of the most frequent languages the documents with the smallest hashes, and of each
    document up to ``SAMPLE_CHARS`` characters from a place that its hash chooses. Counts of the
    languages give the share of hashes that holds about twice as many rows as wanted, so what is
    ranked stays as small, however large the table is.
    """
    counts = (labelled.filter("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("n"))
    shares = counts.select(F.col("lang"), (share * F.lit(DRAWN)).cast("long").alias("below"))
    drawn = F.xxhash64("doc_id", F.col("text"))
    room = F.greatest(F.length("text") - F.lit(SAMPLE_CHARS), F.lit(0)) + 1
    rows = (
        labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
        .select("lang", drawn.alias("drawn"),
                F.substring("text", F.pmod(drawn, room).cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("part"))
        .join(F.broadcast(shares), "lang")  # MOST_LANGUAGES rows at most
        .filter(F.pmod("drawn", F.lit(DRAWN)) < F.col("below"))
    )
    order = Window.partitionBy("lang").orderBy("drawn", "part")
    return (rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language)
            .orderBy("place", "lang").limit(per_language * MOST_LANGUAGES).select("lang", "part"))


def train(labelled: DataFrame, shape: Shape = Shape()) -> ByteNet | None:
    """A network for the languages of ``labelled``; None if no labelled text holds a letter."""
    rows = [(lang, part.encode()) for lang, part in map(tuple, sample(labelled).collect())
            if regex.search(r"\p{L}", part)]
    names = sorted({lang for lang, _ in rows})
    if not names:
        return None
    place = {name: i for i, name in enumerate(names)}
    data = np.frombuffer(b"".join(part for _, part in rows), np.uint8)
    offsets = np.cumsum([0, *(len(part) for _, part in rows)])
    windows, owner, length = cut(data, offsets)
    target = np.array([place[lang] for lang, _ in rows])[owner]
    # Short rests teach little, but a language may have nothing else.
    keep = length >= WINDOW // 8
    keep |= ~np.isin(target, target[keep])
    return ByteNet(names, shape).fit(windows[keep], target[keep])


def judge(texts: pa.Array, net: ByteNet | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    data, offsets = common.ragged(texts)
    held = data.tobytes()
    letters = [
        regex.search(r"\p{L}", held[a:b].decode("utf-8", "replace")) is not None
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
    ]
    if net is None:
        return [UNKNOWN] * len(letters), np.zeros(len(letters))
    windows, owner, length = cut(data, offsets)
    weighted = net.probabilities(windows).astype(np.float64) * length[:, None]
    total = np.zeros((len(letters), len(net.names)))
    np.add.at(total, owner, weighted)
    mean = total / np.maximum(np.diff(offsets), 1)[:, None]
    best = mean.argmax(1)
    names = [net.names[i] if known else UNKNOWN for i, known in zip(best.tolist(), letters, strict=True)]
    return names, np.where(letters, np.clip(mean.max(1), 0, 1), 0.0)


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """``(doc_id, lang_pred, score)``: the language of every whole text, one row for each row.

    ``und`` with score 0 for a null text, one without a letter, or without a trained network. The
    score is the mean probability of the language over the text's windows, by their bytes. Nothing
    but the text is read. Map-only; the network is a few thousand numbers.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, limit=500_000):
            names, score = judge(block.column("text"), net)
            yield common.record_batch(schema, [block.column("doc_id"), names, score])

    return common.documents(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def with_known_language(docs: DataFrame, net: ByteNet | None, least: float = 0.0) -> DataFrame:
    """Rows whose text has a language with a score of at least ``least``, with all their columns.

    Null texts and texts without letters have none and go, as does everything without a network.
    Repeated rows stay or go together.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, limit=500_000):
            names, score = judge(block.column("text"), net)
            keep = np.array([x != UNKNOWN for x in names]) & (score >= least)
            yield block.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """One fold in five, by checksum of the id; a null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def learned(docs: DataFrame) -> ByteNet | None:
    """A network from the labelled rows outside the held-out fold."""
    labelled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                           F.col("text").cast("string").alias("text"),
                           F.col("lang").cast("string").alias("lang"))
    return train(labelled.filter(~held_out(F.col("doc_id"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, learned(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
