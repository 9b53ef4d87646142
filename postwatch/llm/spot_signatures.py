"""Document fingerprints from spots that common words mark, in built-in expressions only.

Every common word (an anchor) starts a signature: the anchor and the next content words behind it.
The set of a text's signatures is its fingerprint, and two texts are as alike as the Jaccard
similarity of their sets. Stretches that no such chain reaches (lists, code, languages whose common words
are not known) have their runs of three words in the fingerprint instead.

Edited texts and neighbours need the next document. Documents are dealt into ranges of ids; each
range also gets the first document of the range that follows, so a window over a range sees every
neighbour, and texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postwatch.llm import common

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he in is it its not of on or that the they "
    "this to was were which with you "
    "aber als auch auf das dem den der des die ein eine einen er es ich im ist mit nicht sich sie "
    "sind und von war wie zu "
    "au aux ce ces dans de du elle en est et il je la le les mais ne nous ou par pas pour que qui "
    "se son sur un une vous "
    "al como con del el era ha las lo los más no para pero por su sus y"
).split()
#: Content words of a signature, and how far behind the anchor they may stand.
CHAIN = 2
REACH = 8
#: Ranges of ids: segments between sampled quantiles, rows of a range, and most ranges.
SEGMENTS = 256
RANGE_ROWS = 1000
MOST_RANGES = 1_000_000
LOWEST = -(1 << 63)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_hashes(text: Column) -> Column:
    """A hash of each word: negative for anchors, positive for content words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    size = F.lit((1 << 63) - 1)
    return F.transform(words, lambda w: F.when(
        w.isin(ANCHORS), -F.xxhash64(w).bitwiseAND(size) - 1
    ).otherwise(F.xxhash64(w).bitwiseAND(size)))


def short(value: Column) -> Column:
    return value.bitwiseAND(F.lit(0xFFFFFFFF))


def chains(hashes: Column) -> Column:
    """For each word the signature it starts: anchors that enough content words follow, else null."""
    def signature(word: Column, place: Column) -> Column:
        following = F.filter(F.slice(hashes, place + 2, F.lit(REACH)), lambda x: x >= 0)
        return F.when(word < 0, let(following, lambda f: F.when(
            F.size(f) >= CHAIN,
            short(F.xxhash64(word, *(F.element_at(f, i + 1) for i in range(CHAIN)))))))

    return F.transform(hashes, signature)


def runs(hashes: Column, found: Column) -> Column:
    """Runs of words, as long as a signature, from every word that no chain reaches.

    Chains reach as far behind their anchor as their words may stand. At the end of a text, where no
    whole run is left, the last one stands for its words.
    """
    width = F.size(hashes)

    def reached(i: Column) -> Column:
        near = F.slice(found, F.greatest(i - REACH, F.lit(1)), F.least(i, F.lit(REACH + 1)))
        return F.exists(near, lambda x: x.isNotNull())

    return F.transform(
        F.filter(F.sequence(F.lit(1), width), lambda i: ~reached(i)),
        lambda i: short(F.xxhash64(F.slice(hashes, F.greatest(F.least(i, width - CHAIN), F.lit(1)),
                                           F.lit(CHAIN + 1)))))


def signatures(text: Column) -> Column:
    """The sorted set of a text's 32-bit signatures. Null and empty texts have none.

    Chains behind anchors, and runs of words wherever no chain reaches: all words of a text have a
    part in it, also those of languages without anchors. A text without words has one signature,
    of the text itself.
    """
    def of(hashes: Column) -> Column:
        return F.when(F.size(hashes) > 0, let(chains(hashes), lambda found: F.concat(
            F.filter(found, lambda x: x.isNotNull()), runs(hashes, found)))
        ).otherwise(F.array(short(F.xxhash64(text))))

    found = F.sort_array(F.array_distinct(let(word_hashes(text), of)))
    return F.when(F.length(text) > 0, found).otherwise(F.array().cast("array<bigint>"))


def fingerprint(found: Column) -> Column:
    """The set as text: eight hexadecimal digits for each signature, in ascending order."""
    return F.array_join(F.transform(found, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 1 for two empty ones.

    Sets whose sizes alone keep the similarity below ``least`` are not compared and give 0.
    """
    fewer, more = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    exact = let(shared, lambda s: s / (F.size(a) + F.size(b) - s))
    return F.when(more == 0, F.lit(1.0)).when((fewer == 0) | (fewer / more < least), F.lit(0.0)).otherwise(
        exact)


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, next_text, signs, next_signs)`` of ``(doc_id, text)``, null texts empty.

    The next document is the one of the next smaller id, after the last one the first. Rows that
    repeat an id stand in the order of their texts, rows without one come last.
    """
    rows = common.documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                                         F.coalesce("doc_id", F.lit(LOWEST)).alias("key"))
    steps = [i / SEGMENTS for i in range(1, SEGMENTS)]
    count, least, most, cuts = rows.agg(
        F.count("*"), F.min("key"), F.max("key"), F.percentile_approx("key", steps)).first()
    if not count:
        return rows.select("doc_id", "text", F.lit("").alias("next_text"),
                           *(F.array().cast("array<bigint>").alias(x) for x in ("signs", "next_signs")))
    cuts = sorted({least, *cuts, most + (most < (1 << 63) - 1)})
    parts = max(1, -(-min(-(-count // RANGE_ROWS), MOST_RANGES) // max(1, len(cuts) - 1)))
    borders = F.array(*(F.lit(x).cast("bigint") for x in cuts))
    segment = F.greatest(F.size(F.filter(borders, lambda x: x <= F.col("key"))), F.lit(1))
    start, stop = F.get(borders, segment - 1), F.get(borders, segment)
    # Doubles are wide enough for distances; a range is only a grouping and stays monotone.
    share = (F.col("key").cast("double") - start.cast("double")) / F.greatest(
        F.coalesce(stop, start).cast("double") - start.cast("double"), F.lit(1.0))
    part = F.least(F.floor(share * parts), F.lit(parts - 1)).cast("long")
    dealt = rows.withColumn("segment", segment).withColumn("range", F.col("segment") * parts + part)

    # The first document of a range is the neighbour of the last one of the range before it.
    heads = dealt.groupBy("segment", "range").agg(F.max("key").alias("head"))
    tops = sorted(heads.groupBy("segment").agg(F.max("head")).collect(), reverse=True)  # <= SEGMENTS
    after = [(tops[i][0], tops[(i + 1) % len(tops)][1]) for i in range(len(tops))]
    following = docs.sparkSession.createDataFrame(after, "segment int, top long")
    down = Window.partitionBy("segment").orderBy(F.desc("range"))
    heads = heads.join(F.broadcast(following), "segment").select(
        "range", F.coalesce(F.lead("head").over(down), "top").alias("key"))
    guests = (dealt.select("key", "doc_id", "text").join(F.broadcast(heads), "key")  # <= MOST_RANGES
              .groupBy("range").agg(F.min(F.struct(F.col("text"), F.col("doc_id"), F.col("key")))
                                    .alias("first"))
              .select("range", F.lit(1).alias("guest"), "first.key", "first.doc_id", "first.text"))
    own = dealt.select("range", F.lit(0).alias("guest"), "key", "doc_id", "text")
    order = Window.partitionBy("range").orderBy("guest", F.desc("key"), "text")
    seen = own.unionByName(guests).select(
        "*", F.lead("text").over(order).alias("next_text"), signatures(F.col("text")).alias("signs"))
    return (seen.withColumn("next_signs", F.lead("signs").over(order)).filter("guest = 0")
            .select("doc_id", "text", "next_text", "signs", "next_signs"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, signs, fingerprint)`` of every whole text, one row for each row. Map-only."""
    text = F.coalesce("text", F.lit(""))
    rows = common.documents(docs).select("doc_id", F.length(text).cast("long").alias("n_chars"),
                                         signatures(text).alias("signs"))
    return rows.withColumn("fingerprint", fingerprint(F.col("signs")))


def similar_pairs(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Documents whose fingerprints are alike, by a join within partitions of set lengths.

    Two frames: ``(doc_id, class_id)``, where documents of equal fingerprints have the smallest id
    among them, and ``(class_a, class_b, likeness)`` for the alike classes, a < b. Texts without
    words or null are in no class. Two sets can only be alike if the lengths agree up to ``least``,
    so a class is sent to the partition of its own length and the next; and only if one of the
    rarest signatures of one is among those of the other, so only these are joined.
    """
    rows = fingerprints(docs).filter(F.size("signs") > 0)
    members = rows.select("doc_id", "fingerprint")
    classes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"),
                                              F.first("signs").alias("signs"))
    member = members.join(classes.select("fingerprint", "class_id"), "fingerprint").select(
        "doc_id", "class_id")
    sets = classes.select("class_id", "signs", F.size("signs").alias("size"))
    single = sets.select("class_id", F.explode("signs").alias("sign"))
    common_ness = single.groupBy("sign").agg(F.count("*").alias("n"))
    ranked = single.join(common_ness, "sign").groupBy("class_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "sign"))).alias("ranked"))
    prefix = (F.col("size") - F.ceil(F.col("size") * least) + 1).cast("int")
    level = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / least)))
    keyed = ranked.join(sets, "class_id").select(
        "class_id", "size", level.alias("level"),
        F.explode(F.slice("ranked", F.lit(1), prefix)["sign"]).alias("sign"))
    left = keyed.select(F.col("class_id").alias("a"), F.col("size").alias("a_size"), "sign",
                        F.explode(F.array("level", F.col("level") + 1)).alias("level"))
    right = keyed.select(F.col("class_id").alias("b"), F.col("size").alias("b_size"), "sign", "level")
    near = (F.col("a_size") <= F.col("b_size")) & (F.col("a_size") >= least * F.col("b_size"))
    near &= (F.col("a_size") < F.col("b_size")) | (F.col("a") < F.col("b"))
    pairs = left.join(right, ["level", "sign"]).filter(near).select("a", "b").distinct()
    judged = (pairs.join(sets.select(F.col("class_id").alias("a"), F.col("signs").alias("a_signs")), "a")
              .join(sets.select(F.col("class_id").alias("b"), F.col("signs").alias("b_signs")), "b")
              .select("a", "b", likeness(F.col("a_signs"), F.col("b_signs"), least).alias("likeness")))
    return member, judged.filter(F.col("likeness") >= least).select(
        F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), "likeness")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and how alike they and the next one's are.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.
    The edited text has the last half of its characters replaced by the first as many of the next
    document, or all of them if it is shorter. Null texts count as empty; a single document is its
    own next one.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - half)
    edited = F.concat(kept, F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "signs", "next_signs",
        # One evaluation of the edited text serves its digest and its signatures.
        let(edited, lambda x: F.struct(F.sha2(x, 256).alias("sha256"), signatures(x).alias("signs")))
        .alias("edited"))
    return rows.select(
        "doc_id", "n_chars", F.col("edited.sha256").alias("edited_sha256"),
        fingerprint(F.col("signs")).alias("fingerprint"),
        fingerprint(F.col("edited.signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited.signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(common.table(spark, sf_dir, "documents"))
