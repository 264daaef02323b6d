"""Mixing sources to target weights by fixed-length blocks.

The words of each source form one long run that is cut into blocks of equal
length. The mix consists of slots. For every output shard the number of slots of
each source is drawn (multinomial, given the totals that the targets fix); a
source's slots are then numbered over its shards in turn. Slot ``k`` takes, in
epoch ``k div B``, the block that a keyed permutation of 0 .. B-1 gives for
``k mod B``. The last slot is cut to the words that are still missing, so that a
source gives its target to the word, however small it is. Slots and blocks meet
in an equi-join by (source, block).

Everything is DataFrame operations. Positions inside a source come from sums
of bounded chunks, so that a source with most of the rows needs no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.session import materialize
from ledgersift.llm.words import WORD, word_count

BLOCK_WORDS = 256
CHUNK_ROWS = 2_000
SLOT_RUN = 4096
SHARDS = 64
WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
SEED = 20_240_501
MAX_BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = REPEATS,
                   share: float = 1.0) -> DataFrame:
    """Targets from (source, source_size): one row per source.

    Sources in code-point order, null last, get the weights in turn. A target
    stops at ``limit`` times the size, the excess goes to the others by weight:
    the targets are ``least(limit * size, level * weight)`` with the one level
    at which they sum to the total, found in a prefix sum over the sources.
    Adds sid, weight and target (double).
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights)).cast("int") + 1)
    named = sizes.withColumn(
        "sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn("weight", weight)
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    leveled = (
        named.withColumn("cap", F.col("source_size").cast("double") * limit)
        .withColumn("total", F.sum(F.col("source_size")).over(everything) * F.lit(share))
        .withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight") * (1 + 1e-12))
        .withColumn("place", F.row_number().over(by_cap))
    )
    first = F.min(F.when(F.col("fits"), F.struct("place", "level"))).over(everything)
    return leveled.withColumn("level", F.coalesce(first["level"], F.lit(float("inf")))).select(
        "sid", "weight", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"), *sizes.columns
    )


def place_documents(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Add sid, source_size, target and ``start``: the document's first word in its source's run."""
    narrow = targets.select("sid", F.col("source").alias("_source"), "source_size", "target", "chunks")
    if targets.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        narrow = F.broadcast(narrow)
    sided = docs.join(narrow, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    chunk = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.col("chunks"))
    sided = sided.withColumn("_chunk", chunk)
    offsets = (
        sided.groupBy("sid", "_chunk").agg(F.sum("size").alias("_words"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_words").over(
                    Window.partitionBy("sid").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_words")
    )
    inside = Window.partitionBy("sid", "_chunk").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sided.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets.hint("merge"), ["sid", "_chunk"])
        .withColumn("start", F.col("_before") + F.col("_inside"))
        .drop("_chunk", "_before", "_inside", "chunks")
    )


def permuted(index: Column, size: Column, tag: Column, rounds: int = 24, inverse: bool = False) -> Column:
    """A keyed permutation of 0 .. size-1 for any size (swap or not, round by round)."""
    turns = F.sequence(F.lit(rounds - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(rounds - 1))

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), tag, r), size) - x, size)
        top = F.greatest(x, partner)
        return F.when(F.pmod(F.xxhash64(F.lit(SEED + 1), tag, r, top), F.lit(2)) == 1, partner).otherwise(x)

    return F.aggregate(turns, index.cast("bigint"), turn)


def mix_slots(targets: DataFrame, shards: int = SHARDS, block: int = BLOCK_WORDS, limit: int = REPEATS) -> DataFrame:
    """The mix as slots (shard, sid, slot, k, epoch, block, take); at most ``limit`` epochs of each source.

    A shard holds the slots that its drawn count of the source gives it: ``slot`` numbers them inside the
    shard, ``k`` inside the source, over its shards in turn. ``take`` words are taken from the start of the block: all of them but in a source's last slot.
    """
    # Sources without words are dropped below; Spark may compute their figures first, so nothing divides by their size.
    some = F.greatest(F.col("source_size"), F.lit(1))
    blocks = F.ceil(some / block).cast("bigint")
    goal = F.least(F.round("target").cast("bigint"), F.col("source_size") * limit)
    # The last block of a run is shorter; ``_at`` is its place among the slots of the epoch that is not full.
    counts = (
        targets.where(F.col("source_size") > 0)
        .withColumn("_blocks", blocks)
        .withColumn("_goal", goal)
        .withColumn("_full", F.call_function("div", F.col("_goal"), some))
        .withColumn("_rest", F.col("_goal") - F.col("_full") * F.col("source_size"))
        .withColumn("_gap", F.col("_blocks") * block - F.col("source_size"))
        .withColumn(
            "_at", permuted(F.col("_blocks") - 1, F.col("_blocks"), _epoch_tag(F.col("_full")), inverse=True)
        )
        .withColumn("_late", F.when(F.col("_rest") > F.col("_at") * block, F.col("_gap")).otherwise(0))
        .withColumn(
            "_slots",
            F.col("_full") * F.col("_blocks") + F.ceil((F.col("_rest") + F.col("_late")) / block).cast("bigint"),
        )
        .where(F.col("_slots") > 0)
    )
    given = ("_blocks", "_slots", "_full", "_rest", "_gap", "_at", "source_size")
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shares = shard_counts(counts.select("sid", F.col("_slots").alias("slots")), shards).withColumn(
        "_first", F.coalesce(F.sum("slots").over(before), F.lit(0))
    )
    slots = (
        _numbered(counts.select("sid", *given).join(shares, "sid"), "slots", ["sid", "shard"], "slot")
        .withColumn("k", F.col("_first") + F.col("slot"))
    )
    epoch = F.call_function("div", F.col("k"), F.col("_blocks"))
    place = F.pmod(F.col("k"), F.col("_blocks"))
    before = place * block - F.when(place > F.col("_at"), F.col("_gap")).otherwise(0)
    size = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    words = F.when(F.col("epoch") < F.col("_full"), size).otherwise(F.least(size, F.col("_rest") - before))
    return slots.withColumn("epoch", epoch).withColumn(
        "block", permuted(place, F.col("_blocks"), _epoch_tag(F.col("epoch")))
    ).select(
        "shard", "sid", "slot", "k", "epoch", "block", words.cast("bigint").alias("take")
    )


def shard_counts(totals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(sid, shard, slots): multinomial counts of the ``slots`` of each source over equally likely shards.

    Each slot is one draw by a keyed hash; a shard that gets no slot of a source has no row for it.
    """
    draws = _numbered(totals.select("sid", "slots"), "slots", ["sid"], "_draw")
    shard = F.pmod(F.xxhash64(F.lit(SEED + 2), "sid", "_draw"), F.lit(shards)).cast("int")
    return draws.groupBy("sid", shard.alias("shard")).agg(F.count(F.lit(1)).alias("slots"))


def _numbered(rows: DataFrame, count: str, keys: list[str], name: str) -> DataFrame:
    """Each row as often as ``count`` says, numbered from 0; long runs are spread over tasks."""
    last = F.floor((F.col(count) - 1) / SLOT_RUN).cast("bigint")
    runs = rows.where(F.col(count) > 0).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    first = F.col("_run") * SLOT_RUN
    numbers = F.sequence(first, F.least(first + SLOT_RUN, F.col(count)) - 1)
    return runs.repartition(*keys, "_run").withColumn(name, F.explode(numbers)).drop("_run")


def _epoch_tag(epoch: Column) -> Column:
    return F.xxhash64(F.struct(F.col("sid"), epoch))


def block_pieces(placed: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The blocks as pieces of documents: (sid, block, start, first, words, offset).

    ``first`` is counted inside the document, ``offset`` inside the block.
    """
    end = F.col("start") + F.col("size")
    parts = placed.where(F.col("size") > 0).select(
        "sid", "start", "size",
        F.explode(
            F.sequence(F.call_function("div", F.col("start"), F.lit(block)), F.call_function("div", end - 1, F.lit(block)))
        ).alias("block"),
    )
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return parts.select(
        "sid", "block", "start", (low - F.col("start")).alias("first"), (high - low).alias("words"),
        (low - F.col("block") * block).alias("offset"),
    )


def _within(words: Column, offset: Column, take: Column) -> Column:
    """The words of a piece that lie in the first ``take`` words of its block."""
    return F.greatest(F.least(words, take - offset), F.lit(0))


def plan(docs: DataFrame, share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(documents with ``size``; the targets, one row per source, written to the shared folder)."""
    sized = docs.withColumn("size", word_count(F.col("text")))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    # The number of rows only sets the number of chunks.
    chunks = F.ceil(F.col("rows") / CHUNK_ROWS).cast("bigint")
    return sized, materialize(source_targets(per_source, share=share).withColumn("chunks", chunks).drop("rows"))


def taken_words(docs: DataFrame, words: int = BLOCK_WORDS) -> DataFrame:
    """Per row: doc_id, size, source_size, target, ``taken``, the words the mix takes, repeats counted, and
    ``n_shards``, the number of output shards that hold some of them.

    Null texts have size 0, null sources are one source, equal rows are placed
    one after the other, an empty table gives no rows. Other columns are ignored.
    """
    sized, targets = plan(docs.select("doc_id", "text", "source"))
    placed = place_documents(sized.drop("text"), targets)
    # A block has at most one slot in each epoch; a document at most SHARDS shards.
    used = mix_slots(targets, block=words).groupBy("sid", "block").agg(F.collect_list(F.struct("take", "shard")).alias("uses"))
    taken = (
        block_pieces(placed, words).join(used.hint("merge"), ["sid", "block"])
        .withColumn("use", F.explode("uses"))
        .withColumn("words", _within(F.col("words"), F.col("offset"), F.col("use.take"))).where(F.col("words") > 0)
        .groupBy("sid", "start")
        .agg(F.sum("words").alias("taken"), F.size(F.collect_set("use.shard")).cast("bigint").alias("n_shards"))
    )
    # An empty document shares its start with its successor but takes nothing.
    key = F.when(F.col("size") > 0, F.col("start"))
    return (
        placed.withColumn("_start", key)
        .join(taken.withColumnRenamed("start", "_start").hint("merge"), ["sid", "_start"], "left")
        .select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
            F.coalesce("n_shards", F.lit(0)).cast("bigint").alias("n_shards"),
        )
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: for each document and epoch one row with the words taken, in the columns of ``docs``.

    A document taken whole keeps its text unchanged; of the others the taken
    words are joined by single spaces and ``n_chars``, if there, is set anew.
    Documents without words hold nothing to mix and go.
    """
    names = docs.columns
    sized, targets = plan(docs)
    placed = place_documents(sized, targets)
    bounds = sized.select("doc_id", "source", "size")
    taken = (
        block_pieces(place_documents(bounds, targets)).join(mix_slots(targets).hint("merge"), ["sid", "block"])
        .withColumn("words", _within(F.col("words"), F.col("offset"), F.col("take"))).where(F.col("words") > 0)
        .groupBy("sid", "start", "epoch")
        .agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("_pieces"), F.sum("words").alias("_taken"))
    )
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(
        F.flatten(
            F.transform(
                F.col("_pieces"),
                lambda p: F.slice(F.col("_words"), (p["first"] + 1).cast("int"), p["words"].cast("int")),
            )
        ),
        " ",
    )
    whole = F.col("_taken") == F.col("size")
    mixed = (
        placed.where(F.col("size") > 0).join(taken.hint("merge"), ["sid", "start"])
        .withColumn("_words", F.when(~whole, words))
        .withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    )
    if "n_chars" in names:
        mixed = mixed.withColumn("n_chars", F.length("text").cast("bigint"))
    return mixed.select(*names)


def mix_blocks(docs: DataFrame, words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as output blocks: (shard, source, slot, epoch, block, n_words, text), one row per slot.

    ``text`` holds the words taken, joined by single spaces: ``words`` of them but at the end of
    a source's run and in its last slot. ``slot`` numbers the blocks of a source inside their shard.
    """
    sized, targets = plan(docs.select("doc_id", "text", "source"))
    placed = place_documents(sized, targets).where(F.col("size") > 0)
    first, last = F.col("start"), F.col("start") + F.col("size") - 1
    blocks = F.sequence(F.call_function("div", first, F.lit(words)), F.call_function("div", last, F.lit(words)))

    def piece(b: Column) -> Column:
        low = F.greatest(first, b * words)
        high = F.least(last + 1, (b + 1) * words)
        part = F.slice("_words", (low - first + 1).cast("int"), (high - low).cast("int"))
        return F.struct(b.alias("block"), (low - b * words).alias("offset"), part.alias("part"))

    held = (
        placed.select("sid", "start", "size", F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1)).alias("_words"))
        .select("sid", F.explode(F.transform(blocks, piece)).alias("_piece"))
        .select("sid", "_piece.*")
    )
    whole = held.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("_parts"))
    run = F.flatten(F.transform("_parts", lambda p: p["part"]))
    named = targets.select("sid", "source")
    return (
        mix_slots(targets, block=words).join(whole.hint("merge"), ["sid", "block"]).join(named, "sid")
        .withColumn("_run", F.slice(run, 1, F.col("take").cast("int")))
        .select(
            "shard", "source", "slot", "epoch", "block", F.size("_run").cast("bigint").alias("n_words"),
            F.array_join("_run", " ").alias("text"),
        )
    )
