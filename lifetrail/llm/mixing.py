"""Mixing sources to target weights with Sainte-Lague apportionment.

Each source's words stand in a seeded order of its documents and are cut
into blocks of ``block_words``.  The blocks of the whole mix are
apportioned to the sources by highest quotients ``target / (2 s + 1)``;
this method never takes a seat back when the house grows, so the first
seats make the first shard, the next ones the second, and every shard
gets integer quotas.  A source with a quota of q among its n blocks takes
all of them ``q div n`` times and the remaining ones by a seeded
permutation of the block numbers.  The blocks a source gives are numbered
by round and permuted number; number k goes to the shard whose running
quota of the source covers k, so each shard holds its quotas.

All of it is DataFrame code: one aggregation by (source, hash range)
gives the sources' sizes and where each hash range starts; a second pass
numbers the words within each range.  A hot source is split over many
ranges.  Only the plan, one row per source and shard, is small by nature.

Defined cases: null text: size 0; a null source is a source of its own
that sorts last; a null ``doc_id`` is kept; repeated rows stand side by
side; a source of size 0 takes nothing; an empty table gives no rows;
other columns pass through ``mix`` unless they start with ``mix_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifetrail.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it, the last one also with what follows.
WORD_PART = r"[\x20\x09-\x0D]*" + WORD + r"(?:[\x20\x09-\x0D]+\z)?"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
BLOCK_WORDS = 64
SHARDS = 8
SEED = 20_26
ROWS_PER_RANGE, MOST_RANGES = 256, 1 << 16
#: Multipliers of the permutations; a prime that does not divide the number of blocks permutes them.
PRIMES = (1_000_003, 999_983)
#: A table of up to so many sources is broadcast.
BROADCAST_SOURCES = 10_000


def words(text="text"):
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size`` with ``rank``, ``weight`` and ``target``.

    Sources in code-point order (null last) get the weights in turn and
    share ``share`` times all words; no target passes ``most`` times its
    source's size.  Resharing the excess by weight ends at one level: a
    target is level * weight or its limit.  Sorted by limit / weight, the
    level is set by the first source that stays below its limit."""
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(by_source))
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(int(w)) for w in weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    s = s.withColumn("limit", F.lit(most) * F.col("source_size")).withColumn("full_at", F.col("limit") / F.col("weight"))
    before = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("full_at", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
    s = s.withColumn("try", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after))
    first = F.when(F.col("try") <= F.col("full_at"), F.struct("full_at", "rank", "try"))
    s = s.withColumn("level", F.min(first).over(whole)["try"])
    target = F.when(F.col("level") * F.col("weight") < F.col("limit"), F.col("level") * F.col("weight")).otherwise(F.col("limit").cast("double"))
    return s.select("source", "source_size", "rank", "weight", target.alias("target"))


def quotas(plan: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """``shard, rank, quota``: each shard's blocks by source.

    For a house of h seats a source's number of seats lies within half
    the number of sources (and one) of its exact share, so only those
    seats compete; the quotas of a shard are the difference of two houses."""
    whole = Window.partitionBy()
    p = plan.where("target > 0").withColumn("all_targets", F.sum("target").over(whole)).withColumn("n_sources", F.count("*").over(whole))
    p = p.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    p = p.withColumn("house", F.floor(F.round(F.col("all_targets") / block_words) * (F.col("shard") + 1) / shards).cast("long"))
    p = p.withColumn("exact", F.floor(F.col("house") * F.col("target") / F.col("all_targets")).cast("long"))
    p = p.withColumn("reach", F.floor(F.col("n_sources") / 2).cast("long") + 2)
    p = p.withColumn("sure", F.greatest(F.col("exact") - F.col("reach"), F.lit(0).cast("long")))
    seats = p.withColumn("seat", F.explode(F.sequence(F.col("sure"), F.col("exact") + F.col("reach"))))
    seats = seats.withColumn("quotient", F.col("target") / (2 * F.col("seat") + 1))
    best = Window.partitionBy("shard").orderBy(F.col("quotient").desc(), "rank", "seat")
    sure = p.groupBy("shard").agg(F.sum("sure").alias("all_sure"))
    won = seats.withColumn("place", F.row_number().over(best)).join(sure, "shard").groupBy("shard", "rank").agg(
        (F.first("sure") + F.sum(F.when(F.col("place") <= F.col("house") - F.col("all_sure"), 1).otherwise(0))).alias("up_to"))
    earlier = Window.partitionBy("rank").orderBy("shard")
    return won.select("shard", "rank", (F.col("up_to") - F.coalesce(F.lag("up_to").over(earlier), F.lit(0))).alias("quota"))


def mix_plan(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_COPIES, block_words=BLOCK_WORDS, shards=SHARDS, seed=SEED) -> DataFrame:
    """One row per source: target, blocks, quota over all shards, ``running`` (the quotas
    of the shards up to each one), and how its blocks are picked."""
    plan = targets(sizes, weights, share, most)
    so_far = Window.partitionBy("rank").orderBy("shard")
    running = quotas(plan, block_words, shards).withColumn("up_to", F.sum("quota").over(so_far)).groupBy("rank").agg(
        F.sort_array(F.collect_list(F.struct("shard", "up_to")))["up_to"].alias("running"))
    p = plan.join(running, "rank", "left").withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    none = F.array_repeat(F.lit(0).cast("long"), shards)
    p = p.withColumn("running", F.transform(F.coalesce("running", none), lambda x: F.least(x, F.lit(most) * F.col("blocks"))))
    p = p.withColumn("quota", F.element_at("running", -1))
    p = p.withColumn("rounds", F.coalesce(F.floor(F.col("quota") / F.when(F.col("blocks") > 0, F.col("blocks"))).cast("long"), F.lit(0)))
    p = p.withColumn("more", F.col("quota") - F.col("rounds") * F.col("blocks"))
    factor = F.lit(1)
    for prime in reversed(PRIMES):
        factor = F.when(F.col("blocks") % prime != 0, F.lit(prime)).otherwise(factor)
    p = p.withColumn("factor", factor.cast("long"))
    return p.withColumn("shift", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), "source"), F.col("blocks"))).otherwise(0).cast("long"))


def permuted(block):
    """A block's number within each round."""
    return F.pmod(F.col("mix_factor") * block + F.col("mix_shift"), F.col("mix_blocks"))


def picked_more(block):
    """Whether a block is among those that the last round takes."""
    return permuted(block) < F.col("mix_more")


def shard_of(round_, block):
    """The shard of what a round takes of a block; null if it takes nothing."""
    k = round_ * F.col("mix_blocks") + permuted(block)
    return F.when(k < F.element_at("mix_running", -1), F.size(F.filter("mix_running", lambda up_to: up_to <= k)))


def shard_words(first, last, end, block_words: int):
    """``shard, words`` of every shard that takes words of a document."""
    each = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("mix_rounds")), lambda r: F.transform(F.sequence(first, last), lambda b: F.struct(
        shard_of(r, b).alias("shard"), (F.least((b + 1) * block_words, end) - F.greatest(b * block_words, F.col("mix_start"))).alias("words")))))
    number = F.sequence(F.lit(0), F.size("mix_running") - 1)
    sums = lambda parts: F.transform(number, lambda s: F.struct(
        s.alias("shard"), F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + F.when(p["shard"] == s, p["words"]).otherwise(F.lit(0).cast("long"))).alias("words")))
    by_shard = F.element_at(F.transform(F.array(each), sums), 1)  # the parts are made once
    none = F.array().cast("array<struct<shard:int,words:long>>")
    return F.when(F.col("mix_size") > 0, F.filter(by_shard, lambda x: x["words"] > 0)).otherwise(none)


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_COPIES, block_words=BLOCK_WORDS, shards=SHARDS, seed=SEED, columns: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with ``mix_size``, ``mix_source_size``,
    ``mix_target``, ``mix_taken``, ``mix_shards`` (words that each shard
    takes) and what ``mixed_documents`` and ``mixed_shards`` need."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    columns = list(columns or [c for c in docs.columns if not c.startswith("mix_")])
    ranges = min(MOST_RANGES, max(1, docs.count() // ROWS_PER_RANGE))
    rows = docs.select(*columns, key.alias("mix_key"), words().alias("mix_size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("mix_hash"))
    place = F.shiftrightunsigned("mix_hash", 33)
    rows = rows.withColumn("mix_range", F.shiftright(place * F.lit(ranges), 31)).withColumn("mix_place", place)
    sums = docs.select(F.col("source").cast("string").alias("source"), key.alias("mix_key"), words().alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    sums = sums.withColumn("mix_range", F.shiftright(F.shiftrightunsigned("h", 33) * F.lit(ranges), 31))
    sums = materialise(sums.groupBy("source", "mix_key", "mix_range").agg(F.sum("size").alias("size")), "mix-ranges")
    sources = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialise(mix_plan(sources, weights, share, most, block_words, shards, seed).withColumn(
        "mix_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))), "mix-plan")
    small = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    earlier = Window.partitionBy("mix_key").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("mix_key", "mix_range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("mix_range_start"))
    kept = ("source_size", "target", "blocks", "rounds", "more", "factor", "shift", "running")
    starts = starts.join(small.select("mix_key", *(F.col(c).alias(f"mix_{c}") for c in kept)), "mix_key")
    in_range = Window.partitionBy("mix_key", "mix_range").orderBy("mix_place", "mix_hash", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(starts, ["mix_key", "mix_range"])
    out = out.withColumn("mix_start", F.col("mix_range_start") + F.coalesce(F.sum("mix_size").over(in_range), F.lit(0)))
    end = F.col("mix_start") + F.col("mix_size")
    first, last = F.floor(F.col("mix_start") / block_words).cast("long"), F.floor((end - 1) / block_words).cast("long")
    more = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda taken, b: taken + F.when(
        picked_more(b), F.least((b + 1) * block_words, end) - F.greatest(b * block_words, F.col("mix_start"))).otherwise(F.lit(0).cast("long")))
    taken = F.col("mix_rounds") * F.col("mix_size") + F.when(F.col("mix_size") > 0, more).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("mix_taken", taken).withColumn("mix_shards", shard_words(first, last, end, block_words))
    return out.drop("mix_key", "mix_range", "mix_place", "mix_hash", "mix_range_start")


def _carried(docs: DataFrame) -> DataFrame:
    """What the mix works on, and the rest of the row as one column, so no column's name can clash."""
    return docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("mix_document"))


def _as_document(docs: DataFrame, text) -> list:
    return [text.alias(c) if c == "text" else F.col("mix_document").getField(c).alias(c) for c in docs.columns]


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, **settings) -> DataFrame:
    """The mix itself: a document once for each round that takes words of
    it, with those words (and the white space after them) as its text; its
    other columns pass through unchanged, whatever their names."""
    mixed = mix(_carried(docs), block_words=block_words, columns=["text", "mix_document"], **settings).where("mix_taken > 0")
    parts = F.regexp_extract_all("text", F.lit(WORD_PART), F.lit(0))
    block = lambda i: F.floor((F.col("mix_start") + i) / block_words).cast("long")
    last = F.array_join(F.filter(parts, lambda part, i: picked_more(block(i))), "")
    rounds = F.when(F.col("mix_rounds") > 0, F.array_repeat(F.col("text"), F.col("mix_rounds").cast("int"))).otherwise(F.array().cast("array<string>"))
    rest = F.when(F.col("mix_taken") == (F.col("mix_rounds") + 1) * F.col("mix_size"), F.col("text")) \
        .when(F.col("mix_taken") > F.col("mix_rounds") * F.col("mix_size"), last)
    texts = F.filter(F.concat(rounds, F.array(rest)), lambda t: t.isNotNull())
    return mixed.withColumn("mix_text", F.explode(texts)).select(*_as_document(docs, F.col("mix_text")))


def mixed_shards(docs: DataFrame, block_words: int = BLOCK_WORDS, **settings) -> DataFrame:
    """The mix by shard: ``mix_shard`` and the columns of ``docs``, a
    document once for each shard and round that take words of it, with
    those words as its text (a column of their own called ``mix_shard`` goes)."""
    mixed = mix(_carried(docs), block_words=block_words, columns=["text", "mix_document"], **settings).where("mix_taken > 0").withColumn("mix_parts", F.regexp_extract_all("text", F.lit(WORD_PART), F.lit(0)))
    block = lambda i: F.floor((F.col("mix_start") + i) / block_words).cast("long")
    blocks = F.sequence(block(F.lit(0)), block(F.col("mix_size") - 1))
    turns = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("mix_rounds")), lambda r: F.transform(blocks, lambda b: F.struct(r.alias("round"), shard_of(r, b).alias("shard")))))
    turns = F.array_distinct(F.filter(turns, lambda x: x["shard"].isNotNull()))
    mixed = mixed.withColumn("mix_turn", F.explode(turns))
    text = F.array_join(F.filter("mix_parts", lambda part, i: shard_of(F.col("mix_turn")["round"], block(i)).eqNullSafe(F.col("mix_turn")["shard"])), "")
    return mixed.select(F.col("mix_turn")["shard"].alias("mix_shard"), *_as_document(docs.drop("mix_shard"), text))
