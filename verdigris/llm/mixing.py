"""Mixing sources to target weights, in DataFrame functions only.

The words (tokens) of each source are packed into blocks of a fixed length: documents follow each other in the order
of a seeded hash, and a block may begin and end inside a document.  The mix is a row of equal slots, dealt to output
shards.  Each shard draws multinomial source counts, conditioned on the whole mix's counts being the targets: every
slot that a source's target gives it draws a seeded 64-bit number, and the slots are numbered in the order of these, so
that the sources' order is a random permutation and a shard, a range of numbers, is a draw from it without return.  The
numbers are counted in two levels, buckets and places in a bucket, so that no task holds the mix.  A slot's index within
its source is mapped to a block by a pseudorandom permutation of the source's blocks, another for every pass over the
source.  So no block is taken more often than there are passes; slots and blocks are then joined by source and block
number.

A permutation of a source's blocks 0..n-1 is a swap-or-not shuffle (Hoang, Morris and Rogaway, 2012): in each of
SHUFFLES rounds a number x has the partner k - x mod n, with a hashed k, and a hash of the greater of the two tells
whether they change places.  That holds for any n, and every number is found alone.

Sums over all sources, and over all buckets of slots, are made by ranges, so that no task sees all of them.

Targets: sources have cyclic weights by rank and share the total; a target stops at `most` times its source's size, and
the excess is dealt again by weight until none is above.  Sizes are words, `[^\\x20\\x09-\\x0D]+`; a null text has none.
A null source is a source, the last one.  Repeated rows are documents of their own.  Documents without words keep their
row of the plan and are in no block.  An empty table gives empty tables.  Other columns are ignored.  Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.plans import running
from verdigris.plans.scratch import Scratch, bounded

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of a source's hash order; a source's running sum is one window over so many rows, and one within each bucket.
BUCKETS = 4096
#: Slots that one row of the slot plan stands for, and about as many that one bucket of their order holds.
RUN = 4096
#: Tasks that write out the slots, a few runs each; the runs are few rows, which nothing else would spread.
MOST_TASKS = 20_000
#: Rounds of a permutation of blocks.
SHUFFLES = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """sizes: source, source_size, a row for each source.  Adds rank (by code point, null last) and target.  Sources
    reach their caps in ascending order of cap per weight, so one ordered pass finds what a unit of weight is worth."""
    t = running.before(sizes.withColumn("one", F.lit(1)), [F.col("source").cast("binary").asc_nulls_last()], ["one"], scratch)
    t = t.select("source", "source_size", F.col("before_one").alias("rank"))
    t = t.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(most))
    t = running.before(t, [F.col("cap") / F.col("w"), F.col("rank")], ["cap", "w"], scratch)
    all_ = t.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    t = t.withColumn("unit", (F.lit(float(all_["size"] or 0) * share) - F.col("before_cap")) / (F.lit(all_["w"]) - F.col("before_w")))
    # what a unit is worth is found at the first source that does not reach its cap
    free = t.where(F.col("unit") * F.col("w") < F.col("cap")).agg(F.min(F.struct(F.col("cap") / F.col("w"), "rank", "unit")).alias("f")).first()["f"]
    if free is None:
        return t.select("source", "source_size", "rank", F.col("cap").alias("target"))
    order = F.struct(F.col("cap") / F.col("w"), F.col("rank"))
    capped = order < F.struct(F.lit(free[0]), F.lit(free["rank"]).cast(t.schema["rank"].dataType))
    return t.select("source", "source_size", "rank", F.when(capped, F.col("cap")).otherwise(F.lit(free["unit"]) * F.col("w")).alias("target"))


def _permuted(i: Column, n: Column, key: Column) -> Column:
    """Where the permutation of 0..n-1 that belongs to the key takes i."""

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        swap = F.shiftrightunsigned(F.xxhash64(key, r, F.greatest(x, partner)), 63) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SHUFFLES)), i, turn)


def place(docs: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """Each document's place in its source's row of words: doc_id, key (hash of its text), source, s, size, begin; no
    begin without words.  The running sum has two levels, so that no task holds a source."""
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    d = d.withColumn("s", _source_key(F.col("source"))).withColumn("order", F.xxhash64("key", "doc_id", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 3), F.lit(BUCKETS)).cast("int"))
    d = scratch.keep(d, "sizes")
    per = d.groupBy("s", "bucket").agg(F.sum("size").alias("in_bucket"))
    per = per.select("s", "bucket", (F.sum("in_bucket").over(Window.partitionBy("s").orderBy("bucket")) - F.col("in_bucket")).alias("at"))
    within = Window.partitionBy("s", "bucket").orderBy("order", "key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = d.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return scratch.keep(inside.join(per, ["s", "bucket"]).select("doc_id", "key", "source", "s", "size", F.when(F.col("size") > 0, F.col("at") + F.col("inside")).alias("begin")), "placed")


def slots(sources: DataFrame, scratch: Scratch, shard_slots: int, most: float, seed: int) -> DataFrame:
    """sources: s, rank, source_size, n_blocks, target.  One row for each slot of the mix: shard, slot, s, block_no.  A
    source's slots are its target by the mean length of its blocks, of which the last may be short."""
    b = sources.where("n_blocks > 0").withColumn("take", F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("bigint"), F.col("n_blocks") * int(most)))
    b = running.before(b, [F.col("rank")], ["take"], scratch)
    buckets = max(1, -(-(b.agg(F.sum("take")).first()[0] or 0) // RUN))
    laps = b.where("take > 0").withColumn("lap", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("take") - 1) / F.col("n_blocks")))))
    laps = laps.withColumn("key", F.xxhash64(F.lit(seed), "s", "lap")).withColumn("here", F.least(F.col("n_blocks"), F.col("take") - F.col("lap") * F.col("n_blocks")))
    runs = laps.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("here") - 1) / RUN)))).repartition(min(MOST_TASKS, buckets // 4 + 1), "s", "lap", "run")
    s = runs.withColumn("i", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("here")) - 1)))
    s = s.withColumn("at", F.col("before_take") + F.col("lap") * F.col("n_blocks") + F.col("i")).withColumn("drawn", F.xxhash64(F.lit(seed), "at"))
    s = s.select("s", _permuted(F.col("i"), F.col("n_blocks"), F.col("key")).alias("block_no"), "at", "drawn", F.pmod("drawn", F.lit(buckets)).alias("bucket"))
    s = scratch.keep(s, "slots")
    per = running.before(s.groupBy("bucket").agg(F.count("*").alias("in_bucket")), [F.col("bucket")], ["in_bucket"], scratch)
    inside = s.withColumn("inside", F.row_number().over(Window.partitionBy("bucket").orderBy("drawn", "at")) - 1)
    s = inside.join(per, "bucket").withColumn("slot", F.col("before_in_bucket") + F.col("inside"))
    return s.select(F.floor(F.col("slot") / shard_slots).alias("shard"), "slot", "s", "block_no")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, block: int = 128, shard_slots: int = 8192, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text, source.  Returns (mix, plan).  mix: a row for each piece of a document in each slot of the
    mix, with shard, slot, s, begin (together naming the row of the plan), first (word in the document) and words.
    plan: a row for each document, with doc_id, key, source, s, size, begin, source_size and target."""
    scratch = Scratch(docs.sparkSession)
    placed = place(docs, seed, scratch)
    sizes = placed.groupBy("s", "source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes.drop("s"), scratch, weights, share, most).withColumn("s", _source_key(F.col("source"))).withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    goals = scratch.keep(goals, "targets")
    numbers = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))
    pieces = placed.where("size > 0").withColumn("block_no", F.explode(numbers))
    first = F.greatest(F.col("block_no") * block - F.col("begin"), F.lit(0))
    end = F.least((F.col("block_no") + 1) * block - F.col("begin"), F.col("size"))
    pieces = pieces.select("s", "block_no", "begin", first.alias("first"), (end - first).alias("words"))
    mix = slots(goals, scratch, shard_slots, most, seed).join(pieces, ["s", "block_no"])
    per_source = goals.select("s", "source_size", "target")
    plan = placed.join(F.broadcast(per_source) if bounded(per_source, 1_000_000) else per_source, "s")
    return mix, plan


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of docs, whatever they are called, text and n_chars (if there is one) by
    what is taken: of a document whose words are taken up to r times there are r rows; row i holds, in their order, the
    pieces that are taken i times at least, with the white space that follows each word.  Documents of which nothing is
    taken have no row.  Rows that agree in doc_id, text and source are told apart by their place in the mix alone; their
    other columns are those of one of them."""
    mix, plan = mix_sources(docs, **options)
    times = mix.groupBy("s", "begin", "first", "words").agg(F.count("*").alias("times"))
    taken = times.groupBy("s", "begin").agg(F.array_sort(F.collect_list(F.struct("first", "words", "times"))).alias("pieces"))
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.array_max(F.transform("pieces", lambda p: p["times"])))))
    # a null doc_id is told by its text
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    copies = copies.join(plan.where("size > 0").select("s", "begin", named, "key"), ["s", "begin"])
    texts = docs.select(named, F.xxhash64(F.col("text").cast("string")).alias("key"), _source_key(F.col("source").cast("string")).alias("s"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    out = copies.join(texts.dropDuplicates(["id", "key", "s"]), ["id", "key", "s"])
    words = F.regexp_extract_all("doc.text", F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    chosen = F.filter("pieces", lambda p: p["times"] >= F.col("copy"))
    # a text is cut into words once, not for each piece: the struct binds them
    bound = F.array(F.struct(words.alias("w"), chosen.alias("c")))
    joined = F.transform(bound, lambda x: F.array_join(F.flatten(F.transform(x["c"], lambda p: F.slice(x["w"], (p["first"] + 1).cast("int"), p["words"].cast("int")))), ""))
    own = {"text": F.col("new"), "n_chars": F.length("new").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    out = out.select("doc", F.get(joined, F.lit(0)).alias("new"))
    return out.select(*(own[c].alias(c) if c in own else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
