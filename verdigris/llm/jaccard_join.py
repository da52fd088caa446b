"""N-gram Jaccard join: blocked sparse matrix product of document by n-gram incidence.

The rows of the matrix are the distinct shingle sets of the documents (exact copies share a row).  Which rows can reach
the threshold together follows from their sizes alone: sets a and b that do differ in at most
D = (1 - t) (|a| + |b|) / (1 + t) columns.  So with the columns dealt by hash into more than D column blocks, two such
rows agree entirely in at least (blocks - D) of them.  Only rows that agree with others in as many column blocks are
kept; of them, row blocks with a column block in common are multiplied: overlaps are accumulated column block by column
block, and a pair is discarded once its count plus what is left of the smaller row is below t (|a| + |b|) / (1 + t).

All bounds are exact integer arithmetic, so no link is lost and none is added; the hashes have 64 bits, those that tell
copies 128.  Rows of the same size class use the same number of column blocks: a class ends at 1.5 times the end of the
one before, and a row is also dealt by the next class's blocks where a partner could be there.  Column blocks that are
empty in a row may be empty in its partner too: as these need not be seen to agree, a row needs as many fewer.  They are
only written for rows so uneven that nothing else need agree; then the partner is as uneven and writes them too.

Digests and signatures that hold a large share of all rows are joined by broadcast of these few keys, others by
shuffle.  A signature that meets many row blocks is a product of rows and
blocks, which adaptive execution splits.

A null, empty or wordless text has an empty set, is linked with nothing and is its own component.  Repeated rows of an
id are returned as often as they come; under one id they are one document, linked by any of its texts.  A null id keeps
its row and takes the least id of its component.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.shingles import mix, shingle_sets
from verdigris.plans import hot
from verdigris.plans.components import components
from verdigris.plans.scratch import Scratch, bounded

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
#: Texts of one step: about so many bytes, or a single text.
STEP_BYTES = 1 << 20
#: Weight of a row block: a row weighs its elements and ROW more.
BLOCK, ROW = 150_000, 256
#: Rows of a table that may be broadcast: 2 million longs are 32 MB on an executor.
BROADCAST_ROWS = 2_000_000
#: Columns with fewer rows than this are multiplied pair by pair, others as a dense block.
DENSE = 8


def class_ends() -> np.ndarray:
    ends = [6]
    while ends[-1] < 1 << 40:
        ends.append(ends[-1] * 3 // 2)
    return np.array(ends)


ENDS = class_ends()


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about STEP_BYTES."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    lo, total = 0, 0
    for i, s in enumerate(size):
        if total and total + s > STEP_BYTES:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(size):
        yield lo, len(size)


def column_blocks(h: np.ndarray, n: np.ndarray, percent: int, up: int) -> dict[str, np.ndarray]:
    """For each row that is dealt by the blocks of its own size class (up 0) or of the one `up` above: row, class,
    need (agreeing blocks without which no partner reaches percent), sigs (one array) and their number."""
    c = np.searchsorted(ENDS, np.maximum(n, 1), "left") + up
    ok = (n > 0) & ((up == 0) | (ENDS[np.maximum(c - 1, 0)] < n * 100 // percent))
    differ = (100 - percent) * 2 * ENDS[c] // (100 + percent)
    blocks = np.where(ok, differ + 1 + -(-differ // 25), 0)
    rows = np.repeat(np.arange(len(n)), n)
    if not ok.all():
        h, rows = h[ok[rows]], rows[ok[rows]]
    base = np.r_[0, np.cumsum(blocks)]
    x = mix(h + (c[rows] + 1).astype(_U) * _GOLD)
    key = base[rows] + (x % np.maximum(blocks, 1)[rows].astype(_U)).astype(np.int64)
    total = np.zeros(base[-1], _U)
    np.add.at(total, key, mix(x))
    full = np.bincount(key, minlength=base[-1]) > 0
    row = np.repeat(np.arange(len(n)), blocks)
    empty = np.bincount(row[~full], minlength=len(n))
    uneven = empty >= blocks - differ
    most = np.minimum(ENDS[c], n * 100 // percent)
    need = np.maximum(1, blocks - (100 - percent) * (n + most) // (100 + percent) - empty)
    out = full | uneven[row]
    place = np.arange(base[-1]) - base[row]
    sigs = mix(total + place.astype(_U) * _GOLD + mix(c[row].astype(_U) + _U(1)))
    return {"row": np.flatnonzero(ok), "class": c[ok], "need": need[ok], "sigs": sigs[out], "count": np.bincount(row[out], minlength=len(n))[ok]}


def _rows(k: int, percent: int):
    """Of each document: size and two digests of its set; of each class it is dealt by: class, need and sigs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in steps(batch["text"]):
                h, n = shingle_sets(batch["text"][lo:hi], k)
                row = np.repeat(np.arange(len(n)), n)
                digests = []
                for seed in (1, 2):
                    d = np.zeros(len(n), _U)
                    np.add.at(d, row, mix(h + mix(np.full(1, seed, _U))))
                    digests.append(mix(d).view(np.int64))
                parts = [column_blocks(h, n, percent, up) for up in (0, 1)]
                # documents without a set have one row, without sigs
                parts.append({"row": (r := np.flatnonzero(n == 0)), "class": r * 0, "need": r * 0, "sigs": np.empty(0, _U), "count": r * 0})
                for up, p in enumerate(parts):
                    at = np.r_[0, np.cumsum(p["count"])].astype(np.int32)
                    sigs = pa.ListArray.from_arrays(pa.array(at), pa.array(p["sigs"].view(np.int64)))
                    cols = [batch["doc_id"][lo:hi].take(pa.array(p["row"])), pa.array(n[p["row"]], pa.int32()), *(pa.array(d[p["row"]]) for d in digests), pa.array(np.full(len(at) - 1, up == 1)), pa.array(p["class"], pa.int32()), pa.array(p["need"], pa.int32()), sigs]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "k1", "k2", "again", "class", "need", "sigs"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in steps(batch["text"]):
                h, n = shingle_sets(batch["text"][lo:hi], k)
                at = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], pa.ListArray.from_arrays(at, pa.array(h.view(np.int64)))], ["doc_id", "items"])

    return run


def block_links(h: np.ndarray, n: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
    """Links (i, j), i < j, of rows given by their sorted hashes h and sizes n; left tells each row's block: only pairs
    with one row in either block, or any pair where there is one block.  The product's blocks, thinned to a forest."""
    rows = np.arange(len(n))
    one = left.all() or not left.any()
    row = np.repeat(rows, n)
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    df = np.diff(np.r_[start, len(h)])
    shared = df > 1
    if not one:  # a column in one block only joins nothing
        here = np.add.reduceat(left[row].astype(np.int64), start)
        shared &= (here > 0) & (here < df)
    live = np.bincount(row[np.repeat(shared, df)], minlength=len(n)) * 100 >= percent * n
    pick = np.repeat(shared, df) & live[row]
    col, row, names = np.repeat(np.arange(len(df)), df)[pick], row[pick], np.flatnonzero(live)
    if len(names) < 2:
        return np.empty((0, 2), np.int64)
    place = np.zeros(len(n), np.int64)
    place[names] = np.arange(len(names))
    row, size = place[row], n[names]
    allowed = np.triu(np.ones((len(names),) * 2, bool), 1)
    if not one:
        allowed &= left[names][:, None] != left[names][None, :]
    # overlap o is enough if 100 o >= percent (|a| + |b| - o)
    least = -(-percent * (size[:, None] + size[None, :]) // (100 + percent))
    allowed &= np.minimum(size[:, None], size[None, :]) >= least
    start = np.flatnonzero(np.r_[True, col[1:] != col[:-1]])
    df = np.diff(np.r_[start, len(col)])
    count = np.zeros((len(names),) * 2, np.float32)
    rest = np.bincount(row, minlength=len(names))
    for d in range(2, DENSE):
        at = start[df == d]
        for i in range(d):
            for j in range(i + 1, d):
                a, b = row[at + i], row[at + j]
                np.add.at(count, (np.minimum(a, b), np.maximum(a, b)), 1)
        for i in range(d):
            rest -= np.bincount(row[at + i], minlength=len(names))
    wide = np.flatnonzero(df >= DENSE)
    alone = np.flatnonzero(df == 1)
    rest -= np.bincount(row[start[alone]], minlength=len(names))
    for lo in range(0, len(wide), 2048):
        alive = allowed & (count + np.minimum(rest[:, None], rest[None, :]) >= least)
        use = np.flatnonzero(alive.any(0) | alive.any(1))
        if not len(use):
            return np.empty((0, 2), np.int64)
        slot = np.full(len(names), -1)
        slot[use] = np.arange(len(use))
        cols = wide[lo : lo + 2048]
        at = np.repeat(start[cols], df[cols]) + np.arange(df[cols].sum()) - np.repeat(np.r_[0, np.cumsum(df[cols])[:-1]], df[cols])
        r, c = row[at], np.repeat(np.arange(len(cols)), df[cols])
        part = np.zeros((len(use), len(cols)), np.float32)
        part[slot[r][slot[r] >= 0], c[slot[r] >= 0]] = 1
        count[np.ix_(use, use)] += part @ part.T
        rest -= np.bincount(r, minlength=len(names))
    found = np.argwhere(allowed & (count >= least))
    parent = np.arange(len(names))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for i, j in found:
        if (a := top(i)) != (b := top(j)):
            parent[max(a, b)] = min(a, b)
            forest.append((names[i], names[j]))
    return np.array(forest, np.int64).reshape(-1, 2)


def _multiply(percent: int):
    def run(block: pa.Table) -> pa.Table:
        ids = block["doc_id"].to_numpy()
        items = block["items"].combine_chunks()
        if isinstance(items, pa.ChunkedArray):
            items = pa.concat_arrays(items.chunks)
        n = np.asarray(pc.list_value_length(items), dtype=np.int64)
        links = block_links(items.flatten().to_numpy().view(_U), n, block["left"].to_numpy(zero_copy_only=False).astype(bool), percent)
        return pa.table({"a": ids[links[:, 0]], "b": ids[links[:, 1]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _small(df: DataFrame) -> DataFrame:
    """Broadcast it if it is small by count; else Spark joins by shuffle."""
    return F.broadcast(df) if bounded(df, BROADCAST_ROWS) else df


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs: doc_id, text.  Links documents whose sets of k-word shingles have a Jaccard similarity of percent / 100 or
    more (at least 67).  Returns doc_id, n_shingles, representative (least id with the same set) and component_id."""
    if not 67 <= percent <= 100:
        raise ValueError("percent must be in 67..100")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.keep(docs.mapInArrow(_rows(k, percent), "doc_id bigint, n int, k1 bigint, k2 bigint, again boolean, class int, need int, sigs array<bigint>"), "rows")
    same = scratch.keep(rows.where("n > 0 and not again").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "same")

    shared = rows.select("k1", F.explode("sigs").alias("sig")).groupBy("sig").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.count("*").alias("rows")).where("lo < hi").select("sig", "rows")
    shared = scratch.keep(shared, "shared")
    agree = hot.join_unique(rows.select("k1", "k2", "n", "class", "need", F.explode("sigs").alias("sig")), shared, ["sig"], "rows", small=BROADCAST_ROWS)
    enough = agree.groupBy("k1", "k2", "class", "need").agg(F.collect_set("sig").alias("sigs"), F.first("n").alias("n")).where("size(sigs) >= need")
    kept = scratch.keep(enough.join(same, ["k1", "k2"]).select("rep", "n", "class", "need", F.explode("sigs").alias("sig")), "kept")
    named = rows.where("not again").select("doc_id", "n", F.when(F.col("n") > 0, F.col("k1")).alias("k1"), F.when(F.col("n") > 0, F.col("k2")).alias("k2"))
    every = scratch.keep(hot.join_unique(named, same, ["k1", "k2"], "copies", "left").select("doc_id", "n", "rep"), "every")
    scratch.drop(shared, rows, same)

    # Row blocks: rows whose least partner is the same stay together, as far as a block holds them.
    least = kept.groupBy("sig").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("rows")).where("least < most").drop("most")
    least = scratch.keep(least, "least")
    near = hot.join_unique(kept, least, ["sig"], "rows", small=BROADCAST_ROWS)
    members = scratch.keep(near.groupBy("rep").agg(F.min("least").alias("pivot"), (F.max("n") + ROW).alias("weight")), "members")
    light = max(1, -(-(members.agg(F.sum("weight")).first()[0] or 0) // BLOCK))
    of_pivot = members.groupBy("pivot").agg(F.sum("weight").alias("total"))
    own = F.xxhash64("pivot", F.pmod(F.xxhash64("rep"), F.ceil(F.col("total") / BLOCK)))
    together = F.pmod(F.xxhash64("pivot"), F.lit(light))
    homes = scratch.keep(members.join(of_pivot, "pivot").select("rep", F.when(F.col("total") > BLOCK // 4, own).otherwise(together).alias("home")), "homes")

    # A row goes where it agrees with rows at home in as many column blocks as a partner must; each pair of row blocks is
    # one group.
    at_home = scratch.keep(near.select("rep", "class", "need", "sig").join(homes, "rep"), "at_home")
    scratch.drop(kept, least, homes)
    there = at_home.groupBy("sig", "home").agg(F.count("*").alias("rows")).withColumnRenamed("home", "to")
    meet = at_home.join(there, "sig").where("home <> to or rows > 1").groupBy("rep", "home", "to", "class", "need").agg(F.countDistinct("sig").alias("agreeing"))
    meet = meet.where("agreeing >= need").select("rep", "home", "to").distinct()
    pairs = meet.select("rep", F.xxhash64(F.least("home", "to"), F.greatest("home", "to")).alias("pair"), (F.col("home") <= F.col("to")).alias("left"))
    wanted = members.select(F.col("rep").alias("doc_id"))
    texts = docs.join(_small(wanted), "doc_id", "left_semi").dropDuplicates()
    sets = scratch.keep(texts.mapInArrow(_sets(k), "doc_id bigint, items array<bigint>"), "sets")
    blocks = pairs.join(sets, pairs["rep"] == sets["doc_id"]).select("pair", "left", "doc_id", "items")
    links = scratch.keep(blocks.groupBy("pair").applyInArrow(_multiply(percent), "a bigint, b bigint"), "links")
    scratch.drop(sets, at_home, members)
    found = components(links, scratch)
    scratch.drop(links)
    out = every.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("representative"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
