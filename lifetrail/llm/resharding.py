"""Minimum-cost-flow resharding under the law of equal bytes.

Documents sit in old shards.  Every old shard is cut into blocks by a
hash of the document, and Spark sums each block's bytes.  A transport
network leads from old shards (supply: their bytes) to new shards
(capacity: the bytes they may hold); keeping bytes costs nothing, moving
a byte costs one.  Its cheapest flow says how many bytes go from where to
where, so the fewest bytes move.  Whole blocks then follow the flow,
largest first, and a few blocks are exchanged to level what blocks cannot
divide.  Documents follow their block.  ``reshard`` writes a first layout;
``reshard_layout`` takes an existing one, rewrites only the shards whose
content changes and reads the others where they lie.

The driver sees block sizes only: at most ``blocks`` per old shard,
whatever the table's size.  Slots are numbered in two steps (rows before
a block, rows before a document in its block), so no shard is ever one
group; a hot old shard has as many blocks as any other.

Defined cases: a null text has no bytes (size 8) and the CRC of the empty
text; a null ``doc_id`` is kept; repeated rows stand side by side; equal
sizes go in order of shard and block number; an empty table gives no
rows; other columns are kept by ``assign`` unless they start with ``shard_``.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifetrail.llm.common import materialise, scratch_dir

SHARDS = 24
BLOCKS = 256


def text_size() -> Column:
    return (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 8).cast("long")


def cheapest_flow(supply: Sequence[int], capacity: Sequence[int], cost) -> dict[tuple[int, int], int]:
    """Units from each supply to each capacity at least total cost (all supply is placed).

    Successive shortest paths: each round sends what still can go along
    the cheapest path of the residual network, found with potentials."""
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are smaller than the supply")
    n, m = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    pot = [0] * (n + m)
    while any(left):
        dist, via = [float("inf")] * (n + m), [-1] * (n + m)
        queue = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                queue.append((0, i))
        heapq.heapify(queue)
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            if u < n:
                steps = ((n + j, cost(u, j)) for j in range(m))
            else:
                steps = ((i, -cost(i, u - n)) for i in range(n) if flow.get((i, u - n), 0) > 0)
            for v, c in steps:
                new = d + c + pot[u] - pot[v]
                if new < dist[v]:
                    dist[v], via[v] = new, u
                    heapq.heappush(queue, (new, v))
        end = min((n + j for j in range(m) if room[j]), key=lambda v: dist[v] + pot[v])
        path = [end]
        while via[path[-1]] >= 0:
            path.append(via[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n])
        for u, v in zip(path, path[1:]):
            if u >= n:  # taking back what v sent to u
                amount = min(amount, flow[v, u - n])
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[u, v - n] = flow.get((u, v - n), 0) + amount
            else:
                flow[v, u - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
        pot = [p + (d if d < float("inf") else 0) for p, d in zip(pot, dist)]
    return {k: v for k, v in flow.items() if v}


def place_blocks(sizes: dict[tuple[int, int], int], capacity: Sequence[int], old_shards: int) -> dict[tuple[int, int], int]:
    """New shard of each (old shard, block)."""
    supply = [0] * old_shards
    for (old, _), s in sizes.items():
        supply[old] += s
    flow = cheapest_flow(supply, capacity, lambda i, j: int(i != j))
    due = [[flow.get((i, j), 0) for j in range(len(capacity))] for i in range(old_shards)]
    room, to = list(capacity), {}
    for (old, block), s in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        # where the flow still wants most from this shard; a shard that is full takes no more
        j = max(range(len(capacity)), key=lambda j: (min(due[old][j], room[j]), room[j], -j))
        due[old][j] -= s
        room[j] -= s
        to[old, block] = j
    return _levelled(to, sizes, capacity)


def _levelled(to: dict, sizes: dict, capacity: Sequence[int]) -> dict:
    """Move or exchange blocks between the fullest and the emptiest shard while that brings them closer."""
    inside: list[dict] = [{} for _ in capacity]
    for b, j in to.items():
        inside[j][b] = sizes[b]
    over = [sum(x.values()) - c for x, c in zip(inside, capacity)]
    for _ in range(20 * len(capacity)):
        hi, lo = max(range(len(over)), key=lambda j: (over[j], -j)), min(range(len(over)), key=lambda j: (over[j], j))
        gap = over[hi] - over[lo]
        best, move = gap, None
        give = sorted(inside[hi].items(), key=lambda x: (x[1], x[0]))
        take = [(None, 0), *sorted(inside[lo].items(), key=lambda x: (x[1], x[0]))]
        at = 0
        for b, s in give:  # both lists ascend: one walk finds the best partner of each
            while at + 1 < len(take) and abs(gap - 2 * (s - take[at + 1][1])) <= abs(gap - 2 * (s - take[at][1])):
                at += 1
            if (d := abs(gap - 2 * (s - take[at][1]))) < best:
                best, move = d, (b, take[at][0])
        if move is None:
            return to
        for b, j, k in ((move[0], hi, lo), (move[1], lo, hi)):
            if b is not None:
                s = inside[j].pop(b)
                inside[k][b] = s
                over[j] -= s
                over[k] += s
                to[b] = k
    return to


def assign(docs: DataFrame, old_shard: Column, old_shards: int, shards: int = SHARDS, blocks: int = BLOCKS, capacity: Sequence[int] | None = None, seed: int = 0) -> DataFrame:
    """``docs`` with ``shard_old, shard_block, shard_size, shard_new, shard_slot``.

    ``capacity`` defaults to equal shares of all bytes."""
    spark = docs.sparkSession
    docs = docs.select(*(c for c in docs.columns if not c.startswith("shard_")), old_shard.cast("int").alias("shard_old"))
    base = docs.withColumn("shard_size", text_size()).withColumn("shard_hash", F.xxhash64(F.lit(seed), "doc_id", "text"))
    base = base.withColumn("shard_block", F.pmod("shard_hash", F.lit(blocks)).cast("int"))
    sums = base.groupBy("shard_old", "shard_block").agg(F.sum("shard_size").alias("size"), F.count("*").alias("n")).collect()  # old_shards x blocks rows at most
    sizes = {(r["shard_old"], r["shard_block"]): r["size"] for r in sums}
    if capacity is None:
        total = sum(sizes.values())
        capacity = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    to = place_blocks(sizes, capacity, old_shards)
    counts = {(r["shard_old"], r["shard_block"]): r["n"] for r in sums}
    first, held = [], [0] * len(capacity)
    for b in sorted(to):
        first.append((b[0], b[1], to[b], held[to[b]]))
        held[to[b]] += counts[b]
    plan = spark.createDataFrame(first, "shard_old int, shard_block int, shard_new int, shard_first long")
    in_block = Window.partitionBy("shard_old", "shard_block").orderBy("shard_hash", F.col("doc_id").asc_nulls_first(), "shard_size")
    numbered = base.withColumn("shard_place", F.row_number().over(in_block) - 1)
    out = numbered.join(F.broadcast(plan), ["shard_old", "shard_block"])  # old_shards x blocks rows at most
    return out.withColumn("shard_slot", F.col("shard_first") + F.col("shard_place")).drop("shard_hash", "shard_first", "shard_place")


def rewrite(assigned: DataFrame, folder: str, only: Sequence[int] | None = None) -> None:
    """Write the documents of all new shards (or ``only`` some) as Parquet below ``folder/shard_new=N``.

    Rows come dealt by block, and a block lies in one shard: each task
    writes the shards of its blocks, nothing is shuffled again, and there
    are at most as many files as blocks."""
    rows = assigned if only is None else assigned.where(F.col("shard_new").isin(list(only)))
    rows.sortWithinPartitions("shard_new", "shard_slot").write.partitionBy("shard_new").parquet(folder)


def changed_shards(assigned: DataFrame) -> list[int]:
    """Shards that lose or gain a document; the driver gets one number per shard at most."""
    moved = assigned.where(F.col("shard_old") != F.col("shard_new"))
    rows = moved.select(F.explode(F.array("shard_old", "shard_new")).alias("s")).distinct().collect()
    return sorted(r["s"] for r in rows)


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, **settings) -> DataFrame:
    """Assign all documents, write the new shards, and return them as read back."""
    spark = docs.sparkSession
    folder = f"{scratch_dir(spark, 'shards')}/documents"
    assigned = assign(docs, old_shard, old_shards, **settings)
    schema = assigned.schema
    rewrite(assigned, folder)
    return spark.read.schema(schema).parquet(folder)


def reshard_layout(spark: SparkSession, old_folder: str, old_shards: int, folder: str | None = None, blocks: int = BLOCKS, seed: int = 0, **settings) -> DataFrame:
    """Reshard the layout ``old_folder/shard_new=N`` that ``rewrite`` made.

    Changed shards are written below ``folder`` (a new one by default), the
    others stay in ``old_folder`` with the slots they have; returned are all
    documents, read from where they lie now."""
    folder = folder or f"{scratch_dir(spark, 'shards')}/documents"
    old = spark.read.parquet(old_folder)
    assigned = assign(old, F.col("shard_new"), old_shards, blocks=blocks, seed=seed, **settings)
    changed = changed_shards(assigned)
    rewrite(assigned, folder, only=changed)
    stay = old.where(~F.col("shard_new").isin(changed)).withColumn("shard_old", F.col("shard_new"))
    stay = stay.withColumn("shard_block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(blocks)).cast("int"))
    return spark.read.schema(assigned.schema).parquet(folder).unionByName(stay.select(*assigned.columns))
