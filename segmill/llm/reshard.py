"""Resharding by minimum-cost flow: from old shard sizes and new capacities, move the fewest bytes, then rewrite what changed.

A sharded table is a folder with a folder `shard=N` of Parquet files for each shard. Only shards that rows enter or leave are
written anew; the files of all others stay where they are and are read from there.

The flow runs on the driver over shards only (its size is the number of shards, never the data's). Rows of an old shard lie on
an axis, largest size class first; the flow's arcs cut that axis into intervals, the part that stays first. A row goes where
its middle byte lies, so a shard misses its capacity by at most half a row of middling size at either end of an arc.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, written


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Ship all supply within capacity at the least total cost (cost[i][j] a unit): successive shortest paths with residual arcs."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities don't hold the supply")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        # Bellman-Ford over sources 0..n-1 and sinks n..n+m-1; arcs i->j cost[i][j], residual j->i -cost[i][j] where flow > 0
        far = float("inf")
        dist, back = [0 if left[i] else far for i in range(n)] + [far] * m, [-1] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                if dist[i] < far:
                    for j in range(m):
                        if dist[i] + cost[i][j] < dist[n + j]:
                            dist[n + j], back[n + j], changed = dist[i] + cost[i][j], i, True
            for j in range(m):
                if dist[n + j] < far:
                    for i in range(n):
                        if flow[i][j] and dist[n + j] - cost[i][j] < dist[i]:
                            dist[i], back[i], changed = dist[n + j] - cost[i][j], n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: dist[n + j])
        path, at = [], n + end
        while back[at] >= 0:
            path.append((back[at], at))
            at = back[at]
        most = min([left[at], room[end], *(flow[v][u - n] for u, v in path if u >= n)])
        for u, v in path:
            if u < n:
                flow[u][v - n] += most
            else:
                flow[v][u - n] -= most
        left[at] -= most
        room[end] -= most
    return flow


def capacities(total: int, shards: int) -> list[int]:
    """Equal ones: sums to total, at most one byte apart."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def plan(sizes: list[int], caps: list[int]) -> list[tuple[int, int, int, int]]:
    """(old, lo, hi, shard): intervals of each old shard's byte axis and where they go. Bytes that stay cost nothing, others one each."""
    flow = min_cost_flow(sizes, caps, [[int(i != j) for j in range(len(caps))] for i in range(len(sizes))])
    out = []
    for i, row in enumerate(flow):
        lo = 0
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                out.append((i, lo, lo + row[j], j))
                lo += row[j]
    return out


def reshard(docs: DataFrame, old_shards: int = 16, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", old_col: str | None = None, block_rows: int = 16_384, caps: list[int] | None = None) -> DataFrame:
    """(id, text, size, old_shard, shard and its block and rank): the new shard of every row, from 0 to shards-1; rewrite() gives slots.

    size: UTF-8 bytes of the text (null: none) plus 8. old_col names the column with the present shard; without it, or where it is
    null or no shard from 0 to old_shards-1, a row's present shard is a hash of its id. caps: bytes that each shard may hold, equal
    ones unless given. Rows with a null id or text are placed like any other. Repeated rows are each placed;
    which of two equal rows gets which slot doesn't matter. Other columns are ignored; an empty table gives no rows. A shard
    can't be smaller than its largest row, so very long texts in small tables make shards uneven.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    hashed = F.pmod(F.xxhash64(F.col(id_col)), F.lit(old_shards))
    present = hashed if old_col is None else F.when(F.col(old_col).between(0, old_shards - 1), F.col(old_col)).otherwise(hashed)
    rows = docs.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        present.cast("int").alias("old_shard"),
    )
    n = rows.count()
    buckets = max(8, -(-n // (old_shards * block_rows)))
    # written, as blocks go by position too (rows that agree in all would otherwise be one block) and are read twice
    rows = written(rows.withColumns({"class": -F.floor(F.log2("size")).cast("int"), "bucket": F.pmod(F.xxhash64("id", "size", F.monotonically_increasing_id()), F.lit(buckets)).cast("int")}), "rows")
    block = ["old_shard", "class", "bucket"]
    blocks = written(rows.groupBy(*block).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "blocks")
    sizes = [0] * old_shards
    for r in blocks.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect():  # one row per old shard
        sizes[r["old_shard"]] = r["bytes"]
    arcs = spark.createDataFrame(plan(sizes, caps or capacities(sum(sizes), shards)) or [(-1, 0, 0, 0)], "old_shard int, lo long, hi long, shard int")
    # prefix sums over blocks, of which there are about rows / block_rows
    before = Window.partitionBy("old_shard").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    based = blocks.select(*block, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*block).orderBy(F.desc("size"), "id", F.xxhash64("text"))
    placed = rows.join(based, block).withColumns({"start": F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "rank": F.row_number().over(inside)})
    middle = F.col("p.start") + F.floor(F.col("p.size") / 2)
    p, a = placed.alias("p"), F.broadcast(arcs).alias("a")  # one row per arc: fewer than old plus new shards
    return p.join(a, (F.col("p.old_shard") == F.col("a.old_shard")) & (middle >= F.col("a.lo")) & (middle < F.col("a.hi"))).select("p.*", "a.shard")


#: Blocks whose bases are broadcast (some 40 bytes each); more are joined by shuffling.
BROADCAST_BLOCKS = 200_000


def affected(placed: DataFrame) -> list[int]:
    """The shards that rows of reshard() enter or leave."""
    moves = placed.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("shard"))
    return sorted(r["shard"] for r in moves.distinct().collect())  # at most one row per shard


def rewrite(placed: DataFrame, folder: str | None = None, present: str | None = None) -> DataFrame:
    """Write the new shards, one folder `shard=N` each, and read the table back with its slots.

    present is the folder, of rewrite()'s own layout, that the rows of placed were read from: its files of shards that no row
    enters or leaves are part of the new table as they are, and only the affected shards are written. Without it all are.
    """
    spark = placed.sparkSession
    folder = folder or new_path(spark, "shards")
    rows = placed.select("id", "text", "size", "old_shard", "class", "bucket", "rank", "shard")
    files = f"id {placed.schema['id'].dataType.simpleString()}, text string, size long, old_shard int, class int, bucket int, rank int, shard int"
    changed = None if present is None else affected(placed)
    (rows if changed is None else rows.where(F.col("shard").isin(changed))).write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    table = spark.read.schema(files).parquet(folder)
    if changed is not None:
        table = table.unionByName(spark.read.schema(files).parquet(present).where(~F.col("shard").isin(changed)))
    block = ["shard", "old_shard", "class", "bucket"]
    counts = table.groupBy(*block).agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    before = Window.partitionBy("shard").orderBy("old_shard", "class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.select(*block, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    # a row a block: sent to the tasks while they are few, or else the texts would be shuffled before Spark sees how small the other side is
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_BLOCKS else bases
    return table.join(bases, block).withColumn("slot", F.col("base") + F.col("rank") - F.col("first")).drop("class", "bucket", "rank", "first", "base")
