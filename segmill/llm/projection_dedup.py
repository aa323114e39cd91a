"""Embedding near-duplicates by sorted projection passes.

In each pass every vector gets a key of concatenated random-hyperplane bits; vectors are put in the lexicographic order of
(label, key) and compared with the `window` to `2 * window` vectors that follow and precede them; pairs with a cosine of
at least the threshold link, and links of all passes are united to components. Equal vectors are one node beforehand, so a
vector that holds a third of all rows costs no comparison. Links are then counted by comparing all vectors of a component with
each other, so that a group wider than the windows, whose members the passes have only chained, has all its links.

Order is by exact rank (sorted partitions plus prefix sums of their sizes). Ranks are cut into blocks of `window`; a vector is
compared with its own block and the two beside it, and a task holds `span` + 1 blocks, however many share a key. For the count
components are laid end to end and cut into blocks of `span * window` vectors, and a task holds two of them. What leaves a
task is a spanning edge or a count per vector, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, written


def directions(dims: int, passes: int, bits: int, seed: int = 8) -> np.ndarray:
    """passes * bits random hyperplanes."""
    return np.random.default_rng(seed).standard_normal((passes * bits, dims))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _keys(nodes: DataFrame, passes: int, bits: int) -> DataFrame:
    """(node, label, key_0 .. ): one 64-bit key a pass; hyperplanes depend on the dimension alone."""
    names = [f"key_{p}" for p in range(passes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            out = np.zeros((passes, len(batch)), np.int64)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                planes.setdefault(int(d), directions(int(d), passes, bits))
                side = (_matrix(batch.column("vector").take(pa.array(at))) @ planes[int(d)].T > 0).astype(np.int64)
                weights = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
                for p in range(passes):
                    out[p, at] = side[:, p * bits : (p + 1) * bits] @ weights
            yield pa.record_batch([batch.column("node"), batch.column("label"), pa.array(sizes.astype(np.int32)), *(pa.array(k) for k in out)], ["node", "label", "dims", *names])

    return nodes.mapInArrow(run, f"node long, label long, dims int, {', '.join(f'{n} long' for n in names)}")


def _ranks(rows: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """(keep, rank): the place of each row in the order, from 0."""
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = rows.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).select(*keep)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.record_batch([pa.array(np.full(len(batch), part, np.int32)), pa.array(np.arange(at, at + len(batch))), *batch.columns], ["part", "at", *keep])
            at += len(batch)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema)
    ranked = written(ordered.mapInArrow(number, f"part int, at long, {types}"), "ranks")
    sizes = ranked.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return ranked.join(F.broadcast(bases), "part").select(*keep, (F.col("base") + F.col("at")).alias("rank"))


def _blocks(keys: DataFrame, passes: int, window: int) -> DataFrame:
    """(node, blocks array<long>): the block of each pass; its number grows with (pass, label, key). Equal keys lie in another order in each pass."""
    each = keys.select("node", "label", "dims", F.posexplode(F.array(*(F.col(f"key_{p}") for p in range(passes)))).alias("pass", "key"))
    each = each.withColumn("tie", F.xxhash64("node", "pass"))
    ranked = _ranks(each, ["pass", "label", "dims", "key", "tie", "node"], ["pass", "node"])
    block = F.floor(F.col("rank") / window)
    return ranked.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", block.alias("b")))), lambda x: x["b"]).alias("blocks"))


def _compare(placed: DataFrame, window: int, span: int, threshold: float) -> DataFrame:
    """(node, other): the smallest node of the component that a task's own blocks give."""
    each = placed.select("node", "label", "vector", F.posexplode("blocks").alias("pass", "block"))
    group = F.floor(F.col("block") / span)
    first = (F.col("block") % span == 0) & (group > 0)
    # the first block of a group is also compared with the last of the group before
    spread = each.withColumn("group", F.explode(F.when(first, F.array(group, group - 1)).otherwise(F.array(group))))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[1].as_py()
        table = table.combine_chunks()
        node, label, block = (table[c].to_numpy() for c in ("node", "label", "block"))
        vectors = table["vector"].combine_chunks()
        sizes = vectors.value_lengths().to_numpy()
        root = node.copy()
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            unit = _unit(_matrix(vectors.take(pa.array(own))))
            for b in np.unique(block[own]):
                if b // span != group:
                    continue
                here, there = own[block[own] == b], own[block[own] == b + 1]
                x = np.flatnonzero(block[own] == b)
                y = np.concatenate([x, np.flatnonzero(block[own] == b + 1)])
                both = np.concatenate([here, there])
                close = (unit[x] @ unit[y].T >= threshold) & (label[here][:, None] == label[both][None, :])
                close[:, : len(x)] &= np.arange(len(x))[:, None] < np.arange(len(x))[None, :]
                i, j = np.nonzero(close)
                edges.append((here[i], both[j]))
        if edges:
            i, j = (np.concatenate(x) for x in zip(*edges, strict=True))
            while len(i):
                before = root.copy()
                np.minimum.at(root, i, root[j])
                np.minimum.at(root, j, root[i])
                if (before == root).all():
                    break
        keep = root != node
        return pa.table({"node": node[keep], "other": root[keep]})

    return spread.groupBy("pass", "group").applyInArrow(run, "node long, other long")


def _counts(nodes: DataFrame, comps: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node, linked long): vectors of the component that link with the node; every two of a component are compared, blocks of `size` at a time."""
    many = comps.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    ranked = _ranks(comps.join(many, "component").select("component", "node"), ["component", "node"], ["component", "node"])
    placed = written(ranked.select("component", "node", F.floor(F.col("rank") / size).alias("block")), "members")
    ends = placed.groupBy("component").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    rows = placed.join(ends, "component").join(nodes.select("node", "copies", "vector"), "node")
    rows = rows.select("component", "node", "copies", "vector", "block", F.explode(F.sequence("first", "last")).alias("with"))
    rows = rows.select("component", "node", "copies", "vector", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[0].as_py(), key[1].as_py()
        table = table.combine_chunks()
        component, node, copies, block = (table[c].to_numpy() for c in ("component", "node", "copies", "block"))
        vectors, linked = table["vector"].combine_chunks(), np.zeros(len(node), np.int64)
        order = np.argsort(component, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            unit = _unit(_matrix(vectors.take(pa.array(own))))
            x, y = np.flatnonzero(block[own] == low), np.flatnonzero(block[own] == high)
            for start in range(0, len(x), 256):
                part = x[start : start + 256]
                close = unit[part] @ unit[y].T >= threshold
                if low == high:
                    close &= part[:, None] < y[None, :]
                linked[own[part]] += close @ copies[own[y]]
                linked[own[y]] += copies[own[part]] @ close
        keep = linked > 0
        return pa.table({"node": node[keep], "linked": linked[keep]})

    return rows.groupBy("low", "high").applyInArrow(run, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, passes: int = 12, bits: int = 32, window: int = 256, span: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): cosine links in double precision between vectors of equal label.

    Null, empty and zero vectors, vectors with null, infinite or NaN components and rows with a null label link with nothing;
    vectors of different length don't link. Rows that share an id each give a row with the links of their own vector. A row
    with a null id links with nothing. Ties in the order are settled by a hash of node and pass. A component of N vectors costs
    N^2 / 2 comparisons and sends each of its vectors to N / (span * window) tasks. Other columns are ignored; an empty table gives an empty result.
    """
    # single-precision vectors travel as they are; tasks compute in double precision
    kind = vectors.select(vector_col).schema[0].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>").alias("vector"), F.col(label_col).cast("long").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & (norm > 0) & (norm < float("inf")), F.lit(False))
    rows = rows.withColumn("vector", F.when(good, F.col("vector")))
    fine = rows.where("vector is not null")
    # a node is a number of its own, fixed once the table is written: different vectors may share an id
    nodes = fine.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    blocks = _blocks(_keys(nodes, passes, bits), passes, window)
    found = written(_compare(nodes.join(blocks, "node"), window, span, threshold), "links")
    comps = written(components(nodes.select("node"), found.select(F.col("node").alias("a"), F.col("other").alias("b")), "node"), "components")
    counts = _counts(nodes, comps, span * window, threshold)
    smallest = nodes.select("node", "least").join(comps, "node").groupBy("component").agg(F.min("least").alias("smallest"))
    named = comps.join(smallest, "component").select("node", "smallest")
    known = nodes.join(named, "node").join(counts, "node", "left").select("label", "vector", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "smallest")
    known = written(known, "labelled")
    out = rows.join(known, ["label", "vector"], "left")
    component = F.coalesce("smallest", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
