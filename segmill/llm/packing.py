"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of tokens.

Open bins lie in the order of what is left in them. A document searches its successor (the tightest bin that holds it) and goes
on to the next larger one until a bin is compatible: the document's source and duplicate cluster must be in none of the bin's
bitmaps. No bin: a new one. Groups of about `group_docs` documents are packed independently, in one task each; a group is a
hash of the document, so hot sources and clusters spread evenly over groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, largest first. sources and clusters: small integers, -1 for none; per_source pieces of a source fit a bin."""
    placed: list[tuple[int, int]] = [(-1, -1)] * len(sizes)
    left: list[tuple[int, int]] = []  # (residual, bin), sorted
    source_maps: list[list[int]] = []  # a bin's bitmaps of sources: the k-th has those with more than k pieces
    cluster_maps: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        source, cluster = 1 << sources[i] if sources[i] >= 0 else 0, 1 << clusters[i] if clusters[i] >= 0 else 0
        at = bisect_left(left, (sizes[i], -1))
        while at < len(left) and (cluster_maps[left[at][1]] & cluster or source_maps[left[at][1]][-1] & source):
            at += 1
        if at < len(left):
            residual, b = left.pop(at)
        else:
            residual, b = capacity, len(source_maps)
            source_maps.append([0] * per_source)
            cluster_maps.append(0)
        placed[i] = b, capacity - residual
        carry = source
        for k, m in enumerate(source_maps[b]):
            source_maps[b][k], carry = m | carry, m & carry
        cluster_maps[b] |= cluster
        if residual > sizes[i]:
            insort(left, (residual - sizes[i], b))
    return placed


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 4, group_docs: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """(id_col, piece, start, n_tokens, bin_id, bin_offset): where each piece of each document lies.

    Tokens are runs without ASCII white space, plus one end token a document, so null and empty texts take one token. Documents
    longer than capacity are cut into pieces of capacity tokens, each a bin of its own, and a rest that is packed. At most
    per_source pieces of a source share a bin, and never two of a duplicate cluster: cluster_col, or else equal texts. Null
    sources conflict with nothing. Repeated rows are packed each, in different bins (they are a cluster). bin_id is
    `group * 2**32 + bin`. Rows with a null id are packed too. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.size(F.filter(F.split(text, SPACE), lambda w: w != "")) + 1).cast("long").alias("tokens"),
        F.col(source_col).cast("string").alias("source"),
        (F.xxhash64(text) if cluster_col is None else F.xxhash64(F.col(cluster_col).cast("string"))).alias("cluster"),
    )
    n = rows.count()
    groups = max(1, -(-n // group_docs))
    # dealt by id, text and position: neither copies nor rows that agree in all gather in a group
    rows = rows.withColumn("group", F.pmod(F.xxhash64("id", "cluster", F.monotonically_increasing_id()), F.lit(groups)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        table = table.sort_by([("id", "ascending"), ("tokens", "ascending"), ("cluster", "ascending")])
        ids, tokens = table["id"].to_pylist(), table["tokens"].to_pylist()
        sources, clusters = ([-1 if v is None else names.setdefault(v, len(names)) for v in table[c].to_pylist()] for c, names in (("source", {}), ("cluster", {})))
        out: list[tuple] = []
        rest: list[tuple[int, int, int]] = []
        for i, n in enumerate(tokens):
            whole = n // capacity if n > capacity else 0
            out += [(ids[i], k, k * capacity, capacity, None, 0) for k in range(whole)]
            if n - whole * capacity:
                rest.append((i, whole, n - whole * capacity))
        placed = best_fit([s for *_, s in rest], [sources[i] for i, *_ in rest], [clusters[i] for i, *_ in rest], capacity, per_source)
        packed = [(ids[i], k, k * capacity, s, b, at) for (i, k, s), (b, at) in zip(rest, placed, strict=True)]
        used = max((b for b, _ in placed), default=-1) + 1
        out = [(*r[:4], used + k, 0) for k, r in enumerate(out)] + packed
        columns = list(zip(*out, strict=True)) or [()] * 6
        return pa.table([pa.array(columns[0], table["id"].type), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:4]), pa.array([group << 32 | b for b in columns[4]], pa.int64()), pa.array(columns[5], pa.int64())], ["id", "piece", "start", "n_tokens", "bin_id", "bin_offset"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, n_tokens long, bin_id long, bin_offset long"
    return rows.groupBy("group").applyInArrow(run, schema).withColumnRenamed("id", id_col)
