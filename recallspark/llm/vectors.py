"""Operator 9: near-duplicate embeddings by lattice hashing.

Equal vectors are one node with a multiplicity. Each node lies, in each of lattice.TABLES tables,
in the cell of its E8 code and looks into the neighbouring cells (lattice.PROBES in all). Two
nodes meet in a cell that is one's own and the other's own or neighbour. Cells in which nobody
meets are dropped before vectors move. A pair that meets in several cells belongs to one of them:
that of the first table in which both have the same own cell, else of the first in which they meet.
There it is verified by its cosine in double precision; the tasks send no pairs but the number of
links of each node and a spanning forest. Cells of more than BLOCK nodes are cut into blocks, each
pair of blocks a group of its own. Cells have 32-bit numbers: two of one number are one cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice
from .common import bounded, join_keyed, only, scratch, written
from .components import components

THRESHOLD = 0.9
BLOCK = 1024


def _celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    planes = only("vectors", dict)
    table = np.repeat(np.arange(lattice.TABLES, dtype=np.int64) << 32, lattice.PROBES)
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            some = batch.slice(i, 1000)
            sizes = some.column("v").value_lengths().to_numpy()
            values, at = some.column("v").flatten().to_numpy(), np.append(0, np.cumsum(sizes))
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                x = values[(at[own][:, None] + np.arange(d)[None, :]).ravel()].reshape(-1, d)
                x = x / np.abs(x).max(axis=1)[:, None]  # no overflow for large components
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                if int(d) not in planes:
                    planes[int(d)] = lattice.projections(int(d))
                c = lattice.cells(x, planes[int(d)])
                yield pa.RecordBatch.from_pydict({
                    "node": some.column("node").take(pa.array(own)),
                    "copies": some.column("copies").take(pa.array(own)),
                    "unit": pa.array([r.tobytes() for r in x], pa.binary()),
                    "cells": pa.array([r.tobytes() for r in c], pa.binary()),
                    "all_cells": pa.array(list(c.reshape(len(c), -1) + table), pa.list_(pa.int64())),
                })


def _links(threshold: float):
    def group(cell: int, low: int, high: int, rows: list[tuple]) -> Iterator[tuple]:
        node, copies, block = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
        x = np.frombuffer(b"".join(r[3] for r in rows)).reshape(len(rows), -1)
        cells = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(len(rows), lattice.TABLES, lattice.PROBES)
        own, at, number = np.ascontiguousarray(cells[:, :, 0]), cell >> 32, cell & 0xFFFFFFFF
        home = own[:, at] == number
        found = np.zeros(len(rows), np.int64)
        label = np.arange(len(rows))
        for i in range(len(rows)):
            if block[i] != low:
                continue
            j = np.flatnonzero((block == high) & (home | home[i]) & ((node > node[i]) if low == high else True))
            same = own[j] == own[i]
            shared = same.any(axis=1)
            mine = np.where(shared, same.argmax(axis=1) == at, False)
            if not shared.all():  # no own cell in common: the first table in which either's own is among the other's
                rest = np.flatnonzero(~shared)
                theirs = (cells[j[rest]] == own[i][None, :, None]).any(axis=2)
                ours = (own[j[rest]][:, :, None] == cells[i][None]).any(axis=2)
                first = (theirs | ours).argmax(axis=1) == at
                a, b = own[i, at], own[j[rest], at]
                mine[rest] = first & (np.where(theirs[:, at] & ours[:, at], np.minimum(a, b), np.where(theirs[:, at], a, b)) == number)
            j = j[mine]
            j = j[x[j] @ x[i] >= threshold]
            if not len(j):
                continue
            for k in j[label[j] != label[i]]:
                if label[k] != label[i]:
                    label[label == label[k]] = label[i]
                    yield int(node[i]), int(node[k]), None
            found[i] += copies[j].sum()
            found[j] += copies[i]
        for i in np.flatnonzero(found):
            yield int(node[i]), None, int(found[i])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            # vectors of different lengths can be in one cell by its number alone
            by_length: dict[int, list] = {}
            for row in held:
                by_length.setdefault(len(row[3]), []).append(row)
            got = [g for rows in by_length.values() if len(rows) > 1 for g in group(*key, rows)]
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in range(3)], names=["a", "b", "n"])

        for batch in batches:
            for cell, low, high, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "low", "high", "node", "copies", "block", "unit", "cells")), strict=True):
                if (cell, low, high) != key:
                    if held:
                        yield out()
                    key, held = (cell, low, high), []
                held.append(row)
        if held:
            yield out()

    return links


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per distinct vec_id of vectors(vec_id, embedding).

    Vectors link when their cosine is `threshold` or more. Null, empty and zero vectors and those
    with null or non-finite components link with nothing, as do vectors of different lengths. Of
    rows that share a vec_id the least embedding counts; rows without one are left out. component_id
    is the least vec_id that links reach. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    bounded(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    own = own.groupBy("vec_id").agg(F.min("v").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    own = own.select("vec_id", F.when(finite, F.col("v")).alias("v"))
    with scratch(spark):
        # equal vectors are found by a hash that takes rows apart first, then by the vectors themselves
        hashed = written(own.withColumn("h", F.xxhash64("v")), "vectors")
        firsts = hashed.where("v is not null").groupBy("h", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
        nodes = written(firsts, "nodes")
        # two vectors of one hash: the number of the vector among them tells them apart
        twins = nodes.groupBy("h").agg(F.count("*").alias("kinds"), F.min("node").alias("node"), F.sum("copies").alias("n"))
        plain, mixed = written(twins.where("kinds = 1").select("h", "node", "n"), "hashes"), written(twins.where("kinds > 1").select("h"), "twins")
        placed = join_keyed(hashed.where("v is not null").select("vec_id", "h"), plain, "h").select("vec_id", "node")
        if not mixed.isEmpty():
            placed = placed.union(hashed.join(mixed, "h").join(nodes, ["h", "v"]).select("vec_id", "node"))
        placed = written(placed, "placed")
        celled = written(nodes.select("node", "copies", "v").mapInArrow(_celled, "node long, copies long, unit binary, cells binary, all_cells array<long>"), "cells")
        at = celled.select("node", F.posexplode("all_cells").alias("p", "cell")).select("node", "cell", (F.col("p") % lattice.PROBES == 0).alias("home"))
        at = at.groupBy("node", "cell").agg(F.max("home").alias("home"))
        busy = at.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("some_home")).where("n > 1 and some_home")
        meet = join_keyed(at, written(busy, "busy"), "cell").select("cell", "node", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        meet = meet.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        meet = meet.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        meet = meet.select("cell", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node")
        rows = meet.join(celled.select("node", "copies", "unit", "cells"), "node")
        dealt = rows.repartition(partitions, "cell", "low", "high").sortWithinPartitions("cell", "low", "high")
        found = written(dealt.mapInArrow(_links(threshold), "a long, b long, n long"), "vector-links")
        counted = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        label = components(found.where("b is not null").select("a", "b"))
        node = nodes.join(counted, "node", "left").join(label, "node", "left")
        node = node.select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"), "copies")
        linked = written(join_keyed(placed, written(node, "counted"), "node", "copies").select("vec_id", "n_links", F.col("component").alias("component_id")), "linked", keep=True)
        alone = hashed.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = linked.union(written(alone, "alone", keep=True))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
