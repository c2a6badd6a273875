"""Embedding near-duplicates by an exact metric range join.

Unit vectors are compared by distance: cosine >= t is a distance of at most r = sqrt(2 - 2 t). The vectors of a label are dealt to the cells
of their nearest pivots. A vector v of cell h can have a partner in cell c only if d(v, c) <= d(v, h) + 2 r, by the triangle inequality,
and only if it lies within r of the plane half-way between the pivots; then a replica of v goes to c. With c before h, each pair meets in
one cell. Cells join independently, large ones block by block, by matrix products in double precision.

Pivots are a few rows of each label, picked by a hash, as many as the label has cells of `cell` vectors. They decide how much is replicated, never
what is found. Equal vectors are one class, told apart by 128 bits and numbered. A block reports a sum of links for each vector and one edge to the least of its group, not the pairs.

Defined cases: null, empty or zero vectors, vectors with null, NaN or infinite components, and null labels link with nothing. Vectors of
different lengths link with nothing of another length. Rows with equal ids are judged each by its vector, and one is a link of the other
if they are similar. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components, groups_of
from ._scratch import Scratch

#: Vectors of a cell, on average, if a label has more; vectors of a block; vectors dealt to cells at a time (at least one for each pivot);
#: distances that are held at a time while they are dealt.
CELL, BLOCK, DEAL, HELD = 2048, 2048, 16384, 1 << 22
#: Distances this far over a bound still count as within it, so that rounding drops nothing.
SLACK = 1e-9


def _clean(batches):
    for batch in batches:
        column = batch.column(1)
        offs = np.asarray(column.offsets)
        values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        keys, unit, dim = [], [], []
        for i, label in enumerate(batch.column(2).to_pylist()):
            v = values[offs[i] : offs[i + 1]]
            size = np.abs(v).max(initial=0.0)
            if not valid[i] or label is None or not np.isfinite(size) or size == 0:
                keys.append(None)
                unit.append(None)
                dim.append(None)
                continue
            v = v / size  # else squares may overflow
            v = v / np.sqrt(v @ v)
            raw = v.tobytes()
            keys.append(hashlib.blake2b(label.encode() + b"\0" + raw, digest_size=16).digest())
            unit.append(raw)
            dim.append(len(v))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(unit, pa.binary()), pa.array(dim, pa.int32())], names=["id", "label", "key", "unit", "dim"])


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def _deal(r: float):
    schema = pa.schema([("cls", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("unit", pa.binary()), ("times", pa.int64()), ("cell", pa.int32()), ("core", pa.bool_())])

    def deal(key, rows: pa.Table, pivots: pa.Table) -> pa.Table:
        """Each vector in the cell of its nearest pivot, and replicas in earlier cells that may hold partners."""
        x = _matrix(rows.column("unit"))
        n = rows.num_rows
        if not n:
            return schema.empty_table()
        order = np.argsort(pivots.column("cls").to_numpy()) if pivots.num_rows else np.zeros(0, int)
        most = rows.column("cells")[0].as_py()
        if len(order) and most > 1:
            p = np.unique(_matrix(pivots.column("unit"))[order][:most], axis=0)
            step, parts = max(1, HELD // len(p)), []
            for a in range(0, n, step):
                d = np.sqrt(np.maximum(2 - 2 * (x[a : a + step] @ p.T), 0))
                home = d.argmin(1)
                own = d[np.arange(len(d)), home][:, None]
                apart = np.sqrt(np.maximum(2 - 2 * (p[home] @ p.T), 1e-300))
                near = (d <= own + 2 * r + SLACK) & ((d * d - own * own) <= 2 * r * apart + SLACK) & (np.arange(len(p)) < home[:, None])
                who, where = np.nonzero(near)
                parts.append((home, who + a, where))
            home, who, where = (np.concatenate(y) for y in zip(*parts, strict=True))
        else:
            home, who, where = np.zeros(n, int), np.zeros(0, int), np.zeros(0, int)
        take = np.concatenate([np.arange(n), who])
        out = rows.select(["cls", "label", "dim", "unit", "times"]).take(pa.array(take))
        return out.append_column("cell", pa.array(np.concatenate([home, where]).astype(np.int32))).append_column("core", pa.array(np.arange(len(take)) < n)).cast(schema)

    return deal


def _join(threshold: float):
    def join(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy(zero_copy_only=False)
        cls, times = table.column("cls").to_numpy(), table.column("times").to_numpy()
        x = _matrix(table.column("unit"))
        one = not table.column("two")[0].as_py()
        a, b = (np.arange(len(cls)),) * 2 if one else (np.flatnonzero(left), np.flatnonzero(~left))
        hit = (x[a] @ x[b].T) >= threshold
        if one:
            np.fill_diagonal(hit, False)
        some_a, some_b = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(some_a):
            return pa.table({"cls": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        hit = hit[np.ix_(some_a, some_b)]
        a, b = a[some_a], b[some_b]
        if one:
            member, linked = a, hit
            links = hit @ times[b]
        else:
            member = np.concatenate([a, b])
            linked = np.zeros((len(member), len(member)), bool)
            linked[: len(a), len(a) :] = hit
            linked |= linked.T
            links = np.concatenate([hit @ times[b], hit.T @ times[a]])
        return pa.table({"cls": pa.array(cls[member]), "links": pa.array(links.astype(np.int64)), "root": pa.array(cls[member[groups_of(linked)]])})

    return join


def embedding_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """One row for each of `df`'s: id, n_links (other rows linked directly), component_id (the least id reachable), kept (id = component_id)."""
    spark = df.sparkSession
    tmp = Scratch(spark)
    r = float(np.sqrt(2 - 2 * threshold))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = tmp.put(rows.mapInArrow(_clean, f"id {rows.schema['id'].dataType.simpleString()}, label string, key binary, unit binary, dim int"), "rows")
    classes = rows.filter("key is not null").groupBy("key").agg(F.any_value("label").alias("label"), F.any_value("dim").alias("dim"), F.any_value("unit").alias("unit"), F.count("*").alias("times"), F.min("id").alias("first"))
    # the numbers are read from the written table, so they stay
    classes = tmp.put(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    sizes = sizes.select(F.col("label").alias("_l"), F.col("dim").alias("_d"), F.col("n"), F.ceil(F.col("n") / cell).cast("int").alias("cells"))
    sizes = sizes.withColumn("deals", F.ceil(F.col("n") / F.greatest(F.lit(DEAL), F.col("cells"))))
    sized = classes.join(sizes, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d"))).drop("_l", "_d")
    place = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    pivots = sized.filter((F.col("cells") > 1) & (place < 4 * F.col("cells") / F.col("n"))).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
    pivots = pivots.select("cls", "label", "dim", "deal", "unit").toDF("cls", "label", "dim", "deal", "unit")
    dealt = sized.withColumn("deal", F.pmod(F.xxhash64("cls"), F.col("deals")))
    keys = ["label", "dim", "deal"]
    kinds = "cls bigint, label string, dim int, unit binary, times bigint, cell int, core boolean"
    cells = dealt.select("cls", *keys, "unit", "times", "cells").groupBy(*keys).cogroup(pivots.groupBy(*keys)).applyInArrow(_deal(r), kinds)
    cells = tmp.put(cells, "cells")

    counts = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count_if("core") / block).alias("cores"), F.ceil(F.count_if(~F.col("core")) / block).alias("others"))
    counts = counts.select(F.col("label").alias("_l"), F.col("dim").alias("_d"), F.col("cell").alias("_c"), "cores", "others")
    met = cells.join(counts, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")) & (F.col("cell") == F.col("_c"))).drop("_l", "_d", "_c")
    mine = F.pmod(F.xxhash64("cls", F.lit(9)), F.when(F.col("core"), F.col("cores")).otherwise(F.col("others")))
    met = met.withColumn("mine", mine)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    unit = lambda i, j, two, left: F.struct(i.alias("i"), j.alias("j"), two.alias("two"), left.alias("left"))
    m, no, yes = F.col("mine"), F.lit(False), F.lit(True)
    among = F.transform(upto(F.col("cores")), lambda j: unit(F.least(m, j), F.greatest(m, j), m != j, m < j))
    over = F.transform(upto(F.col("others")), lambda j: unit(m, -1 - j, yes, yes))
    under = F.transform(upto(F.col("cores")), lambda i: unit(i, -1 - m, yes, no))
    units = met.withColumn("u", F.explode(F.when(F.col("core"), F.concat(among, over)).otherwise(under)))
    units = units.select("label", "dim", "cell", "u.i", "u.j", "u.two", "u.left", "cls", "unit", "times")
    found = units.groupBy("label", "dim", "cell", "i", "j").applyInArrow(_join(threshold), "cls bigint, links bigint, root bigint")
    found = tmp.put(found, "found")
    tmp.drop("cells")

    comps = components(tmp, found.select(F.col("cls").alias("a"), F.col("root").alias("b")), "comp")
    links = found.groupBy("cls").agg(F.sum("links").alias("links")).withColumnRenamed("cls", "_k")
    classes = classes.select("cls", "key", "first", "times").join(links, F.col("cls") == F.col("_k"), "left").join(comps, F.col("cls") == F.col("node"), "left")
    classes = tmp.put(classes.select("key", "first", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("label", "cls").alias("comp")), "joined")
    tmp.keep("rows", "joined")
    firsts = classes.groupBy("comp").agg(F.min("first").alias("component")).withColumnRenamed("comp", "_comp")
    classes = classes.join(firsts, F.col("comp") == F.col("_comp")).select(F.col("key").alias("_key"), "links", "component")
    out = rows.drop("unit").join(classes, F.col("key") == F.col("_key"), "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
