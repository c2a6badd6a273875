"""MinHash near-duplicate detection by an inverted join on signature coordinates.

A document's set is its distinct five-word shingles; equal sets are one class. A class is posted under each (coordinate, value) of its
signature. Values of one class only are dropped; a class needs `least` shared values at all. In the order of list lengths, two
classes that agree in `least` coordinates meet in a list of each one's first (shared - least + 1) values, so only these lists are merged
(the prefix); the long lists are skipped, and agreement in them is read off the two signatures.

Candidates are gathered as connected clumps, not as pairs: every class is held against the least member of its lists; lists that still
hold several clumps are compared in blocks, across clumps only, and each comparison reports the edges that join clumps. All pairs
that agree lie in one clump. The full sets of a clump are then compared exactly, block by block, by products of 0/1 matrices, and a block
reports one edge to the least of each group of linked classes. A group of copies so costs rows in proportion to its size.

A pair of similarity 0.75 agrees in fewer than 30 of 64 coordinates with a probability under one in a million.

Classes are told apart by 128 bits and numbered; shingles are 64 bits, and only those of two sets at a time are held against each other.

Defined cases: null text has no words and, like a text without words, is linked with nothing. Fewer words than a shingle make one shingle.
Rows with equal ids are judged each by its text. A null id is the least of its group only if all are null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._components import components, groups_of
from ._packed import runs
from ._scratch import Scratch
from ._sketch import maybe, sketch
from ._words import U64, chunks, hashes, rolling

COORDINATES, LEAST = 64, 30
#: Classes that are compared at a time, rows of lists and shingles of sets handed to one call (about), and columns of a matrix.
BLOCK, GROUP_ROWS, GROUP_SHINGLES, COLUMNS = 1024, 20_000, 1 << 20, 8192


def _sets(words: np.ndarray, counts: np.ndarray, size: int):
    """The sorted distinct shingles of each row."""
    number, whole = rolling(words, counts, size)
    ends = np.cumsum(counts)
    for a, b in zip(ends - counts, ends, strict=True):
        if b - a >= size:
            yield np.unique(number[a : b - size + 1])
        elif b > a:
            yield rolling(words[a:b], np.array([b - a]), int(b - a))[0][:1]
        else:
            yield number[:0]


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _rid(row_id, digest: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(repr(row_id).encode() + digest, digest_size=8).digest(), "little", signed=True)


def _signatures(size: int, seed: int):
    factors = np.random.default_rng(seed).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * U64(2) + U64(1)

    def signatures(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            n, keys, rid, sig = [], [], [], []
            for row, data, offs in chunks(batch.column(1)):
                sets = list(_sets(*hashes(data, offs, lower=True), size))
                lens = np.fromiter(map(len, sets), np.int64, len(sets))
                some = np.flatnonzero(lens)
                out = np.zeros((len(sets), COORDINATES), np.int32)
                if len(some):
                    every = np.concatenate(sets)
                    starts = (np.cumsum(lens) - lens)[some]
                    for k, f in enumerate(factors):
                        out[some, k] = np.minimum.reduceat(((every * f) >> U64(32)).astype(np.uint32), starts).view(np.int32)
                for i, s in enumerate(sets):
                    digest = _key(s)
                    keys.append(digest if len(s) else None)
                    rid.append(_rid(ids[row + i], digest))
                n += lens.tolist()
                sig.append(out)
            flat = pa.array(np.concatenate([np.zeros((0, COORDINATES), np.int32), *sig]).ravel(), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, COORDINATES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(rid, pa.int64()), lists], names=["id", "n", "key", "rid", "sig"])

    return signatures


def _wanted(size: int, likely):
    def wanted(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out_key, out_rid, out_set = [], [], []
            for row, data, offs in chunks(batch.column(1)):
                got = []
                for i, s in enumerate(_sets(*hashes(data, offs, lower=True), size)):
                    digest = _key(s)
                    got.append((digest, _rid(ids[row + i], digest), s))
                for k in np.flatnonzero(maybe(likely.value, np.array([g[1] for g in got], np.int64))):
                    out_key.append(got[k][0])
                    out_rid.append(got[k][1])
                    out_set.append(got[k][2].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.binary()), pa.array(out_rid, pa.int64()), pa.array(out_set, pa.binary())], names=["key", "rid", "shingles"])

    return wanted


def _across(least: int):
    def across(table: pa.Table) -> pa.Table:
        """Edges between clumps of which a list (or two blocks of one) holds classes that agree in `least` coordinates."""
        v, block, comp, j = (table.column(c).to_numpy() for c in ("v", "block", "comp", "j"))
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        order = np.lexsort((block, v))
        v, block, comp, j, sig = v[order], block[order], comp[order], j[order], sig[order]
        pairs = []
        for s, e in runs(v):
            first = block[s:e] == block[s]
            if first.all() and j[s] != block[s]:
                continue  # the other block of the unit is empty
            now = comp[s:e].copy()
            x = np.flatnonzero(first)
            for r in x:
                y = np.arange(r + 1, e - s) if first.all() else np.flatnonzero(~first)
                y = y[now[y] != now[r]]
                hit = y[(sig[s + y] == sig[s + r]).sum(1) >= least]
                for other in np.unique(now[hit]):
                    pairs.append((min(now[r], other), max(now[r], other)))
                    now[now == other] = now[r]
        pairs = np.array(sorted(set(pairs)), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return across


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets are similar, as a matrix; none to itself."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    shared = np.zeros(len(every), bool)
    same = every[1:] == every[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    every, owner = every[shared], owner[shared]
    column = np.cumsum(np.concatenate([np.zeros(min(1, len(every)), np.int64), (every[1:] != every[:-1]).astype(np.int64)]))
    both = np.zeros((len(sets), len(sets)))
    width = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, width, COLUMNS):
        x, y = np.searchsorted(column, [c, c + COLUMNS])
        held = np.zeros((len(sets), min(COLUMNS, width - c)), np.float32)
        held[owner[x:y], column[x:y] - c] = 1
        both += held @ held.T
    out = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(out, False)
    return out


def _verify(percent: int):
    def verify(table: pa.Table) -> pa.Table:
        """An edge to the least of its group for each class that is linked within its clump (or two blocks of one)."""
        clump, cls = table.column("clump").to_numpy(), table.column("cls").to_numpy()
        order = np.lexsort((cls, clump))
        clump, cls = clump[order], cls[order]
        blobs = table.column("shingles").take(pa.array(order)).to_pylist()
        a, b = [], []
        for s, e in runs(clump):
            if e - s < 2:
                continue
            root = groups_of(_linked([np.frombuffer(x, np.uint64) for x in blobs[s:e]], percent))
            mine = np.flatnonzero(root != np.arange(e - s))
            a.append(cls[s:e][root[mine]])
            b.append(cls[s:e][mine])
        none = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.concatenate([none, *a])), "b": pa.array(np.concatenate([none, *b]))})

    return verify


class _Job:
    def __init__(self, docs: DataFrame, size: int, percent: int, least: int, seed: int):
        self.spark, self.docs, self.size, self.percent, self.least = docs.sparkSession, docs, size, percent, least
        self.tmp = Scratch(self.spark)
        kind = T.StructType([docs.schema[0], *T.StructType.fromDDL("n bigint, key binary, rid bigint, sig array<int>").fields])
        self.rows = self.tmp.put(docs.mapInArrow(_signatures(size, seed), kind), "rows")
        classes = self.rows.filter("key is not null").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first"), F.max("n").alias("n"), F.any_value("sig").alias("sig"))
        # the numbers are read from the written table, so they stay
        self.classes = self.tmp.put(classes.select(F.monotonically_increasing_id().alias("cls"), "key", "first", F.col("first.rid").alias("rid"), "n", "sig"), "classes")

    def prefixes(self) -> DataFrame:
        """(cls, v): the lists in which a class can meet one that it agrees with."""
        value = F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("x").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        posted = self.classes.select("cls", F.posexplode("sig").alias("k", "x")).select("cls", value.alias("v"))
        shared = posted.groupBy("v").agg(F.count("*").alias("len")).filter("len > 1").withColumnRenamed("v", "w")
        lists = posted.join(shared, F.col("v") == F.col("w")).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("len", "v"))).alias("lists"))
        short = F.slice("lists", F.lit(1), F.size("lists") - self.least + 1)
        return self.tmp.put(lists.filter(F.size("lists") >= self.least).select("cls", F.explode(short).alias("l")).select("cls", F.col("l.v").alias("v")), "prefixes")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Adds how many coordinates agree; drops pairs whose sizes alone rule a link out."""
        of_a = self.classes.select(F.col("cls").alias("ca"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        of_b = self.classes.select(F.col("cls").alias("cb"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        both = pairs.join(of_b, F.col("b") == F.col("cb")).join(of_a, F.col("a") == F.col("ca"))
        agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda z: z))
        both = both.filter(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        return both.select("a", "b", agree.alias("agree")).filter(F.col("agree") >= self.least)

    def clumps(self) -> DataFrame:
        """(cls, clump) of the classes that may have a link."""
        tmp = self.tmp
        prefixes = self.prefixes()
        heads = prefixes.groupBy("v").agg(F.min("cls").alias("a"), F.count("*").alias("len")).filter("len > 1").withColumnRenamed("v", "w")
        stars = prefixes.join(heads, F.col("v") == F.col("w")).filter("cls != a").select("a", F.col("cls").alias("b")).distinct()
        found = components(tmp, self.similar(stars), "near")

        member = prefixes.join(found, F.col("cls") == F.col("node"), "left").select("v", "cls", F.coalesce("label", "cls").alias("comp"))
        member = tmp.put(member, "member")
        mixed = member.groupBy("v").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("len")).filter("c0 < c1").select(F.col("v").alias("w"), F.ceil(F.col("len") / BLOCK).alias("blocks"))
        left = member.join(mixed, F.col("v") == F.col("w")).drop("w").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
        left = tmp.put(left, "left")
        groups = max(1, -(-left.count() // GROUP_ROWS))
        units = left.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        units = units.withColumn("unit", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("v"), F.lit(groups))).otherwise(F.col("v")))
        units = units.select("unit", "v", "cls", "comp", F.least("block", "j").alias("lo"), F.greatest("block", "j").alias("j"), "block", (F.col("blocks") == 1).alias("small"))
        units = units.join(self.classes.select(F.col("cls").alias("_c"), "sig"), F.col("cls") == F.col("_c")).drop("_c")
        joined = components(tmp, units.groupBy("small", "unit", "lo", "j").applyInArrow(_across(self.least), "a bigint, b bigint"), "across")
        out = member.select("cls", "comp").distinct().join(joined, F.col("comp") == F.col("node"), "left").select("cls", F.coalesce("label", "comp").alias("clump"))
        return tmp.put(out, "clumps")

    def run(self) -> DataFrame:
        """(node, label): the component, as its least class, of each class that has a link."""
        tmp, clumps = self.tmp, self.clumps()
        of = clumps.join(self.classes.select(F.col("cls").alias("_c"), "n", "rid", "key"), F.col("cls") == F.col("_c")).drop("_c")
        sizes = of.groupBy("clump").agg(F.count("*").alias("len"), F.sum("n").alias("size")).filter("len > 1")
        sizes = sizes.select(F.col("clump").alias("_k"), F.greatest(F.ceil(F.col("len") / BLOCK), F.ceil(F.col("size") / GROUP_SHINGLES)).alias("blocks"))
        asked = tmp.put(of.join(sizes, F.col("clump") == F.col("_k")).drop("_k"), "asked")
        groups = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // GROUP_SHINGLES))
        likely = self.spark.sparkContext.broadcast(sketch(asked.select("rid")))
        sets = self.docs.mapInArrow(_wanted(self.size, likely), "_key binary, _rid bigint, shingles binary")
        sets = sets.join(asked.select("cls", "clump", "rid", "key", "blocks"), (F.col("rid") == F.col("_rid")) & (F.col("key") == F.col("_key"))).dropDuplicates(["cls"])
        units = sets.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("clump"), F.lit(groups))).otherwise(F.col("clump"))
        units = units.select((F.col("blocks") == 1).alias("small"), unit.alias("unit"), F.least("block", "j").alias("lo"), F.greatest("block", "j").alias("hi"), "clump", "cls", "shingles")
        links = units.groupBy("small", "unit", "lo", "hi").applyInArrow(_verify(self.percent), "a bigint, b bigint")
        return components(tmp, links, "all")


def _labelled(job: _Job) -> DataFrame:
    """(key, component, rid and key of its row): the least row of the component of each class."""
    found = job.run().withColumnRenamed("node", "_n")
    classes = job.classes.select("cls", "key", "first").join(found, F.col("cls") == F.col("_n"), "left").select("key", F.struct("first.none", "first.id", "first.rid", "key").alias("first"), F.coalesce("label", "cls").alias("comp"))
    classes = job.tmp.put(classes, "comps")
    job.tmp.keep("rows", "comps")
    firsts = classes.groupBy("comp").agg(F.min("first").alias("least")).withColumnRenamed("comp", "_comp")
    return classes.join(firsts, F.col("comp") == F.col("_comp")).select(F.col("key").alias("_key"), F.col("least.id").alias("component"), F.col("least.rid").alias("_rid"), F.col("least.key").alias("_first"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, least: int = LEAST, seed: int = 7) -> DataFrame:
    """One row for each of `df`'s: id, n_shingles, component_id (the least id that it reaches by links), kept (id = component_id)."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    job = _Job(docs, words, percent, least, seed)
    out = job.rows.join(_labelled(job), F.col("key") == F.col("_key"), "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _numbered(size: int, names: list[str], id_at: int, text_at: int):
    def numbered(batches):
        for batch in batches:
            ids, rid, keys = batch.column(id_at).to_pylist(), [], []
            for row, data, offs in chunks(batch.column(text_at)):
                for i, s in enumerate(_sets(*hashes(data, offs, lower=True), size)):
                    digest = _key(s)
                    rid.append(_rid(ids[row + i], digest))
                    keys.append(digest if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rid, pa.int64()), pa.array(keys, pa.binary())], names=[*names, "rid", "key"])

    return numbered


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, least: int = LEAST, seed: int = 7) -> DataFrame:
    """The rows of `df`, all columns: of each group the row of the least id, and all rows without words."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    job = _Job(docs, words, percent, least, seed)
    kept = job.tmp.put(_labelled(job).select("_rid", "_first").distinct(), "kept")
    job.tmp.keep("kept")
    names = [f"_c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    rows = rows.mapInArrow(_numbered(words, names, df.columns.index(id_col), df.columns.index(text_col)), T.StructType([*rows.schema.fields, *T.StructType.fromDDL("rid bigint, key binary").fields]))
    one = rows.filter("key is not null").join(kept, (F.col("rid") == F.col("_rid")) & (F.col("key") == F.col("_first")), "left_semi").groupBy("rid", "key").agg(F.any_value(F.struct(*names)).alias("row"))
    out = one.select("row.*").union(rows.filter("key is null").select(*names))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)])
