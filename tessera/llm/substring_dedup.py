"""Exact substring deduplication by fixed-block anchors.

Documents are cut in non-overlapping blocks of (window + 1) // 2 words, so that every window holds one whole block of its own document.
Blocks are the index; the rolling windows of that size of all documents probe it. A block that occurs a second time, anywhere, is an
anchor. Round each anchor the hit is extended to all windows that hold it, and those that occur a second time are kept; windows that
overlap merge to maximal exact repeats, whose words go.

Rows of equal word sequences are one class, whose first row stands for all: a class of two rows or more is a repeat as a whole. Windows
that a batch of rows holds twice are settled there, so that a frequent passage sends one entry a batch, not one a row. Rolling windows travel
as sorted numbers without their places; only blocks and extended windows carry the row that asks. Blocks only propose: windows are told apart by
96 bits of two independent hashes (10**12 windows that ask share them by chance with a probability under 10**-5).

Defined cases: null text has no words; fewer words than the window are all kept. Extra columns are ignored; every row has its own result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._packed import edges, pack, pack_small, part_of, runs, unpack, unpack_small
from ._scratch import Scratch
from ._sketch import maybe, sketch
from ._words import U64, buffers, chunks, hashes, mix, rolling, second

#: Words that one batch gathers before it is sent, words of one part of the index, and the fewest parts.
BATCH_WORDS, PART_WORDS, LEAST_PARTS = 1 << 20, 1 << 21, 64


def _rows(batch, column: int):
    """(first row, word hashes, word counts) of each chunk."""
    for row, data, offs in chunks(batch.column(column)):
        yield row, *hashes(data, offs)


def _keys(words: np.ndarray, counts: np.ndarray) -> list[bytes]:
    ends = np.cumsum(counts)
    return [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends - counts, ends, strict=True)]


def _rids(ids: list, keys: list[bytes]) -> list[int]:
    """Numbers that stand for (id, words); rows that share one are copies of each other."""
    return [int.from_bytes(hashlib.blake2b(repr(i).encode() + k, digest_size=8).digest(), "little", signed=True) for i, k in zip(ids, keys, strict=True)]


def _summary(batches):
    for batch in batches:
        data, offs = buffers(batch.column(1))
        n_words, keys = [], []
        for _, words, counts in _rows(batch, 1):
            n_words += counts.tolist()
            keys += _keys(words, counts)
        sha = [hashlib.sha256(b" ".join(data[a:b].tobytes().split())).hexdigest() for a, b in zip(offs[:-1], offs[1:], strict=True)]
        rids = _rids(batch.column(0).to_pylist(), keys)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(keys, pa.binary()), pa.array(sha, pa.string())], names=["id", "rid", "n_words", "key", "sha"])


_SENT = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("every", "twice", "own", "own_check", "own_of")], ("ids", pa.list_(pa.int64())), ("sure_ids", pa.list_(pa.int64())), ("sure", pa.list_(pa.binary()))])
_SENT_DDL = "part int, every binary, twice binary, own binary, own_check binary, own_of binary, ids array<bigint>, sure_ids array<bigint>, sure array<binary>"


def _met(number: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each, members of each group) of equal pairs."""
    order = np.lexsort((check, number))
    number, check = number[order], check[order]
    new = np.ones(len(order), bool)
    new[1:] = (number[1:] != number[:-1]) | (check[1:] != check[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, np.bincount(group)


class _Sender:
    """Gathers numbers of windows, and those that a row asks for, and sends them by part of the number's range.

    Blocks are numbers; every window's goes once a batch, with a mark if the batch holds it twice. Extended windows (`asked_only`) are numbers
    with a check, sent only as asked. What a row asks for and its batch holds twice is known to repeat: it goes to the part of the row
    instead, so that no part gathers the rows of a frequent window, and once, marked, to its own part.
    """

    def __init__(self, parts: int, bits: int, asked_only: bool):
        self.parts, self.drop, self.asked_only = parts, U64(64 - bits), asked_only
        self.clear()

    def clear(self):
        self.every, self.own, self.check, self.own_of, self.ids, self.size = [], [], [], [], [], 0

    def add(self, every, own, own_of, ids, check=None):
        self.every.append(every)
        self.own.append(own)
        self.check.append(np.zeros(len(own), np.uint32) if check is None else check)
        self.own_of.append(own_of + len(self.ids))
        self.ids += ids
        self.size += len(every)

    def _blocks(self):
        """(numbers, marks, numbers that ask, their checks, their rows; sure numbers, their rows)."""
        every = np.sort(np.concatenate(self.every))
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        twice = np.diff(np.append(first, len(every))) > 1
        every = every[first]
        own, of = np.concatenate(self.own), np.concatenate(self.own_of)
        sure = twice[np.searchsorted(every, own)]
        return every, twice, own[~sure], np.zeros(int((~sure).sum()), np.uint32), of[~sure], own[sure], of[sure]

    def _windows(self):
        own, check, of = (np.concatenate(x) for x in (self.own, self.check, self.own_of))
        group, met = _met(own, check)
        sure = met[group] > 1
        _, first = np.unique(group[sure], return_index=True)
        # a repeat of the batch asks once more, for no row, and so is marked
        marks, mark_checks = own[sure][first], check[sure][first]
        return marks, mark_checks, own[~sure], check[~sure], of[~sure], own[sure], of[sure]

    def rows(self):
        if not self.size:
            return []
        every, twice, own, check, of, sure_own, sure_of = self._windows() if self.asked_only else self._blocks()
        sure_own = sure_own >> self.drop
        order = np.argsort(own, kind="stable")
        own, check, of = own[order], check[order], of[order]
        order = np.argsort(every, kind="stable")
        every, twice = every[order], twice[order]
        ids = np.array(self.ids, np.int64)
        order = np.argsort(sure_of, kind="stable")
        sure_own, sure_of = sure_own[order], sure_of[order]
        sent: dict[int, tuple[list, list]] = {}
        home = part_of(mix(ids.view(np.uint64)), self.parts)
        for a, b in runs(sure_of):
            to = sent.setdefault(int(home[sure_of[a]]), ([], []))
            to[0].append(int(ids[sure_of[a]]))
            to[1].append(sure_own[a:b].tobytes())
        cut, cut_own = edges(every, self.parts), edges(own, self.parts)
        out = []
        some = (np.diff(cut) > 0) | (np.diff(cut_own) > 0)
        some[list(sent)] = True
        for p in np.flatnonzero(some).tolist():
            a, b, c, d = cut[p], cut[p + 1], cut_own[p], cut_own[p + 1]
            used, at = np.unique(of[c:d], return_inverse=True)
            known = sent.get(p, ([], []))
            out.append({"part": p, "every": pack(every[a:b] >> self.drop), "twice": pack_small(twice[a:b]), "own": pack(own[c:d] >> self.drop), "own_check": pack_small(check[c:d]), "own_of": pack_small(at), "ids": ids[used].tolist(), "sure_ids": known[0], "sure": known[1]})
        self.clear()
        return out


def _send_blocks(block: int, parts: int, bits: int):
    def send(batches):
        out = _Sender(parts, bits, False)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, words, counts in _rows(batch, 1):
                number, whole = rolling(words, counts, block)
                ends = np.cumsum(counts)
                owner = np.repeat(np.arange(len(counts)), counts)
                aligned = whole & ((np.arange(len(words)) - (ends - counts)[owner]) % block == 0)
                out.add(number[whole], number[aligned], owner[aligned], _rids(ids[row : row + len(counts)], _keys(words, counts)))
                if out.size >= BATCH_WORDS:
                    yield pa.RecordBatch.from_pylist(out.rows(), schema=_SENT)
        yield pa.RecordBatch.from_pylist(out.rows(), schema=_SENT)

    return send


def _hot_blocks(got: list[dict], asks: list[np.ndarray]) -> list[np.ndarray]:
    """Which of the asked numbers of each row of `got` occur twice or more in the part."""
    every = [unpack(r["every"]) for r in got]
    twice = np.concatenate([np.zeros(0, bool), *[unpack_small(r["twice"]).astype(bool) for r in got]])
    marked = np.concatenate([np.zeros(0, np.uint64), *every])[twice]
    every = np.sort(np.concatenate([np.zeros(0, np.uint64), *every]))
    hot = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], marked]))
    return [_member(own, hot) for own in asks]


def _hot_windows(got: list[dict], asks: list[np.ndarray]) -> list[np.ndarray]:
    marks = [unpack(r["every"]) for r in got]
    number = np.concatenate([*marks, *asks])
    check = np.concatenate([*[unpack_small(r["twice"]) for r in got], *[unpack_small(r["own_check"]) for r in got]])
    group, met = _met(number, check)
    met[group[: sum(map(len, marks))]] += 1  # a mark stands for two
    return np.split((met > 1)[group], np.cumsum([len(x) for x in (*marks, *asks)])[:-1])[len(marks) :]


def _repeated(asked_only: bool):
    def repeated(table: pa.Table) -> pa.Table:
        """Of one part: for each row, the numbers it asked for that occur twice or more."""
        got = table.to_pylist()
        asks = [unpack(r["own"]) for r in got]
        rows, numbers = [], []
        for r, own, hit in zip(got, asks, (_hot_windows if asked_only else _hot_blocks)(got, asks), strict=True):
            of, found = unpack_small(r["own_of"])[hit], own[hit]
            order = np.argsort(of, kind="stable")
            of, found = of[order], found[order]
            for a, b in runs(of):
                rows.append(r["ids"][of[a]])
                numbers.append(found[a:b].tobytes())
            rows += r["sure_ids"]
            numbers += r["sure"]
        return pa.table({"rid": pa.array(rows, pa.int64()), "found": pa.array(numbers, pa.binary())})

    return repeated


def _member(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which values are among `found`, which is sorted."""
    if not len(found):
        return np.zeros(len(values), bool)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


def _numbers(found: list) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in found]]))


def _covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in the runs of `size` from each start."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _send_windows(window: int, block: int, parts: int, bits: int):
    """Extends anchors to the windows that hold them, and asks which of these repeat."""

    def send(batches):
        out = _Sender(parts, 64, True)
        for batch in batches:
            ids, found, whole_class = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for row, words, counts in _rows(batch, 1):
                number, whole = rolling(words, counts, window)
                anchor = rolling(words, counts, block)[0] >> U64(64 - bits)
                ends = np.cumsum(counts)
                ask, check, of = [], [], []
                told = second(words, window)
                for i, (a, b) in enumerate(zip(ends - counts, ends, strict=True)):
                    at = np.flatnonzero(_member(anchor[a:b], _numbers(found[row + i])))
                    reach = np.zeros(b - a + 1, np.int64)
                    np.add.at(reach, np.maximum(at - (window - block), 0), 1)
                    np.add.at(reach, at + 1, -1)
                    mine = np.flatnonzero((np.cumsum(reach[:-1]) > 0) & whole[a:b])
                    if whole_class[row + i]:  # every window of a class of copies repeats
                        mine = np.repeat(mine, 2)
                    ask.append(number[a:b][mine])
                    check.append(told[a:b][mine])
                    of.append(np.full(len(mine), i))
                if ask:
                    ask, of = np.concatenate(ask), np.concatenate(of)
                    out.add(ask, ask, of, ids[row : row + len(counts)], np.concatenate(check))
                if out.size >= BATCH_WORDS:
                    yield pa.RecordBatch.from_pylist(out.rows(), schema=_SENT)
        yield pa.RecordBatch.from_pylist(out.rows(), schema=_SENT)

    return send


def _remove(window: int):
    def remove(batches):
        for batch in batches:
            data, offs = buffers(batch.column(1))
            found = batch.column(2).to_pylist()
            n_removed, sha, kept_text = [], [], []
            for row, words, counts in _rows(batch, 1):
                number, whole = rolling(words, counts, window)
                ends = np.cumsum(counts)
                for i, (a, b) in enumerate(zip(ends - counts, ends, strict=True)):
                    starts = np.flatnonzero(_member(number[a:b], _numbers(found[row + i])) & whole[a:b])
                    gone = _covered(starts, window, b - a)
                    text = data[offs[row + i] : offs[row + i + 1]].tobytes().split()
                    kept = b" ".join(w for w, g in zip(text, gone.tolist(), strict=True) if not g)
                    n_removed.append(int(gone.sum()))
                    sha.append(hashlib.sha256(kept).hexdigest())
                    kept_text.append(kept.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())], names=["rid", "key", "n_removed", "kept_sha256", "kept_text"])

    return remove


def _pick(likely):
    """Rows (rid, key, text) that the filter lets through."""

    def pick(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keys = [k for _, words, counts in _rows(batch, 1) for k in _keys(words, counts)]
            rids = np.array(_rids(ids, keys), np.int64)
            mine = np.flatnonzero(maybe(likely.value, rids))
            yield pa.RecordBatch.from_arrays([pa.array(rids[mine], pa.int64()), pa.array([keys[i] for i in mine], pa.binary()), batch.column(1).take(pa.array(mine))], names=["rid", "key", "text"])

    return pick


def substring_dedup(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of `df`'s: id, n_words, n_removed, kept_sha256, and kept_text where some words go (null: all or none do)."""
    spark = df.sparkSession
    tmp = Scratch(spark)
    block = (window + 1) // 2
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    summary_type = T.StructType([T.StructField("id", docs.schema["id"].dataType), *T.StructType.fromDDL("rid bigint, n_words bigint, key binary, sha string").fields])
    summary = tmp.put(docs.mapInArrow(_summary, summary_type), "summary")
    classes = summary.filter(F.col("n_words") >= window).groupBy("key").agg(F.min("rid").alias("rid"), (F.count("*") > 1).alias("copies"))
    classes = tmp.put(classes, "classes")
    n_words = summary.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, -(-n_words // PART_WORDS))
    bits = min(64, max(44, 2 * n_words.bit_length() - 8))
    long_enough = docs.filter(F.octet_length("text") >= 2 * window - 1)

    sent = long_enough.mapInArrow(_send_blocks(block, parts, bits), _SENT_DDL)
    anchors = tmp.put(sent.groupBy("part").applyInArrow(_repeated(False), "rid bigint, found binary"), "anchors")
    asking = tmp.put(anchors.groupBy("rid").agg(F.collect_list("found").alias("found")).join(classes, "rid"), "asking")
    tmp.drop("anchors")

    likely = spark.sparkContext.broadcast(sketch(asking.select("rid")))
    texts = long_enough.mapInArrow(_pick(likely), "rid bigint, key binary, text string").join(asking, ["rid", "key"])
    texts = tmp.put(texts.select("rid", "text", "found", "copies", "key"), "texts")
    sent = texts.mapInArrow(_send_windows(window, block, parts, bits), _SENT_DDL)
    repeats = tmp.put(sent.groupBy("part").applyInArrow(_repeated(True), "rid bigint, found binary"), "repeats")
    repeats = repeats.groupBy("rid").agg(F.collect_list("found").alias("found"))
    cut = texts.filter("not copies").select("rid", "text", "key").join(repeats, "rid").select("rid", "text", "found", "key").mapInArrow(_remove(window), "rid bigint, key binary, n_removed bigint, kept_sha256 string, kept_text string")
    cut = tmp.put(cut, "cut")
    tmp.drop("texts", "asking", "repeats")

    whole = classes.filter("copies").select(F.col("key").alias("_key"), "copies")
    out = summary.join(whole, F.col("key") == F.col("_key"), "left").join(cut, ["rid", "key"], "left")
    gone = F.coalesce("copies", F.lit(False))
    return out.select(
        F.col("id").alias(id_col), "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), "kept_text",
    )
