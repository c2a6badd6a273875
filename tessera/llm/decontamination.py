"""Benchmark decontamination with one Aho-Corasick automaton.

Items are lower-cased (A-Z) and cut in words; every `window` consecutive words (all, of a shorter item) become a pattern. A document is
brought into the same form and scanned once; a match marks the words it covers, and word numbers give places in the original text.

Defined cases: null text has no words and no hits. Items without words are never found. Items with equal windows are all reported; an item
id that occurs twice counts once, by its text. Null item ids are reported as empty strings. Extra columns are ignored; every document row has a result.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._scratch import Scratch
from ._words import ALNUM, buffers

#: Characters of patterns that one automaton holds at most. More items take more passes, each over its own share.
MOST_CHARS = 8_000_000
_TO = bytes((b + 32 if 65 <= b <= 90 else b) if ALNUM[b] or 65 <= b <= 90 else 32 for b in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(_TO).split()


class Automaton:
    """Patterns are words between single spaces, so a match begins and ends at words. Of an item with a step only every so manieth window is taken."""

    def __init__(self, items: list[tuple[str, str, int, int]], window: int):
        self.trie = ahocorasick.Automaton()
        found: dict[str, tuple[int, set[str]]] = {}
        for item, text, first, step in items:
            words = [w.decode() for w in normal_words((text or "").encode())]
            size = min(window, len(words))
            for i in range(first, len(words) - size + 1 if words else 0, step):
                found.setdefault(" " + " ".join(words[i : i + size]) + " ", (size, set()))[1].add(item)
        for pattern, (size, owners) in found.items():
            self.trie.add_word(pattern, (size, tuple(sorted(owners))))
        self.any = bool(found)
        if self.any:
            self.trie.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """(whether each word is hit, items found)."""
        hit, items = None, set()
        if self.any and words:
            text = (b" " + b" ".join(words) + b" ").decode()
            for end, (size, owners) in self.trie.iter(text):
                if hit is None:
                    ends = np.cumsum(np.fromiter((len(w.decode()) + 1 for w in words), np.int64, len(words)))
                    hit = np.zeros(len(words) + 1, np.int64)
                last = int(np.searchsorted(ends, end))
                hit[last - size + 1] += 1
                hit[last + 1] -= 1
                items.update(owners)
        return (np.cumsum(hit[:-1]) > 0 if hit is not None else np.zeros(len(words), bool)), items


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Places in the original text of runs of words that are hit."""
    at = [m.span() for m in WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(at[a][0], at[b - 1][1]) for a, b in edges.reshape(-1, 2)]


def _groups(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int) -> list[DataFrame]:
    """Shares of the items (id, text, first, step) whose patterns fit an automaton; nearly always one. An item too long for one is in all, some windows in each."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] * window
    n = max(1, -(-chars // most))
    long = F.length("text") * window > most
    one = lambda g: items.filter(~long & (F.pmod(F.xxhash64("id", "text"), F.lit(n)) == g)).select("id", "text", F.lit(0).alias("first"), F.lit(1).alias("step"))
    return [one(g).union(items.filter(long).select("id", "text", F.lit(g), F.lit(n))) for g in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", carry: tuple = (), most_chars: int = MOST_CHARS) -> DataFrame:
    """One row for each of `docs`: id, `carry`, n_words, n_hit, items (sorted), spans of the original text, n_items, items_sha256, contaminated.

    The automaton goes to the workers. Its size is bounded by `most_chars`; with more items the documents are scanned once for each share.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark)
    keep = [id_col, *carry]
    kind = T.StructType([T.StructField("hit", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])
    out = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"), F.lit(None).cast(kind).alias("_found"))
    groups = _groups(benchmark, item_col, item_text, window, most_chars)
    spans_kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    k = len(keep)
    for g, share in enumerate(groups):
        last = g == len(groups) - 1
        shared = spark.sparkContext.broadcast([(r.id, r.text, r.first, r.step) for r in share.collect()])
        fields = out.schema.fields[:k]
        if last:
            fields = [*fields, *T.StructType.fromDDL("n_words long, n_hit long, items array<string>").fields, T.StructField("spans", spans_kind), *T.StructType.fromDDL("n_items long, items_sha256 string, contaminated boolean").fields]
        else:
            fields = out.schema.fields
        out = out.mapInArrow(_scanner(shared, window, k, last, T.StructType(fields)), T.StructType(fields))
        if not last:
            out = tmp.put(out, f"pass_{g}")
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *out.columns[k:])


def _scanner(shared, window: int, k: int, last: bool, schema: T.StructType):
    def scan(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        automaton = Automaton(shared.value, window)
        arrow = to_arrow_schema(schema)
        for batch in batches:
            data, offs = buffers(batch.column(k))
            before = batch.column(k + 1)
            rows = []
            for i in range(batch.num_rows):
                raw = data[offs[i] : offs[i + 1]].tobytes()
                words = normal_words(raw)
                hit, items = automaton.scan(words)
                if (had := before[i].as_py()) is not None:
                    hit = hit | np.frombuffer(had["hit"], bool)
                    items |= set(had["items"])
                if last:
                    found = sorted(items)
                    spans = [{"start": a, "end": b} for a, b in original_spans(raw.decode(), hit)] if found else []
                    rows.append((len(words), int(hit.sum()), found, spans, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(found)))
                else:
                    rows.append({"hit": hit.tobytes(), "items": sorted(items)})
            if last:
                made = [pa.array(c, arrow.field(k + j).type) for j, c in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], arrow.field(k + j).type) for j in range(7)]
            else:
                made = [batch.column(k), pa.array(rows, arrow.field(k + 1).type)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *made], schema=pa.schema([pa.field(n, c.type) for n, c in zip(arrow.names, [*batch.columns[:k], *made], strict=True)]))

    return scan
