"""Token counts of byte-level BPE by rank-synchronous merging of arrays.

Texts are cut in pre-tokens by the vocabulary's pattern. Pre-tokens not met before are held as one ragged array of symbols; in each round
every pre-token merges its own lowest-ranked pair, wherever it occurs in it, all at once, until no pair has a rank. A document's count is the
sum over its pre-tokens, kept in a bounded memo. Pre-tokens of over LONG bytes would take a round over the whole array for each of their many ranks;
they keep the places of each rank's pairs instead, and a round touches only the places of the lowest rank.

Defined cases: null text counts as empty and has 0 tokens and 0 bytes. Special strings in a text are one token each, as the library has
them by default. Extra columns are ignored; every row has its own result.
"""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the pre-tokens of the library's byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 400_000
#: A pre-token of more bytes is counted by the places of its pairs, without the memo.
LONG = 256


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such vocabularies: printable bytes for themselves, the others from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in _byte_letters().items():
            self.of_byte[byte] = vocab[letter]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.into = keys[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        first = np.unique(self.keys, return_index=True)[1]
        self.keys, self.ranks, self.into = self.keys[first], self.ranks[first], self.into[first]
        special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.memo: dict[str, int] = {}

    def merge(self, tokens: list[str]) -> np.ndarray:
        """Symbols that are left of each pre-token."""
        raw = [t.encode("utf-8", "replace") for t in tokens]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        counts = sizes.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), sizes)
        none = np.iinfo(np.int64).max
        while len(symbols) > 1:
            pair = symbols[:-1] << 20 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.where(known, self.ranks[at], none)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(np.append(rank, none), starts)
            live = best < none
            if not live.any():
                break
            # sequences that are done leave the arrays
            stay = np.repeat(live, np.diff(np.append(starts, len(owner))))
            best_of = np.repeat(best, np.diff(np.append(starts, len(owner))))
            hit = np.append(rank, none) == best_of
            hit &= stay
            # of a run of overlapping hits (one symbol repeated) every second one merges, from the left
            where = np.flatnonzero(hit)
            run = np.cumsum(np.diff(where, prepend=-5) != 1)
            first = np.flatnonzero(np.diff(run, prepend=0))
            where = where[(np.arange(len(where)) - first[run - 1]) % 2 == 0]
            symbols[where] = self.into[at[where]]
            np.subtract.at(counts, owner[where], 1)
            stay[where + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return counts

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, place in the table) of pairs; the rank of a pair without one is beyond all ranks."""
        pair = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], np.iinfo(np.int64).max), at

    def merge_long(self, token: str) -> int:
        """Symbols that are left of one long pre-token: a linked list of symbols, and the places of the pairs of each rank."""
        raw = np.frombuffer(token.encode("utf-8", "replace"), np.uint8)
        n = len(raw)
        symbols = np.append(self.of_byte[raw], -1)  # the end has no pair
        after, before, left = np.arange(1, n + 2), np.arange(-1, n), n
        after[n] = n
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[after[at] < n]
            rank, _ = self.ranks_of(symbols[at], symbols[after[at]])
            some = rank < np.iinfo(np.int64).max
            at, rank = at[some], rank[some]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank, prepend=-1))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rank)], strict=True):
                r = int(rank[a])
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(at[a:b])

        note(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[symbols[at] >= 0]  # else the symbol was merged into the one before
            rank, where = self.ranks_of(symbols[at], symbols[after[at]])
            at, where = at[rank == r], where[rank == r]
            if not len(at):
                continue
            # of a run of overlapping pairs (one symbol repeated) every second one merges, from the left
            joined = np.zeros(len(at), bool)
            joined[1:] = after[at[:-1]] == at[1:]
            first = np.flatnonzero(~joined)
            turn = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            at, where = at[turn % 2 == 0], where[turn % 2 == 0]
            gone = after[at]
            symbols[at] = self.into[where]
            symbols[gone] = -1
            after[at] = after[gone]
            before[after[at]] = at
            left -= len(at)
            note(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        return left

    def learn(self, tokens: list[str]) -> dict[str, int]:
        short = [t for t in tokens if len(t) <= LONG]
        return dict(zip(short, self.merge(short).tolist(), strict=True)) | {t: self.merge_long(t) for t in tokens if len(t) > LONG}

    def plain(self, texts: list[str]) -> list[int]:
        cut = [self.pattern.findall(t) for t in texts]
        fresh: set[str] = set()
        for tokens in cut:
            fresh.update(tokens)
        if len(self.memo) + len(fresh) > MEMO:
            self.memo = {}
        missing = [t for t in fresh if t not in self.memo]
        found = self.memo
        if missing:
            new = self.learn(missing)
            found |= {t: n for t, n in new.items() if len(t) <= LONG}
            if any(len(t) > LONG for t in missing):
                found = found | new
        return [sum(map(found.__getitem__, tokens)) for tokens in cut]

    def count(self, texts: list[str]) -> list[int]:
        odd = [i for i, t in enumerate(texts) if self.special.search(t)] if self.special else []
        if not odd:
            return self.plain(texts)
        held = set(odd)
        out = self.plain(["" if i in held else t for i, t in enumerate(texts)])
        for i in odd:
            parts = self.special.split(texts[i])
            out[i] = len(parts) - 1 + sum(self.plain([p for p in parts if p]))
        return out


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row for each of `df`'s: id, n_bytes, n_tokens, over_limit (n_tokens > limit). `vocabulary` is a file that every worker can read."""
    rows = df.select(id_col, text_col)
    schema = T.StructType([rows.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches):
        counter = _counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n: list[int] = []
            size, group = 0, []
            for t in texts:
                group.append(t)
                size += len(t)
                if size > 1 << 20:
                    n += counter.count(group)
                    size, group = 0, []
            n += counter.count(group)
            n_bytes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=schema.names)

    return rows.mapInArrow(count, schema)
