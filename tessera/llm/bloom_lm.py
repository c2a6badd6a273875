"""Language-model scores from a log-frequency Bloom filter.

Word and bigram counts of the training texts are summed by part of the hash range. A count c enters the filter as the members
(n-gram, 1) to (n-gram, q), q the number of steps of a geometric scale up to c; a reader probes (n-gram, 1), (n-gram, 2), ... until a
probe fails and takes the last step's value. The filter goes to the workers. Its size is bounded by `most_bits`; with more n-grams than that
holds, it starts at a higher step. With it go the exact counts of the most frequent words (at most `head`), for the unigram score only.

Tokens whose counts the workers can't tell are open: words out of the head, whose exact counts the unigram score needs, and n-grams below
the filter's first step. Each run of texts writes its open tokens packed, asks the count tables for its distinct n-grams by a shuffle,
and scores them with the answers. Estimates take the same steps either way, so that a score depends on the bounds by false positives only.

A word's probability is the add-one unigram estimate, mixed with the bigram estimate: p(w | h) = m c(h w) / c(h) + (1 - m) p(w). All counts are
lower ends of their steps, so that the bigram estimates of a context may sum to a little over one only by false positives and by the context's
step. Words are told apart by 64 bits (among 10**9 different ones some 0.03 pairs share them by chance), bigrams by twice as many bits as the number of
training tokens has, less 8, and 44 at least: at any size some hundred pairs of bigrams in all share a number. An ask leaves out the bits of a bigram that
ten more than the number of bigrams has don't need: one bigram in a thousand that isn't counted is taken for one that is, fewer than by the filter.

Bigrams count from `least_pair` occurrences on, 1 by default.

Defined cases: null text counts as empty; every text has an end token. A null id is in the training part. With no training text all
counts are 0 (N = 0, V = 0). Rows with equal ids are scored each by its text. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._packed import pack, pack_small, part_of, present, unpack, unpack_small
from ._scratch import Scratch
from ._words import U64, chunks, hashes, mix

#: Tokens that a batch gathers before its counts are sent, and that are merged before they are dealt to the parts of a share; segments of the
#: filter; tokens of a part of the count tables; parts that counts are dealt to directly: with more they go by as many shares of parts.
BATCH_TOKENS, MERGED_TOKENS, SEGMENTS, PART_TOKENS, FAN = 1 << 21, 1 << 22, 64, 1 << 21, 1024
#: Bytes of text whose open tokens are asked for together; bits of an ask over those of the number of bigrams.
OPEN_BYTES, ASK_SPARE = 1 << 22, 10
#: Words whose counts the workers hold exactly; bits of the filter, per member and at most; probes of a member.
HEAD, MEMBER_BITS, MOST_BITS, PROBES = 1 << 20, 10, 1 << 28, 4
#: Steps of the scale of counts: each is the least whole number over 1.5 times the one before.
SCALE = [1, 2, 3, 5, 8]
while SCALE[-1] < 1 << 40:
    SCALE.append(int(SCALE[-1] * 1.5) + 1)
SCALE = np.array(SCALE, np.int64)
#: Share of the bigram estimate.
BIGRAM = 0.3
END, BEGIN = U64(0x9AE16A3B2F90404F), U64(0xC949D7C7509E6557)


def _tokens(data, offs):
    """(token hashes with an end token after each row, the token before each, tokens of each row)."""
    words, counts = hashes(data, offs, lower=True)
    ends = np.cumsum(counts)
    tokens = np.insert(words, ends, END)
    counts = counts + 1
    before = np.concatenate([[BEGIN], tokens[:-1]])[: len(tokens)]
    before[np.cumsum(counts) - counts] = BEGIN
    return tokens, before, counts


def _bigrams(before, tokens, bits: int):
    """Numbers of bigrams; the lower bits are 0, which packs to next to nothing."""
    return _upper(mix(before * U64(0xD6E8FEB86659FD93) + mix(tokens + U64(0x2545F4914F6CDD1D))), bits)


def _upper(numbers, bits: int):
    return numbers & U64(2**64 - 2 ** (64 - bits))


_SENT = pa.schema([("part", pa.int32()), ("texts", pa.int64()), *[(c, pa.binary()) for c in ("w", "wn", "b", "bn")]])
_SENT_DDL = "part int, texts bigint, w binary, wn binary, b binary, bn binary"


def _counted(values: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams, sorted, and their counts."""
    value = np.concatenate([np.zeros(0, np.uint64), *values])
    if counts is None:
        return np.unique(value, return_counts=True)
    count = np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(value, kind="stable")
    value, count = value[order], count[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(value)), bool), value[1:] != value[:-1]]))
    return value[starts], np.add.reduceat(count, starts) if len(value) else count


def _dealt(parts: int, texts: int, **counted) -> pa.RecordBatch:
    """Counts by part of the hash range."""
    out = {}
    for kind, (value, count) in counted.items():
        for p, a, b in present(value, parts):
            row = out.setdefault(p, {"part": p, "texts": 0, "w": b"", "wn": b"", "b": b"", "bn": b""})
            row[kind], row[kind + "n"] = pack(value[a:b]), pack_small(count[a:b])
    if out:
        next(iter(out.values()))["texts"] = texts
    return pa.RecordBatch.from_pylist(list(out.values()), schema=_SENT)


def _send(parts: int, bits: int):
    def send(batches):
        words, pairs, size, texts = [], [], 0, 0
        for batch in batches:
            for _, data, offs in chunks(batch.column(0)):
                tokens, before, counts = _tokens(data, offs)
                words.append(tokens)
                pairs.append(_bigrams(before, tokens, bits))
                size, texts = size + len(tokens), texts + len(counts)
                if size >= BATCH_TOKENS:
                    yield _dealt(parts, texts, w=_counted(words), b=_counted(pairs))
                    words, pairs, size, texts = [], [], 0, 0
        yield _dealt(parts, texts, w=_counted(words), b=_counted(pairs))

    return send


def _deal_on(parts: int):
    """Counts of a share of the parts, merged over many batches and dealt to its parts."""

    def deal_on(batches):
        have = {c: [] for c in ("w", "wn", "b", "bn")}
        size = texts = 0

        def merged():
            return _dealt(parts, texts, w=_counted(have["w"], have["wn"]), b=_counted(have["b"], have["bn"]))

        for batch in batches:
            for i in range(batch.num_rows):
                for c in have:
                    blob = batch.column(c)[i].as_py()
                    have[c].append(unpack(blob) if c in "wb" else unpack_small(blob).astype(np.int64))
                texts += batch.column("texts")[i].as_py()
                size += len(have["b"][-1])
                if size >= MERGED_TOKENS:
                    yield merged()
                    have = {c: [] for c in have}
                    size = texts = 0
        yield merged()

    return deal_on


def _sum(least_pair: int):
    def summed(table: pa.Table) -> pa.Table:
        return _sums(table, least_pair)

    return summed


def _sums(table: pa.Table, least_pair: int) -> pa.Table:
    """Counts of one part, and how many n-grams have each; bigrams met less than `least_pair` times are left out."""
    out = {"part": [table.column("part")[0].as_py()], "texts": [sum(table.column("texts").to_pylist())]}
    for kind in ("w", "b"):  # one blob at a time, not the whole table as Python objects
        counts = [unpack_small(x.as_py()).astype(np.int64) for x in table.column(kind + "n")]
        value, total = _counted([unpack(x.as_py()) for x in table.column(kind)], counts)
        step = np.searchsorted(SCALE, total, "right")
        tally = np.bincount(step, minlength=len(SCALE) + 1)
        out[kind + "_tally"] = [tally.tolist()]
        if kind == "b":
            value, total = value[total >= least_pair], total[total >= least_pair]
        out[kind], out[kind + "n"] = [pack(value)], [pack_small(total)]
        out[kind + "_total"] = [sum(int(x.sum()) for x in counts)]
    return pa.table({c: pa.array(x, pa.int32() if c == "part" else pa.list_(pa.int64()) if c.endswith("tally") else pa.binary() if c in ("w", "wn", "b", "bn") else pa.int64()) for c, x in out.items()}).select(_SUM)


_SUM = ["part", "texts", "w", "wn", "w_tally", "w_total", "b", "bn", "b_tally", "b_total"]
_SUM_DDL = "part int, texts bigint, w binary, wn binary, w_tally array<bigint>, w_total bigint, b binary, bn binary, b_tally array<bigint>, b_total bigint"


def _probe_places(grams: np.ndarray, step: int, probe: int, bits: int) -> np.ndarray:
    x = mix(grams + U64((0x9E3779B97F4A7C15 * (step * PROBES + probe + 1)) & (2**64 - 1)))
    return (x >> U64(32)) * U64(bits) >> U64(32)


class Filter:
    """Segments of `bits` bits, one for each equal range of the hashes."""

    def __init__(self, parts: int, bits: int, array: np.ndarray):
        self.parts, self.bits, self.array = parts, bits, array

    def count(self, grams: np.ndarray, least: int) -> np.ndarray:
        """Counts as lower ends of their steps; 0: not a member. Steps below `least` were not entered."""
        out = np.zeros(len(grams), np.int64)
        live = np.arange(len(grams))
        base = part_of(grams, self.parts).astype(np.int64) * self.bits
        step = least
        while len(live) and step <= len(SCALE):
            for probe in range(PROBES):
                at = base[live] + _probe_places(grams[live], step, probe, self.bits).astype(np.int64)
                live = live[(self.array[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            out[live] = SCALE[step - 1]
            step += 1
        return out


def _places(parts: int, bits: int, least_w: int, least_b: int, head_from: int):
    """Of one part: the bits of its members in its segment of the filter, and its words of the head."""

    def places(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        at = [np.zeros(0, np.uint64)]
        for kind, least in (("w", least_w), ("b", least_b)):
            grams, count = unpack(row[kind]), unpack_small(row[kind + "n"]).astype(np.int64)
            steps = np.searchsorted(SCALE, count, "right")
            for step in range(least, int(steps.max(initial=0)) + 1):
                mine = grams[steps >= step]
                at += [_probe_places(mine, step, probe, bits) for probe in range(PROBES)]
        words, count = unpack(row["w"]), unpack_small(row["wn"])
        top = count >= head_from
        segment = row["part"] * SEGMENTS // parts
        return pa.table({"segment": pa.array([segment], pa.int32()), "at": pa.array([pack(np.unique(np.concatenate(at)))], pa.binary()), "w": pa.array([pack(words[top])], pa.binary()), "wn": pa.array([pack_small(count[top])], pa.binary())})

    return places


def _segment(bits: int):
    """One segment of the filter, and its words of the head."""

    def segment(table: pa.Table) -> pa.Table:
        array = np.zeros(bits, bool)
        for blob in table.column("at"):
            array[unpack(blob.as_py()).astype(np.int64)] = True
        words = np.concatenate([unpack(x.as_py()) for x in table.column("w")])
        count = np.concatenate([unpack_small(x.as_py()).astype(np.int64) for x in table.column("wn")])
        order = np.argsort(words)
        return pa.table({"segment": table.column("segment")[:1], "bits": pa.array([np.packbits(array, bitorder="little").tobytes()], pa.binary()), "w": pa.array([pack(words[order])], pa.binary()), "wn": pa.array([pack_small(count[order])], pa.binary())})

    return segment


class Model:
    """What the workers hold: the filter, the head of the word counts, and totals."""

    def __init__(self, flt: Filter, least: tuple[int, int], words, counts, tokens: int, types: int, texts: int, share: float, least_pair: int, pair_bits: int, ask_bits: int):
        self.ask_bits, self.pair_bits, self.least_pair, self.flt, self.least, self.words, self.counts = ask_bits, pair_bits, least_pair, flt, least, words, counts
        self.tokens, self.types, self.texts, self.share = tokens, types, texts, share
        self.by_rank = np.argsort(-counts, kind="stable")
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.by_rank] = np.arange(len(words))

    def place(self, tokens):
        """(where tokens stand in the head, whether they do)."""
        if not len(self.words):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return at, self.words[at] == tokens

    def head(self, tokens):
        """(exact counts, whether a token is in the head)."""
        at, known = self.place(tokens)
        return np.where(known, self.counts[at] if len(self.counts) else 0, 0), known

    def words_about(self, words):
        """(steps, exact counts, whether these are known, whether the step isn't told) of words: steps from the filter, counts from the head."""
        exact, known = self.head(words)
        about = self.flt.count(words, self.least[0])
        unsure = ~known & (self.least[0] > 1)
        low = (about == 0) & known
        about[low] = _floor(exact[low])
        about[unsure] = 0
        return about, exact, known, unsure

    def pairs_about(self, pairs):
        about = self.flt.count(pairs, self.least[1])
        return about, (about == 0) & (self.least[1] > self.least_pair)

    def log_p(self, pair, context, about):
        """log10 of the mixed estimate."""
        return np.log10(self.share * np.minimum(pair, context) / np.maximum(context, 1) + (1 - self.share) * (about + 1) / (self.tokens + self.types + 1.0))

    def score(self, tokens, before, counts, trained):
        """Each row's (known tokens, exact log10, log10 under the model) over the tokens that aren't open, and where open ones are.

        A bigram of a `trained` row has been counted: if the filter begins at the second step and lacks it, it was met once, and needn't be asked for.
        """
        kinds, back = np.unique(tokens, return_inverse=True)
        about, exact, known, unsure = self.words_about(kinds)
        base = np.log10((exact + 1) / (self.tokens + self.types + 1.0))
        first = np.cumsum(counts) - counts
        context, opened = np.zeros(len(tokens)), np.zeros(len(tokens), bool)
        context[1:], opened[1:] = about[back][:-1], unsure[back][:-1]
        context[first], opened[first] = self.texts, False
        opened |= ~known[back]
        pair = np.zeros(len(tokens))
        some = np.flatnonzero((context >= self.least_pair) & ~opened)
        about_pair, unsure_pair = self.pairs_about(_bigrams(before[some], tokens[some], self.pair_bits))
        if self.least[1] == 2 and self.least_pair == 1:
            once = unsure_pair & np.repeat(trained, counts)[some]
            about_pair[once], unsure_pair[once] = 1, False
        pair[some] = about_pair
        opened[some[unsure_pair]] = True
        closed = known[back]
        p = self.log_p(pair, context, about[back])
        return np.add.reduceat(closed.astype(np.int64), first), np.add.reduceat(np.where(closed, base[back], 0.0), first), np.add.reduceat(np.where(opened, 0.0, p), first), np.flatnonzero(opened)


def _score(model):
    def score(batches):
        m, rid = model.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            n, known, base, full, opened, begin = [], [], [], [], [None] * len(batch), rid
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for row, data, offs in chunks(batch.column(1), OPEN_BYTES):
                tokens, before, counts = _tokens(data, offs)
                trained = ~held[row : row + len(counts)]
                k, b, s, at = m.score(tokens, before, counts, trained)
                for out, x in zip((n, known, base, full), (counts, k, b, s), strict=True):
                    out.append(x)
                if len(at):
                    words, back = np.unique(np.concatenate([tokens[at], before[at]]), return_inverse=True)
                    place, in_head = m.place(words)
                    # words of the head by rank, so that frequent ones have small numbers; then the others
                    order = np.concatenate([np.flatnonzero(in_head)[np.argsort(m.rank[place[in_head]])], np.flatnonzero(~in_head)])
                    number = np.empty(len(words), np.int64)
                    number[order] = np.arange(len(words))
                    back = number[back]
                    rows = np.repeat(np.arange(len(counts)), counts)[at]
                    token, b4 = back[: len(at)], back[len(at) :] + 1
                    b4[1:][b4[1:] == token[:-1] + 1] = 0
                    ranks = np.sort(m.rank[place[in_head]]).astype(np.uint64)
                    opened[row] = pack(ranks), pack(words[~in_head]), pack_small(token), pack_small(b4), pack_small(np.diff(rows, prepend=0))
            rid += len(batch)
            cat = lambda x, kind: pa.array(np.concatenate([np.zeros(0, kind), *x]).astype(kind))
            blobs = [pa.array([o and o[i] for o in opened], pa.binary()) for i in range(len(_OPEN))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(begin, rid)), batch.column(0), batch.column(2), cat(n, np.int64), cat(known, np.int64), cat(base, np.float64), cat(full, np.float64), *blobs], names=["rid", "id", "held_out", "n_tokens", "known", "base", "score", *_OPEN])

    return score


#: Open tokens of a run of rows, on its first row: distinct words (ranks in the head, then hashes), places in them of each token and the one
#: before (from 1; 0: the open token before it), rows as differences.
_OPEN = ["o_head", "o_words", "o_token", "o_before", "o_row"]


class _Opened:
    """Open tokens of a run of rows, and the n-grams they ask for: sorted words, and sorted bigrams."""

    def __init__(self, model: Model, row: dict):
        self.words = words = np.concatenate([model.words[model.by_rank[unpack(row["o_head"]).astype(np.int64)]], unpack(row["o_words"])])
        self.token, before = (unpack_small(row[c]).astype(np.int64) for c in ("o_token", "o_before"))
        self.before = np.where(before > 0, before - 1, np.concatenate([[0], self.token[:-1]]))
        self.about, self.exact, self.known, unsure = model.words_about(words)
        self.asks_word = ~self.known & (words != BEGIN)
        self.some = ((words == BEGIN) | (self.about >= model.least_pair) | unsure)[self.before]  # no rarer context has a bigram that counts
        pairs, self.back = np.unique(_bigrams(words[self.before[self.some]], words[self.token[self.some]], model.pair_bits), return_inverse=True)
        self.pair, self.asks_pair = model.pairs_about(pairs)
        self.w, self.b = words[self.asks_word], _upper(pairs[self.asks_pair], model.ask_bits)


_ASK = pa.schema([("part", pa.int32()), ("rid", pa.int64()), ("w", pa.binary()), ("b", pa.binary())])


def _ask(model, parts: int):
    """The distinct n-grams that the open tokens of each run of rows ask for, by part of the hash range."""

    def ask(batches):
        for batch in batches:
            for i in range(len(batch)):
                (row,) = batch.slice(i, 1).to_pylist()
                o = _Opened(model.value, row)
                asks = {}
                for kind, grams in (("w", o.w), ("b", o.b)):
                    for p, a, b in present(grams, parts):
                        asks.setdefault(p, {"part": p, "rid": row["rid"], "w": b"", "b": b""})[kind] = pack(grams[a:b])
                yield pa.RecordBatch.from_pylist(list(asks.values()), schema=_ASK)

    return ask


def _untold(model):
    """Of the counts, those that may be asked for: words out of the head, bigrams below the filter's first step."""

    def untold(batches):
        m = model.value
        for batch in batches:
            rows = []
            for part, w, wn, b, bn in zip(*(batch.column(c).to_pylist() for c in ("part", "w", "wn", "b", "bn")), strict=True):
                words, word_counts, pairs, pair_counts = unpack(w), unpack_small(wn), unpack(b), unpack_small(bn)
                some = ~m.place(words)[1]
                low = np.searchsorted(SCALE, pair_counts.astype(np.int64), "right") < m.least[1]
                rows.append({"part": part, "w": pack(words[some]), "wn": pack_small(word_counts[some]), "b": pack(_upper(pairs[low], m.ask_bits)), "bn": pack_small(pair_counts[low])})
            yield pa.RecordBatch.from_pylist(rows, schema=_COUNTS)

    return untold


_COUNTS = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("w", "wn", "b", "bn")]])


def _answer(asked: pa.Table, sums: pa.Table) -> pa.Table:
    """The counts of the asked n-grams of one part in the order of the asks: exact for words, steps for bigrams."""
    have = {kind: (np.zeros(0, np.uint64), np.zeros(0, np.uint32)) for kind in "wb"}
    for r in sums.to_pylist():
        have = {"w": (unpack(r["w"]), unpack_small(r["wn"])), "b": (unpack(r["b"]), np.searchsorted(SCALE, unpack_small(r["bn"]).astype(np.int64), "right"))}
    out = {c: [] for c in ("rid", "part", "wn", "bn")}
    for rid, part, *asks in zip(*(asked.column(c).to_pylist() for c in ("rid", "part", "w", "b")), strict=True):
        out["rid"].append(rid)
        out["part"].append(part)
        for kind, blob in zip("wb", asks, strict=True):
            out[kind + "n"].append(pack_small(_pick(unpack(blob), *have[kind])))
    return pa.table({c: pa.array(x, kind) for (c, x), kind in zip(out.items(), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)})


def _pick(grams, value, count):
    """The counts of n-grams out of sorted values; 0 where there are none."""
    if not len(value):
        return np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(value, grams), len(value) - 1)
    return np.where(value[at] == grams, count[at].astype(np.int64), 0)


def _floor(counts):
    """Lower ends of the steps."""
    return np.where(counts > 0, SCALE[np.searchsorted(SCALE, counts, "right") - 1], 0)


def _finish(model):
    """What the open tokens add to each row."""

    def told(answers, kind):
        # parts are ranges of the sorted asks
        return np.concatenate([np.zeros(0, np.int64), *[unpack_small(a[kind]).astype(np.int64) for a in answers]])

    def finish(opened: pa.Table, answers: pa.Table) -> pa.Table:
        m, got, parts = model.value, sorted(answers.to_pylist(), key=lambda a: a["part"]), []
        for row in opened.to_pylist():
            o = _Opened(m, row)
            words, known, token, exact = o.words, o.known, o.token, o.exact
            exact[o.asks_word] = told(got, "wn")
            about = np.where(known, o.about, _floor(exact))
            context = np.where(words == BEGIN, m.texts, about)[o.before].astype(float)
            step = told(got, "bn")
            o.pair[o.asks_pair] = np.where(step > 0, SCALE[step - 1], 0)
            pair = np.zeros(len(token))
            pair[o.some] = o.pair[o.back]
            p = m.log_p(np.where(context >= m.least_pair, pair, 0), context, about[token])
            base = np.where(known, 0.0, np.log10((exact + 1) / (m.tokens + m.types + 1.0)))[token]
            rows, place = np.unique(np.cumsum(unpack_small(row["o_row"]).astype(np.int64)), return_inverse=True)
            sums = [np.bincount(place, x) for x in (((exact > 0) & ~known)[token].astype(float), base, p)]
            parts.append(pa.table({"rid": pa.array(rows + row["rid"]), "more_known": pa.array(sums[0].astype(np.int64)), "more_base": pa.array(sums[1]), "more_score": pa.array(sums[2])}))
        return pa.concat_tables(parts) if parts else pa.schema([("rid", pa.int64()), ("more_known", pa.int64()), ("more_base", pa.float64()), ("more_score", pa.float64())]).empty_table()

    return finish


def train(tmp: Scratch, texts: DataFrame, head: int = HEAD, most_bits: int = MOST_BITS, share: float = BIGRAM, least_pair: int = 1) -> tuple[Model, DataFrame, int]:
    """(the model, all counts by part, the number of parts) for a table of one text column."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 6
    parts = SEGMENTS * max(1, -(-size // PART_TOKENS // SEGMENTS))
    pair_bits = min(64, max(44, 2 * size.bit_length() - 8))
    shares = -(-parts // FAN)
    sent = texts.mapInArrow(_send(parts if shares == 1 else shares, pair_bits), _SENT_DDL)
    if shares > 1:
        sent = sent.repartition(shares, "part").mapInArrow(_deal_on(parts), _SENT_DDL)
    sums = tmp.put(sent.groupBy("part").applyInArrow(_sum(least_pair), _SUM_DDL), "sums")
    tallies = {k: np.zeros(len(SCALE) + 1, np.int64) for k in "wb"}
    tokens = n_texts = 0
    for k in "wb":
        for r in sums.select(F.posexplode(f"{k}_tally").alias("step", "n")).groupBy("step").agg(F.sum("n").alias("n")).collect():
            tallies[k][r.step] = r.n
    totals = sums.agg(F.coalesce(F.sum("w_total"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    tokens, n_texts = int(totals[0]), int(totals[1])
    types = int(tallies["w"].sum())
    above = np.cumsum(tallies["w"][::-1])[::-1]  # words of each step or more
    at = next(s for s in range(1, len(SCALE) + 2) if s > len(SCALE) or above[s] <= head)
    head_from = int(SCALE[at - 1]) if at <= len(SCALE) else 1 << 62
    # the least steps for which all members fit; step 1 is the count 1, step 2 is 2
    # words out of the head are asked for in any case, so that the filter has only those of the head's steps
    least = {"w": at, "b": least_pair}

    def members(kind):
        return int((tallies[kind] * np.maximum(np.arange(len(SCALE) + 1) - least[kind] + 1, 0)).sum())

    while (members("w") + members("b")) * MEMBER_BITS > most_bits:
        kind = "b" if members("b") >= members("w") else "w"
        least[kind] += 1
    bits = max(64, -(-(members("w") + members("b")) * MEMBER_BITS // SEGMENTS // 8) * 8)
    array = np.zeros((SEGMENTS, bits // 8), np.uint8)
    words, counts = [], []
    places = sums.groupBy("part").applyInArrow(_places(parts, bits, least["w"], least["b"], head_from), "segment int, at binary, w binary, wn binary")
    made = places.groupBy("segment").applyInArrow(_segment(bits), "segment int, bits binary, w binary, wn binary")
    for r in sorted(made.collect(), key=lambda r: r.segment):
        array[r.segment] = np.frombuffer(r.bits, np.uint8)
        words.append(unpack(r.w))
        counts.append(unpack_small(r.wn).astype(np.int64))
    none = np.zeros(0, np.uint64)
    model = Model(Filter(SEGMENTS, bits, array.ravel()), (least["w"], least["b"]), np.concatenate([none, *words]), np.concatenate([none.astype(np.int64), *counts]), tokens, types, n_texts, share, least_pair, pair_bits, min(pair_bits, int(tallies["b"].sum()).bit_length() + ASK_SPARE))
    return model, sums.select("part", "w", "wn", "b", "bn"), parts


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 7, held: int = 2, **shape) -> DataFrame:
    """One row for each of `df`'s: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    tmp = Scratch(spark)
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (F.col(id_col).isNotNull() & (crc % fold == held)).alias("held_out"))
    model, sums, parts = train(tmp, docs.filter("not held_out").select("text"), **shape)
    shared = spark.sparkContext.broadcast(model)
    id_type = docs.schema["id"].dataType.simpleString()
    # row numbers are read from the written table, so they stay
    scored = tmp.put(docs.mapInArrow(_score(shared), f"rid bigint, id {id_type}, held_out boolean, n_tokens bigint, known bigint, base double, score double, {', '.join(f'{c} binary' for c in _OPEN)}"), "scored")
    opened = scored.select("rid", *_OPEN).filter("o_row is not null")
    untold = sums.mapInArrow(_untold(shared), "part int, w binary, wn binary, b binary, bn binary")
    ask = opened.select("rid", "o_head", "o_words", "o_token", "o_before").mapInArrow(_ask(shared, parts), "part int, rid bigint, w binary, b binary")
    answers = ask.groupBy("part").cogroup(untold.groupBy("part")).applyInArrow(_answer, "rid bigint, part int, wn binary, bn binary")
    more = opened.groupBy("rid").cogroup(answers.groupBy("rid")).applyInArrow(_finish(shared), "rid bigint, more_known bigint, more_base double, more_score double")
    more = tmp.put(more, "more").withColumnRenamed("rid", "_rid")
    tmp.keep("scored", "more")
    out = scored.drop(*_OPEN).join(more, F.col("rid") == F.col("_rid"), "left")
    plus = lambda column, extra, none: (F.col(column) + F.coalesce(extra, F.lit(none))).alias
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", plus("known", "more_known", 0)("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        plus("base", "more_base", 0.0)("base_score"), plus("score", "more_score", 0.0)("score"),
    )
