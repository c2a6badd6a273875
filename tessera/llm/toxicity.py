"""Toxicity scores after noisy-channel deobfuscation.

Suspicious spans of a text are found from byte classes: words with digits or symbols beside letters (leetspeak), letters set apart by
blanks, marks or other punctuation, and letters repeated three times or more, of any length. Each is a lattice: a character stands for itself
or a letter it may replace, a repeat or a mark may be dropped, a mark may be the edge of a word, each at a cost. The best path under a letter
trigram model of the training texts (Viterbi) is the restored word, and takes part beside the words of the text. Words joined by marks are
also read each for itself. In a run of single letters, terms are looked up from each letter on. Digits alone are a number, not a word.

Terms are whole words and their first 4 to 8 bytes (stems). Those that mark toxic rows are picked, the best `most_terms` of them (a parameter), and
a small network scores what a text has of them. Terms and network are fitted on at most `most` labelled rows of each class (a parameter)
outside the held-out fold, each half of them seen through the terms picked on the other. The letter model counts all training texts. Every row is scored by its whole text.

Defined cases: null and empty texts get the score of a text without terms. Without labels of both classes every score is the prior (0.5
without labels). Rows with equal ids are scored each by its text. Extra columns are ignored; lang, source and id are never inputs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._fit import Constant, Network, fold, sample
from ._scratch import Scratch
from ._words import ALNUM, U64, _table, chunks, mix, powers, spans

STEMS = (4, 5, 6, 7, 8)
#: Rows of each label that the model is fitted on at most, and terms of that sample that it keeps at most.
MOST, MOST_TERMS = 3000, 100_000
#: Letters that a character stands for in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
MARKS = " .-_*~'"
#: Substitutes that are punctuation as often: a span is read with and without them at its edges.
SOFT = "!|+"
#: Letters of a spaced run that are looked up from each letter on, as words.
PIECES = np.arange(3, 10)
#: Costs, as natural logarithms: of a replaced letter, of a dropped repeat, of a dropped mark, and of a character that stays though it is odd.
REPLACED, REPEATED, MARKED, ODD = 1.0, 0.5, 0.1, 9.0
#: Letters a to z are 1 to 26, the edge of a word 0, any other letter 27.
LETTERS = 28
#: Of more repeats than three, three are read.
REPEATS, TWICE, DOUBLE = (re.compile(rf"(.)\1{n}", re.DOTALL) for n in ("{3,}", "{2,}", ""))
AT_MARKS = re.compile(f"[{re.escape(MARKS)}]+")
#: Restored spans that are remembered: how many, and up to how many bytes each.
MEMO, MEMO_BYTES = 100_000, 64


def _code_table() -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[97:123] = out[65:91] = np.arange(1, 27)
    out[128:] = 27
    return out


CODE = _code_table()


def _trigrams(batches):
    """Counts of letter trigrams, with edges, of one task."""
    sums = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        for _, data, offs in chunks(batch.column(0)):
            code = CODE[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[offs] = True
            # an edge between rows, so that no trigram spans two
            code = np.insert(code, np.flatnonzero(edge[:-1]), 0)
            code = np.concatenate([[0, 0], code, [0]])
            sums += np.bincount((code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:], minlength=LETTERS**3)
    some = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], names=["gram", "n"])


def letter_model(texts: DataFrame) -> np.ndarray:
    """Natural logarithms of p(third | first, second), smoothed by bigrams and single letters."""
    sums = np.zeros(LETTERS**3)
    for r in texts.mapInArrow(_trigrams, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        sums[r.gram] = r.n
    three = sums.reshape(LETTERS, LETTERS, LETTERS)
    three[0, 0, 0] = 0
    two = three.sum(0)
    one = two.sum(0) + 1
    p = one / one.sum()
    p = (two + 5 * p) / (two.sum(1, keepdims=True) + 5)
    p = (three + 5 * p) / (three.sum(2, keepdims=True) + 5)
    return np.log(p)


def restore(span: str, model: np.ndarray, twice: bool = False, edges: bool = False) -> str:
    """The best letters for a span, by Viterbi over pairs of letters; `twice`: of repeats two stay, else any may be dropped; `edges`: a blank or mark may be the edge of a word, a blank in the result."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for c in TWICE.sub(r"\1\1", span.lower()) if twice else REPEATS.sub(r"\1\1\1", span.lower()):
        options: list[tuple[str, float]] = []
        if "a" <= c <= "z" or ord(c) > 127:
            options.append((c, 0.0))
        for letter in LEET.get(c, ""):
            options.append((letter, REPLACED))
        drop = None
        if c in MARKS:
            drop = MARKED
            if edges:
                options.append((" ", 0.0))
        elif not options:
            options.append((c, ODD))
        if c == before and not twice:
            drop = REPEATED
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (x, y), (score, word) in best.items():
            moves = [((y, k := 0 if o == " " else 27 if ord(o) > 127 or not "a" <= o <= "z" else ord(o) - 96), score - cost + model[x, y, k], (word, o)) for o, cost in options]
            if drop is not None:
                moves.append(((x, y), score - drop, word))
            for state, s, w in moves:
                if state not in after or after[state][0] < s:
                    after[state] = (s, w)
        best = after or best
        before = c
    word, out = max(((s + model[x, y, 0], w) for (x, y), (s, w) in best.items()), key=lambda b: b[0])[1], []
    while word is not None:  # each letter with those before it: linear in long spans
        word, o = word
        out.append(o)
    return "".join(reversed(out))


def candidates(span: str, model: np.ndarray) -> list[tuple[str, int]]:
    """The words that a span may stand for, each with the place of the one it counts as: cut at all marks, cut where the model sets
    edges, and as one word, with and without soft substitutes at its edges, repeats dropped or two of them kept.
    """
    forms = list(dict.fromkeys((span.strip(MARKS), span.strip(MARKS + SOFT))))
    marked = [form for form in forms if any(c in MARKS for c in form)]
    parts = [part for form in marked for part in AT_MARKS.split(form)]
    cut = dict.fromkeys(restore(part, model, twice) for part in parts for twice in ([False, True] if DOUBLE.search(part) else [False]))
    some = [word for form in marked for word in restore(form, model, edges=True).split()]
    whole = [restore(form, model, twice) for form in forms for twice in ([False, True] if DOUBLE.search(form) else [False])]
    return [(word, i if i < len(cut) else 0) for i, word in enumerate(dict.fromkeys([*cut, *some, *whole]))]


def pieces(run: str, model: np.ndarray) -> list[tuple[str, int]]:
    """The words of a spaced run where the model sets edges, end to end."""
    return [(word, i) for i, word in enumerate(restore(run, model, edges=True).split())]


LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in range(256)])
ASCII_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
STANDS = np.array([chr(b) in LEET for b in range(256)])
SYMBOL = np.array([chr(b) in "@$" for b in range(256)])
MARK = np.array([chr(b) in MARKS[1:] for b in range(256)])
#: Bytes of a span; blanks and any other punctuation cut.
KEEP = np.array([b > 127 or chr(b).isalnum() or chr(b) in LEET or chr(b) in MARKS[1:] for b in range(256)])
SOFT_BYTE = np.array([chr(b) in SOFT for b in range(256)])
#: Bytes of the units whose single ones make a run, with and without soft substitutes.
UNIT = LETTER | STANDS
HARD_UNIT = UNIT & ~SOFT_BYTE
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def suspects(data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of the spans to restore."""
    return odd_words(data, offs) + [run[:3] for run in runs(data, offs)]


def odd_words(data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of words with substitutes, marks or repeats."""
    start, end = spans(data, offs, KEEP)
    if not len(start):
        return []
    letter, stands, mark = LETTER[data], STANDS[data], MARK[data]
    low = FOLDED[data]
    none = np.zeros(1, bool)
    after = np.concatenate([none, letter[:-1]])  # the byte before is a letter
    ahead = np.concatenate([letter[1:], none])
    plain = ASCII_LETTER[data]
    again = np.concatenate([np.zeros(2, bool), (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & plain[2:]]) if len(data) > 2 else np.zeros(len(data), bool)

    def has(mask):
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[end] - sums[start]

    size = end - start
    n_letters = has(plain)
    # a substitute beside a letter on either side, or symbols and digits alone (digits alone are a number)
    leet = ((has(stands & (after | ahead)) > 0) & (n_letters > 0)) | ((has(SYMBOL[data]) > 0) & (has(stands) >= 3))
    apart = has(mark & after & ahead)
    # letters set apart one by one, or a mark but an apostrophe anywhere inside a word
    spaced = (apart >= 2) & (n_letters <= apart + 2) & (n_letters >= 3)
    spaced |= (has(mark & (data != 39) & after & ahead) > 0) & (n_letters >= 4)
    repeated = (has(again) > 0) & (n_letters >= 4)
    row = np.searchsorted(offs, start, "right") - 1
    odd = np.flatnonzero(leet | spaced | repeated)
    return list(zip(row[odd].tolist(), start[odd].tolist(), end[odd].tolist(), strict=True))


def runs(data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(row, start, end, characters) of single letters and substitutes in a row with any blanks, marks or punctuation between them."""
    found = {}
    for unit in (UNIT, HARD_UNIT) if SOFT_BYTE[data].any() else (UNIT,):
        start, end = spans(data, offs, unit)
        single = np.flatnonzero((end - start == 1) & (ASCII_LETTER | STANDS)[data[start]])
        row = np.searchsorted(offs, start[single], "right") - 1
        cut = np.flatnonzero((np.diff(single) != 1) | (np.diff(row) != 0)) + 1
        cut = np.concatenate([[0], cut, [len(single)]])
        says = np.concatenate([[0], np.cumsum((ASCII_LETTER | SYMBOL)[data[start[single]]])])  # digits alone are no word
        for k in np.flatnonzero((np.diff(cut) >= 3) & (says[cut[1:]] > says[cut[:-1]])).tolist():
            some = single[cut[k] : cut[k + 1]]
            at = int(row[cut[k]]), int(start[some[0]]), int(end[some[-1]]), FOLDED[data[start[some]]].tobytes().decode()
            found[at] = at
    return list(found)


def _blanks(data: np.ndarray) -> np.ndarray:
    """The text with blanks, dashes and dots outside ASCII as blanks or marks of as many bytes."""
    if not len(data) or data.max() < 0xC2:
        return data
    raw = data.tobytes()
    for mark, found in BLANKS:
        raw = found.sub(lambda m, mark=mark: mark * len(m[0]), raw)
    return np.frombuffer(raw, np.uint8)


#: UTF-8 of blanks, and of invisible characters, dashes, dots and quotes.
BLANKS = [
    (b" ", re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")),
    (b"-", re.compile(rb"\xc2[\xad\xb7]|\xe2\x80[\x8b-\x9f\xa2-\xa7]|\xe2\x81\xa0|\xe2\x88[\x92\x99]|\xef\xbb\xbf")),
]


def _terms(data: np.ndarray, offs: np.ndarray, memo: dict, model: np.ndarray):
    """(row, term, word) of the words and stems of each row, restored spans among them."""
    start, end = spans_lower(data, offs)
    parts = [_stems(data, offs, start, end)]
    data = _blanks(data)
    spaced = runs(data, offs)
    odd = [(r, data[a:b].tobytes().decode("utf-8", "replace"), False) for r, a, b in odd_words(data, offs)] + [(r, " ".join(x), True) for r, _, _, x in spaced]
    if odd:
        if len(memo) > MEMO:
            memo.clear()
        row, words, of, text_of_run = [], [], [], []
        for r, span, run in odd:
            key = span + "\n" if run else span
            kept = memo.get(key)  # one blob an entry: a worker remembers many
            if kept is not None:
                found = list(zip(kept[0].split(b"\n"), kept[1], strict=True)) if kept[1] else []
            else:
                found = [(word.encode(), i) for word, i in (pieces(span, model) if run else candidates(span, model))]
                if len(span) <= MEMO_BYTES:
                    memo[key] = (b"\n".join(word for word, _ in found), bytes(i for _, i in found))
            n = len(words)
            row += [r] * len(found)
            of += [n + i for _, i in found]
            words += [word for word, _ in found]
            if run:
                text_of_run.append((n, len(words)))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        text = np.frombuffer(b"".join(words), np.uint8)
        row, of, own = np.array(row), np.array(of), np.arange(len(words))
        start, end, at = [ends - sizes], [ends], [own]
        for a, b in text_of_run:
            # the words lie end to end as the letters of the run: pieces from each letter on, all before and all after it
            lo, hi = int(ends[a] - sizes[a]), int(ends[b - 1])
            letter = np.arange(lo, hi)
            in_word = np.repeat(own[a:b], sizes[a:b])
            start += [np.repeat(letter, len(PIECES)), letter, np.full(hi - lo, lo)]
            end += [np.minimum(np.repeat(letter, len(PIECES)) + np.tile(PIECES, hi - lo), hi), np.full(hi - lo, hi), letter + 1]
            at += [np.repeat(in_word, len(PIECES)), in_word, in_word]
        start, end, at = (np.concatenate(x) for x in (start, end, at))
        some = end - start >= 3
        start, end, at = start[some], end[some], at[some]
        if len(start):
            # what a span may stand for counts as one word, and a piece of a run as the word it begins in
            parts.append(_stems(text, np.array([0, len(text)]), start, end, row[at], np.concatenate([[0], ends])[of[at]], ends[of[at]]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def spans_lower(data, offs):
    return spans(FOLDED[data], offs, ALNUM)


def _stems(data, offs, start, end, row=None, word_start=None, word_end=None):
    """Terms of words that lie in a row each: (row, hash of the term, hash of the word); given rows and words stand for their own."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_table(True)[data] * powers(len(data)), out=sums[1:])
    down = powers(len(data) + 1, "down")
    cut = lambda a, b: mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    row = np.searchsorted(offs, start, "right") - 1 if row is None else row
    size, term = end - start, cut(start, end)
    word = term if word_start is None else cut(word_start, word_end)
    rows, terms, words = [row], [term], [word]
    for n in STEMS:
        some = np.flatnonzero(size > n)
        rows.append(row[some])
        terms.append(cut(start[some], start[some] + n) ^ U64(n))
        words.append(word[some])
    return np.concatenate(rows), np.concatenate(terms), np.concatenate(words)


def _sampled(model):
    def sampled(batches):
        """Distinct terms of each sampled row."""
        memo: dict = {}
        for batch in batches:
            label, half, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for r0, data, offs in chunks(batch.column(1)):
                row, term, _ = _terms(data, offs, memo, model.value)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(len(offs)))
                for i in range(len(offs) - 1):
                    out.append((label[r0 + i], half[r0 + i], np.unique(term[order][cut[i] : cut[i + 1]]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["label", "half", "terms"])

    return sampled


class Lexicon:
    """Terms with weights; a direct table says at once which hashes can't be terms."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.weights = terms[order], weights[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(terms >> U64(48)).astype(np.int64)] = True

    def inputs(self, n: int, row, term, word) -> np.ndarray:
        """Of each row: the sum over its distinct words of the highest weight, cut off; the two highest; how many words and hits."""
        out = np.zeros((n, 5))
        some = np.flatnonzero(self.maybe[(term >> U64(48)).astype(np.int64)])
        if len(self.terms) and len(some):
            at = np.minimum(np.searchsorted(self.terms, term[some]), len(self.terms) - 1)
            known = self.terms[at] == term[some]
            some, weight = some[known], self.weights[at[known]]
            order = np.lexsort((-weight, word[some], row[some]))
            r, w, weight = row[some][order], word[some][order], weight[order]
            first = np.ones(len(r), bool)
            first[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
            r, weight = r[first], weight[first]
            out[:, 0] = np.minimum(np.bincount(r, weight, n), 30)
            out[:, 1] = np.minimum(np.bincount(r, minlength=n), 12)
            order = np.lexsort((-weight, r))
            r, weight = r[order], weight[order]
            top = np.flatnonzero(np.concatenate([np.ones(min(1, len(r)), bool), r[1:] != r[:-1]]))
            out[r[top], 2] = weight[top]
            second = top[(top + 1 < len(r)) & (r[np.minimum(top + 1, len(r) - 1)] == r[top])] + 1
            out[r[second], 3] = weight[second]
        out[:, 4] = np.minimum(np.log1p(np.bincount(row, minlength=n)), 8)
        return out


def _tagged(shared, names: list[str], at: int):
    """Scores beside all columns."""

    def tagged(batches):
        letters, lexicons, model = shared.value
        memo: dict = {}
        for batch in batches:
            out = [np.zeros(0)]
            for _, data, offs in chunks(batch.column(at)):
                out.append(model.probability(lexicons[0].inputs(len(offs) - 1, *_terms(data, offs, memo, letters))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=[*names, "_score"])

    return tagged


def _score(shared, label: bool):
    """Scores of rows (id, text, held_out), or with `label` the inputs of rows (label, text, half) under the other half's terms."""

    def score(batches):
        letters, lexicons, model = shared.value
        memo: dict = {}
        for batch in batches:
            out = []
            half = batch.column(2).to_pylist()
            for r0, data, offs in chunks(batch.column(1)):
                n = len(offs) - 1
                row, term, word = _terms(data, offs, memo, letters)
                if label:
                    both = [lexicon.inputs(n, row, term, word) for lexicon in lexicons]
                    out += [both[1 - half[r0 + i]][i] for i in range(n)]
                else:
                    out.append(model.probability(lexicons[0].inputs(n, row, term, word)))
            if label:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["label", "x"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate([np.zeros(0), *out]))], names=["id", "held_out", "score"])

    return score


def _pick(counted: DataFrame, yes: int, no: int, most: int) -> Lexicon:
    """The terms of rows (term, yes, no) that mark toxic rows best."""
    weight = F.log((F.col("yes") + 0.3) / (yes + 1.0)) - F.log((F.col("no") + 0.3) / (no + 1.0))
    good = counted.withColumn("weight", weight).filter((F.col("yes") >= 3) & (F.col("weight") >= 2.0))
    got = good.orderBy(F.col("weight").desc(), F.col("yes").desc(), "term").limit(most).select("term", "weight").toArrow()
    return Lexicon(got.column("term").to_numpy().astype(np.int64).view(np.uint64), got.column("weight").to_numpy().astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, allowed, train, most: int, most_terms: int, seed: int):
    """(letter model, [lexicon], model); docs has columns id and text."""
    spark = docs.sparkSession
    letters = letter_model(docs.filter(train).select("text"))
    picked, totals = sample(labels, id_col, label_col, allowed, {0: most, 1: most}, seed)
    empty = Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    total = sum(totals.values())
    if len({label for _, label in picked}) < 2:
        return letters, [empty], Constant(totals.get(1, 0) / total if total else 0.5)
    kind = docs.schema["id"].dataType.simpleString()
    ids = spark.createDataFrame([(i, label, k % 2) for k, (i, label) in enumerate(picked)], f"_id {kind}, label int, half int")
    rows = docs.join(F.broadcast(ids), F.col("id") == F.col("_id")).select("label", "text", "half")
    terms = rows.mapInArrow(_sampled(spark.sparkContext.broadcast(letters)), "label int, half int, terms array<bigint>").select("label", "half", F.explode("terms").alias("term"))
    both = terms.groupBy("term").agg(*[F.count_if((F.col("label") == k) & (F.col("half") == h)).alias(f"{a}{h}") for k, a in ((1, "yes"), (0, "no")) for h in (0, 1)])
    tmp = Scratch(spark)
    both = tmp.put(both.filter("yes0 + yes1 >= 3"), "terms")
    n = {(k, h): sum(label == k and i % 2 == h for i, (_, label) in enumerate(picked)) for k in (0, 1) for h in (0, 1)}
    halves = [_pick(both.select("term", F.col(f"yes{h}").alias("yes"), F.col(f"no{h}").alias("no")), n[1, h], n[0, h], most_terms) for h in (0, 1)]
    whole = _pick(both.select("term", (F.col("yes0") + F.col("yes1")).alias("yes"), (F.col("no0") + F.col("no1")).alias("no")), n[1, 0] + n[1, 1], n[0, 0] + n[0, 1], most_terms)
    tmp.drop("terms")
    got = rows.mapInArrow(_score(spark.sparkContext.broadcast((letters, halves, None)), True), "label int, x array<double>").orderBy("label", "x").collect()
    y, x = np.array([r.label for r in got]), np.array([r.x for r in got])
    if len(set(y.tolist())) < 2:
        return letters, [empty], Constant(totals.get(1, 0) / total)
    model = Network(width=8).fit(x, y)
    had, true = y.mean(), totals[1] / total
    model.shift = float(np.log(true / (1 - true)) - np.log(had / (1 - had)))
    return letters, [whole], model


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7, most: int = MOST, most_terms: int = MOST_TERMS, seed: int = 9) -> DataFrame:
    """One row for each of `df`'s: id, held_out, score (probability of label 1), predicted (1 if score >= threshold)."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out_of = fold(F.col("id"), folds) == held
    shared = df.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, label_col, fold(F.col(id_col), folds) != held, ~out_of, most, most_terms, seed))
    kind = docs.schema["id"].dataType.simpleString()
    out = docs.select("id", "text", out_of.alias("held_out")).mapInArrow(_score(shared, False), f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7, most: int = MOST, most_terms: int = MOST_TERMS, seed: int = 9) -> DataFrame:
    """The rows of `df`, all columns, whose score is under the threshold."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, label_col, fold(F.col(id_col), folds) != held, fold(F.col("id"), folds) != held, most, most_terms, seed))
    names = [f"_{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    kind = T.StructType([*rows.schema.fields, T.StructField("_score", T.DoubleType())])
    out = rows.mapInArrow(_tagged(shared, names, df.columns.index(text_col)), kind).filter(F.col("_score") < threshold)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)])
