"""Quality classifier by positive-unlabelled learning (operator 8).

Trusted positives are documents labelled good, the rest of the web text is unlabelled. The
non-negative unbiased risk  prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])
is minimised; where the second part turns negative, its gradient is reversed, so that it cannot be
pushed below zero by overfitting. The prior is estimated from positives and unlabelled texts alone: no
negative label is used anywhere. The model adds up one weight for each feature's bin, so any
single-feature shape can be learned; features are counts of the text, and shares of its words and character
runs in hashed buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.frames import map_rows
from lodestone.llm.textbytes import LOWER_AZ, WORD_BREAKS, buffer_of, mix64, slices, word_hashes, words_of
from lodestone.runtime import materialize, small

#: The classifier is fitted on at most so many documents of each kind, those with the smallest hash of their id.
MOST_POSITIVES, MOST_UNLABELLED = 12_000, 24_000
BINS = 24
#: Buckets of hashed words and of hashed runs of GRAM characters.
BUCKETS, GRAM = 32, 4
#: Bytes of texts whose features are counted at once; longer texts are counted in pieces. A worker needs some 60 bytes for each.
SLICE = 1 << 18
#: The part, and the number, of positives that must lie above a cut of the prior's estimate, and its slack in standard deviations.
LEAST_ABOVE, LEAST_POSITIVES, SLACK = 0.2, 30, 1.5

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".,;:",
    "bang": b"!?",
    "symbol": b"*#$%&@^~+=_<>{}[]\\/",
    "bar": b"|",
    "line": b"\n",
    "other": [*range(9), *range(14, 32), 127],
    "high": range(128, 256),
}
_CLASS_OF = np.full(256, len(_CLASSES), np.int32)
for _k, _members in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_members)] = _k
_MARKS = np.isin(np.arange(len(_CLASSES) + 1), [list(_CLASSES).index(c) for c in ("bang", "symbol", "bar")])
_LINE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
COUNTS = [*_CLASSES, "words", "word_length", "longest", "distinct", "distinct_pairs", "distinct_triples", "top_word", "distinct_lines", "marked"]
NAMES = [*COUNTS, *[f"word_{k}" for k in range(BUCKETS)], *[f"gram_{k}" for k in range(BUCKETS)]]


def _distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: its number of distinct values, and the count of the commonest."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    if not len(v):
        return np.zeros(n), np.zeros(n)
    new = np.concatenate(([True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])))
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate((at, [len(v)])))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[at], counts)
    return np.bincount(d[at], minlength=n).astype(float), top.astype(float)


def _runs(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word runs and their first indices by document."""
    sizes = np.maximum(np.diff(first) - (k - 1), 0)
    out = np.concatenate(([0], np.cumsum(sizes)))
    take = np.arange(out[-1]) - np.repeat(out[:-1], sizes) + np.repeat(first[:-1], sizes)
    h = np.zeros(len(take), np.uint64)
    for j in range(k):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[take + j])
    return h, out


@dataclass
class Parts:
    """What the bytes of some texts add to their features; the parts of pieces of one text add up."""

    classes: np.ndarray
    grams: np.ndarray
    words: np.ndarray
    first: np.ndarray
    lengths: np.ndarray
    marked: np.ndarray
    lines: np.ndarray
    first_line: np.ndarray
    #: Of a piece's first and last line: the sum without places, and the last line's length.
    plain: np.uint64 = np.uint64(0)
    open_length: int = 0


def _parts(buf: np.ndarray, off: np.ndarray, follow: np.ndarray = np.zeros(0, np.uint8)) -> Parts:
    """``follow``: the bytes after the piece, where runs of characters may go on."""
    n = len(off) - 1
    kind = _CLASS_OF[buf]
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
    classes = np.bincount(doc * np.int32(len(_CLASSES) + 1) + kind, minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)[:, : len(_CLASSES)]
    starts, ends, first = words_of(buf, off)
    marks = np.concatenate((np.zeros(1, np.int32), np.cumsum(_MARKS[kind], dtype=np.int32)))
    ends_line = np.flatnonzero(buf == 10)
    cuts = np.unique(np.concatenate((off[:-1][np.diff(off) > 0], ends_line + 1)))
    cuts = cuts[cuts < len(buf)]
    lines, plain, open_length = np.zeros(0, np.uint64), np.uint64(0), 0
    if len(cuts):
        sizes = np.diff(np.append(cuts, len(buf)))
        lines = np.add.reduceat(_LINE_VALUE[buf] * (np.arange(1, len(buf) + 1) - np.repeat(cuts, sizes)).astype(np.uint64), cuts)
        plain, open_length = _LINE_VALUE[buf[: sizes[0]]].sum(), 0 if buf[-1] == 10 else int(sizes[-1])
    return Parts(classes, _grams(buf, off, follow), word_hashes(buf, starts, ends), first, (ends - starts).astype(np.int32), marks[ends] > marks[starts], lines, np.searchsorted(cuts, off), plain, open_length)


def _joined(pieces: list[Parts]) -> Parts:
    """The parts of one text from those of its pieces; a line that goes on in the next piece keeps its places."""
    lines, held = [pieces[0].lines], pieces[0].open_length
    for p in pieces[1:]:
        more = p.lines.copy()
        if held and len(more):
            lines[-1][-1:] += more[:1] + np.array([held], np.uint64) * p.plain
            alone = len(more) == 1
            more = more[1:]
            held = (held + p.open_length) if alone and p.open_length else p.open_length
        else:
            held = p.open_length
        if len(more):
            lines.append(more)
    words, every = np.concatenate([p.words for p in pieces]), np.concatenate(lines)
    return Parts(
        sum(p.classes for p in pieces), sum(p.grams for p in pieces), words, np.array([0, len(words)]), np.concatenate([p.lengths for p in pieces]),
        np.concatenate([p.marked for p in pieces]), every, np.array([0, len(every)]),
    )


def _long_text(buf: np.ndarray) -> Parts:
    """The parts of one long text, SLICE bytes at a time and on to the next word break."""
    pieces, low = [], 0
    while low < len(buf):
        high = min(len(buf), low + SLICE)
        while high < len(buf) and not WORD_BREAKS[buf[high - 1]]:
            stop = np.flatnonzero(WORD_BREAKS[buf[high : high + SLICE]])
            high = high + int(stop[0]) + 1 if len(stop) else min(len(buf), high + SLICE)
        pieces.append(_parts(buf[low:high], np.array([0, high - low]), buf[high : high + GRAM - 1]))
        low = high
    return _joined(pieces)


def _features(p: Parts, size: np.ndarray) -> np.ndarray:
    """The features of texts of ``size`` bytes from their parts."""
    n = len(size)
    shares = p.classes / np.maximum(size, 1)[:, None]
    words, first, length = p.words, p.first, p.lengths.astype(float)
    count = np.diff(first).astype(float)
    some = np.maximum(count, 1)
    longest = np.zeros(n)
    owner = np.repeat(np.arange(n), np.diff(first))
    np.maximum.at(longest, owner, length)
    one, top = _distinct(words, first)
    ratios = [one / some]
    for k in (2, 3):
        h, at = _runs(words, first, k)
        ratios.append(np.where(count >= k, _distinct(h, at)[0] / np.maximum(count - k + 1, 1), 1.0))
    line_ratio = _distinct(p.lines, p.first_line)[0] / np.maximum(np.diff(p.first_line), 1) if len(p.lines) else np.ones(n)
    marked = np.bincount(owner, weights=p.marked, minlength=n) / some
    total = np.bincount(owner, weights=length, minlength=n)
    grams = p.grams / np.maximum(size - GRAM + 1, 1)[:, None]
    return np.column_stack([shares, np.log1p(count), total / some, np.log1p(longest), *ratios, top / some, line_ratio, marked, _hashed(words, owner, n, some), grams])


def _hashed(values: np.ndarray, owner: np.ndarray, n: int, totals: np.ndarray) -> np.ndarray:
    """Share of each document's values in each bucket."""
    bucket = (values % np.uint64(BUCKETS)).astype(np.int64)
    return np.bincount(owner * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS) / totals[:, None]


def _grams(buf: np.ndarray, off: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Counts of the runs of GRAM bytes, letters in lower case, by bucket; none reaches into another document."""
    n = len(off) - 1
    low = LOWER_AZ[np.concatenate((buf, follow))]
    if len(low) < GRAM:
        return np.zeros((n, BUCKETS), np.int64)
    runs = min(len(buf), len(low) - GRAM + 1)
    code = low[:runs].astype(np.uint32)
    for k in range(1, GRAM):
        code = (code << np.uint32(8)) | low[k : runs + k]
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))[:runs]
    limit = off[1:].astype(np.int32)
    if n == 1:
        limit = limit + np.int32(len(follow))
    whole = limit[owner] - np.arange(runs, dtype=np.int32) >= GRAM
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(27)).astype(np.int32)[whole]
    return np.bincount(owner[whole] * np.int32(BUCKETS) + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers for each text; an empty or null text has the row of zero counts."""
    buf, off = buffer_of(texts)
    out = []
    for i, j in slices(off, SLICE):
        part, at = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        parts = _long_text(part) if len(part) > 2 * SLICE and j == i + 1 else _parts(part, at)
        out.append(_features(parts, np.diff(at)).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)), np.float32)


@dataclass
class Model:
    """Bin edges of each feature and a weight for each bin."""

    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "right") + k * BINS for k, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        g = self.weights[self.bins(x)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-g))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1200, rate: float = 0.2, decay: float = 5e-5) -> Model:
    """Minimise the non-negative risk with logistic loss by Adam; deterministic."""
    both = np.concatenate((positive, unlabelled))
    edges = [np.unique(np.quantile(both[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(both.shape[1])]
    # A wide tail beyond the usual range gets its own bin.
    edges = [np.unique(np.concatenate((e[: BINS - 3], [(e[-1] + both[:, k].max()) / 2]))) if len(e) else np.array([both[:, k].max() / 2]) for k, e in enumerate(edges)]
    model = Model(edges, np.zeros(BINS * len(edges)), 0.0)
    bp, bu = model.bins(positive), model.bins(unlabelled)
    m, v = np.zeros(len(model.weights) + 1), np.zeros(len(model.weights) + 1)

    def grad(bins: np.ndarray, slope: np.ndarray) -> np.ndarray:
        g = np.bincount(bins.ravel(), weights=np.repeat(slope, bins.shape[1]), minlength=len(model.weights))
        return np.append(g, slope.sum()) / max(1, len(bins))

    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-model.weights[bp].sum(axis=1) - model.bias)), 1 / (1 + np.exp(-model.weights[bu].sum(axis=1) - model.bias))
        unl, pos = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean(), -np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        negative_part = grad(bu, su) - prior * grad(bp, sp)
        if unl - prior * pos >= 0:
            g = prior * grad(bp, sp - 1) + negative_part
        else:
            g = -negative_part
        g[:-1] += decay * model.weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        model.weights -= move[:-1]
        model.bias -= float(move[-1])
    return model


def risk(model: Model, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk: of the positives, and of the negatives before it is kept from falling below zero."""
    loss = lambda x, sign: np.logaddexp(0, -sign * (model.weights[model.bins(x)].sum(axis=1) + model.bias)).mean()
    return prior * loss(positive, 1), loss(unlabelled, -1) - prior * loss(positive, -1)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled scores: the least ratio of the parts above a cut, over all cuts.

    Above any cut lie at least prior * (part of the positives) of the unlabelled, and where only positives are left just
    that. Each ratio is taken at its upper bound for chance, so the estimate leans to the side that keeps good documents;
    cuts with few positives above are left out, so a small sample gives a high prior.
    """
    cuts = np.unique(positive)
    above = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    # One more of each kind than seen, so that no part is taken for certain.
    also = (len(unlabelled) - np.searchsorted(np.sort(unlabelled), cuts, "left") + 1) / (len(unlabelled) + 2)
    keep = above >= min(1.0, max(LEAST_ABOVE, LEAST_POSITIVES / len(positive)))
    deviation = np.sqrt(also * (1 - also) / len(unlabelled) + (also / above) ** 2 * above * (1 - above) / len(positive))
    ratio = (also + SLACK * deviation) / above
    best = int(np.argmin(np.where(keep, ratio, np.inf)))
    return float(min(0.95, max(0.05, ratio[best])))


def fit_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior, from scores of one half of the rows by a model fitted on the other half."""
    first = fit(positive[::2], unlabelled[::2], 0.5, steps=300)
    return estimated_prior(first.score(positive[1::2]), first.score(unlabelled[1::2]))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _vectors(batches):
    for batch in batches:
        x = features(batch.column(1)).astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(NAMES)), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["positive", "x"])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on documents outside the held-out part: those labelled 1, and those without a label.

    Samples are bounded by MOST_POSITIVES and MOST_UNLABELLED, each the documents with the smallest hash of their id.
    Without at least two of each kind there is nothing to learn from, and no model.
    """
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(8))
    ids = docs.where("doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id")
    positive = ids.join(known.where("quality = 1"), "doc_id", "left_semi").distinct().orderBy(order, "doc_id").limit(MOST_POSITIVES)
    unlabelled = ids.join(labels.where("quality is not null").select("doc_id"), "doc_id", "left_anti").distinct().orderBy(order, "doc_id").limit(MOST_UNLABELLED)
    chosen = materialize(positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False))), "sample")
    sample = docs.select("doc_id", "text").join(small(chosen), "doc_id").select("positive", "text")
    rows = sample.mapInArrow(_vectors, "positive boolean, x array<float>").toArrow()
    flag = rows.column("positive").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    order = np.lexsort((*x.T[: len(COUNTS)], flag))  # the same sums whatever order the rows came in
    x, flag = x[order], flag[order]
    if min(flag.sum(), (~flag).sum()) < 2:
        return None
    # A fixed shuffle, so that the halves of the prior's estimate are alike.
    mixed = np.random.default_rng(8).permutation(len(flag))
    x, flag = x[mixed], flag[mixed]
    return fit(x[flag], x[~flag], fit_prior(x[flag], x[~flag]))


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; null and empty texts are scored as empty. Without a model all score 0.5."""

    def run(batches):
        for batch in batches:
            s = model.score(features(batch.column(1))) if model is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text the model takes for good; all of them without a model."""
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= 0.5))

    return map_rows(docs, run)
