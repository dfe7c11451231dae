"""Secrets in texts: fixed patterns, and a linear-chain conditional random field beside them (operator 13).

Tokens are runs of letters, digits and a few signs, and every other sign alone; each is tagged as a secret's begin, its inside,
or outside. Its score for a tag adds up weights of its shape, itself, its three neighbours before and the one after, and of
the file. The field is trained here on a bounded sample: what the patterns find are its secrets, the rest is outside,
but for odd tokens after a name, of which nothing is known. In each step
parts of the evidence are hidden, so that a name before a value, and the look of a value, each count on their own, and
values that no pattern knows are found. Decoding is Viterbi's, exact: a token whose lead for outside is larger than all that its
transitions could gain is outside on every best path, so only the runs between such tokens are decoded, many at once.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textbytes import LOWER_AZ, buffer_of, mix64, slices
from lodestone.runtime import materialize, small

KINDS = ("assign", "access", "hex", "tagged")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What a text must hold for a pattern to match, for Spark's own regular expressions.
LIKELY = "(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"

OUTSIDE, BEGIN, INSIDE = range(3)
#: The field is trained on at most so many texts that may hold a pattern, and so many others: those with the smallest hash of their id.
MOST_LIKELY, MOST_OTHER = 2000, 2000
#: At most so many windows around secrets, with odd tokens and without; tokens before and after a secret; tokens of a window.
MOST_WINDOWS, BEFORE, AFTER, LONGEST = 1500, 12, 8, 28
#: Bytes of texts that are tagged at once.
SLICE = 1 << 18

WORDS, WORD_BYTES = 4096, 16
EDGE, LONG = WORDS, WORDS + 1
SHAPES = 8 * 32 * 4 * 2
NEAR = (0, -1, -2, -3, 1)
#: How far back the name of a secret is looked for.
REACH = 4
#: First number of each group of features: shape, its size and changes, its signs, token and its neighbours, a name before, the file's three.
LOOKS, ALL = 3, 3 + len(NEAR) + 1 + 3
FIRST = np.cumsum([0, SHAPES + 256, 8 * 4 + 1, 32 * 2 + 1, *[WORDS + 2] * len(NEAR), REACH + 1, 8, 8])
FEATURES = int(FIRST[-1]) + 8
_SPACE, _LOWER, _UPPER, _DIGIT, _SIGN, _HIGH, _ALONE = range(7)
_CLASS = np.full(256, _ALONE, np.uint8)
for _chars, _kind in ((b"\t\n\x0b\x0c\r ", _SPACE), (range(97, 123), _LOWER), (range(65, 91), _UPPER), (range(48, 58), _DIGIT), (b"_-+/.~", _SIGN), (range(128, 256), _HIGH)):
    _CLASS[list(_chars)] = _kind
_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the patterns' matches in order, and where their secret values lie."""
    found, values = [], []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            found.append((m.start(), 0, m.end()))
            values.append(m.span(2))
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        spans = [m.span() for m in pattern.finditer(text)]
        found += [(a, kind, b) for a, b in spans]
        values += spans
    return sorted(found), sorted(values)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans])


@dataclass
class Tokens:
    """The tokens of a slice of texts: where they are in its bytes, first token of each text, and their features."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    file: np.ndarray

    @classmethod
    def of(cls, buf: np.ndarray, off: np.ndarray) -> Tokens:
        kind = _CLASS[buf]
        run = (kind != _SPACE) & (kind != _ALONE)
        start = kind == _ALONE
        start[1:] |= run[1:] & ~run[:-1]
        opens = off[:-1][np.diff(off) > 0]
        start[opens] = kind[opens] != _SPACE
        starts = np.flatnonzero(start)
        if not len(starts):
            return cls(starts, starts, np.zeros(len(off), np.int64), starts, starts, np.zeros((0, 3), np.int64))
        solid = (kind != _SPACE).view(np.uint8)
        lengths = np.add.reduceat(solid, starts, dtype=np.int32)

        def count(mask: np.ndarray) -> np.ndarray:
            return np.add.reduceat(mask.view(np.uint8), starts, dtype=np.int32)

        some = sum((count(kind == k) > 0).astype(np.int64) << b for b, k in enumerate((_LOWER, _UPPER, _DIGIT, _SIGN, _HIGH)))
        turns = np.zeros(len(buf), bool)
        turns[1:] = (kind[1:] != kind[:-1]) & (kind[1:] != _SPACE)
        turns[starts] = False
        size = np.searchsorted([2, 4, 7, 11, 15, 23, 35], lengths)
        change = np.searchsorted([1, 3, 6], count(turns), "right")
        shape = ((size * 32 + some) * 4 + change) * 2 + (count(_HEX[buf]) == lengths)
        alone = kind[starts] == _ALONE
        shape[alone] = SHAPES + buf[starts[alone]].astype(np.int64)
        low, word = LOWER_AZ[buf], lengths.astype(np.uint64)
        for k in range(WORD_BYTES):
            has = np.flatnonzero(lengths > k)
            word[has] = word[has] * np.uint64(0x9E3779B97F4A7C15) + low[starts[has] + k].astype(np.uint64)
        word = (mix64(word) % np.uint64(WORDS)).astype(np.int64)
        word[lengths > WORD_BYTES] = LONG
        first = np.searchsorted(starts, off)
        share = np.maximum(np.diff(off), 1)
        file = np.zeros((len(off) - 1, 3), np.int64)
        full = np.flatnonzero(np.diff(off) > 0)
        if len(full):
            for k, wanted in ((1, kind == _DIGIT), (2, kind >= _SIGN)):
                part = np.add.reduceat(wanted.view(np.uint8), off[:-1][full], dtype=np.int64) / share[full]
                file[full, k] = np.searchsorted([0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2], part)
        file[:, 0] = np.minimum(7, np.log2(share).astype(np.int64) // 2)
        return cls(starts, starts + lengths, first, shape, word, file)

    def features(self, low: int, high: int) -> np.ndarray:
        """Numbers of the features of tokens low to high, one row each."""
        at = np.arange(low, high)
        doc = np.searchsorted(self.first, at, "right") - 1
        begin, end = self.first[doc], self.first[doc + 1]
        shape = self.shape[at]
        word = shape < SHAPES
        change, mix, size = shape // 2 % 4, shape // 8 % 32, shape // 256
        cols = [shape, FIRST[1] + np.where(word, size * 4 + change, 32), FIRST[2] + np.where(word, mix * 2 + shape % 2, 64)]
        for step, near in enumerate(NEAR):
            other = at + near
            inside = (other >= begin) & (other < end)
            cols.append(FIRST[LOOKS + step] + np.where(inside, self.word[np.clip(other, 0, len(self.word) - 1)], EDGE))
        # Whether each token, from REACH before the first, is a name.
        edge = max(0, low - REACH)
        named, back = np.isin(self.word[edge:high], _names()), np.zeros(len(at), np.int64)
        for k in range(REACH, 0, -1):
            back[(at - k >= begin) & named[np.maximum(at - k - edge, 0)]] = k
        cols += [FIRST[LOOKS + len(NEAR)] + back, *[FIRST[LOOKS + len(NEAR) + 1 + k] + self.file[doc, k] for k in range(3)]]
        return np.column_stack(cols)


@functools.cache
def _names() -> np.ndarray:
    """The buckets of the names that the first pattern knows."""
    words = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
    buf = np.frombuffer(b" ".join(words), np.uint8)
    return Tokens.of(buf, np.array([0, len(buf)])).word


@dataclass
class Field:
    """Weights of a conditional random field: (feature, tag) and (tag, next tag)."""

    emit: np.ndarray
    move: np.ndarray

    def lead(self) -> np.ndarray:
        """The most that transitions can gain by each tag over OUTSIDE, between any two neighbours."""
        into = (self.move - self.move[:, OUTSIDE : OUTSIDE + 1]).max(axis=0)
        from_it = (self.move - self.move[OUTSIDE]).max(axis=1)
        return into + from_it

    def tag(self, tokens: Tokens, chunk: int = 1 << 15) -> np.ndarray:
        """The best tag of each token; a text starts and ends outside."""
        n = len(tokens.starts)
        tags, lead, at, scores = np.zeros(n, np.int8), self.lead(), [], []
        for low in range(0, n, chunk):
            score = self.emit[tokens.features(low, min(n, low + chunk))].sum(axis=1)
            unsure = np.flatnonzero((score[:, OUTSIDE : OUTSIDE + 1] < (score + lead)[:, 1:]).any(axis=1))
            at.append(unsure + low)
            scores.append(score[unsure])
        if n and len(at := np.concatenate(at)):
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | np.isin(at[1:], tokens.first)
            begins = np.flatnonzero(new)
            tags[at] = viterbi(np.concatenate(scores), begins, np.diff(np.append(begins, len(at))), self.move)
        return tags


def viterbi(score: np.ndarray, begins: np.ndarray, lens: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tags of runs of ``score``, each between two outside tokens; runs of like lengths go together."""
    tags = np.zeros(len(score), np.int8)
    classes = np.ceil(np.log2(lens)).astype(int)
    for c in np.unique(classes):
        pick = np.flatnonzero(classes == c)
        pick = pick[np.argsort(-lens[pick], kind="stable")]
        b, size = begins[pick], lens[pick]
        back = np.zeros((len(pick), size[0], 3), np.int8)
        best = move[OUTSIDE] + score[b]
        for t in range(1, size[0]):
            k = int(np.searchsorted(-size, -t, "left"))  # runs longer than t stand first
            ways = best[:k, :, None] + move
            back[:k, t] = ways.argmax(axis=1)
            best[:k] = ways.max(axis=1) + score[b[:k] + t]
        state = (best + move[:, OUTSIDE]).argmax(axis=1)
        for t in range(size[0] - 1, -1, -1):
            k = int(np.searchsorted(-size, -t, "left"))
            tags[b[:k] + t] = state[:k]
            state[:k] = back[np.arange(k), t, state[:k]]
    return tags


def marginals(score: np.ndarray, lens: np.ndarray, move: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded runs (run, token, tag): log normaliser, each token's tag probabilities, and transition probabilities summed by the runs' shares."""
    n, longest, _ = score.shape
    top, step = score.max(axis=2), np.exp(move)
    e = np.exp(score - top[..., None])
    ahead, behind, scale = np.zeros_like(e), np.zeros_like(e), np.ones((n, longest))
    for t in range(longest):
        now = (ahead[:, t - 1] @ step if t else step[OUTSIDE]) * e[:, t]
        scale[:, t] = now.sum(axis=1)
        ahead[:, t] = now / scale[:, t, None]
    last = ahead[np.arange(n), lens - 1] @ step[:, OUTSIDE]
    for t in range(longest - 1, -1, -1):
        more = ((e[:, t + 1] * behind[:, t + 1]) @ step.T) / scale[:, t + 1, None] if t + 1 < longest else np.zeros((n, 3))
        behind[:, t] = np.where((lens - 1 == t)[:, None], step[:, OUTSIDE] / last[:, None], more)
    live = np.arange(longest) < lens[:, None]
    one = ahead * behind * live[..., None]
    after = (e * behind / scale[..., None])[:, 1:] * (live[:, 1:] * share[:, None])[..., None]
    moved = step * (ahead[:, :-1].reshape(-1, 3).T @ after.reshape(-1, 3))
    moved[OUTSIDE] += share @ one[:, 0]
    moved[:, OUTSIDE] += share @ one[np.arange(n), lens - 1]
    return ((np.log(scale) + top) * live).sum(axis=1) + np.log(last), one, moved


def fit(features: np.ndarray, tags: np.ndarray, lens: np.ndarray, steps: int = 50, rate: float = 0.2, decay: float = 1e-4, hidden: float = 0.8) -> Field:
    """Maximise the likelihood of padded windows (window, token, feature) by Adam, part of the evidence hidden in each step.

    Windows with a secret weigh half as much together as the others, however few there are.
    """
    rng = np.random.default_rng(13)
    n, longest, m = features.shape
    live = np.arange(longest) < lens[:, None]
    secret = (tags > 0).any(axis=1)
    share = np.where(secret, 1 / max(1, secret.sum()), 2 / max(1, (~secret).sum())) / 3
    truth = np.eye(3)[tags]
    moves = np.zeros((3, 3))
    pairs = live[:, 1:]
    np.add.at(moves, (tags[:, :-1][pairs], tags[:, 1:][pairs]), np.repeat(share, pairs.sum(axis=1)))
    np.add.at(moves[OUTSIDE], tags[:, 0], share)
    np.add.at(moves[:, OUTSIDE], tags[np.arange(n), lens - 1], share)
    flat = features.reshape(-1, m)
    weights = np.zeros(FEATURES * 3 + 9)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        emit, move = weights[: FEATURES * 3].reshape(-1, 3), weights[FEATURES * 3 :].reshape(3, 3)
        # Of a window with a secret the looks or the neighbours may be hidden, not both, and some of the rest; elsewhere everything is seen.
        draw = rng.random(n)
        seen = np.where(secret[:, None] & (rng.random((n, m)) < hidden / 2), 0.0, 1.0)
        seen[secret & (draw < hidden / 2), : LOOKS + 1] = 0
        seen[secret & (draw > 1 - hidden / 2), LOOKS + 1 : LOOKS + len(NEAR) + 1] = 0
        seen = np.repeat(seen, longest, axis=0)
        score = (emit[flat] * seen[..., None]).sum(axis=1).reshape(n, longest, 3)
        _, one, moved = marginals(score, lens, move, share)
        slope = ((one - truth) * (live * share[:, None])[..., None]).reshape(-1, 3)
        g = np.empty_like(weights)
        for y in range(3):
            g[: FEATURES * 3].reshape(-1, 3)[:, y] = np.bincount(flat.ravel(), weights=(slope[:, y, None] * seen).ravel(), minlength=FEATURES)
        g[FEATURES * 3 :] = (moved - moves).ravel()
        g = g + decay * weights
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        weights = weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field(weights[: FEATURES * 3].reshape(-1, 3), weights[FEATURES * 3 :].reshape(3, 3))


def _windows(batches):
    """Windows of sampled texts: kind (0 around a secret, 1 with an odd token, 2 plain), features and tags, flat."""
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = (text or "").encode()
            tokens = Tokens.of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            n = len(tokens.starts)
            if not n:
                continue
            tags, cuts = np.zeros(n, np.int8), []
            for a, b in base_spans(text)[1]:
                a, b = len(text[:a].encode()), len(text[:b].encode())
                low, high = int(np.searchsorted(tokens.ends, a, "right")), int(np.searchsorted(tokens.starts, b, "left"))
                if low < high and not tags[low:high].any():
                    tags[low], tags[low + 1 : high] = BEGIN, INSIDE
                cuts.append((max(0, low - BEFORE), min(n, high + AFTER), 0))
            odd = (tokens.ends - tokens.starts >= 8) & (tokens.shape < SHAPES) & ((tokens.shape // 8) % 32 > 1)
            x = tokens.features(0, n).astype(np.int32)
            # An odd token after a name that no pattern takes may be a secret or not: its window teaches nothing.
            doubt = odd & (x[:, LOOKS + len(NEAR)] > FIRST[LOOKS + len(NEAR)])
            for low in range(0, n, BEFORE + AFTER):
                high = min(n, low + BEFORE + AFTER)
                if not (tags[low:high].any() or doubt[low:high].any()):
                    cuts.append((low, high, 1 if odd[low:high].any() else 2))
            for low, high, kind in cuts:
                high = min(high, low + LONGEST)
                rows.append((kind, f"{doc_id}:{low}", x[low:high].ravel(), tags[low:high]))
        cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8())))]
        yield pa.RecordBatch.from_arrays(cols, names=["kind", "place", "x", "y"])


def train(docs: DataFrame) -> Field | None:
    """A field from a bounded sample of ``docs``; None where no pattern is found in it.

    At most MOST_LIKELY texts that may hold a pattern and MOST_OTHER that do not are read, and MOST_WINDOWS windows of each kind kept.
    """
    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.col("text").rlike(LIKELY), F.lit(False)).alias("likely"))
    rows = materialize(rows.groupBy("doc_id").agg(F.max("likely").alias("likely")), "likely")
    order = F.xxhash64("doc_id", F.lit(13))
    chosen = [rows.where(which).orderBy(order, "doc_id").limit(most).select("doc_id") for which, most in (("likely", MOST_LIKELY), ("not likely", MOST_OTHER))]
    ids = materialize(chosen[0].unionByName(chosen[1]), "sample")
    sample = docs.select("doc_id", "text").join(small(ids), "doc_id")
    windows = materialize(sample.mapInArrow(_windows, "kind int, place string, x array<int>, y array<tinyint>"), "windows")
    parts = []
    for kind in range(3):
        rows = windows.where(F.col("kind") == kind).orderBy(F.xxhash64("place"), "place", "y", "x").limit(MOST_WINDOWS).collect()
        if kind == 0 and not any(any(r.y) for r in rows):
            return None
        parts += rows
    m = ALL
    lens = np.array([len(r.y) for r in parts])
    x, y = np.zeros((len(parts), lens.max(), m), np.int64), np.zeros((len(parts), lens.max()), np.int64)
    for k, r in enumerate(parts):
        x[k, : lens[k]], y[k, : lens[k]] = np.reshape(r.x, (-1, m)), r.y
    return fit(x, y, lens)


def tagged(field: Field | None, buf: np.ndarray, off: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """For each text the spans, in bytes of it, that the field tags."""
    for i, j in slices(off, SLICE):
        part, cut = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        found: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
        if field is not None and len(part):
            tokens = Tokens.of(part, cut)
            tags = field.tag(tokens)
            inside = tags != OUTSIDE
            opens = inside.copy()
            opens[1:] &= (tags[1:] == BEGIN) | ~inside[:-1] | np.isin(np.arange(1, len(tags)), tokens.first)
            begins = np.flatnonzero(opens)
            at = np.flatnonzero(inside)
            last = at[np.searchsorted(at, np.append(begins[1:], len(tags))) - 1] if len(begins) else begins
            doc = np.searchsorted(tokens.first, begins, "right") - 1
            for d, a, b in zip(doc, tokens.starts[begins] - cut[doc], tokens.ends[last] - cut[doc]):
                found[d].append((int(a), int(b)))
        yield from found


def _in_code_points(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, at, place = [], 0, 0
    for a, b in spans:
        place += len(raw[at:a].decode())
        size = len(raw[a:b].decode())
        out.append((place, place + size))
        at, place = b, place + size
    return out


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row.

    ``spans`` holds kind:start:end of all spans in code points, ends exclusive, by start and then kind; what the field finds has the kind
    ``tagged`` and is left out where it meets a span of a pattern. A pattern's span is its whole match. Null texts count as empty; long ones are
    read whole; repeated rows and null ids give rows of their own; extra columns are ignored; an empty table gives no rows. Without
    a field (nothing to learn from) only the patterns' spans are there.
    """

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: list[list] = [[] for _ in range(5)]
            for text, extra in zip(texts, tagged(field, *buffer_of(batch.column(1)))):
                base, _ = base_spans(text)
                spans = list(base)
                if extra:
                    if not text.isascii():
                        extra = _in_code_points(text.encode(), extra)
                    spans += [(a, 3, b) for a, b in extra if all(b <= s or e <= a for s, _, e in base)]
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                for col, value in zip(out, [*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(spans))]):
                    col.append(value)
            cols = [pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(out)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def find_secrets(docs: DataFrame) -> DataFrame:
    """``scan`` of all texts with a field trained on a bounded sample of them."""
    return scan(docs, train(docs))
