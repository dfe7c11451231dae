"""Exact merge-type piece encoding by backtracking (operator 4).

A token sequence is the merge result of its text exactly if every two neighbours are what
re-merging their joined text gives. So a segment is encoded from left to right: the longest
piece found there by an Aho-Corasick automaton is tried first, shorter ones after it; a piece is
taken only if it is compatible with its left neighbour; a position from which no way leads on is
struck from a bitfield and never tried again.

No piece contains a space mark after another character, so texts are cut before each run of
spaces, and at characters that no piece contains; segments repeat, and a bounded memo in each
worker keeps their ids.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Entries of the per-worker memos; a full memo is emptied, so memory is bounded.
MEMO_SEGMENTS = 500_000
MEMO_PAIRS = 500_000


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class PieceModel:
    """Vocabulary of a merge-type (BPE) piece model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.score = {self.piece[i]: sp.get_score(i) for i in range(n) if not special[i]}
        self.id_of = {self.piece[i]: i for i in range(n) if not special[i]}
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.chars = {p for p in self.id_of if len(p) == 1}
        if sp.encode(f"ﬁ  x {SPACE}", out_type=str)[0] != SPACE or len(self.byte_id) != 256:
            raise ValueError("the model must add a leading space, normalise nothing and have all byte pieces")
        if any(c not in self.chars for p in self.id_of for c in p) or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of):
            raise ValueError("pieces must be made of single-character pieces, with spaces in front only")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if self.remerge(p) == [i]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        loose = "".join(c for c in "\n\t\r" if c not in self.chars)
        self.segment = re.compile(f"{SPACE}+[^{SPACE}{loose}]*|[^{SPACE}{loose}]+" + (f"|[{loose}]" if loose else ""))
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, str, str]] = {}

    def remerge(self, text: str) -> list[int]:
        """Plain merging: again and again the best-scored neighbours, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id_of[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = a * 65536 + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.remerge(self.piece[a] + self.piece[b]) == [a, b]
        return found

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        # The longest matches one after the other are the first way tried; mostly their neighbours are compatible.
        pairs = self.pairs
        ids = [i for _, (_, i) in self.automaton.iter_long(text)]
        for a, b in zip(ids, ids[1:]):
            good = pairs.get(a * 65536 + b)
            if not (self.compatible(a, b) if good is None else good):
                break
        else:
            return ids
        n = len(text)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            at[end - match[0] + 1].append(match)
        dead = bytearray(n // 8 + 1)  # a bit for each position from which no way leads on
        ids = []
        tried: list[tuple[int, int]] = []
        pos, k = 0, len(at[0]) - 1
        while pos < n:
            options = at[pos]
            while k >= 0:
                length, i = options[k]
                if not dead[(pos + length) >> 3] >> ((pos + length) & 7) & 1 and (not ids or self.compatible(ids[-1], i)):
                    break
                k -= 1
            if k >= 0:
                ids.append(i)
                tried.append((pos, k))
                pos += length
                k = len(at[pos]) - 1 if pos < n else -1
            else:
                dead[pos >> 3] |= 1 << (pos & 7)
                pos, k = tried.pop()
                ids.pop()
                k -= 1
        return ids

    def encode_segment(self, text: str) -> list[int]:
        known = self.chars
        if known.issuperset(text):
            return self.backtrack(text)
        ids: list[int] = []
        start = 0
        for k, c in enumerate([*text, ""]):
            if c not in known:
                if k > start:
                    ids += self.backtrack(text[start:k])
                ids += [self.byte_id[b] for b in c.encode()]
                start = k + 1
        return ids

    def decode_ids(self, ids: list[int]) -> str:
        """Text of ids without the removal of the leading space."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.piece[i] for i in ids]).replace(SPACE, " ")
        out = b"".join([bytes((b,)) if (b := self.byte_of.get(i)) is not None else self.piece[i].encode() for i in ids])
        return out.decode("utf-8", "replace").replace(SPACE, " ")

    def segments(self, text: str) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each segment of a text."""
        if not text:
            return []
        memo = self.memo
        parts = self.segment.findall(SPACE + text.replace(" ", SPACE))
        out = [memo.get(p) for p in parts]
        if None in out:
            for k, got in enumerate(out):
                if got is None:
                    seg = parts[k]
                    ids = self.encode_segment(seg)
                    if len(memo) >= MEMO_SEGMENTS:
                        memo.clear()
                    out[k] = memo[seg] = (len(ids), ",".join(map(str, ids)), self.decode_ids(ids))
        return out


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _run(path: str, digests: bool):
    def run(batches):
        model = load(path)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                got = model.segments(text.as_py() or "")
                ids = ",".join([g[1] for g in got])
                decoded = "".join([g[2] for g in got])[1:]
                n.append(ids.count(",") + 1 if ids else 0)
                if digests:
                    a.append(hashlib.sha256(ids.encode()).hexdigest())
                    b.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    a.append([int(i) for i in ids.split(",")] if ids else [])
                    b.append(decoded)
            kind = pa.string() if digests else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, kind), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "a", "b"])

    return run


def encode_decode(docs: DataFrame, model: str | None = None, digests: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids: (doc_id, n_tokens, ids, decoded) or their SHA-256 digests.

    No begin or end ids. Null and empty texts have no ids and decode to the empty text. Any valid
    UTF-8 is accepted; characters without a piece become byte pieces. Rows are independent, so
    repeated rows, ties and extra columns (ignored) change nothing; an empty table gives no rows.
    """
    path = model or default_model()
    names = ("ids_sha256 string", "decoded_sha256 string") if digests else ("ids array<int>", "decoded string")
    return docs.select("doc_id", "text").mapInArrow(_run(path, digests), f"doc_id long, n_tokens long, {names[0]}, {names[1]}")
