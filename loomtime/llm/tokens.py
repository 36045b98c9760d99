"""Encoding of a corpus by a public byte-level BPE vocabulary.

A text is cut into pieces exactly as the vocabulary's pattern does. The distinct words not met before by the worker are walked
depth-first as a trie (in sorted order, so that a shared prefix is a shared stack): the state of a node is the last token of the
encoding of the bytes down to it. The encoding of a node is that of a shallower node followed by one token, and that
token is the only one whose pair with the state above survives BPE's merge order; so each shared prefix is computed once and
no merge loop runs at all. Pieces met before come from a bounded per-worker cache, which saves time and changes nothing.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtime.runtime import spread

VOCABULARY = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.json")

# The word pattern of byte_bpe_50k, and Unicode's White_Space property
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"

#: A piece is a run without white space with the space before it, or a run of white space: no word crosses its border.
PIECE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable bytes stand for themselves, the others
    follow from code point 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Byte-level BPE: token bytes, ids, and for each merged token the two tokens it is merged from."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(k): v for k, v in model["vocab"].items() if all(c in alphabet for c in k)}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.order: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right = self.ids[raw(a)], self.ids[raw(b)]
            whole = self.ids[raw(a) + raw(b)]
            self.rank[left, right] = r
            if whole not in self.parts:
                self.parts[whole], self.order[whole] = (left, right), r
        self.length = {i: len(b) for b, i in self.ids.items()}
        #: token lengths that can end in these two bytes, longest first
        ends: dict[bytes, set[int]] = {}
        for b in self.ids:
            ends.setdefault(b[-2:], set()).add(len(b))
        for b in [x for x in ends if len(x) == 2]:
            ends[b] |= ends.get(b[-1:], set())
        self.ends = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self.fits: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def joins(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` side by side. The merges of both are undone from the last one on; the pair at
        the border is open until one of its sides is used up, and a merge of it before that moment would cross the border (of
        equal merges the one further left comes first)."""
        pair = left << 20 | right
        known = self.fits.get(pair)
        if known is None:
            a, b, until_a, until_b, known = left, right, 1 << 30, 1 << 30, True
            while True:
                over = self.rank.get((a, b))
                if over is not None and over < until_a and over <= until_b:
                    known = False
                    break
                done_a, done_b = self.order.get(a, -1), self.order.get(b, -1)
                if done_a < 0 and done_b < 0:
                    break
                if done_a > done_b:
                    until_a, a = done_a, self.parts[a][1]
                else:
                    until_b, b = done_b, self.parts[b][0]
            self.fits[pair] = known
        return known

    def stands(self, token: int) -> bool:
        """Whether the bytes of ``token`` alone are encoded as ``token``."""
        known = self.alone.get(token)
        if known is None:
            parts = self.parts.get(token)
            known = parts is None or (self.stands(parts[0]) and self.stands(parts[1]) and self._merges(token, *parts))
            self.alone[token] = known
        return known

    def _merges(self, token: int, left: int, right: int) -> bool:
        """Whether no earlier merge over the border keeps ``left`` and ``right`` from meeting."""
        a, b, until_a, until_b = left, right, 1 << 30, 1 << 30
        while True:
            done_a, done_b = self.order.get(a, -1), self.order.get(b, -1)
            if done_a < 0 and done_b < 0:
                return True
            if done_a > done_b:
                until_a, a = done_a, self.parts[a][1]
            else:
                until_b, b = done_b, self.parts[b][0]
            over = self.rank.get((a, b))
            if over is not None and over < until_a and over <= until_b:
                return False

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words, by one depth-first walk of their trie."""
        ids, ends, length, fits, joins = self.ids, self.ends, self.length, self.fits, self.joins
        state: list[int] = []  # last token at each depth of the current path
        path = b""
        out: dict[str, list[int]] = {}
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = len(os.path.commonprefix((path, raw)))
            del state[shared:]
            path = raw
            for depth in range(shared + 1, len(raw) + 1):
                for n in ends.get(raw[max(0, depth - 2) : depth], (1,)):
                    if n > depth:
                        continue
                    token = ids.get(raw[depth - n : depth])
                    if token is None:
                        continue
                    if n < depth:
                        above = state[depth - n - 1]
                        whole = fits.get(above << 20 | token)
                        if whole is None:
                            whole = joins(above, token)
                    else:
                        whole = self.stands(token)
                    if whole:
                        state.append(token)
                        break
            at, found = len(raw), []
            while at:
                found.append(state[at - 1])
                at -= length[state[at - 1]]
            out[word] = found[::-1]
        return out


class Encoder:
    """Texts to ids. Pieces and words met before are kept, but long ones (hashes, paths, data), which hardly ever come again, only as long as their
    chunk of texts; about ``most`` pieces, words and token pairs each stay, so a worker's memory is bounded."""

    def __init__(self, path: str, most: int = 200_000, long: int = 18):
        self.vocabulary, self.most, self.long = Vocabulary(path), most, long
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.words: dict[str, list[int]] = {}
        self.tokens, self.starts = array("i"), array("q", [0])

    def learn(self, pieces: set[str]) -> list[str]:
        """Encode what is new; the long pieces come back, to be dropped after use."""
        if max(len(self.place), len(self.words)) > self.most:
            self.clear()
        if len(self.vocabulary.fits) > 2 * self.most:
            self.vocabulary.fits.clear()
        place, words, tokens, starts = self.place, self.words, self.tokens, self.starts
        new = sorted((p for p in pieces if p not in place), key=len)
        cut = [WORD.findall(p) for p in new]
        fresh = self.vocabulary.encode_words({w for ws in cut for w in ws if w not in words})
        words.update(fresh)
        for p, ws in zip(new, cut):
            place[p] = len(starts) - 1
            for w in ws:
                tokens.extend(words[w])
            starts.append(len(tokens))
        for w in fresh:
            if len(w) > 8:
                del words[w]
        return new[bisect_right(new, self.long, key=len) :]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts one after another."""
        pieces = [PIECE.findall(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(pieces))
        dropped = self.learn(set(flat))
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        starts = np.frombuffer(self.starts, np.int64)
        tokens = np.frombuffer(self.tokens, np.int32) if self.tokens else np.empty(0, np.int32)
        first = starts[at]
        count = starts[at + 1] - first
        past = np.r_[0, np.cumsum(count)]
        ids = tokens[np.repeat(first - past[:-1], count) + np.arange(past[-1])]
        del starts, tokens  # views keep the arrays from changing
        if dropped:  # they lie at the end
            keep = self.place[dropped[0]]
            for p in dropped:
                del self.place[p]
            del self.tokens[self.starts[keep] :], self.starts[keep + 1 :]
        return past[np.r_[0, np.cumsum([len(p) for p in pieces])].astype(np.int64)], ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _chunks(texts: Iterable, most: int) -> Iterator[list]:
    """Texts in order, in lists of about ``most`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) if t else 0
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>): the whole text of each row by the byte-level BPE vocabulary file ``vocabulary``, without special tokens.

    Their strings in a text are ordinary text. Null and empty texts both give an empty list; null doc_ids and repeated rows stay;
    other columns are left out. Long texts take memory and time in proportion to their length. The file must lie at the
    same path on every executor.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            done = 0
            for texts in _chunks((x.as_py() for x in batch.column(1)), 1_000_000):
                offsets, ids = own.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), lists], names=["doc_id", "ids"])
                done += len(texts)

    given = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return spread(given).mapInArrow(run, "doc_id bigint, ids array<int>")
