"""Held-out evaluation items inside corpus texts.

A match is a run of at least ``min_words`` successive words (runs of letters and digits, letter case aside) shared by a
text and one field of an item. Any run of 2k words holds a whole k-word block out of the blocks that start at every
(k+1)-th word of the field, so one Aho-Corasick automaton over these blocks sees every run in one scan of the text;
each hit is then extended word by word in both directions and kept if it is long enough. The automaton's size is
that of the evaluation set, not of the corpus, and is checked before it is sent out.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Normalised words: runs of letters and digits, lower case."""
    return " ".join(WORD.findall(text)).lower().split(" ") if text else []


def build_automaton(fields: list[tuple[int, str, list[str]]], min_words: int) -> ahocorasick.Automaton:
    """Automaton over the k-word blocks; a block's value lists (index of field, index of its first word)."""
    k = max(1, min_words // 2)
    step = max(1, min_words - k + 1)
    blocks: dict[str, list[tuple[int, int]]] = {}
    for f, (_, _, words) in enumerate(fields):
        if len(words) >= min_words:
            for at in range(0, len(words) - k + 1, step):
                blocks.setdefault(" " + " ".join(words[at : at + k]) + " ", []).append((f, at))
    automaton = ahocorasick.Automaton()
    for block, places in blocks.items():
        automaton.add_word(block, (len(block), places))
    if blocks:
        automaton.make_automaton()
    return automaton


def matches(text: str, automaton: ahocorasick.Automaton, fields: list[tuple[int, str, list[str]]], min_words: int) -> list[tuple]:
    """(item_id, field, start, end, n_words) of each maximal shared run, with offsets of the original text."""
    flat = " " + " ".join(WORD.findall(text)).lower() + " "
    hits = list(automaton.iter(flat))
    if not hits:
        return []
    words = flat[1:-1].split(" ")
    found = set()
    done: dict[tuple[int, int], int] = {}
    place = {}
    at = 1
    for i, w in enumerate(words):
        place[at] = i
        at += len(w) + 1
    for end, (length, places) in hits:
        w = place[end - length + 2]
        for f, b in places:
            wanted = fields[f][2]
            diagonal = (f, w - b)
            if done.get(diagonal, -1) >= w:
                continue
            i, j = w, b
            while i > 0 and j > 0 and words[i - 1] == wanted[j - 1]:
                i, j = i - 1, j - 1
            last, q = w, b
            while last < len(words) and q < len(wanted) and words[last] == wanted[q]:
                last, q = last + 1, q + 1
            done[diagonal] = last - 1
            if last - i >= min_words:
                found.add((f, i, last))
    if not found:
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    return [(fields[f][0], fields[f][1], spans[i][0], spans[j - 1][1], j - i) for f, i, j in sorted(found)]


SCHEMA = "doc_id bigint, item_id bigint, field string, start int, end int, n_words int"
_KEPT: dict = {}


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               fields: tuple[str, ...] = ("prompt", "answer"), min_words: int = 12, max_eval_mb: int = 64) -> DataFrame:
    """One row (doc_id, item_id, field, start, end, n_words) for each maximal run of at least ``min_words`` words of an item's field
    in a text; start and end are offsets in the text as it was given.

    Null, empty and wordless texts give no row; a null or shorter field (fewer than ``min_words`` words) can't match; equal items are
    all reported; repeated documents each report; other columns are ignored. ``items`` is the held-out set: its size is
    checked on the cluster and more than ``max_eval_mb`` MB raise ValueError (split the set and union the results).
    """
    if min_words < 2:
        raise ValueError("min_words is at least 2")
    size = items.agg(sum(F.coalesce(F.sum(F.length(f)), F.lit(0)) for f in fields).alias("n")).first()["n"] or 0
    if size > max_eval_mb * 1_000_000:
        raise ValueError(f"evaluation set of {size} characters is over max_eval_mb={max_eval_mb}")
    held = [(r[0], f, words_of(r[k + 1])) for r in items.select(item_id, *fields).collect() for k, f in enumerate(fields) if r[0] is not None and r[k + 1]]
    held = [x for x in held if len(x[2]) >= min_words]
    sent = documents.sparkSession.sparkContext.broadcast(held)
    tag = uuid.uuid4().hex

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        if _KEPT.get("tag") != tag:
            _KEPT.update(tag=tag, automaton=build_automaton(known, min_words))
        automaton = _KEPT["automaton"]
        for batch in batches:
            rows: list[tuple] = []
            if len(automaton):
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if (body := body.as_py()):
                        rows += [(doc, *m) for m in matches(body, automaton, known, min_words)]
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "field", "start", "end", "n_words"])

    given = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    return given.mapInArrow(scan, SCHEMA)


def leak_report(leaks: DataFrame) -> DataFrame:
    """One row for each document and item: fields hit, number of runs, longest run."""
    return leaks.groupBy("doc_id", "item_id").agg(
        F.array_sort(F.collect_set("field")).alias("fields"), F.count(F.lit(1)).alias("runs"), F.max("n_words").alias("longest"))
