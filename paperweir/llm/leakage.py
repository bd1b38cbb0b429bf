"""Wording of held-out items in a corpus, found with one Aho-Corasick automaton.

Every known word is one character, so a run of words is a short string and the automaton runs over words. It
holds every run of `run` words of each item, or the whole item where it is shorter. A text is scanned once;
places map back to code points of the text as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of an item that count as leaked when they stand in a row.
RUN = 13
#: Words of items in one automaton, which bounds its memory (and the different ones, each of which needs a character of its
#: own: there are a million). More items are divided over several automata, each of which scans the corpus.
WORDS_AT_ONCE = 200_000
#: A word, which a hyphen at a line end may divide.
WORD = re.compile(r"[^\W_]+(?:(?:[-‐­]\r?\n)+[^\W_]+)*")
_DIVIDED = re.compile(r"[-‐­]\r?\n")
#: Characters that stand for words begin here, behind the surrogates.
_FIRST = 0xE000


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case, joined over hyphens at line ends."""
    found = [w.lower() for w in WORD.findall(text)]
    return [_DIVIDED.sub("", w) if "\n" in w else w for w in found]


class Automaton:
    """Items of wording, as sent to the workers; the automaton itself is built there."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int):
        vocabulary: dict[str, str] = {}
        patterns: dict[str, set[int]] = {}
        for item, ws in items:
            for w in ws:
                vocabulary.setdefault(w, chr(_FIRST + len(vocabulary)))
            line = "".join(vocabulary[w] for w in ws)
            size = min(run, len(line))
            for i in range(len(line) - size + 1 if size else 0):
                patterns.setdefault(line[i : i + size], set()).add(item)
        self.vocabulary = vocabulary
        self.machine = ahocorasick.Automaton()
        for p, at in patterns.items():
            self.machine.add_word(p, (len(p), tuple(sorted(at))))
        self.machine.make_automaton()
        self.shortest = min(map(len, patterns), default=0)

    def scan(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, first word, word after the last) of every run of words that the text shares with an item."""
        if not self.shortest:
            return
        get = self.vocabulary.get
        # words() for a text without a line end after a hyphen, but lower-cased at once
        plain = text.isascii() and "-\n" not in text and "-\r" not in text
        line = "".join([get(w, " ") for w in (WORD.findall(text.lower()) if plain else words(text))])
        if len(line) - line.count(" ") < self.shortest:
            return
        for end, (size, items) in self.machine.iter(line):
            for item in items:
                yield item, end + 1 - size, end + 1


@lru_cache(maxsize=4)
def _built(items: tuple, run: int) -> Automaton:
    return Automaton([(i, list(ws)) for i, ws in items], run)


def leaks(corpus: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", run: int = RUN, words_at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """Documents and the items they share a run of words with: `key, item, start_char, end_char`.

    A row for each pair, with the first place in the text (code points, end exclusive). An item of fewer than
    `run` words must stand in full; one without words is in no document. Null texts and keys give no rows;
    documents that are repeated as they were count once. Items are held-out test material, which does not grow with the corpus;
    beyond `words_at_once` words they go to several automata, so that none grows without bound.
    """
    blocks: list[list[tuple[int, tuple[str, ...]]]] = [[]]
    held, size = 0, max(words_at_once, run)
    for row in items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).dropna().distinct().toLocalIterator():
        ws = tuple(words(row.t))
        # an item that is too long by itself is divided into pieces that share all but one word of a run
        for at in range(0, max(1, len(ws) - run + 1), max(1, size - run + 1)):
            piece = ws[at : at + size]
            if held + len(piece) > words_at_once and blocks[-1]:
                blocks.append([])
                held = 0
            blocks[-1].append((row.i, piece))
            held += len(piece)
    spark = corpus.sparkSession
    found = None
    rows = corpus.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).dropna()
    for block in blocks:
        sent = spark.sparkContext.broadcast(tuple(sorted(block)))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machine = _built(sent.value, run)
            for batch in batches:
                out: list[tuple[int, int, int, int]] = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    first: dict[int, tuple[int, int]] = {}
                    for item, lo, hi in machine.scan(t):
                        first.setdefault(item, (lo, hi))
                    if first:
                        spans = [m.span() for m in WORD.finditer(t)]
                        out += [(k, item, spans[lo][0], spans[hi - 1][1]) for item, (lo, hi) in first.items()]
                columns = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], ["k", "item", "start_char", "end_char"])

        part = rows.mapInArrow(scan, "k long, item long, start_char int, end_char int")
        found = part if found is None else found.unionByName(part)
    one = found.groupBy("k", "item").agg(F.min(F.struct("start_char", "end_char")).alias("s"))
    return one.select("k", "item", "s.start_char", "s.end_char")
