"""Encoding of texts with a public byte-level BPE vocabulary, in numpy.

Distinct pieces of a batch are encoded together. Pieces of about one length form a padded matrix; in every
round each row merges its leftmost pair of least rank, found by a hashed lookup of pairs, and the matrix is
compacted by one column. Pieces longer than `WIDE` bytes (runs of letters in scripts without spaces) are
merged in one flat array instead, all places of the least rank in a round, which gives the same ids: a pair
that holds a new token always has a higher rank than the pair that made it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a piece is encoded in the matrix of its length bucket.
WIDE = 192
#: Pieces whose ids one worker keeps; the cache starts afresh beyond that.
KEPT_PIECES = 400_000
#: Characters of text handled at a time.
CHARS_AT_ONCE = 4_000_000
NONE = np.int32(2**31 - 1)
#: How the public 50k vocabularies split text before merging (fixed value).
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PairTable:
    """Open-addressing hash table from a pair of ids to its rank, probed for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        size = 1 << max(4, int(len(rank) * 4 - 1).bit_length())
        self.mask, self.shift = np.int64(size - 1), np.int64(17)
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys = (left.astype(np.int64) << self.shift) | right.astype(np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            s = slot[todo]
            free = self.keys[s] == -1
            first = np.unique(s[free], return_index=True)[1]
            placed = todo[free][first]
            self.keys[slot[placed]], self.ranks[slot[placed]] = keys[placed], rank[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys * np.int64(-7046029254386353131)
        return ((mixed ^ (mixed >> np.int64(29))) >> np.int64(13)) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where no merge exists."""
        keys = (left.astype(np.int64) << self.shift) | right.astype(np.int64)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Encoder:
    """The vocabulary of a .tiktoken file; an id is the rank of its bytes."""

    def __init__(self, path: str, pattern: str = PIECE_PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = self._pairs(ranks)
        self.pairs = PairTable(left, right, rank)
        self.findall = regex.compile(pattern).findall
        self.codes: dict[str, int] = {}
        self._clear()

    @staticmethod
    def _pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pair of ids that makes each token: every split of it into two known tokens of lower rank.

        All such splits are kept, as an encoder that works on the ranks of bytes also would merge them.
        """
        out = []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    out.append((a, b, rank))
        return tuple(np.array(x, np.int32) for x in zip(*out))

    def _clear(self) -> None:
        self.codes.clear()
        self.flat, self.starts, self.used = np.empty(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0

    def _merge_rows(self, tok: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a padded matrix of byte ids."""
        n, width = tok.shape
        out: list[np.ndarray | None] = [None] * n
        rows = np.arange(n)
        rank = self.pairs(tok[:, :-1].ravel(), tok[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.empty((n, 0), np.int32)
        rank[np.arange(1, width)[None, :] >= lengths[:, None]] = NONE
        lengths = lengths.copy()
        while len(rows):
            width = tok.shape[1]
            if width > 1:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(rows)), at]
                live = best != NONE
            else:
                live = np.zeros(len(rows), bool)
            for i in np.flatnonzero(~live):
                out[rows[i]] = tok[i, : lengths[i]]
            if not live.any():
                break
            if not live.all():
                rows, tok, rank, lengths, at, best = rows[live], tok[live], rank[live], lengths[live], at[live], best[live]
            k = np.arange(len(rows))
            tok[k, at] = best
            keep = np.ones(tok.shape, bool)
            keep[k, at + 1] = False
            tok = tok[keep].reshape(len(rows), width - 1)
            rank = rank[keep[:, 1:]].reshape(len(rows), width - 2)
            lengths = lengths - 1
            if width > 2:
                before, after = at > 0, at < lengths - 1
                for where, j in ((before, at - 1), (after, at)):
                    r, c = k[where], j[where]
                    rank[r, c] = self.pairs(tok[r, c], tok[r, c + 1])
                end = ~after & (at < width - 2)
                rank[k[end], at[end]] = NONE
                width_now = int(lengths.max())
                if width_now < width - 1:
                    tok, rank = np.ascontiguousarray(tok[:, :width_now]), np.ascontiguousarray(rank[:, : width_now - 1])
        return out

    def _merge_long(self, tok: np.ndarray) -> np.ndarray:
        """Ids of one long piece, all places of the least rank in a round, left to right."""
        rank = self.pairs(tok[:-1], tok[1:])
        while len(rank):
            best = rank.min()
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            if len(at) > 1 and (np.diff(at) == 1).any():  # a run of overlapping places: every other one, from its left end
                new = np.r_[True, np.diff(at) > 1]
                first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            tok = tok.copy()
            tok[at] = best
            keep = np.ones(len(tok), bool)
            keep[at + 1] = False
            tok, rank = tok[keep], rank[keep[1:]]
            now = at - np.arange(len(at))
            for j in (now[now > 0] - 1, now[now < len(tok) - 1]):
                rank[j] = self.pairs(tok[j], tok[j + 1])
            if len(now) and now[-1] == len(tok) - 1 and len(rank) >= len(tok):
                rank = rank[: len(tok) - 1]
        return tok

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new pieces and gives them codes."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        encoded: list[np.ndarray | None] = [None] * len(raw)
        order = np.argsort(sizes, kind="stable")
        lo = 0
        while lo < len(order):
            size = int(sizes[order[lo]])
            if size > WIDE:
                for i in order[lo:]:
                    encoded[i] = self._merge_long(self.byte_ids[np.frombuffer(raw[i], np.uint8)])
                break
            top = size if size <= 16 else min(WIDE, size + size // 8)  # a bucket: lengths within an eighth
            hi = min(int(np.searchsorted(sizes[order], top, side="right")), lo + max(1, 2_000_000 // top))
            part = order[lo:hi]
            lengths = sizes[part]
            width = int(lengths.max())
            block = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
            for i, ids in zip(part, self._merge_rows(self.byte_ids[block], lengths)):
                encoded[i] = ids
            lo = hi
        lens = np.fromiter(map(len, encoded), np.int64, len(encoded))
        first, count = len(self.codes), len(encoded)
        while first + count + 1 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * len(self.starts))
        total = int(lens.sum())
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.starts[first] = self.used
        self.starts[first + 1 : first + count + 1] = self.used + np.cumsum(lens)
        self.flat[self.used : self.used + total] = np.concatenate(encoded) if total else []
        self.used += total
        self.codes.update(zip(pieces, range(first, first + count)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of each text (one more than texts)."""
        if len(self.codes) > KEPT_PIECES:
            self._clear()
        found = [self.findall(t) if t else [] for t in texts]
        new = set()
        for pieces in found:
            new.update(pieces)
        new = [p for p in new if p not in self.codes]
        if new:
            self._learn(new)
        get = self.codes.__getitem__
        counts = np.fromiter(map(len, found), np.int64, len(found))
        code = np.fromiter((c for pieces in found for c in map(get, pieces)), np.int64, int(counts.sum()))
        lens = self.starts[code + 1] - self.starts[code]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(self.starts[code] - (ends - lens), lens)
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return self.flat[take], bounds


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PIECE_PATTERN) -> Encoder:
    """The encoder of a vocabulary file, built once in a worker."""
    return Encoder(path, pattern)


def default_vocabulary() -> str:
    """The file of byte_bpe_50k, of the installed package of public tokenizers or of /opt/tokenizers."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Token ids of every row's text: columns `key` and `ids`, a row for each row of `df`.

    Special tokens are never added or recognised; their strings are ordinary text. A null or empty text gives
    an empty list. The whole text is encoded, however long. Null keys and repeated rows stay; other columns
    are not read. Narrow: no shuffle, a task holds one batch.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            sizes = np.cumsum([len(t) if t else 0 for t in texts])
            lo = 0
            while lo < len(texts):
                before = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, before + CHARS_AT_ONCE, side="right")))
                ids, bounds = enc.encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), lists], [key, "ids"])
                lo = hi

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
