"""Full-text search: index tables, query compiler and BM25 in batches of questions.

A query is a set of phrases, most of them of one token. Questions go to the workers in blocks of bounded size, and
each worker scores all questions of a block over the documents it has, which never move: what leaves a task is the
k best documents of each question. Documents come as texts, or from an index of two stored tables (postings by
term, documents with their lengths), of which only the terms that are asked for are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from sys import intern

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweir.functions.text import QUERY_STOPWORDS, index_tokens, query_tokens
from paperweir.operators.vectors import gathered
from paperweir.session import cut

IMPORTANT_LENGTH, MAX_REQUIRED = 6, 4
K1, B = 1.2, 0.75
#: Inverse document frequency of terms in half of all documents or more.
IDF_FLOOR = 1e-6
#: Questions that are sent to the workers at once.
QUESTIONS = 100_000
#: Documents that a block of questions meets at once, and bytes of the table of weights of their frequent phrases.
DOCS, WEIGHTS = 65_536, 128 << 20
#: Rows that the rare phrases of a relaxed question have, on average over the questions of a block; see `Asked`.
RARE = 100
#: Documents of a shard of stored postings, and the number of folders that divide these by term.
SHARD, TERM_PARTS = 8_192, 64


def tokens(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Places of tokens: `key, term, pos`."""
    return docs.select(key, F.posexplode(index_tokens(text)).alias("pos", "term"))


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Inverted index: `term, key, tf, positions`."""
    return tokens(docs, key, text).groupBy("term", key).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def term_df(index: DataFrame) -> DataFrame:
    """Documents of each term: `term, df`."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def doc_lengths(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Tokens of each document, also of empty ones: `key, dl`."""
    return docs.select(key, F.coalesce(F.size(index_tokens(text)), F.lit(0)).alias("dl")).withColumn("dl", F.greatest("dl", F.lit(0)))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: `n` documents, `avgdl` tokens on average; empty documents count."""
    return docs.select(F.greatest(F.coalesce(F.size(index_tokens(text)), F.lit(0)), F.lit(0)).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def compile_queries(questions: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """`key, required, optional`: the terms that must all occur, and those of which one must.

    Stop words are left out. Of terms of six letters or more the four longest (earlier ones first) are
    required; every other term is in the group of which one must occur. Without a long term all are optional.
    Repeats stay, since they count in the score. A question without terms has two empty lists.
    """
    stop = F.array(*[F.lit(w) for w in QUERY_STOPWORDS])
    terms = F.filter(query_tokens(text), lambda t: ~F.array_contains(stop, F.lower(t)))
    long_ = F.filter(F.transform(F.col("terms"), lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t"))), lambda s: s["l"] <= -IMPORTANT_LENGTH)
    chosen = F.slice(F.array_sort(long_), 1, MAX_REQUIRED)
    in_order = F.transform(F.array_sort(F.transform(chosen, lambda s: F.struct(s["i"].alias("i"), s["t"].alias("t")))), lambda s: s["t"])
    df = questions.select(key, terms.alias("terms")).withColumn("required", in_order)
    return df.select(key, "required", F.filter("terms", lambda t: ~F.array_contains(F.col("required"), t)).alias("optional"))


def _phrases(compiled: DataFrame, key: str) -> DataFrame:
    """`key, role, phrase, mult`: how often a query names a phrase; a phrase is the array of its index tokens."""
    roles = F.array(F.struct(F.lit("required").alias("role"), F.col("required").alias("ts")), F.struct(F.lit("optional").alias("role"), F.col("optional").alias("ts")))
    each = compiled.select(key, F.explode(roles).alias("r")).select(key, "r.role", F.explode("r.ts").alias("t"))
    return each.select(key, "role", index_tokens("t").alias("phrase")).where(F.size("phrase") > 0).groupBy(key, "role", "phrase").agg(F.count("*").alias("mult"))


def index_tables(docs: DataFrame, doc: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) to store: `part, term, doc, dl, tf, positions` and `doc, dl` of every document.

    `part` is a hash of the term; stored by it and sorted by `term`, postings answer questions without reading texts, and
    only those of the terms asked for; see `store_index` and `refresh`.
    """
    rows = docs.select(doc, index_tokens(text).alias("ts")).withColumn("dl", F.greatest(F.coalesce(F.size("ts"), F.lit(0)), F.lit(0)))
    places = rows.select(doc, "dl", F.posexplode("ts").alias("pos", "term"))
    each = places.groupBy("term", doc, "dl").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return each.select(_term_part("term").alias("part"), "term", doc, "dl", "tf", "positions"), rows.select(doc, "dl")


def _term_part(term: str) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_PARTS)).cast("int")


def store_index(index: tuple[DataFrame, DataFrame], at: str) -> None:
    """Writes both tables of an index below `at`: postings in a folder for each part, sorted by term there.

    A frequent term of a part goes to many files: documents spread it over salts.
    """
    postings_, lengths = index
    doc = lengths.columns[0]
    spread = postings_.withColumn("_salt", F.pmod(F.xxhash64(doc), F.lit(8)))
    spread.repartition("part", "_salt").sortWithinPartitions("part", "term").drop("_salt").write.mode("overwrite").partitionBy("part").parquet(f"{at}/postings")
    lengths.write.mode("overwrite").parquet(f"{at}/lengths")


def read_index(spark, at: str) -> tuple[DataFrame, DataFrame]:
    """The index stored at `at`."""
    return spark.read.parquet(f"{at}/postings"), spark.read.parquet(f"{at}/lengths")


def refresh(index: tuple[DataFrame, DataFrame], changed: DataFrame, doc: str, gone: DataFrame | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The index after documents were inserted or updated (`changed`) and deleted (`gone`, with `doc`): only they are read."""
    ids = changed.select(doc) if gone is None else changed.select(doc).unionByName(gone.select(doc))
    new = index_tables(changed, doc, text)
    return tuple(old.select(*fresh.columns).join(ids.distinct(), doc, "left_anti").select(*fresh.columns).unionByName(fresh) for old, fresh in zip(index, new))


@dataclass
class Block:
    """Questions of a block: their keys, phrases as lists of term numbers, and rows (question, phrase, times, required)."""

    keys: list
    terms: list[str]
    phrases: list[tuple[int, ...]]
    question: np.ndarray
    phrase: np.ndarray
    times: np.ndarray
    required: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Block:
        """From rows (key, role, phrase, times), those of a question together."""
        keys: list = []
        terms: dict[str, int] = {}
        phrases: dict[tuple[int, ...], int] = {}
        q, p, m, r = [], [], [], []
        for key, role, phrase, times in rows:
            if not keys or keys[-1] != key:
                keys.append(key)
            ids = tuple(terms.setdefault(t, len(terms)) for t in phrase)
            q.append(len(keys) - 1)
            p.append(phrases.setdefault(ids, len(phrases)))
            m.append(times)
            r.append(role == "required")
        return cls(keys, list(terms), list(phrases), np.array(q), np.array(p), np.array(m, float), np.array(r, bool))


@dataclass
class Asked:
    """What the documents are asked: units of phrases, and rare phrases question by question.

    A unit is a question with strict hits, or what relaxed questions have in common: the phrases and times that are left
    without the rare ones. Any weight is above zero, so that a row without rare phrases of a question that is among its
    k best is among the k best of its unit too. The best of a question are thus among those of its unit and the rows
    with its rare phrases, and questions that differ in rare phrases only are scored once.
    """

    block: Block
    strict: np.ndarray  # by unit
    unit: np.ndarray  # of each question, -1 without phrases that are not rare
    question: np.ndarray  # of relaxed questions, each phrase once: question, phrase, times
    phrase: np.ndarray
    times: np.ndarray
    rare: np.ndarray  # by phrase

    @classmethod
    def of(cls, block: Block, df: dict[int, int], strict: np.ndarray) -> Asked:
        have = np.array([df.get(i, 0) for i in range(len(block.phrases))], np.int64)
        # a phrase that is required and optional counts for both; one without documents for nothing
        relaxed = ~strict[block.question] & (have[block.phrase] > 0)
        width = max(1, len(block.phrases))
        pairs, at = np.unique(block.question[relaxed] * width + block.phrase[relaxed], return_inverse=True)
        question, phrase = pairs // width, pairs % width
        times = np.bincount(at, block.times[relaxed], len(pairs))
        # the rarest phrases, as far as the questions that name them get RARE rows each on average
        order = np.argsort(have, kind="stable")
        cost = np.cumsum((have * np.bincount(phrase, minlength=len(have)))[order])
        rare = np.zeros(len(have), bool)
        rare[order[cost <= RARE * len(block.keys)]] = True
        unit = np.full(len(block.keys), -1)
        own = np.flatnonzero(strict)
        unit[own] = np.arange(len(own))
        mine = strict[block.question]
        q, p, m, r = [unit[block.question[mine]]], [block.phrase[mine]], [block.times[mine]], [block.required[mine]]
        common = ~rare[phrase]
        cq, cp, cm = question[common], phrase[common], times[common]
        edges = np.flatnonzero(np.r_[True, cq[1:] != cq[:-1]]) if len(cq) else np.empty(0, np.int64)
        units: dict[bytes, int] = {}
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(cq)]):
            new = len(own) + len(units)
            unit[cq[lo]] = u = units.setdefault(cp[lo:hi].tobytes() + cm[lo:hi].tobytes(), new)
            if u == new:
                q.append(np.full(hi - lo, u))
                p.append(cp[lo:hi])
                m.append(cm[lo:hi])
                r.append(np.zeros(hi - lo, bool))
        q, p, m, r = (np.concatenate(x) for x in (q, p, m, r))
        n = len(own) + len(units)
        return cls(replace(block, keys=range(n), question=q, phrase=p, times=m, required=r), np.arange(n) < len(own), unit, question, phrase, times, rare)


def _blocks(named: DataFrame, key: str, size: int) -> Iterator[Block]:
    """The questions, `size` of them at a time."""
    rows: list[tuple] = []
    n, last = 0, None
    for r in named.select(key, "role", "phrase", "mult").orderBy(key).toLocalIterator():
        if not rows or r[0] != last:
            if n == size:
                yield Block.of(rows)
                rows, n = [], 0
            n, last = n + 1, r[0]
        rows.append((last, intern(r[1]), tuple(map(intern, r[2])), r[3]))  # one copy of each word
    if rows:
        yield Block.of(rows)


def _found(tokens_: pa.ListArray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, row, times) of the block's phrases in lists of tokens, ordered by phrase and row."""
    offsets = np.asarray(tokens_.offsets)
    flat = tokens_.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    term = pc.fill_null(pc.index_in(flat, value_set=pa.array(block.terms, pa.string())), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(term >= 0)
    at = at[np.argsort(term[at], kind="stable")]
    alone = np.full(len(block.terms), -1)  # the phrase that is this term alone
    several = []
    for i, ids in enumerate(block.phrases):
        if len(ids) == 1:
            alone[ids[0]] = i
        else:
            several.append((i, ids))
    phrase = alone[term[at]]
    one = phrase >= 0
    pairs, times = np.unique(phrase[one].astype(np.int64) * max(1, len(offsets)) + row[at[one]], return_counts=True)
    ps, rs, fs = [pairs // max(1, len(offsets))], [pairs % max(1, len(offsets))], [times]
    bounds = np.searchsorted(term[at], np.arange(len(block.terms) + 1)) if several else None
    for i, ids in several:
        here = at[bounds[ids[0]] : bounds[ids[0] + 1]]
        for j, t in enumerate(ids[1:], 1):
            here = here[here + j < offsets[row[here] + 1]]
            here = here[term[here + j] == t]
        if len(here):
            rows, times = np.unique(row[here], return_counts=True)
            ps.append(np.full(len(rows), i))
            rs.append(rows)
            fs.append(times)
    phrase, rows, times = (np.concatenate(x) for x in (ps, rs, fs))
    order = np.argsort(phrase, kind="stable") if several else slice(None)
    return phrase[order], rows[order], times[order]


class _Shard:
    """Weights by phrase and row, ordered so, of n documents; the best score is the largest here."""

    def __init__(self, block: Block, phrase: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int) -> None:
        self.block, self.row, self.weight = block, row, weight
        self.bounds = np.searchsorted(phrase, np.arange(len(block.phrases) + 1))
        self.begins = np.searchsorted(block.question, np.arange(len(block.keys) + 1))
        self.size = np.diff(self.bounds)
        # frequent phrases have their weights in a table, which is read by row
        many = np.flatnonzero(self.size > n // 64)
        many = many[np.argsort(-self.size[many], kind="stable")][: WEIGHTS // (8 * max(1, n))]
        self.table = {}
        for i in many.tolist():
            self.table[i] = np.zeros(n)
            self.table[i][self.rows(i)] = self.weights(i)
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def rows(self, i: int) -> np.ndarray:
        return self.row[self.bounds[i] : self.bounds[i + 1]]

    def weights(self, i: int) -> np.ndarray:
        return self.weight[self.bounds[i] : self.bounds[i + 1]]

    def of(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Weights of a phrase in these rows, zero where it is not."""
        if i in self.table:
            return self.table[i][rows]
        have = self.rows(i)
        at = np.minimum(np.searchsorted(have, rows), len(have) - 1)
        return np.where(have[at] == rows, self.weights(i)[at], 0.0)

    def down(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and weights of a phrase, from the largest weight."""
        if i not in self.sorted:
            order = np.argsort(-self.weights(i), kind="stable")
            self.sorted[i] = self.rows(i)[order], self.weights(i)[order]
        return self.sorted[i]

    def strict(self, q: int) -> np.ndarray:
        """Rows with all required phrases of a question and one of the others."""
        mine = np.arange(self.begins[q], self.begins[q + 1])
        ids, need = self.block.phrase[mine], self.block.required[mine]
        must, rest = ids[need], [i for i in ids[~need].tolist() if self.size[i]]
        if not len(must):
            return np.unique(np.concatenate([self.rows(i) for i in rest])) if rest else np.empty(0, np.int64)
        if not self.size[must].all() or (len(must) < len(ids) and not rest):
            return np.empty(0, np.int64)
        must = must[np.argsort(self.size[must], kind="stable")].tolist()
        rows = self.rows(must[0])
        for i in must[1:]:
            rows = rows[self.of(i, rows) > 0]
        if rest and len(rows):
            any_ = np.zeros(len(rows), bool)
            for i in rest:
                any_ |= self.of(i, rows) > 0
            rows = rows[any_]
        return rows

    def strict_questions(self) -> np.ndarray:
        """Questions with strict hits among these documents."""
        possible = np.ones(len(self.block.keys), bool)
        need = self.block.required
        possible[self.block.question[need & (self.size[self.block.phrase] == 0)]] = False
        return np.array([q for q in np.flatnonzero(possible).tolist() if len(self.strict(q))], np.int64)

    def scores(self, entries: list[tuple[int, float]], rows: np.ndarray) -> np.ndarray:
        score = np.zeros(len(rows))
        for i, times in entries:
            score += times * self.of(i, rows)
        return score

    def best(self, q: int, strict: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of a question with their scores: of its strict hits, or of all.

        Phrases are taken in from the one that can give most. A row with none of those taken in so far can reach no more than
        the others give together, so that only rows with a weight that may bring them among the k best are looked at.
        """
        mine = range(self.begins[q], self.begins[q + 1])
        entries = [(i, t) for i, t in ((int(self.block.phrase[m]), float(self.block.times[m])) for m in mine) if self.size[i]]
        if strict and self.block.required[self.begins[q] : self.begins[q + 1]].any():
            rows = self.strict(q)
            return _first(rows, self.scores(entries, rows), k)
        gives = sorted(((t * self.down(i)[1][0], t, i) for i, t in _times(entries).items()), reverse=True)
        left = sum(g for g, _, _ in gives)
        rows, score, least = np.empty(0, np.int64), np.empty(0), -np.inf
        for j, (most, times, i) in enumerate(gives):
            if left < least:
                break
            left -= most
            new, weight = self.down(i)
            if least > left:
                new = new[: np.searchsorted(-weight, -(least - left) / times, side="right")]
            for _, _, before in gives[:j]:
                new = new[self.of(before, new) == 0]
            rows, score = _first(np.concatenate([rows, new]), np.concatenate([score, self.scores(entries, new)]), k)
            if len(rows) == k:
                least = score[-1] - 4e-9  # with all that round to the same, and what sums in another order differ by
        return rows, score


def _times(entries: list[tuple[int, float]]) -> dict[int, float]:
    """Times of each phrase; one that is required and optional counts for both."""
    out: dict[int, float] = {}
    for i, t in entries:
        out[i] = out.get(i, 0.0) + t
    return out


def _first(rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of the largest scores; equal to nine places, the smaller rows."""
    if len(rows) > 4 * k:
        some = score >= np.partition(score, len(score) - k)[len(score) - k] - 2e-9
        rows, score = rows[some], score[some]
    order = np.lexsort((rows, np.round(-score, 9)))[:k]
    return rows[order], score[order]


def _counts(block: Block, phrase: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each phrase, and questions with strict hits, among n documents."""
    shard = _Shard(block, phrase, row, np.ones(len(row)), n)
    return shard.size, shard.strict_questions()


def _answers(asked: Asked, docs: pa.Array, phrase: np.ndarray, row: np.ndarray, tf: np.ndarray, dl: np.ndarray, idf: np.ndarray, avgdl: float, k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The k best of `docs` for each unit, and of the rows with rare phrases for each question, which is -1 less its number.

    `row` counts in `docs`, which is in the order that breaks ties.
    """
    block = asked.block
    shard = _Shard(block, phrase, row, idf[phrase] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl)), len(docs))
    some = np.unique(block.question[shard.size[block.phrase] > 0])
    lacks = np.zeros(len(block.keys), bool)  # a required phrase, so that no row here is strict
    lacks[block.question[block.required & (shard.size[block.phrase] == 0)]] = True
    some = some[~(asked.strict & lacks)[some]].tolist()
    for at in range(0, len(some), 5_000):
        qs = some[at : at + 5_000]
        got = [shard.best(q, bool(asked.strict[q]), k) for q in qs]
        unit = np.repeat(qs, [len(r) for r, _ in got]).astype(np.int32)
        rows, score = (np.concatenate(x) for x in zip(*got))
        yield pa.RecordBatch.from_arrays([pa.array(unit), docs.take(pa.array(rows)), pa.array(-score), pa.array(asked.strict[unit])], names)
    for question, rows, score in _rare(asked, shard, phrase, len(docs), k):
        yield pa.RecordBatch.from_arrays([pa.array((-1 - question).astype(np.int32)), docs.take(pa.array(rows)), pa.array(-score), pa.array(np.zeros(len(rows), bool))], names)


def _rare(asked: Asked, shard: _Shard, phrase: np.ndarray, n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(question, row, score) of the k best rows among those with rare phrases of a question, whose scores are of all its phrases."""
    named = np.flatnonzero(asked.rare[asked.phrase] & (shard.size[asked.phrase] > 0))
    begins = np.searchsorted(asked.question, np.arange(len(asked.unit) + 1))
    postings_ = phrase * n + shard.row
    ends = np.cumsum(shard.size[asked.phrase[named]])
    lo = 0
    while lo < len(named):
        # up to a million rows at a time, a question not divided
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000, side="right")))
        hi = int(np.searchsorted(asked.question[named], asked.question[named[hi - 1]], side="right"))
        at = named[lo:hi]
        lo = hi
        p, size = asked.phrase[at], shard.size[asked.phrase[at]]
        take = np.repeat(shard.bounds[p] - np.cumsum(size) + size, size) + np.arange(size.sum())
        pairs = np.unique(np.repeat(asked.question[at], size) * n + shard.row[take])
        question, rows = pairs // n, pairs % n
        each = begins[question + 1] - begins[question]
        entry = np.repeat(begins[question] - np.cumsum(each) + each, each) + np.arange(each.sum())
        pair = np.repeat(np.arange(len(pairs)), each)
        want = asked.phrase[entry] * n + rows[pair]
        found = np.minimum(np.searchsorted(postings_, want), len(postings_) - 1)
        there = postings_[found] == want
        score = np.bincount(pair[there], asked.times[entry[there]] * shard.weight[found[there]], len(pairs))
        order = np.lexsort((rows, np.round(-score, 9), question))
        question, rows, score = question[order], rows[order], score[order]
        keep = np.arange(len(question)) - np.searchsorted(question, question) < k
        yield question[keep], rows[keep], score[keep]


def _merged(found: DataFrame, asked: Asked, keys: list, k: int, key: str, kind: str, doc: str) -> DataFrame:
    """`key, rank, doc, score, mode` from the rows of units and questions."""
    spark = found.sparkSession
    first = Window.partitionBy("q").orderBy(F.round("score", 9), doc)
    best = cut(found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("rank"), "best")
    of = pa.table({"unit": pa.array(asked.unit.astype(np.int32)), "q": pa.array(np.arange(len(keys), dtype=np.int32))})
    units = spark.createDataFrame(of.filter(pc.greater_equal(of["unit"], 0)), "unit int, q int")
    named = best.where("q >= 0").withColumnRenamed("q", "unit").join(F.broadcast(units), "unit").select("q", doc, "score", "strict")
    rows = named.unionByName(best.where("q < 0").withColumn("q", -1 - F.col("q"))).repartition("q")
    # a row of both has its whole score from the question
    whole = rows.groupBy("q", doc).agg(F.min("score").alias("score"), F.first("strict").alias("strict"))
    ranked = whole.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(keys), dtype=np.int32)), key: pa.array(keys)}), f"q int, `{key}` {kind}")
    return ranked.join(F.broadcast(names), "q").select(key, "rank", doc, "score", F.when(F.col("strict"), "strict").otherwise("relaxed").alias("mode"))


def _idf(block: Block, df: dict[int, int], n: int) -> np.ndarray:
    d = np.array([df.get(i, 0) for i in range(len(block.phrases))], float)
    idf = np.log((n - d + 0.5) / (d + 0.5))
    return np.where(idf <= 0, IDF_FLOOR, idf)


def _totals(counts: DataFrame, block: Block) -> tuple[dict[int, int], np.ndarray, int, int]:
    """Documents of each phrase, which questions have strict hits, documents and tokens, from rows `i, n`.

    `i` counts phrases, then questions, then documents and tokens: no more rows than the block has of these.
    """
    sums = {r.i: r.n for r in counts.groupBy("i").agg(F.sum("n").alias("n")).collect()}
    p, q = len(block.phrases), len(block.keys)
    return sums, np.array([p + i in sums for i in range(q)], bool), sums.get(p + q, 0), sums.get(p + q + 1, 0)


def _counted(block: Block, df: np.ndarray, strict: np.ndarray, n: int = 0, size: int = 0) -> pa.RecordBatch:
    p, q = len(block.phrases), len(block.keys)
    some = np.flatnonzero(df)
    at = np.concatenate([some, p + np.flatnonzero(strict), [p + q, p + q + 1]])
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([df[some], np.ones(strict.sum(), np.int64), [n, size]]).astype(np.int64))], ["i", "n"])


def _split(texts: pa.ChunkedArray) -> pa.ListArray:
    """Lists of tokens from texts of tokens with blanks between them; null is an empty list."""
    texts = texts.combine_chunks()
    parts = pc.split_pattern(texts, " ")
    return pa.ListArray.from_arrays(parts.offsets, parts.values)


def _from_texts(rows: DataFrame, block: Block, k: int, doc: str) -> tuple[DataFrame, Asked]:
    """`q, doc, score, strict` of units and questions from tokenised documents `doc, ts`, up to `DOCS` of which are a shard."""
    spark = rows.sparkSession
    plain = spark.sparkContext.broadcast(block)
    kind = rows.schema[doc].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, strict, n, size = np.zeros(len(plain.value.phrases), np.int64), np.zeros(len(plain.value.keys), bool), 0, 0
        for shard in gathered(batches, DOCS):
            ts = _split(shard.column(1))
            phrase, row, _ = _found(ts, plain.value)
            found, some = _counts(plain.value, phrase, row, len(ts))
            df += found
            strict[some] = True
            n, size = n + len(ts), size + len(ts.flatten())
        yield _counted(plain.value, df, strict, n, size)

    sums, strict, n, size = _totals(rows.mapInArrow(count, "i long, n long"), block)
    idf, avgdl = _idf(block, sums, n), size / n if size else 1.0
    asked = Asked.of(block, sums, strict)
    sent = spark.sparkContext.broadcast(asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in gathered(batches, DOCS):
            order = pc.sort_indices(shard.column(0))
            docs, ts = shard.column(0).take(order).combine_chunks(), _split(shard.column(1).take(order))
            phrase, row, tf = _found(ts, sent.value.block)
            yield from _answers(sent.value, docs, phrase, row, tf, np.diff(np.asarray(ts.offsets)), idf, avgdl, k, ["q", doc, "score", "strict"])

    return rows.mapInArrow(search, f"q int, `{doc}` {kind}, score double, strict boolean"), asked


def _from_index(index: tuple[DataFrame, DataFrame], block: Block, k: int, doc: str) -> tuple[DataFrame, Asked]:
    """The same from stored postings: those of the block's terms, brought together by shards of documents."""
    postings_, lengths = index
    spark = lengths.sparkSession
    kind = lengths.schema[doc].dataType.simpleString()
    n, total = lengths.agg(F.count("*"), F.sum("dl")).first()
    n, shards = n or 0, max(1, -(-(n or 0) // SHARD))
    terms = spark.createDataFrame(list(enumerate(block.terms)), "t int, term string").withColumn("part", _term_part("term"))
    read = postings_.join(F.broadcast(terms), ["part", "term"])  # at most the terms of one block of questions
    multi = any(len(ids) > 1 for ids in block.phrases)
    hits = cut(read.select(F.pmod(F.xxhash64(doc), F.lit(shards)).alias("shard"), "t", F.col(doc).alias("doc"), "dl", "tf", *(["positions"] if multi else [])), "postings")
    plain = spark.sparkContext.broadcast(block)

    def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for t in _runs(batches):
            ids = t.column(2).combine_chunks().dictionary_encode()
            values, at = ids.dictionary, ids.indices.to_numpy()
            order = pc.sort_indices(values).to_numpy()
            docs, rank = values.take(pa.array(order)), np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            row, term, dl = rank[at], t.column(1).to_numpy(), np.zeros(len(order))
            dl[row] = t.column(3).to_numpy()
            yield docs, dl, *_matched(plain.value, term, row, t.column(4).to_numpy(), t.column(5).combine_chunks() if multi else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, strict = np.zeros(len(plain.value.phrases), np.int64), np.zeros(len(plain.value.keys), bool)
        for docs, _, phrase, row, _ in shard_rows(batches):
            found, some = _counts(plain.value, phrase, row, len(docs))
            df += found
            strict[some] = True
        yield _counted(plain.value, df, strict)

    sorted_ = hits.repartition("shard").sortWithinPartitions("shard")
    df, strict, _, _ = _totals(sorted_.mapInArrow(count, "i long, n long"), block)
    idf, avgdl = _idf(block, df, n), (total or 0) / n if total else 1.0
    asked = Asked.of(block, df, strict)
    sent = spark.sparkContext.broadcast(asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, dl, phrase, row, tf in shard_rows(batches):
            yield from _answers(sent.value, docs, phrase, row, tf, dl, idf, avgdl, k, ["q", doc, "score", "strict"])

    return sorted_.mapInArrow(search, f"q int, `{doc}` {kind}, score double, strict boolean"), asked


def _matched(block: Block, term: np.ndarray, row: np.ndarray, tf: np.ndarray, positions: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, row, times) from postings of terms, ordered by phrase and row."""
    order = np.lexsort((row, term))
    term, row, tf = term[order], row[order], tf[order]
    bounds = np.searchsorted(term, np.arange(len(block.terms) + 1))
    if positions is not None:
        flat, offsets = positions.values.to_numpy(zero_copy_only=False), np.asarray(positions.offsets)
    ps, rs, fs = [], [], []

    def places(t: int) -> np.ndarray:
        """Row and place of a term as one number."""
        at = order[bounds[t] : bounds[t + 1]]
        size = offsets[at + 1] - offsets[at]
        take = np.repeat(offsets[at] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        return (np.repeat(row[bounds[t] : bounds[t + 1]], size).astype(np.int64) << 32) + flat[take]

    for i, ids in enumerate(block.phrases):
        if len(ids) == 1:
            rows, times = row[bounds[ids[0]] : bounds[ids[0] + 1]], tf[bounds[ids[0]] : bounds[ids[0] + 1]]
        else:
            here = places(ids[0])
            for j, t in enumerate(ids[1:], 1):
                here = here[np.isin(here + j, places(t))]
            rows, times = np.unique(here >> 32, return_counts=True)
        if len(rows):
            ps.append(np.full(len(rows), i))
            rs.append(rows)
            fs.append(times)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (ps, rs, fs))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one value of the first column each, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        for lo, hi in zip(edges, edges[1:]):
            if held and held[0].column(0)[0].as_py() != v[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def bm25_topk(questions: DataFrame, docs: DataFrame | None, k: int, key: str = "query_id", query: str = "query", doc: str = "chunk_id", text: str = "text", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The k best documents of every question by BM25: `key, rank, doc, score, mode`; lower scores are better.

    `mode` is strict where the compiled query has hits, else relaxed (any term). Scores equal to nine places
    go to the smaller `doc`. Null questions have no results, nor have those without terms. With an `index` (see
    `index_tables`) no texts are read.

    Questions are taken `QUESTIONS` at a time, and every block of them is scored where the documents are; the
    result is exact. Questions that differ in rare phrases only are scored together (see `Asked`). Work grows with the postings
    of the terms asked for, and nothing but 2k rows of a question and task, and a count for each phrase, leaves the
    tasks; with an index, its postings of these terms are moved once.
    """
    if k <= 0:
        raise ValueError("top_k must be > 0")
    compiled = compile_queries(questions.where(F.col(query).isNotNull()), key, query)
    named = _phrases(compiled, key)
    rows = None if index is not None else cut(docs.select(doc, F.nullif(F.array_join(index_tokens(text), " "), F.lit("")).alias("ts")), "tokens")
    spark = questions.sparkSession
    kind = questions.schema[key].dataType.simpleString()
    found = None
    for block in _blocks(named, key, QUESTIONS):
        part, asked = _from_texts(rows, block, k, doc) if index is None else _from_index(index, block, k, doc)
        part = _merged(part, asked, block.keys, k, key, kind, doc)
        found = part if found is None else found.unionByName(part)
    if found is None:
        source = docs if index is None else index[1]
        return spark.createDataFrame([], f"`{key}` {kind}, rank int, `{doc}` {source.schema[doc].dataType.simpleString()}, score double, mode string")
    return found
