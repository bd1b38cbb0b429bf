"""Eval sets made from chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweir.functions.json_text import generated_questions
from paperweir.functions.text import is_grounded, names_excerpt, question_key
from paperweir.operators import providers
from paperweir.operators.evaluation import candidates, seeded_sample
from paperweir.operators.store import latest
from paperweir.session import cut
from paperweir.sources.files import read_prompt

#: Times that a chunk may be asked for questions.
ATTEMPTS = 3
# Openings of questions, in groups that take turns.
OPENINGS = [
    ["Why", "How", "What", "When"],
    ["Compared to", "In comparison to", "How does", "What distinguishes", "In what way"],
    ["Under what conditions", "In which case", "In what situation", "When would"],
    ["What limitation", "What trade-off", "What constraint", "What drawback"],
    ["What is the implication", "What does this suggest", "What does this imply", "What follows from"],
    ["What explains", "What factors", "What mechanism", "What role does", "To what extent"],
]


#: Rounds of openings, each of which holds every opening once.
ROUNDS = 2


def openings_plan(n: int, seed: int = 0) -> list[str]:
    """`n` openings in turn from the groups; within a group the digest of round and seed orders them."""
    if n <= 0:
        raise ValueError("the number of questions must be > 0")
    most = ROUNDS * sum(map(len, OPENINGS))
    if n > most:
        raise ValueError(f"there are openings for {most} questions; give a file of openings, or ask for fewer")
    out = []
    for r in range(ROUNDS):
        piles = [sorted(g, key=lambda o: hashlib.md5(f"{seed}:{r}:{o}".encode()).hexdigest()) for g in OPENINGS]
        for i in range(max(map(len, piles))):
            out += [p[i] for p in piles if i < len(p)]
    return out[:n]


def _prompt(template: str, per_chunk: int, openings: Column | None) -> Column:
    """The template with its `$` names filled from the columns `title`, `text` and the openings, in one pass."""
    values = {"N": F.lit(str(per_chunk)), "TITLE": F.coalesce("title", F.lit("")), "CHUNK": F.col("text"), "OPENINGS": F.lit("") if openings is None else openings}
    out = []
    for piece in re.split(r"(\$(?:N|TITLE|CHUNK|OPENINGS)\b)", template):
        name = piece[1:]
        out.append(values[name] if piece.startswith("$") and name in values else F.lit(piece))
    return F.concat(*out)


def generate_eval_set(
    chunks: DataFrame, papers: DataFrame, factory: Callable, n: int = 50, per_chunk: int = 1, min_chars: int = 200, seed: int = 0, concurrency: int = 4, openings: list[str] | None = None, prompt_path: str | None = None
) -> DataFrame:
    """`n` eval items of seeded chunks: `query_id, query, difficulty, ground_truth, reference_answer`.

    Chunks that are long enough and no bibliographies are drawn in the order of the seed, 2 n at a time, until there are
    enough questions or no more chunks. Questions that refer to an excerpt, repeat an earlier one or have an answer that
    the chunk doesn't carry are dropped; a chunk without a good one is asked up to three times. With `openings` each
    chunk is given the next ones in turn, and a question must begin with one of those. A template of the caller's must
    name `$OPENINGS` then, and must not without. Fewer than `n` questions are an error when the result is read.
    """
    template = read_prompt("eval_questions" if openings is None else "eval_openings", prompt_path)
    if ("$OPENINGS" in template) != (openings is not None):
        raise ValueError("a prompt has $OPENINGS if, and only if, openings are given")
    pool = candidates(chunks, min_chars)
    done, found, before = 0, None, None
    while True:
        drawn = seeded_sample(pool, "chunk_uid", 2 * n * (done + 1), seed)
        drawn = drawn if before is None else drawn.join(before, "chunk_uid", "left_anti")
        place = F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("chunk_uid"))), "chunk_uid"))  # 2 * n rows
        rows = drawn.withColumn("draw", place + 2 * n * done).join(papers.select("paper_id", "title"), "paper_id", "left").select("draw", "chunk_uid", "paper_id", "page_number", "text", "title")
        rows = cut(rows, "drawn")
        if rows.limit(1).count() == 0:
            break
        some = cut(_questions(rows, template, factory, per_chunk, concurrency, openings), "questions")
        found = some if found is None else found.unionByName(some)
        asked = rows.select("chunk_uid")
        before = asked if before is None else before.unionByName(asked)
        done += 1
        if latest(found, ["k"], ["draw", "i"]).count() >= n:
            break
    found = found if found is not None else _questions(rows, template, factory, per_chunk, concurrency, openings)
    once = latest(found, ["k"], ["draw", "i"])
    number = F.row_number().over(Window.orderBy("draw", "i"))  # some more than n rows
    picked = once.withColumn("no", number).where(F.col("no") <= n)
    have = F.count("*").over(Window.partitionBy())
    enough = F.when(have < n, F.raise_error(F.concat(F.lit(f"asked for {n} questions, got "), have))).otherwise(F.format_string("q%03d", "no"))
    truth = F.struct(F.array("chunk_uid").alias("chunk_uids"), F.array("paper_id").alias("papers"), F.array(F.array("page_number")).alias("pages"), F.array().cast("array<string>").alias("expected_topics"))
    return picked.select(enough.alias("query_id"), F.col("q.question").alias("query"), F.col("q.difficulty").alias("difficulty"), truth.alias("ground_truth"), F.col("q.expected_answer").alias("reference_answer"))


def _questions(rows: DataFrame, template: str, factory: Callable, per_chunk: int, concurrency: int, openings: list[str] | None) -> DataFrame:
    """Good questions of drawn chunks: their columns, `i`, `q` and the key `k` of the question."""
    given = None
    if openings is not None:
        every = F.array(*[F.lit(o) for o in openings])
        turn = lambda j: F.get(every, F.pmod((F.col("draw") - 1) * per_chunk + j, F.lit(len(openings))).cast("int"))
        rows = rows.withColumn("openings", F.transform(F.sequence(F.lit(0), F.lit(per_chunk - 1)), turn))
        given = F.array_join(F.transform("openings", lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o)), "\n")
    prompt = _prompt(template, per_chunk, given)
    good, left = None, rows
    for _ in range(ATTEMPTS):
        said = cut(providers.generate(left.select(F.col("chunk_uid").alias("query_id"), prompt.alias("prompt"), F.lit("").alias("query")), factory, concurrency=concurrency), "questions")
        each = said.select(F.col("query_id").alias("chunk_uid"), F.posexplode(F.slice(generated_questions(F.coalesce("answer", F.lit(""))), 1, per_chunk)).alias("i", "q")).join(rows, "chunk_uid")
        fine = each.where(~names_excerpt("q.question") & F.coalesce(is_grounded("q.expected_answer", "text"), F.lit(False)))
        if openings is not None:
            fine = fine.where(F.exists("openings", lambda o: F.lower("q.question").startswith(F.lower(o))))
        good = fine if good is None else good.unionByName(fine)
        left = left.join(fine.select("chunk_uid"), "chunk_uid", "left_anti")
    return good.withColumn("k", question_key("q.question"))
