import pytest
from pyspark.sql import functions as F

from paperweir.functions import ids, json_text
from paperweir.operators import citations as C
from paperweir.operators import prompting

A = '[arXiv:2311.12022v2 p.3] *"the delta\n  moves"* and [arXiv:cs.DS/0101001 p.1]'


@pytest.fixture(scope="module")
def answers(spark):
    rows = [
        ("good", 'The delta moves. [arXiv:2311.12022v2 p.3] *"the delta moves"*'),
        ("two", A),
        ("page", "x [arXiv:2311.12022 page 3]"),
        ("zero", 'x [arXiv:2311.12022 p.0] *"q"*'),
        ("double", "x [[arXiv:2311.12022 p.1]]"),
        ("version", 'x [arXiv:2311.12022V2 p.1] *"q"*'),
        ("unknown", 'x [arXiv:2999.99999 p.1] *"q"*'),
        ("lost", 'x [arXiv:2311.12022 p.3] *"not there"*'),
        ("bare", 'x [arXiv:2311.12022 p.3] *"delta"*\n \nNo citation here.'),
        ("blank", "  "),
        ("none", "No citation."),
        ("null", None),
    ]
    return spark.createDataFrame(rows, "answer_id string, answer string")


def test_parse(spark, answers):
    got = [(r.citation_id, r.paper_id, r.page_number, r.quote) for r in C.parsed(answers.where("answer_id = 'two'")).orderBy("n").collect()]
    assert got == [("c1", "2311.12022", 3, "the delta moves"), ("c2", "cs.DS/0101001", 1, None)]
    bad = {r.answer_id: (r.m, r.e) for r in answers.select("answer_id", C.malformed("answer").alias("m"), C.parse_error("answer").alias("e")).collect()}
    assert bad["page"][0] == ["[arXiv:2311.12022 page 3]"] and bad["double"][0] == ["[[arXiv:", "arXiv:...]]"]
    assert [k for k, v in bad.items() if v[1]] == ["page", "zero", "double", "version"]


def test_repair(answers):
    got = {r.answer_id: r.r for r in answers.select("answer_id", C.needs_repair("answer").alias("r")).collect()}
    assert not got["good"] and not got["blank"] and got["two"] and got["none"] and got["page"]


def test_verify(spark, answers):
    papers = spark.createDataFrame([("2311.12022",), ("CS.ds/0101001",)], "paper_id string")
    pages = spark.createDataFrame([("2311.12022", 3, "here the delta  moves on"), ("cs.DS/0101001", 1, "x")], "paper_id string, page_number int, text string")
    got = {r.answer_id: (r.status, r.codes) for r in C.verify(answers, papers, pages).collect()}
    assert got["good"] == got["blank"] == ("pass", [])
    assert got["two"] == ("fail", ["missing_quote"])
    assert got["unknown"] == ("fail", ["unresolved_citation"])
    assert got["page"] == got["version"] == ("fail", ["malformed_citation"])
    assert got["lost"] == ("fail", ["quote_not_found"])
    assert got["bare"] == got["none"] == ("fail", ["missing_paragraph_citation"])
    at = C.locate(C.parsed(answers.where("answer_id = 'good'")), pages).first()
    assert (at.quote_start, at.quote_end) == (5, 20)


def test_verify_gaps(spark, answers):
    papers = spark.createDataFrame([("2311.12022", 4), ("cs.DS/0101001", None)], "paper_id string, total_pages int")
    pages = spark.createDataFrame([("2311.12022", 1, "x")], "paper_id string, page_number int, text string")
    known = spark.createDataFrame([("2311.12022", 3), ("cs.DS/0101001", 1)], "paper_id string, page_number int")
    one = answers.where("answer_id in ('good', 'two')")
    got = {r.answer_id: r.codes for r in C.verify(one, papers, pages, known_pages=known).collect()}
    assert got == {"good": ["missing_page_text"], "two": ["missing_page_text", "missing_parsed_file", "missing_quote"]}
    bad = papers.select("paper_id").limit(1)
    got = {r.answer_id: r.codes for r in C.verify(one, papers, pages, known_pages=known, broken_files=bad).collect()}
    assert got["good"] == ["invalid_parsed_json"]
    rows = [("a", "c1", "bad id", 1), ("a", "c2", "2311.12022", 5), ("a", "c3", "CS.DS/0101001", 0), ("a", "c4", "2999.99999", 1), ("a", "c5", "2311.12022", 4)]
    got = {(r.citation_id, r.code) for r in C.validate(spark.createDataFrame(rows, "answer_id string, citation_id string, paper_id string, page_number int"), papers).collect()}
    assert got == {("c1", "invalid_paper_id"), ("c2", "page_out_of_range"), ("c3", "missing_page_count"), ("c3", "page_out_of_range"), ("c4", "unknown_paper_id"), ("c4", "missing_page_count")}


def test_sentences(spark):
    df = spark.createDataFrame([("a", 'One [arXiv:2311.12022 p.1]. Two said "x." Then [arXiv:2311.12022 p.2] 3.5 is not an end. [arXiv:2311.12022 p.3] end')], "answer_id string, answer string")
    got = [(r.text, r.citations) for r in C.sentence_map(df).orderBy("sentence_index").collect()]
    assert [c for _, c in got] == [["c1"], [], ["c2"], ["c3"]]
    assert got[1][0] == 'Two said "x."'


def test_remap_and_rewrite(spark):
    ctx = spark.createDataFrame([("a", 1, "u1", "1111.11111", 1, "nothing at all"), ("a", 2, "u2", "2222.22222", 2, "the river delta moves sediment downstream")], "answer_id string, rank int, chunk_uid string, paper_id string, page_number int, text string")
    df = spark.createDataFrame([("a", 'S one. [arXiv:1111.11111 p.1] *"River delta moves"* River delta sediment goes [arXiv:1111.11111 p.1]. Off [arXiv:1111.11111 p.1] *"unrelated words entirely"*')], "answer_id string, answer string")
    got = {r.citation_id: (r.best_uid, r.score) for r in C.remap(df, ctx).collect()}
    assert got["c1"] == ("u2", 1.0) and got["c2"][0] == "u2" and got["c3"] == (None, None)
    out = df.select(C.rewrite(F.col("answer"), F.array(F.lit("[X]"), F.lit(None), F.lit("[Y]")))).first()[0]
    assert out.count("[X]") == out.count("[Y]") == 1 and out.count("[arXiv:1111.11111 p.1]") == 1


def test_chunk_citations(spark):
    df = spark.createDataFrame([("a [chunk:2] b [Chunk:0] c [chunk:9]", ["[p1]", "[p2]"]), ("none", []), (None, ["x"])], "a string, l array<string>")
    assert [r[0] for r in df.select(C.map_chunk_citations("a", "l")).collect()] == ["a [p2] b [Chunk:0] c [chunk:9]", "none", None]


def test_ids(spark):
    raw = ["2311.12022v2", "cs.DS/0101001v3", "CS.ds/0101001V3", "randomv2", "2311.12022V2", " 2311.12022 ", None]
    df = spark.createDataFrame([(x,) for x in raw], "x string")
    assert [r[0] for r in df.select(ids.base_id("x")).collect()] == ["2311.12022", "cs.DS/0101001", "CS.ds/0101001", "randomv2", "2311.12022V2", " 2311.12022 ", None]
    assert [r[0] for r in df.select(ids.paper_key("x")).collect()] == ["2311.12022", "cs.ds/0101001", "cs.ds/0101001", "randomv2", "2311.12022", "2311.12022", None]


def test_json(spark):
    said = ['{"selected": [2, "3", 2, 99, "x"]}', 'Sure: {"selected": ["1"]} ok', "take 4 and 5", "", '{"selected": []} but 2', "12345678901234"]
    df = spark.createDataFrame([(x,) for x in said], "x string")
    assert [r[0] for r in df.select(json_text.selection_indices("x", 10)).collect()] == [[2, 3], [1], [4, 5], [], [2], []]
    assert df.select(json_text.evidence(json_text.selection_indices("x", 10), 2)).first()[0] == [1, 2]
    q = spark.createDataFrame([('{"chunk_index": "2", "quote": " a  b "}',), ('x {"chunk_index": 9, "quote": "a"}',), ('{"chunk_index": 1, "quote": " "}',), ("no",)], "x string")
    assert [r[0] and tuple(r[0]) for r in q.select(json_text.quote_selection("x", 3)).collect()] == [(2, "a b"), None, None, None]
    g = spark.createDataFrame([('[{"question": "Q?", "expected_answer": "A", "difficulty": "Factual"}, {"question": "", "expected_answer": "A", "difficulty": "factual"}]',), ('```json\n{"items": [{"question": "Q", "expected_answer": "A", "difficulty": "synthesis"}]}\n```',), ("none",)], "x string")
    assert [len(r[0] or []) for r in g.select(json_text.generated_questions("x")).collect()] == [1, 1, 0]


def test_prompts(spark):
    df = spark.createDataFrame([("q", 2, "u2", "p", 3, "two", None), ("q", 1, "u1", "p", 2, "one {query}", "T")], "query_id string, rank int, chunk_uid string, paper_id string, page_number int, text string, title string")
    said = prompting.format_chunks(df).first().chunks
    assert said == "Chunk 1: [arXiv:p p.2] (chunk_uid=u1) T\none {query}\n\nChunk 2: [arXiv:p p.3] (chunk_uid=u2)\ntwo"
    out = prompting.format_chunks(df).select(prompting.render("Q {query}: {chunks}!", chunks="chunks", query=F.lit("{chunks}"))).first()[0]
    assert out == "Q {chunks}: " + said + "!"
    with pytest.raises(ValueError):
        prompting.render("no place", chunks="chunks")
    with pytest.raises(Exception, match="broken chunk"):
        prompting.valid_context(df.withColumn("page_number", F.lit(0))).collect()
