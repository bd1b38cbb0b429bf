import pytest

from paperweir.llm.pairs import defects, is_truncated, language, pair_defects

EN = "How does Kolra handle the sediment?"
CASES = [
    (EN, None, "empty"), (EN, "", "empty"), (EN, " ​ ", "empty"), (EN, '""', "empty"), (EN, "N/A", "empty"), (EN, "(no answer)", "empty"),
    (EN, "I'm sorry, but I can’t help with that request.", "refusal"), (EN, "Thanks for asking, but no answer can be given by me here!", "refusal"),
    ("Was sagt die Arbeit?", "Diese Frage darf ich leider nicht beantworten.", "refusal"), ("Que dit l’étude ?", "Je ne suis pas en mesure de vous aider.", "refusal"),
    ("¿Qué dice?", "No me es posible ayudar con eso.", "refusal"), ("Что сказано?", "Я вынужден отказаться от ответа.", "refusal"), ("论文说了什么？", "很遗憾，我帮不了您。", "refusal"),
    (EN, EN.upper(), "copied_question"), (EN, "> How does\nKolra handle the sediment ??", "copied_question"), (EN, "Question: " + EN, "copied_question"), (EN, "Kolra handle the sediment", "copied_question"), ("Kolra如何处理误差上界？", "Kolra如何处理误差上界？", "copied_question"),
    (EN, "As an AI language model, I don't have access to that information.", "refusal"), (EN, "Sorry, that is outside my scope.", "refusal"), (EN, "It isn't possible for me to say.", "refusal"),
    (EN, "Mi dispiace, non posso rispondere a questa domanda.", "refusal"), (EN, "Desculpe, não posso responder a essa pergunta.", "refusal"), (EN, "申し訳ありませんが、お答えできません。", "refusal"),
    (EN, f"{EN} {EN}", "copied_question"), (EN, "(Kolra bounds it [arXiv:1804.81591 p.3]", "truncated"),
    (EN, "Das Gitter begrenzt die Reihenfolge nach der Bereinigung.", "other_language"), (EN, "编码器平滑了主要模型。", "other_language"), ("论文说了什么？", "The encoder of the margin clearly constrains the appendix.", "other_language"),
    (EN, "Kolra encodes the forecast such as", "truncated"), (EN, "Kolra encodes the forecast while the…", "truncated"), (EN, "Kolra encodes [...]", "truncated"), (EN, "Kolra bounds one mir-", "truncated"), (EN, "Kolra encodes the forecast although (the", "truncated"), ("Kolra如何处理？", "网格划分在盆地边缘推迟了误差", "truncated"),
]
GOOD = [
    (EN, "Yes"), (EN, "About 64.9 %"), (EN, "No, only the sediment"), (EN, "cs.IR"), (EN, "Table 7"), (EN, "optical jet"), (EN, "Kolra bounds it within 60 volumes [arXiv:1804.81591 p.3]"), (EN, "Kolra bounds it. See also Tovhab et al."),
    (EN, "Unfortunately, larger grids are beyond the scope of the paper."), ("O que diz?", "Os autores dizem que não podemos excluir o sedimento."), (EN, "It is possible for me to see that the method works well."), (EN, "The sediment does handle Kolra."), (EN, f"Kolra bounds it [{'a long title of a report, ' * 6}p.3]"),
    (EN, "I'm sorry for the earlier mix-up. Kolra bounds the sediment."), (EN, "The authors cannot answer whether the sediment moves."), (EN, "We are unable to rule out that it moves."), (EN, "Kolra bounds it. The report calls this “el calendario”."),
    (EN, "Asked “How does Kolra handle the sediment?”, the paper answers that it does so well."), ("Kolra如何处理？", "编码器平滑了主要模型……最终改善了响应。"), (None, "It moves."),
]


@pytest.mark.parametrize(("query", "answer", "want"), CASES)
def test_defects(query, answer, want):
    assert defects(query, answer)[0] == want


@pytest.mark.parametrize(("query", "answer"), GOOD)
def test_good(query, answer):
    assert defects(query, answer) == []


def test_parts():
    assert language("x") is None and language("Что это такое") == "ru" and is_truncated("a b,")


def test_table(spark):
    rows = [("q1", EN, "", 1), ("q1", EN, "", 1), ("q2", EN, "Yes", 2), (None, EN, "", 3), ("q3", EN, "I won't be able to share this", 4)]
    df = spark.createDataFrame(rows, "query_id string, query string, answer string, key int")
    got = sorted(tuple(r) for r in pair_defects(df, "query_id", "query", "answer").collect())
    assert got == [("q1", "empty", 1), ("q3", "refusal", 1), ("q3", "truncated", 2)]
    assert pair_defects(df.limit(0), "query_id", "query", "answer").count() == 0
