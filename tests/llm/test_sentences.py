import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperweir.llm.sentences import lattice_words, sentences, split_sentences

CASES = [
    ["One ends.", "Two ends!", "Three ends?!", "Four"],
    ["Dr. A. B. Smith met Prof. Jones at 7 a.m.", "Then they left."],
    ["See Fig. 3 (cf. App. B).", "It rose by 3.5 mm, i.e. a lot, e.g. here.", "In Vol. II.", "Done et al.", "Next."],
    ['He said “It works. Really.” and left.', "“It stands alone.”", "Next one."],
    ["It runs... and yet it stops...", "New one… and on.", "End…"],
    ["See docs.x.test/v2.1/notes.html for v1.2.3.", "Ok."],
    ["Wrapped\nline goes on.", "Next."],
    ["Am 3. Oktober maß er z. B. Die Dichte, d. h. viel.", "„Das steht allein.“", "Ende."],
    ["La marge, p. ex. ici, dure ?", "« Elle dure. »", "La Sra. Valdal no.", "¿Cómo va?", "¡Bien!"],
    ["Это т. е. модель.", "А. Б. Иванов писал, см. рис. 5 и т. д.", "Конец."],
    ["यह है।", "क्या यह है?", "हाँ।"],
    ["هل هذا صحيح؟", "نعم.", "انتهى."],
]
GLUED = [
    ["作者指出：“很好。”", "约为20.6%。", "A v1.2 好！", "是否好?", "放大了……最终好。"],
    ["査読者は「良い。」と述べた。", "次です。", "良いか？"],
]


@pytest.mark.parametrize("parts", CASES)
def test_spaced(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


@pytest.mark.parametrize("parts", GLUED)
def test_glued(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_thai():
    parts = ["ชุดการวัดขยายสัญญาณประมาณ 9.3 หน่วยตลอดหลายปี", "คำถามรุ่น Navkimyx ปรับปรุงสัญญาณ", "ฟิล์มบางขยายสัญญาณ"]
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_thai_beyond_the_list():
    assert lattice_words("thai", "รัฐบาลประเทศไทยกินแมว") == ("รัฐบาล", "ประเทศไทย", "กิน", "แมว")
    assert lattice_words("thai", "โรงเรียนฃฅฃฅ") == ("โรงเรียน", "ฃฅฃฅ")
    for text in ("โรงเรียนต่าง ๆ", "รัฐบาลเนื่องจาก ฝนตกหนัก", "ผลไม้ ได้แก่ มะม่วง", "นักเรียน ฃฅฃฅ กินข้าว"):  # gaps within a sentence
        assert len(sentences(text)) == 1, text
    parts = ["แมวกินปลา", "โรงเรียนปิดแล้ว", "ฃฅฃฅกินข้าว", "เขาไปตลาด"]
    assert [" ".join(parts)[a:b] for a, b in sentences(" ".join(parts))] == parts


ORDINARY = [
    ["ผมซื้อ ส้ม กล้วย มะม่วง ที่ตลาด"],
    ["เมื่อวานผมไปตลาดกับแม่", "เราซื้อปลาและผักหลายอย่าง", "วันนี้ฝนตกหนักทั้งวัน"],
    ["ຂ້ອຍໄປຕະຫຼາດກັບແມ່ມື້ວານນີ້", "ພວກເຮົາຊື້ປາແລະຜັກຫຼາຍຢ່າງ"],
    ["昨日は市場へ行きました", "今日は雨が降っています"],
    ["東京 大阪 京都に行きました。"],
    ["我们昨天去了市场 买了很多鱼。"],
    ["ខ្ញុំទៅផ្សារ។", "យើងទិញត្រី។"],
    ["We met in St. Louis on Jan. 5.", "Sen. Smith spoke with Ing. Novák.", "It rained on Main St.", "The game ended."],
]


@pytest.mark.parametrize("parts", ORDINARY)
def test_ordinary_text(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_lattices():
    assert lattice_words("khmer", "ខ្ញុំទៅផ្សារ") == ("ខ្ញុំ", "ទៅ", "ផ្សារ")
    assert lattice_words("burmese", "ကျွန်တော်ဈေးသွားတယ်")[-1] == "တယ်"
    assert lattice_words("lao", "ພວກເຮົາຊື້ປາ") == ("ພວກ", "ເຮົາ", "ຊື້", "ປາ")
    assert lattice_words("chinese_japanese", "昨日は市場へ")[::2] == ("昨日", "市場")


def test_words_and_runs_of_any_length():
    word = "x" * 5000 + "."
    assert len(sentences(f"{word} Then more.")) == 2
    run = "โรงเรียน" * 400
    assert [len(lattice_words("thai", run)), len(sentences(f"{run}แล้ว เขาไปตลาด"))] == [400, 2]


def test_blank_lines():
    text = "## 1 Heading\r\n\r\nOne. Two\n \n\n  Three  \n"
    assert [text[a:b] for a, b in sentences(text)] == ["## 1 Heading", "One.", "Two", "Three"]
    assert sentences("") == sentences(" \n\t ") == []


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aA1 .!?…\n\r\"“”„«»()[]。」「กคำ 我。", max_size=60))
def test_covers_all_content_in_order(text):
    got = sentences(text)
    end = 0
    for a, b in got:
        assert end <= a < b and text[end:a].strip() == "" and text[a:b] == text[a:b].strip()
        end = b
    assert text[end:].strip() == ""


def test_long_texts_end():
    assert len(sentences("The end. " * 50_000)) == 50_000
    assert sentences("“«" * 20_000) and sentences("ก" * 100_000)


def test_table(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 1), (2, None, 2), (3, "  ", 3), (1, "A b. C d.", 1), (None, "X", 4)], "doc_id long, text string, start_char int")
    got = sorted((tuple(r) for r in split_sentences(df).collect()), key=repr)
    assert got == sorted([(1, 0, 4), (1, 5, 9)] * 2 + [(None, 0, 1)], key=repr)
    assert split_sentences(df.limit(0)).count() == 0
