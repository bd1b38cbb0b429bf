"""Sentence units of texts in many scripts, with offsets.

A blank line ends a sentence and a single line break never does. Within a block, scripts with spaces are
judged by a lattice of terminators: each run of terminators with its closing marks is a possible end, which the
quotation it stands in, the token before it and the word after it accept or reject. Scripts without spaces are
divided into words by a lattice of dictionary words, and each gap is classified by the word before it (does it
leave the sentence open, or close it?) and the word after it (does it go on, or open one?). Thai and Lao have no
terminators, so there a gap between other words ends a sentence too, if clauses stand on both sides of it and not
the members of a list. Khmer, Burmese, Chinese and Japanese have terminators, judged as above and by the particle
that follows a closed quotation; a gap ends a sentence there only behind a word that closes one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tokens before a full stop that never end a sentence.
NEVER = frozenset(
    "dr prof mr mrs ms sr sra srta hr frau mme mlle m. rev gen col lt capt approx aprox ca circa vs cf viz vgl bzw ggf evtl sog inkl exkl env resp esp incl e.g i.e z.b d.h p.ej c.-à-d "
    "т.е напр ок см ср проф акад гл им ул разд डॉ श्री श्रीमती प्रो د أ म".split()
)
# Titles before a name, and months before a day, in the case they are written in.
TITLES = frozenset("St Ste Sta Sto Sen Rep Gov Pres Supt Sgt Cpl Maj Cmdr Adm Lieut Hon Fr Br Ing Dipl Mag Dott Sig Avv Arch Geom Lic Ldo Lda Lcdo Mons Excmo Excma Ilmo Ilma Exmo Exma Dra Dña Eng Mgr Msgr Mt Ft".split())
SHORT_MONTHS = frozenset("Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Okt Nov Dec Dez".split())
# Tokens that refer to a number or letter behind them.
REFERS = frozenset("fig figs tab tabs eq eqs sec secs no nos nr núm num vol vols app ch chap p pp art ref refs cap pág pag par abb abs kap bd anm fußn рис табл стр гл п с г".split())
# Words of Latin script that open a sentence behind a single letter with a full stop.
OPENERS = frozenset(
    "the this that these those each every one a an in on at by with without under within given for from as it its they we when why where which what how does do is are there if while unlike release category "
    "der die das ein eine dieser diese dieses im am le la les un une ce cette ces el los las una este esta en".split()
)
# Months in German, after an ordinal number.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jahrhundert".split())
# Particles that carry a Japanese or Chinese sentence on behind a closed quotation.
CARRIES_ON = ("と", "って", "という", "など", "が", "を", "に", "は", "の", "も", "で", "へ", "や", "か", "から", "より", "的", "这", "等", "一", "之", "是", "和", "与", "，", "、", "；", "：", ",", ";", ":")
# Thai words that leave a sentence open, and words that do not open one.
THAI_OPEN = frozenset(
    "ประมาณ รุ่น และ แต่ หรือ ของ ใน ที่ ซึ่ง จึง เพราะ ถ้า หาก เพื่อ จาก ถึง ด้วย ว่า กับ โดย เป็น คือ เช่น ตาม ต่อ ระหว่าง ก่อน ภายใต้ ตลอด เมื่อ ให้ จะ ไม่ "
    "ได้แก่ อาทิ แม้ แม้ว่า ถึงแม้ เนื่องจาก เพราะว่า สำหรับ เกี่ยวกับ ตั้งแต่ จน จนถึง จนกระทั่ง ต้อง ควร อาจ กำลัง เคย ทั้ง โดยเฉพาะ นอกจาก รวมทั้ง รวมถึง ตลอดจน ราว เกือบ".split()
)
THAI_INNER = frozenset("และ แต่ หรือ ซึ่ง จึง เพราะ ของ ที่ ว่า หน่วย เช่น โดยที่ ด้วย อยู่ แล้ว ครับ ค่ะ นะ คะ ได้แก่ อาทิ จน จนถึง จนกระทั่ง รวมทั้ง รวมถึง ตลอดจน เพราะว่า ก็ เป็นต้น ๆ ฯ ฯลฯ".split())
# Thai words that close a sentence, and words that open one, even beside an unknown word.
THAI_FINAL = frozenset("ครับ ค่ะ นะ คะ จ้ะ แล้ว เป็นต้น".split())
THAI_OPENERS = frozenset("เรา เขา เธอ ผม ฉัน ดิฉัน มัน พวกเขา พวกเรา นี่ นั่น อย่างไรก็ตาม ดังนั้น นอกจากนี้ ทั้งนี้ ต่อมา ปัจจุบัน เมื่อ หลังจาก ถ้า หาก".split())
# The same of Lao.
LAO_OPEN = frozenset("ແລະ ແຕ່ ຫຼື ຂອງ ໃນ ທີ່ ຊຶ່ງ ເຊິ່ງ ເພາະ ຖ້າ ເພື່ອ ຈາກ ເຖິງ ດ້ວຍ ວ່າ ກັບ ໂດຍ ເປັນ ຄື ເຊັ່ນ ຕາມ ລະຫວ່າງ ກ່ອນ ເມື່ອ ໃຫ້ ຈະ ບໍ່ ປະມານ ຕ້ອງ ສຳລັບ".split())
LAO_INNER = frozenset("ແລະ ແຕ່ ຫຼື ຊຶ່ງ ເຊິ່ງ ເພາະ ຂອງ ທີ່ ວ່າ ເຊັ່ນ ດ້ວຍ ກໍ ຈຶ່ງ".split())
LAO_FINAL = frozenset("ແລ້ວ ເດີ ເນາະ".split())
LAO_OPENERS = frozenset("ຂ້ອຍ ຂ້າພະເຈົ້າ ພວກເຮົາ ເຂົາ ລາວ ມັນ ດັ່ງນັ້ນ ປັດຈຸບັນ ເມື່ອ ຖ້າ ຫາກ".split())
# Words that close a sentence in scripts with terminators of their own, where one was left out.
KHMER_FINAL, BURMESE_FINAL = frozenset("ហើយ ទេ".split()), frozenset("သည် တယ် မည် မယ် ပြီ ၏ ပါသည် ပါတယ်".split())
EAST_ASIAN_FINAL = frozenset("です でした ます ました した ません だ だった である た ない よ ね か でしょう だろう ください 了 吗 呢 吧 嗎".split())


@dataclass(frozen=True)
class Spaceless:
    """A script without spaces: its letters, its dictionary, and the words that tell what a gap beside them is."""

    letters: str
    dictionary: str
    leaves_open: frozenset[str] = frozenset()
    goes_on: frozenset[str] = frozenset()
    closes: frozenset[str] = frozenset()
    opens: frozenset[str] = frozenset()
    #: The script has no terminators, so any gap between clauses may end a sentence, a line break in a gap also.
    unmarked: bool = False


SPACELESS = (
    Spaceless("฀-๿", "thai", THAI_OPEN, THAI_INNER, THAI_FINAL, THAI_OPENERS, True),
    Spaceless("຀-໿", "lao", LAO_OPEN, LAO_INNER, LAO_FINAL, LAO_OPENERS, True),
    Spaceless("ក-៓ៜ៝", "khmer", closes=KHMER_FINAL),
    Spaceless("က-၉ၐ-႟", "burmese", closes=BURMESE_FINAL),
    Spaceless("々ぁ-ゟァ-ヿ㐀-䶿一-鿿", "chinese_japanese", goes_on=frozenset("と って という など が を に は の も で へ や から より 的 和 与".split()), closes=EAST_ASIAN_FINAL),
)
#: Words that a stretch between two gaps has at least if it is a clause; shorter ones are members of a list.
CLAUSE = 3

_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)*\n")
_CJK = "　-〿぀-ヿ㐀-䶿一-鿿豈-﫿＀-￯"
_CLOSERS = r"""["”’»“')\]}〉》」』】）＂*_]*"""
_END = re.compile(rf"[.!?…؟।॥។။。！？．｡]+{_CLOSERS}(?=(\s)|$|([{_CJK}])|[؀-ۿऀ-ॿ“„«»¿¡])|[。！？．｡؟।॥។။]+{_CLOSERS}")
_MARKS = re.compile(r"[“”„«»「」『』()（）\[\]【】\"]")
_PAIR = {"“": "”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】"}
_SKIP = re.compile(r"""[\s"“”„«»‘’'(\[{*_#>•–—-]*""")
_TOKEN = re.compile(r"(\S+)$")
_LEAD = "([{\"“„«‘’'*_¿¡"
_WORD = re.compile(r"[^\W\d_]+")
_ORDINAL = re.compile(r"\b(?:am|vom|zum|der|dem|des|den|im|beim|bis|ab|seit)\s+\d{1,2}$")
_PARTS_NEVER = re.compile(r"(?:^|[\s(\[„“«\"])(?:z\.\s?B|d\.\s?h|p\.\s?ej|т\.\s?е|i\.\s?e|e\.\s?g|c\.-à-d|u\.\s?U|o\.\s?g|s\.\s?o|v\.\s?a)$")


@lru_cache(maxsize=None)
def dictionary(name: str) -> tuple[dict[str, int], int]:
    """Words with their costs, and the length of the longest: a dictionary of ICU 77.1, a word a line in words/.

    Words that come without a cost have that of 100.
    """
    out = {}
    for line in Path(__file__).with_name("words").joinpath(f"{name}.txt").read_text(encoding="utf-8").splitlines():
        word, _, cost = line.partition("\t")
        out[word] = int(cost or 100)
    return out, max(map(len, out))


@lru_cache(maxsize=50_000)
def lattice_words(name: str, run: str) -> tuple[str, ...]:
    """The cheapest way through the lattice of dictionary words over a run of letters.

    A letter that no word covers costs more than any word, and such letters side by side are one unknown word.
    """
    words, longest = dictionary(name)
    n = len(run)
    cost, back = [0] + [1 << 60] * n, [0] * (n + 1)
    for i in range(n):
        here = cost[i]
        if here + 300 < cost[i + 1]:
            cost[i + 1], back[i + 1] = here + 300, i
        for j in range(i + 1, min(n, i + longest) + 1):
            price = words.get(run[i:j])
            if price is not None and here + price < cost[j]:
                cost[j], back[j] = here + price, i
    out, j, end = [], n, n
    while j:
        i = back[j]
        if run[i:j] in words:
            if j < end:
                out.append(run[j:end])
            out.append(run[i:j])
            end = i
        j = i
    if end:
        out.append(run[:end])
    return tuple(out[::-1])


def _gap_ends(script: Spaceless, last: str, first: str, sizes: tuple[int, int]) -> bool:
    """Whether a gap between these two words ends a sentence, when so many words stand before and behind it."""
    if last in script.leaves_open or first in script.goes_on:
        return False
    clauses = min(sizes) >= CLAUSE
    if last in script.closes or first in script.opens:
        return clauses or script.unmarked
    known = dictionary(script.dictionary)[0]
    return script.unmarked and clauses and last in known and first in known


@lru_cache(maxsize=None)
def _patterns(script: Spaceless) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    gap = r"(?:[^\S\n]+|[^\S\n]*\n[^\S\n]*)" if script.unmarked else r"[^\S\n]+"
    c = f"[{script.letters}]"
    return re.compile(f"(?<={c}){gap}(?={c})"), re.compile(f"{c}+"), re.compile(f"{c}+|[^\\s{script.letters}]+")


_ANY_SPACELESS = re.compile("[" + "".join(s.letters for s in SPACELESS) + "]")


def _gaps(block: str) -> list[int]:
    """Places of the gaps that end sentences of scripts without spaces."""
    out = []
    if not _ANY_SPACELESS.search(block):
        return out
    for script in SPACELESS:
        gap, run, piece = _patterns(script)
        found = list(gap.finditer(block))
        if not found:
            continue
        pieces = []  # of each stretch between gaps: first word, last word, words
        for lo, hi in zip([0, *(m.end() for m in found)], [*(m.start() for m in found), len(block)]):
            first = last = ""
            size = 0
            for m in piece.finditer(block, lo, hi):
                if run.match(m.group()):
                    words = lattice_words(script.dictionary, m.group())
                    first, last, size = first or words[0], words[-1], size + len(words)
                else:
                    size += 1
            pieces.append((first, last, size))
        for m, a, b in zip(found, pieces, pieces[1:]):
            if _gap_ends(script, a[1], b[0], (a[2], b[2])):
                out.append(m.start())
    return out


def _enclosed(block: str) -> list[tuple[int, int]]:
    """Spans from an opening mark to its closing mark, the outermost only, in order."""
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}
    out: list[tuple[int, int]] = []

    def push(want: str, at: int) -> None:
        stack.append((want, at))
        held[want] = held.get(want, 0) + 1

    for m in _MARKS.finditer(block):
        c, at = m.group(), m.start()
        if c == '"':
            after, before = block[at + 1 : at + 2], block[at - 1 : at] if at else ""
            if not (held.get(c) and before and not before.isspace()):
                if after and not after.isspace():
                    push(c, at)
                continue
        elif c in "“”" and stack and stack[-1][0] == "„":
            c = "„"
        elif c == "„":
            push(c, at)
            continue
        elif c in "«»":
            if not held.get(c):
                push("»" if c == "«" else "«", at)
                continue
        elif c in _PAIR:
            push(_PAIR[c], at)
            continue
        if not held.get(c):
            continue
        while True:  # marks that were left open within end here too
            want, start = stack.pop()
            held[want] -= 1
            if want == c:
                break
        while out and out[-1][0] > start:
            out.pop()
        out.append((start, at))
    return out


def _ends_at_stop(block: str, begin: int, at: int, nxt: int) -> bool:
    """Whether a single full stop at `at` ends the sentence from `begin`, when `nxt` is the next letter or digit."""
    head = at
    while head > begin and not block[head - 1].isspace():
        head -= 1
    if head == at:
        return True
    token = block[head:at].lstrip(_LEAD)
    low = token.lower()
    c = block[nxt]
    if len(token) == 1 and c.isalpha() and block[nxt + 1 : nxt + 2] == "." and not token.isupper() and not "⺀" <= token:
        return False  # the first half of an abbreviation of two letters
    if token in TITLES and c.isupper() or token in SHORT_MONTHS and c.isdigit():
        word = _WORD.match(block, nxt)
        if not word or word.group().lower() not in OPENERS:
            return False
    if low in NEVER or _PARTS_NEVER.search(block, max(begin, at - 8), at):
        return False
    if low in REFERS:
        if c.isdigit():
            return False
        word = _WORD.match(block, nxt)
        if word and (len(word.group()) == 1 or re.fullmatch("[IVXLC]+", word.group())):
            return False
        return not token[0].isupper() and len(low) > 1
    if token.isdigit():
        if block[begin : head].strip(" #*_([") == "":
            return False
        if len(token) <= 2 and c.isalpha():
            word = _WORD.match(block, nxt)
            if word and word.group().lower() in MONTHS or _ORDINAL.search(block, max(begin, at - 12), at):
                return False
        return True
    last = re.split(r"[.\-]", token)[-1]
    if len(last) == 1 and last.isalpha() and (last.isupper() or not last.islower() and not "⺀" <= last):
        if len(token) > 2 and token.count(".") and low in ("a.m", "p.m", "u.s"):
            return True
        prior = _TOKEN.search(block[max(begin, head - 12) : head].rstrip())
        if prior and prior.group(1).lstrip(_LEAD).rstrip(".").lower() in REFERS:
            return True
        if len(block[begin : head].strip(" #*_([")) == 0 and block[nxt - 1].isspace() and not c.isalpha():
            return False
        word = _WORD.match(block, nxt)
        follows = block[word.end() : word.end() + 1] if word else ""
        return bool(word) and word.group().lower() in OPENERS and follows != "."
    return True


def _block_ends(block: str) -> Iterator[int]:
    """Ends of the sentences of a block without blank lines, but for the last."""
    spans = _enclosed(block) if _MARKS.search(block) else []
    starts = [s for s, _ in spans]
    shut = {e for _, e in spans}
    gaps = [(at, at) for at in _gaps(block)]
    found = [(m.start(), m.end(), m) for m in _END.finditer(block)] + [(a, b, None) for a, b in gaps]
    if gaps:
        found.sort(key=lambda x: x[0])
    begin, size = 0, len(block)
    for at, end, m in found:
        if end <= begin:
            continue
        if m is not None:
            # marks that open what follows are no closing marks of this sentence
            while end > at + 1 and block[end - 1] in "“«\"'*_" and end < size and not block[end].isspace() and (end - 1) not in shut and block[end - 1] not in "*_":
                end -= 1
            spaced = re.compile(r"[^\S\n]{0,2}[»«]").match(block, end)
            if spaced and spaced.end() - 1 in shut:
                end = spaced.end()
        i = bisect_right(starts, at) - 1
        if i >= 0 and spans[i][1] >= end:
            continue
        nxt = _SKIP.match(block, end).end()
        if nxt >= size:
            break
        if m is None:
            begin = end
            yield end
            continue
        run = m.group().rstrip("\"”’»“')]}〉》」』】）＂*_")
        c, adjacent = block[nxt], block[end]
        wide = run[0] in "。！？．｡"
        closed = i >= 0 and spans[i][1] < end and spans[i][1] >= at
        if wide or ("⺀" <= adjacent and not adjacent.isspace() and not "​" <= adjacent <= "⁯"):
            if run[0] in "….．" and not wide and run != ".":  # an ellipsis within Chinese or Japanese
                continue
            if run == "." and not "⺀" <= block[at - 1]:
                continue
            if closed and block.startswith(CARRIES_ON, end):
                continue
        elif not adjacent.isspace() and run[0] not in "؟।॥។။" and adjacent not in "“„«¿¡»\"":
            continue
        elif c in "¿¡":
            pass
        elif c.islower():
            continue
        elif run == "." and not _ends_at_stop(block, begin, at, nxt):
            continue
        begin = end
        yield end


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence of `text` in code points, without outer white space."""
    out: list[tuple[int, int]] = []

    def add(lo: int, hi: int) -> None:
        piece = text[lo:hi]
        lead = len(piece) - len(piece.lstrip())
        size = len(piece.strip())
        if size:
            out.append((lo + lead, lo + lead + size))

    at = 0
    for gap in [*_BLANK.finditer(text.replace("\r", " ") if "\r" in text else text), None]:
        lo, hi = at, gap.start() if gap else len(text)
        at = gap.end() if gap else hi
        block = text[lo:hi]
        if not block or block.isspace():
            continue
        begin = 0
        for end in _block_ends(block):
            add(lo + begin, lo + end)
            begin = end
        add(lo + begin, hi)
    return out


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences of every row: `key, start_char, end_char` (code points from 0, end exclusive).

    Null, empty and blank texts give no rows; null keys and repeated rows stay as they are; other columns are
    not read. Whole texts are read, in one task each. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, start, end = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    found = sentences(t)
                    at += [i] * len(found)
                    for a, b in found:
                        start.append(a)
                        end.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(start, pa.int32()), pa.array(end, pa.int32())], [key, "start_char", "end_char"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, start_char int, end_char int")
