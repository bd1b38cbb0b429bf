"""Defects of question and answer pairs, by ordered rules in six languages; refusals also in Italian, Portuguese and Japanese."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Stand-ins for an answer that is not there, without marks.
STAND_INS = frozenset(
    "na|n a|none|null|nil|nan|tbd|tba|todo|unknown|undefined|empty|blank|no answer|not available|not applicable|no response|no data|keine angabe|keine antwort|unbekannt|k a|leer|"
    "sin respuesta|sin datos|desconocido|ninguna|aucune réponse|aucun|inconnu|sans réponse|нет ответа|нет данных|неизвестно|н д|无|暂无|没有|未知|空|无答案|没有答案|无回答|待定".split("|")
)
# How an assistant declines, in the first person.
REFUSALS = re.compile(
    r"""\bI(?:\s+(?:simply|really|just|also|therefore))?\s+(?:can\s?not|can'?t|could\s?n[o']t|won'?t|will\s+not|wouldn'?t|am\s+(?:not\s+able|unable)\s+to|won'?t\s+be\s+able\s+to|will\s+not\s+be\s+able\s+to)
        \s+(?:be\s+able\s+to\s+)?(?:\w+\s+)?(?:answer|help|assist|provide|share|comply|respond|reply|discuss|do\s+(?:that|this)|give|offer|support|fulfil|say|tell|continue|complete|engage|address)
    |\bI(?:'m|\s+am)\s+(?:not\s+able|unable)\s+to\s+(?:answer|help|assist|provide|share|comply|respond|reply|discuss|give|offer|say|tell|do)
    |\bI\s+(?:must|have\s+to|need\s+to|would\s+like\s+to|will)\s+(?:respectfully\s+)?(?:decline|refuse)
    |\bI\s+(?:do\s+not|don'?t)\s+feel\s+comfortable|\bI\s+(?:would\s+)?(?:prefer|rather)\s+not\b|\bI'd\s+rather\s+not\b|\bI\s+(?:decline|refuse)\s+to\b
    |(?:\b(?:not|never|hardly)|n't)\s+(?:\w+\s+)?possible\s+for\s+me\s+to\b|\bimpossible\s+for\s+me\s+to\b|\bI\s+(?:do\s+not|don'?t)\s+have\s+(?:the\s+|any\s+)?(?:access|permission|authori[sz]ation|ability|information|knowledge)\b
    |\bas\s+an?\s+(?:AI|artificial\s+intelligence|(?:large\s+)?language\s+model|assistant)\b[^.]*\b(?:can\s?not|can'?t|do\s+not|don'?t|am\s+(?:not|unable)|won'?t)\b|^\W*(?:(?:I'?m\s+|I\s+am\s+)?(?:so\s+|very\s+)?sorry|apologies|my\s+apologies|unfortunately)\b[^.]*\b(?:outside|beyond|not\s+(?:within|in))\s+(?:of\s+)?(?:my|what\s+I)\s+(?:scope|remit|abilities|capabilities|knowledge|competence)
    |\bno\s+(?:answer|help|response)\s+can\s+be\s+given\s+by\s+me|\bsomething\s+I\s+(?:cannot|can'?t|won'?t)
    |\b(?:kann|darf)\s+ich\s+(?:\w+\s+){0,3}nicht\b|\bich\s+(?:kann|darf)\s+(?:\w+,?\s+){0,5}nicht\s+(?:helfen|beantworten|antworten|weiterhelfen|sagen|mitteilen|bereitstellen|teilen)|\bich\s+bin\s+(?:\w+\s+){0,2}nicht\s+in\s+der\s+Lage|\bich\s+(?:muss|möchte|will)\s+(?:\w+,?\s+){0,4}(?:ablehnen|nicht\s+(?:beantworten|antworten|äußern|helfen))|\bist\s+mir\s+(?:\w+\s+)?nicht\s+möglich
    |\bje\s+(?:ne\s+|n')(?:peux|puis|pourrai|saurais|suis|veux|souhaite)\s+(?:malheureusement\s+)?pas\b|\bje\s+préfère\s+ne\s+pas\b|\bje\s+(?:dois|me\s+dois\s+de)\s+(?:refuser|décliner)|\bje\s+(?:refuse|décline)\b|\bm'est\s+(?:pas\s+possible|impossible)
    |\bno\s+(?:puedo|podré|podría)\s+(?:\w+\s+){0,2}(?:responder|ayudar|contestar|proporcionar|compartir|ofrecer|dar|decir|atender|asistir|ayudarle|ayudarte|responderle)|\bno\s+me\s+es\s+posible|\bno\s+estoy\s+en\s+(?:condiciones|posición)|\bprefiero\s+no\b|\b(?:debo|tengo\s+que)\s+(?:rechazar|declinar|negarme)|\bme\s+niego\s+a
    |\bя\s+не\s+(?:могу|смогу|в\s+состоянии|буду|вправе)|\bне\s+могу\s+(?:\w+\s+){0,3}(?:помочь|ответить|отвечать|предоставить|поделиться|сказать|выполнить|обсуждать)|\bвынужден[а]?\s+отказать|\bотказываюсь\b|\bпредпоч(?:ту|итаю)\s+не\b|\bмне\s+не\s+(?:удастся|разрешено|положено)
    |\b(?:non\s+(?:posso|possiamo|sono\s+in\s+grado\s+di|mi\s+è\s+possibile|potrei)|mi\s+(?:rifiuto|dispiace,?\s+(?:ma\s+)?non))\s*(?:\w+\s+){0,2}(?:rispondere|aiutar\w*|assister\w*|fornir\w*|condivider\w*|dir\w*|dar\w*|discuter\w*|di\b)
    |\b(?:não\s+(?:posso|podemos|consigo|sou\s+capaz\s+de|me\s+é\s+possível|poderei)|recuso-me\s+a|prefiro\s+não)\s*(?:\w+\s+){0,2}(?:responder|ajudar|auxiliar|fornecer|compartilhar|partilhar|dizer|dar|discutir|atender)
    |(?:お答え|回答|お手伝い|お応え|ご提供|提供|対応|支援)(?:することは?|は)?(?:でき(?:ません|かねます|ない)|いたしかねます|しかねます|致しかねます)
    |我(?:们)?(?:恐怕)?(?:无法|不能|不便|没办法|没有办法|拒绝|不可以|不愿|帮不了)|^(?:很?抱歉|对不起|很遗憾|不好意思)[，,。！\s]|(?:无法|不能)(?:回答|提供|协助|帮助)(?:您|你|这个|该|此)""",
    re.I | re.X,
)
_LABEL = re.compile(r"^\W*(?:question|query|q|frage|pregunta|вопрос|问题|问)\s*[:：]\s*", re.I)
_WORD = re.compile(r"[^\W_]+")
_HAN, _CYRILLIC, _LETTER = re.compile("[㐀-鿿]"), re.compile("[Ѐ-ӿ]"), re.compile(r"[^\W\d_]")
# Frequent words by which a language of Latin script is told.
FREQUENT = {
    "en": frozenset("the of and to in is that each every one this with whereas while because although unless when by as at an after before under within without what which how why does need compare explain role it so if even soon once from for on are or not about only yes no".split()),
    "de": frozenset("der die das und ist den dem des ein eine einen einer nicht mit für auf im am bei nach wenn weil obwohl während sobald ohne je über zu wie was warum sagt arbeit braucht behandelt vergleich trotz".split()),
    "fr": frozenset("le la les des du et est un une que qui dans sur sous par pour pas avec selon malgré après sans lorsque parce bien tandis dès quand pourquoi comment dit étude traite demande au aux ce cette l d".split()),
    "es": frozenset("el la los las del y es un una que en con por para no según sin tras pese al si cuando porque aunque mientras cómo qué por trata necesita dice estudio sobre frente durante lo se".split()),
}
# Words after which a sentence goes on.
GOES_ON = frozenset(
    "the a an of to in on at by with and or but nor because since while whereas although though if unless so that as such which who whose whom this these those each every than from into onto over under within without before after once until till when where per via for is are was were be been its their "
    "der die das den dem des ein eine einen einem einer und oder aber weil obwohl während wenn sobald dass mit für auf in im am bei nach von vom zum zur zu je über unter ohne ist sind als wie "
    "le la les un une des du de et ou mais que qui dans sur sous par pour avec selon sans lorsque parce tandis dès quand au aux ce cette bien "
    "el los las unos unas del y o u pero en con por para según sin tras al si cuando porque aunque mientras como "
    "и или но а в во на с со по за из от до для при под над о об что чтобы если когда потому хотя пока как не".split()
)
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "„": "“"}
_CITED = re.compile(r"\[(?!\s*(?:\.\.\.|…)\s*\])[^\[\]]+\]\s*[.。]?\s*$")
_STOPS = ".!?。！？؟।"


def _words(text: str) -> list[str]:
    """Words in lower case; each Han letter is one."""
    out: list[str] = []
    for w in _WORD.findall(unicodedata.normalize("NFKC", text).casefold()):
        out += list(w) if _HAN.search(w) else [w]
    return out


def is_empty(answer: str | None) -> bool:
    """Nothing but blanks, marks or a stand-in."""
    if answer is None:
        return True
    words = _WORD.findall(unicodedata.normalize("NFKC", answer).casefold())
    return not words or " ".join(words) in STAND_INS


def is_refusal(answer: str) -> bool:
    """Declines in the first person. That others could not or would not do something is no refusal."""
    return bool(REFUSALS.search(answer.replace("’", "'")))


def is_copied(query: str | None, answer: str, share: float = 0.6) -> bool:
    """Gives the words of the query back in their order and nothing else, once or again, at least `share` of them each time."""
    asked, given = _words(query or ""), _words(_LABEL.sub("", answer))
    if not asked or not given or len(set(given)) < share * len(set(asked)):
        return False
    at, passes = 0, 1
    for w in given:
        try:
            at = asked.index(w, at) + 1
        except ValueError:
            if w not in asked:
                return False
            at, passes = asked.index(w) + 1, passes + 1
    return passes == 1 or len(given) >= share * len(asked) * passes


def _unclosed(text: str) -> bool:
    """Whether a bracket or quotation mark is left open."""
    stack: list[str] = []
    for c in text:
        if stack and c == stack[-1]:
            stack.pop()
        elif c in _PAIRS:
            stack.append(_PAIRS[c])
        elif c == "”" and stack and stack[-1] == "“":
            stack.pop()
    return bool(stack)


def is_truncated(answer: str, phrase: int = 5, han_phrase: int = 8) -> bool:
    """Breaks off: an ellipsis, comma or hyphen at its end, an open bracket, a word after which a sentence goes
    on, or more words than a phrase has and no end mark. A citation at the end closes a sentence."""
    s = answer.strip()
    if _unclosed(s):
        return True
    if _CITED.search(s):
        return False
    bare = s.rstrip("\"”’»“')]}」』）* \t\n")
    if bare.endswith(("...", "…")) or bare.endswith("..") or s.endswith(("[...]", "[…]")):
        return True
    if bare and bare[-1] in _STOPS:
        return False
    if bare and bare[-1] in ",;:、，；：(–—-‐":
        return True
    words = _WORD.findall(bare)
    if _HAN.search(bare):
        return sum(len(w) for w in words) > han_phrase
    return bool(words) and (len(words) > 1 and words[-1].lower() in GOES_ON or len(bare.split()) > phrase)


def language(text: str) -> str | None:
    """zh, ru, en, de, fr or es, or None where the text doesn't tell."""
    letters = len(_LETTER.findall(text))
    if not letters:
        return None
    if len(_HAN.findall(text)) >= 0.25 * letters:
        return "zh"
    if len(_CYRILLIC.findall(text)) >= 0.4 * letters:
        return "ru"
    words = [w.lower() for w in _WORD.findall(text.replace("’", " ").replace("'", " "))]
    score = {k: sum(w in v for w in words) for k, v in FREQUENT.items()}
    best = max(score, key=lambda k: score[k])
    others = max(v for k, v in score.items() if k != best)
    return best if score[best] >= 2 and score[best] > others else None


def is_other_language(query: str | None, answer: str) -> bool:
    """Answer and query are told to be in two languages. Names, terms and phrases too short to tell are not."""
    asked, given = language(query or ""), language(answer)
    if asked is None or given is None:
        return False
    if asked == "zh" and given != "zh":
        return len(_HAN.findall(answer)) < 2
    return asked != given


def defects(query: str | None, answer: str | None) -> list[str]:
    """Every defect that the ordered rules find; the first is the one that names the pair."""
    if is_empty(answer):
        return ["empty"]
    rules = (("refusal", is_refusal(answer)), ("copied_question", is_copied(query, answer)), ("other_language", is_other_language(query, answer)), ("truncated", is_truncated(answer)))
    return [name for name, hit in rules if hit]


def pair_defects(df: DataFrame, key: str, query: str, answer: str) -> DataFrame:
    """Defective pairs: `key, defect, place`, a row for each triggered rule in their order (`place` from 1).

    A null answer is empty; a null query can't be copied or be of another language. Rows with a null key are
    left out; repeated rows count once. Whole texts are judged. Narrow but for the final distinct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, d, i) for k, q, a in zip(*(c.to_pylist() for c in batch.columns)) for i, d in enumerate(defects(q, a), 1)]
            k, d, i = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(d, pa.string()), pa.array(i, pa.int32())], ["key", "defect", "place"])

    rows = df.select(F.col(key).cast("string"), F.col(query).cast("string"), F.col(answer).cast("string")).where(F.col(key).isNotNull())
    return rows.mapInArrow(run, "key string, defect string, place int").distinct()
