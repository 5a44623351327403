"""Question-answer pairs with a broken answer, each with its defect.

A pair goes through small automata, the first defect found counts:

* ``empty``: nothing but marks, or a stand-in for a missing answer;
* ``copy``: a suffix automaton of the question's words is traversed with the answer's words; an
  answer that it covers, but for labels, says nothing of its own;
* ``language``: script counts and votes of stop words for question and answer, quotations left out;
* ``refusal``: an automaton of patterns for each language (who, negation, verb of answering) finds
  declining, and all other sentences only apologise, give a general reason, refer or offer;
* ``truncated``: a stack of delimiters, dangling ends and, for a last sentence without a full
  stop, what sentences with the same last words do in all other answers: end or go on.

The counts behind the last test cover all answers and are looked up by distributed joins.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.skew import hot_aware_lookup
from loomline.plans.lineage import materialize

# Stand-ins for a missing answer, after case, space and outer punctuation are gone.
STAND_INS = {
    "", "no answer", "none", "null", "nil", "n/a", "na", "nan", "tbd", "tba", "todo", "empty", "missing", "not available", "undefined", "unknown", "blank", "placeholder", "xxx",
    "keine antwort", "leer", "pas de réponse", "aucune réponse", "vide", "sin respuesta", "ninguno", "ninguna", "vacío", "нет ответа", "нет", "пусто", "no response", "answer", "to do", "pending", "wip", "lorem ipsum",
}
# Labels that may stand before a copied question.
LABELS = {"q", "question", "a", "answer", "frage", "antwort", "réponse", "pregunta", "respuesta", "вопрос", "ответ", "re", "prompt", "response", "user", "assistant", "f", "p", "r", "в", "о"}
# Patterns of declining by language. {0} stands for up to six words, {1} for the verbs of answering.
GAP = r"(?:(?:\W+\w[\w'-]*){0,6}?\W+)"
ANSWERING = {
    "en": r"(?:help|assist|answer|respond|reply|comment|discuss|share|say|tell|talk|speak|disclose|reveal|provide|give|go into|advise|comply|engage|elaborate|weigh in|offer)\w*",
    "de": r"(?:weiterhelfen|helfen|behilflich|beantworten|antworten|antwort|äussern|sagen|sprechen|reden|auskunft|auskünfte|angaben|information\w*|mitteilen|verraten|eingehen|unterstützen|kommentieren|erläutern|preisgeben|weitergeben|herausgeben|stellung)",
    "fr": r"(?:aider|répondre|dire|parler|donner|communiquer|fournir|partager|divulguer|commenter|discuter|renseigner|révéler|préciser|me prononcer|traiter)",
    "es": r"(?:ayudar\w*|responder\w*|contestar\w*|decir\w*|hablar|dar\w*|compartir\w*|comentar\w*|revelar\w*|proporcionar\w*|facilitar\w*|opinar|informar\w*|atender\w*|pronunciarme)",
    "ru": r"(?:помо\w+|ответ\w+|отвеча\w+|сказать|говорить|обсуждать|сообщ\w+|дать|давать|предостав\w+|раскры\w+|комментир\w+|поделиться|делиться|рассказ\w+|разглаш\w+|подсказ\w+)",
}
DECLINES = {
    "en": [
        r"\b(?:i|we)(?:\W+\w+){0,2}?\W+(?:can't|cannot|can not|won't|will not|wouldn't|would not|couldn't|could not|don't|do not|may not|must not|shouldn't|should not|am not going to|are not going to|'m not going to){0}{1}",
        r"\b(?:i|we)(?:'m|'re|\W+am|\W+are|\W+will be|'ll be)(?:\W+\w+){0,2}?\W+(?:unable to|not able to|not permitted|not allowed|not authori[sz]ed|not at liberty|not in a position|not willing|not comfortable|forbidden|prohibited){0}{1}",
        r"\b(?:i|we)(?:\W+(?:would|do|really|just|am|are|feel))*\W+(?:don't|not|do not)\W+(?:feel\W+)?comfortable",
        r"\b(?:i|we)\b(?:'d|'ll|\W+\w+){0,3}?\W+(?:decline|refuse|abstain|refrain|pass on (?:this|that|it))",
        r"\b(?:i|we)(?:'d|\W+would)?\W+(?:rather|prefer)\W+(?:not|to not)",
        r"\bnot something (?:that )?(?:i|we)\b|\b(?:outside|beyond|out)\b(?: of)? (?:what|the scope of what) (?:i|we)\b|\bnot (?:for me|my place) to\b",
        r"\b(?:guidelines|polic(?:y|ies)|rules|instructions)\b(?:\W+\w+){0,2}?\W+(?:do not|don't|does not|doesn't|forbid|forbids|prohibit|prohibits|prevent|prevents|won't|keep me from)\b",
        r"\bnot be appropriate\b|\binappropriate for me\b|\bno answer\b.{0,40}\b(?:given|provided|available) by\b|\b(?:cannot|can't) be answered by\b|\bno comment\b|\b(?:request|question)\W+(?:is|was|has been|must be)\W+(?:denied|declined|refused)",
        r"\b(?:i|we)\W+(?:do not|don't)\W+have\W+(?:access|permission|clearance|authori[sz]ation)\b",
    ],
    "de": [
        r"\b(?:kann|können|darf|dürfen|möchte|möchten|will|wollen|werde|werden|mag|sollte)\W+(?:ich|wir){0}(?:nicht|keine\w*|nichts|kaum){0}{1}", r"\b(?:ich|wir)\W+(?:kann|können|darf|dürfen|möchte|möchten|will|wollen|werde|werden|mag|sollte){0}(?:nicht|keine\w*|nichts){0}{1}",
        r"\b(?:bin|sind)\W+(?:ich|wir)\b.{0,120}\bnicht\W+(?:befugt|berechtigt|autorisiert|ermächtigt|in der lage)|\b(?:ich|wir)\W+(?:bin|sind)\b.{0,120}\bnicht\W+(?:befugt|berechtigt|autorisiert|ermächtigt|in der lage)",
        r"\b(?:lehne|verweigere)\W+ich\b|\bich\W+(?:lehne|verweigere)\b|\b(?:muss|möchte)\W+ich\b.{0,120}\bablehnen|\bich\W+(?:muss|möchte)\b.{0,120}\bablehnen",
        r"\b(?:ist|wäre)\b.{0,120}\bmir\b.{0,120}\bnicht\W+(?:erlaubt|gestattet|möglich)|\b(?:mir|uns)\W+(?:ist|wäre)\b.{0,120}\bnicht\W+(?:erlaubt|gestattet|möglich)|\bkein kommentar\b|\bkeine antwort geben\b",
    ],
    "fr": [
        r"\b(?:je|nous)\W+(?:ne\W+|n')(?:\w+\W+)?(?:peux|pouvons|puis|veux|voulons|souhaite|souhaitons|vais|allons|dois|devons|saurais){0}{1}",
        r"\b(?:je|nous)\W+ne\W+(?:suis|sommes)\W+pas\W+(?:autorisée?s?|habilitée?s?|en mesure|en droit|à l'aise)|\bil (?:m'est|nous est)\W+(?:impossible|interdit|défendu)|\bil ne (?:m'est|nous est) pas (?:possible|permis)",
        r"\b(?:je|nous)\W+préf\w+\W+ne\W+(?:pas|rien)|\bj(?:e\W+|'ai\W+)?\W*(?:refuse|décline|m'abstiens)|\bje\W+dois\W+(?:refuser|décliner|m'abstenir)|\bsans commentaire\b|\bpas de commentaire\b",
    ],
    "es": [
        r"\bno\W+(?:puedo|podemos|debo|debemos|quiero|queremos|deseo|voy a|vamos a|me permiten|podré){0}{1}",
        r"\bno\W+(?:estoy|estamos)\W+(?:autorizad\w+|en condiciones|facultad\w+|en posición)|\bno\W+(?:tengo|tenemos)\W+(?:permiso|autorización|permitido)|\bno\W+me\W+(?:es\W+posible|está\W+permitido|corresponde)|\bme es imposible\b",
        r"\bprefiero\W+no\b|\bpreferimos\W+no\b|\bme\W+niego\b|\bdebo\W+(?:rechazar|declinar|negarme|abstenerme)|\blamento\W+no\W+poder\b|\bsin comentarios\b|\brechazo\b",
    ],
    "ru": [
        r"\bне\W+(?:могу|можем|смогу|сможем|хочу|хотим|готовы?|буду|будем|стану|станем|должны?|в состоянии){0}{1}",
        r"\bне\W+(?:вправе|уполномочены?|имею права|имеем права|разрешено|положено|позволено|допускается)|\b(?:мне|нам)\b.{0,120}\b(?:нельзя|запрещено|не разрешено|не позволено)|\b(?:нельзя|запрещено){0}{1}",
        r"\b(?:отказываюсь|отказываемся|воздержусь|воздержимся)\b|\bвынужден\w*\W+отказ\w+|\bпредпоч\w+(?:\W+бы)?\W+не\b|\bбез комментариев\b",
    ],
}
# Beginnings of sentences that only apologise, give a general reason, refer or offer.
FILLERS = """
i hope you understand|please|try asking|try again|is there|are there|can i|may i|could i|shall i|how (?:else )?(?:can|may) i|what else|do you have|would you like|you (?:may|might|could|can|should) (?:want|try|ask|contact|consult|check with|reach)
sorry|i'm sorry|i am sorry|we're sorry|we are sorry|my apologies|our apologies|apologies|i apologi[sz]e|i'm afraid|i regret|thanks|thank you|hm|well|as an? (?:ai|assistant|language model|bot|agent)|unfortunately|regrettably|i must say|ask |contact |reach out
bitte|wenden sie|fragen sie|kontaktieren sie|versuchen sie|haben sie|es tut|tut mir leid|das tut mir leid|entschuldig|verzeih|ich bitte|gibt es|kann ich|darf ich|womit|ich hoffe|leider|danke|als assistent|brauchen sie
veuillez|merci|désolé|je suis désolé|nous sommes désolés|pardon|excusez|avez-vous|puis-je|y a-t-il|une autre question|adressez|demandez|contactez|essayez|consultez|malheureusement|en tant qu'assistant|j'espère|je regrette
lo siento|lo sentimos|por favor|puede (?:preguntar|consultar|contactar)|pregunte|pregunta|consulte|contacte|pruebe|intente|diríjase|¿|espero|por desgracia|lamentablemente|desafortunadamente|disculp|perdon|perdón|gracias|como asistente|necesita
извините|простите|прошу прощения|пожалуйста|обратитесь|спросите|попробуйте|свяжитесь|могу ли|могу я|чем (?:ещё|еще)? ?могу|надеюсь|есть ли|у вас есть|к сожалению|увы|спасибо|как помощник|нужн|сожалею
""".strip().replace("\n", "|")  # fmt: skip
# Sentences that name somebody else who can help.
REFERRALS = r"""
\b(?:may|might|could|can|will|should|would) (?:perhaps |probably |possibly |well )?(?:be able to )?(?:help|assist|answer|advise|know)\w*\b.{0,60}$
\b(?:kann|könnte|wird|können|könnten|hilft|helfen)\b.{0,40}\b(?:helfen|weiterhelfen|weiter|beantworten|auskunft geben)\b
\b(?:peut|pourra|pourrait|saura|peuvent|pourront)\b.{0,40}\b(?:aider|répondre|renseigner)\b
\b(?:puede|podrá|podría|sabrá|pueden|podrán)\b.{0,40}\b(?:ayudar\w*|responder\w*|contestar\w*|informar\w*)\b
\b(?:может|сможет|могут|смогут|поможет|помогут)\b.{0,40}\b(?:помочь|ответить|подсказать|вам)\b
""".strip().replace("\n", "|")  # fmt: skip
# Frequent words of each language.
STOPWORDS = {
    "en": "the of and to in is are was were it its that this with for on by from has have had not be been as at an a or if which what how why where when who does do can should you your my our they them then than after before under each only so because while will all there",
    "de": "der die das und ist sind war waren es nicht mit für auf von dem den des ein eine einer einem einen im am zu zum zur bei nach vor wird werden wurde hat haben wie was wo wann wer warum welche welcher wenn dass sich auch nur oder aber noch ich sie wir unter jede jeder bis ungefähr um dauert liegt leer vorher seit",
    "fr": "le la les des du de et est sont était il elle que qui dans pour pas avec sur par une un au aux ce cette ces ne se en où quand comment combien quel quelle pourquoi vous je nous mais ou si plus sous chaque jusqu environ avant depuis dès même été peut être",
    "es": "el la los las de del y es son era que en para por con no una un al se su sus lo como cuando dónde cuándo cuántas cuántos qué quién pero o si más sobre desde hasta cada está están fue hay puede ser unos unas este esta muy sin",
    "ru": "и в не на что с по это как для из от до за к у о а но или если когда где кто чем при так же бы был была было были есть нет только уже под над все его её их он она они оно мы вы я ли об со во сколько почему какой",
    "it": "il lo gli i le di del della dei delle e è sono era che per con non una uno un da dal dalla nel nella sul sulla ma o se più come quando dove quanto quale chi perché questo questa viene ogni prima dopo anche sotto",
    "pt": "o os as do da dos das em no na nos nas e é são era que por com não uma um ao à pelo pela mas ou se mais como quando onde quanto qual quem porque este esta cada antes depois também sob até",
    "nl": "de het een van en is zijn was dat die met voor niet op aan er in te bij naar door wordt worden werd heeft hebben maar of als meer hoe wanneer waar wie welke omdat deze dit elke voordat ook onder",
    "pl": "i w nie na się z że do jest to jak po od za o ale lub gdy kiedy gdzie kto który która które przez dla są był była było może tylko już przed jego jej ich co czy każdy",
    "uk": "і в не на що з як це по від до за у о а але або якщо коли де хто який яка які при так був була було є немає тільки вже під над усі його її вони вона воно ми ви чи зі та після скільки чому",
    "bg": "и в не на че с по това как за от до у о а но или ако кога къде кой която които при така беше са е има няма само вече под над всички неговия тя те ние вие ли със във след колко защо се да",
}
#: Languages that each word is a frequent one of.
VOTES: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _word in set(_words.split()):
        VOTES[_word] = (*VOTES.get(_word, ()), _lang)
# Letters that vote for a language, half as much as a word.
TELLING = {"de": "äöüß", "fr": "éàâçèêëîïôùûœ", "es": "ñáíóú¿¡", "it": "àèìòù", "pt": "ãõçáâêó", "pl": "ąćęłńśźż", "ru": "ыэё", "uk": "іїєґ"}
TELLING_LETTERS = re.compile("[" + "".join(sorted(set("".join(TELLING.values())))) + "]")
# Words that can't end a sentence.
DANGLING = {
    "en": "the a an and or of to in with for from by that which because so if between into than then whose while but is are was were as at be not on",
    "de": "der die das den dem des ein eine einen einem einer und oder weil dass wenn mit für von zu im am zum zur bei nach aber sowie ist sind",
    "fr": "le la les un une des du de et ou que qui avec pour dans sur par au aux parce si mais est sont",
    "es": "el la los las un una de del y o que con para por en al porque si pero es son",
    "ru": "и или в на с по для из от до за к у о что как если но а при чтобы потому который",
}
NO_ENDS = {lang: frozenset(words.split()) for lang, words in DANGLING.items()}

OPENERS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "（": "）", "「": "」", "【": "】"}
CLOSERS = frozenset(OPENERS.values())
MARKUP = re.compile(r"<[^<>]*>|&(?:nbsp|#160|#x?0*a0|zwnj|zwj|shy);")
WORD = re.compile(r"\w+(?:['’]\w+)*")
FENCE = re.compile(r"^[ \t]*(```|~~~)", re.M)
QUOTATION = re.compile(r"«[^«»]*»|»[^«»]*«|„[^„“”]*[“”]|“[^“”]*”|\"[^\"]*\"|「[^」]*」|```.*?(?:```|\Z)|`[^`]*`", re.S)
TOKEN = re.compile(r"[A-Za-z0-9_./-]+")
TELLS = re.compile(r"[\d_/]")
#: A token with a telling character; looked for at the beginnings of tokens only, which keeps it linear.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_./-])[A-Za-z.-]*[0-9_/][A-Za-z0-9_./-]*")
SENTENCE = re.compile(r"(?<=[.!?…。！？])[»”\"')\]]*\s+|\n+")
#: Marks that may stand behind a full stop.
CLOSING = "»”“\"'’)]}`*_"
LIST_MARK = re.compile(r"^[ \t]*(?:[-*•+]|\d+[.)])[ \t]+", re.M)
ENDS = re.compile(r"[.!?…。！？]$")
QUOTES = re.compile(r"[«»„“\"「`]")
DELIMITERS = re.compile("[" + re.escape("".join(OPENERS) + "".join(OPENERS.values()) + "\"„`~") + "]")
LETTERS = re.compile(r"[^\W\d_]+")
LAST_MARKS = re.compile(r"(?:^|\n)[ \t]*(?:[-*•+]|\d+[.)])$|[,;:([{«„\-–—/&+=]$")
NUMBER = re.compile(r"[\d.,:%]*\d[\d.,:%]*")
WHOLE_NAME = re.compile(r"\d$|\.[a-z]{2,5}$|^[a-z]+_[a-z]+$")


_UNSEEN = {c: " " if chr(c).isspace() else None for c in (*range(9), *range(11, 32), *range(127, 160))}


def visible(text: str | None) -> str:
    """The text without marks-up and invisible characters, in NFKC."""
    text = text or ""
    if "<" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    if text.isascii():
        return text if text.isprintable() else text.translate(_UNSEEN)
    text = unicodedata.normalize("NFKC", text)
    if text.isprintable():
        return text
    return "".join(" " if c.isspace() else c for c in text if c in "\n\t" or unicodedata.category(c) not in ("Cf", "Cc"))


def without_identifiers(text: str) -> str:
    """The text less file names, paths, numbers and the like: what has a digit, underscore or slash."""
    return IDENTIFIER.sub(" ", text)


#: Letters and digits of the longest stand-in.
LONGEST_STAND_IN = max(map(len, STAND_INS))


def is_empty(text: str, words: list[str]) -> bool:
    """Whether a visible text answers nothing. ``words``: its words."""
    if len(words) > 4 or words and sum(map(len, words)) > LONGEST_STAND_IN:
        return False
    text = text.casefold()
    kept = [i for i, c in enumerate(text) if c.isalnum()]
    return not kept or " ".join(text[kept[0] : kept[-1] + 1].split()) in STAND_INS


class SuffixAutomaton:
    """All word sequences that occur in a question, in linear size."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for word in words:
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                if self.length[p] + 1 == self.length[q]:
                    self.link[new] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(word) == q:
                        self.next[p][word] = clone
                        p = self.link[p]
                    self.link[q] = self.link[new] = clone
            last = new

    def coverage(self, words: list[str]) -> tuple[list[bool], int]:
        """Which words lie in a run of 3 or more (or the whole) shared with the question, and the longest run."""
        runs, state, run, longest = [0] * len(words), 0, 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if word in self.next[state]:
                state, run = self.next[state][word], run + 1
            else:
                run = 0
            longest, runs[i] = max(longest, run), run
        covered, reach = [False] * len(words), 0
        for i in range(len(words) - 1, -1, -1):
            reach = max(reach - 1, runs[i] if runs[i] >= min(3, len(words)) else 0)
            covered[i] = reach > 0
        return covered, longest


def words_of(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def is_copy(question: str, said: list[str]) -> bool:
    """Whether the words of an answer are those of the visible question, in its order, but for labels."""
    folded = question.casefold()
    if not said or any(w not in folded and w not in LABELS for w in said[:3]):
        return False
    asked = WORD.findall(folded)
    if not asked or not set(said).difference(asked) <= LABELS:  # what isn't asked can't be covered
        return False
    covered, longest = SuffixAutomaton(asked).coverage(said)
    rest = [w for w, c in zip(said, covered) if not c]
    return longest >= max(1, 0.6 * len(asked)) and all(w in LABELS for w in rest)


# The scripts told apart, by their ranges of characters.
SCRIPTS = {
    name: re.compile(f"[{ranges}]+")
    for name, ranges in (
        ("latin", "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ"), ("cyrillic", "Ѐ-ԯ"), ("greek", "Ͱ-Ͽἀ-῿"), ("kana", "ぁ-ゖァ-ヿ"), ("han", "一-鿿"), ("hangul", "가-힣"), ("hebrew", "א-ת"), ("arabic", "ء-ۓ"), ("devanagari", "ऄ-ह"), ("thai", "ก-ฮ"),
    )
}


def script_of(text: str) -> dict[str, int]:
    if text.isascii():
        n = sum(map(len, SCRIPTS["latin"].findall(text)))
        return {"latin": n} if n else {}
    counts = {name: sum(map(len, pattern.findall(text))) for name, pattern in SCRIPTS.items()}
    return {name: n for name, n in counts.items() if n}


def bare_text(text: str) -> str:
    """A visible text without quotations and identifiers."""
    return without_identifiers(QUOTATION.sub(" ", text) if QUOTES.search(text) else text)


def main_script(bare: str) -> str | None:
    if bare.isascii():
        return "latin" if LETTERS.search(bare) else None
    scripts = script_of(bare)
    return ("kana" if scripts.get("kana", 0) > 2 else max(scripts, key=scripts.get)) if scripts else None


def language_votes(bare: str) -> dict[str, float]:
    """The votes of the words and letters of a text for each language."""
    votes = dict.fromkeys(STOPWORDS, 0.0)
    folded = bare.casefold()
    for word in LETTERS.findall(folded):
        if word in VOTES:
            for lang in VOTES[word]:
                votes[lang] += 1
    if not folded.isascii():
        telling = "".join(TELLING_LETTERS.findall(folded))
        for lang, letters in TELLING.items() if telling else ():
            votes[lang] += 0.5 * sum(map(telling.count, letters))
    return votes


def other_language(question: str, answer: str) -> bool:
    """Whether a visible answer is written in another language than its question."""
    said_bare, asked_bare = bare_text(answer), bare_text(question)
    said_script, asked_script = main_script(said_bare), main_script(asked_bare)
    if not asked_script or not said_script:
        return False
    if asked_script != said_script:
        letters = {k: n * (2 if k in ("han", "kana", "hangul") else 1) for k, n in script_of(said_bare).items()}  # their characters say more
        total = sum(letters.values())
        return total >= 6 and letters.get(asked_script, 0) < 0.3 * total
    if said_script not in ("latin", "cyrillic"):
        return False
    said = language_votes(said_bare)
    best = max(said, key=said.get)
    if said[best] < 1.5:
        return False
    asked = language_votes(asked_bare)
    own = max(asked, key=asked.get)
    if own == best or asked[own] < 1.5 or asked[best] > 0.7 * asked[own]:
        return False
    # Without a word of the question's language less is enough for another one.
    return said[best] >= (2 * said[own] + 1 if said[own] else 1.5)


_decline = {lang: re.compile("|".join(p.replace("{0}", GAP).replace("{1}", ANSWERING[lang]) for p in patterns)) for lang, patterns in DECLINES.items()}
_filler = re.compile("(?:" + FILLERS + ")")
_referral = re.compile(REFERRALS)
# Words of which one at least is in every sentence that declines; a text without any is not looked at.
MARKS_OF_DECLINING = {
    "en": "can't cannot not won't wouldn't couldn't don't doesn't shouldn't unable forbidden prohibited decline refuse abstain refrain pass rather prefer outside beyond out guidelines policy policies rules instructions inappropriate no denied declined refused comfortable can",
    "de": "nicht keine keinen keinem keiner kein nichts kaum lehne verweigere ablehnen",
    "fr": "ne pas rien impossible interdit défendu préfère préférons préférerais refuse décline m'abstiens refuser décliner m'abstenir j'ai sans",
    "es": "no imposible prefiero preferimos niego debo lamento sin rechazo",
    "ru": "не нельзя запрещено отказываюсь отказываемся воздержусь воздержимся вынужден вынуждена вынуждены предпочёл предпочел предпочитаю предпочла без",
}
MARKED: dict[str, set[str]] = {}
for _lang, _words in MARKS_OF_DECLINING.items():
    for _word in _words.split():
        MARKED.setdefault(_word, set()).add(_lang)


def is_refusal(text: str, words: list[str]) -> bool:
    """Whether every sentence of a visible answer declines, apologises, refers or offers, and one at least declines. ``words``: its words."""
    languages = set().union(*(MARKED[w] for w in MARKED.keys() & set(words)))
    if not languages:
        return False
    text = text.casefold().replace("’", "'").strip()
    patterns, declined = [_decline[lang] for lang in sorted(languages)], False
    for sentence in SENTENCE.split(text):
        s = sentence.strip(" -*\"“”«»'")
        if not s.strip(".!"):
            continue
        if any(p.search(s) for p in patterns):
            declined = True
        elif not _filler.match(s) and not _referral.search(s) or s.endswith(":"):
            return False
    return declined


def delimiters_open(text: str) -> bool:
    """Whether a fence, bracket, quotation or code span is still open at the end: a stack over the delimiters."""
    if not DELIMITERS.search(text):
        return False
    parts = re.split(r"```|~~~", text)
    if len(parts) % 2 == 0:
        return True
    prose = " ".join(parts[0::2])
    stack: list[str] = []
    for found in DELIMITERS.finditer(prose):
        i, c = found.start(), found[0]
        if c == "`":
            stack.pop() if stack and stack[-1] == "`" else stack.append("`")
        elif stack and stack[-1] == "`":
            continue
        elif c == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            elif not prose[i - 1 : i].isdigit():  # else inches or seconds
                stack.append('"')
        elif c == "„":
            stack.append("“”")
        elif c in "“”" and stack and stack[-1] == "“”":
            stack.pop()
        elif c == "»" and "»" not in stack and not prose[i - 1 : i].strip() and prose[i + 1 : i + 2].strip():
            stack.append("«")
        elif c == "«" and stack and stack[-1] == "«":
            stack.pop()
        elif c in OPENERS:
            stack.append(OPENERS[c])
        elif c in CLOSERS and stack and stack[-1] == c:
            stack.pop()
    return bool(stack)


def cut_by_form(answer: str) -> bool | None:
    """Whether the end shows a cut by its form; null where only other answers can tell."""
    text = unicodedata.normalize("NFC", answer).rstrip()
    text = text.rstrip("\u200b\u200c\u200d\u2060\ufeff\xad").rstrip()
    if delimiters_open(text):
        return True
    if LAST_MARKS.search(text):
        return True
    bare = text.rstrip("*_~")
    if bare.endswith(("```", "~~~")) or ENDS.search(bare.rstrip(CLOSING)) or bare[-1:] in CLOSERS or bare[-1:] in "\"'`’":
        return False
    return None


def dangles(answer: str) -> bool:
    """Whether the last word can't end a sentence of the answer's language."""
    words = WORD.findall(answer.rsplit("\n", 1)[-1])
    votes = language_votes(bare_text(answer))
    return len(words) > 1 and any(votes.values()) and words[-1].casefold() in NO_ENDS.get(max(votes, key=votes.get), ())


#: Start of a sentence; what can follow its words: a full stop, an end without one, a comma or the like, a word.
START, END, OPEN_END, PHRASE, NAME, NAME_CUT = "\x02", "\x03", "\x04", "\x05", "\x06", "\x07"
MARKS = "()[]«»“”\"',;:"


def tokens_of(sentence: str) -> list[str]:
    """Words with numbers and identifiers masked, so that sentences of one pattern share their words."""
    words = sentence.split()
    if not TELLS.search(sentence):
        return words
    for i, t in enumerate(words):
        if TELLS.search(t):
            core = t.strip("()[]{}«»“”„\"'`*.,;:!?…")
            if NUMBER.fullmatch(core):
                words[i] = t.replace(core, "#")
            elif TOKEN.fullmatch(core) and TELLS.search(core):
                words[i] = t.replace(core, NAME if WHOLE_NAME.search(core) else NAME_CUT)
    return words


def sentences_of(answer: str) -> list[tuple[list[str], str]]:
    """Masked words of each sentence, the last one without its stop, and how it ends."""
    out = []
    text = answer if answer.isascii() else unicodedata.normalize("NFC", answer)
    for s in SENTENCE.split(LIST_MARK.sub("", text.strip())):
        words = tokens_of(s) if s else []
        if words:
            ended = bool(ENDS.search(s.rstrip("»”\"'’)]`*_ ")))
            words[-1] = words[-1].rstrip("»”\"'’)]`*_.!?…。！？")
            if words := [w for w in words if w]:
                out.append((words, END if ended else OPEN_END))
    return out


LONG, SHORT = 4, 2


SEPARATOR = "\x1f"


def contexts(words: list[str], stop: int) -> tuple[str, str]:
    """The words before ``stop`` without their marks, sentence start included: a long and a short context."""
    before = words[max(0, stop - LONG) : stop]
    padded = [*([START] if stop < LONG else []), *(w.strip(MARKS) or w for w in before)]
    return SEPARATOR.join(["4", *padded[-LONG:]]), SEPARATOR.join(["2", *padded[-SHORT:]])


#: Bits of the filter of contexts that are asked for: 8 MB, whatever the data.
FILTER_BITS = 26


def simple_defect(question: str | None, answer: str | None) -> str | None:
    """The first defect that the pair alone shows; ``?`` where the end has to be held against other answers."""
    text = visible(answer)
    said = words_of(text)
    if is_empty(text, said):
        return "empty"
    asked = visible(question)
    if is_copy(asked, said):
        return "copy"
    if is_refusal(text, said):
        return "refusal"
    if other_language(asked, text):
        return "language"
    cut = cut_by_form(answer)
    return "truncated" if cut else "?" if cut is None else None


def broken_pairs(faq: DataFrame, key: str = "id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(id, defect): one row for each id whose answer is defective, however often it was delivered.

    Defects are ``empty``, ``copy``, ``refusal``, ``language`` and ``truncated``, the first that
    applies in that order. A null or blank question alone is no case; with it an answer can't be a
    copy or in another language. Of several different pairs under one id the alphabetically first
    defect counts. Null ids take no part. An empty table gives no row.
    """
    given = faq.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(question).cast("string").alias("q"), F.col(answer).cast("string").alias("a"))
    pairs = materialize(given.distinct())  # texts are shuffled once; both passes over them read this table

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, q, a in zip(*(c.to_pylist() for c in batch.columns)):
                if (defect := simple_defect(q, a)) is None:
                    continue
                row = [i, defect, None, None, None, None, None, 0, False, False]
                if defect == "?":
                    sentences = sentences_of(a)
                    words, _ = sentences[-1] if sentences else ([], "")
                    alone = len(sentences) < 2 or len(sentences_of(a.strip().rsplit("\n", 1)[-1])) < 2
                    if not words or len(words) == 1 and len(WORD.findall(a)) <= 1:
                        continue
                    row[2:10] = [*contexts(words, len(words)), *contexts(words, len(words) - 1), words[-1].strip(MARKS), len(words), dangles(a), alone]
                out.append(row)
            columns = list(zip(*out)) or [()] * 10
            kinds = [batch.column(0).type, *[pa.string()] * 6, pa.int32(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "defect", "long", "short", "long_before", "short_before", "last", "words", "dangles", "alone"])

    kind = pairs.schema["id"].dataType.simpleString()
    judged = materialize(pairs.mapInArrow(judge, f"id {kind}, defect string, long string, short string, long_before string, short_before string, last string, words int, dangles boolean, alone boolean"))
    asked = judged.where("defect = '?'").select("id", "long", "short", "long_before", "short_before", "last", "words", "dangles", "alone")
    each = asked.select(F.explode(F.array("long", "short", "long_before", "short_before")).alias("context"))
    needed = materialize(each.groupBy("context").agg(F.count("*").alias("asked")))
    wanted = faq.sparkSession.sparkContext.broadcast(context_filter(needed))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        bits, mask = wanted.value, (1 << FILTER_BITS) - 1

        def flush() -> pa.RecordBatch:
            rows = [(c, n, k) for (c, n), k in counts.items()]
            counts.clear()
            columns = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["context", "next", "n"])

        for batch in batches:
            for a in batch.column(0).to_pylist():
                for words, end in sentences_of(a):
                    stripped = [w.strip(MARKS) for w in words]
                    bare = [START, *(s or w for s, w in zip(stripped, words))]
                    ends = [START, *map(SEPARATOR.join, zip(bare, bare[1:]))]  # the short context of each place
                    for j, e in enumerate(ends):
                        slot = crc32(e.encode("utf-8", "surrogatepass")) & mask
                        if not bits[slot >> 3] >> (slot & 7) & 1:
                            continue
                        inner = j < len(words)
                        mark = PHRASE if inner and j and words[j - 1][-1] in ",;:" else ""
                        follower = mark + stripped[j] if inner else end
                        counts[SEPARATOR.join(bare[max(0, j - LONG + 1) : j + 1]), follower] += 1
                if len(counts) > 500_000:
                    yield flush()
        yield flush()

    answers = pairs.where("a is not null").select("a")
    counted = answers.mapInArrow(follow, "context string, next string, n bigint")
    # The short context is the end of the long one.
    both = F.array(F.concat(F.lit("4" + SEPARATOR), "context"), F.concat(F.lit("2" + SEPARATOR), F.substring_index("context", SEPARATOR, -SHORT)))
    followers = counted.select(F.explode(both).alias("context"), "next", "n").groupBy("context", "next").agg(F.sum("n").alias("n"))
    known = materialize(followers.join(needed.select("context"), "context"))
    # A context that is asked for: how often a stop, an open end, a comma or a word follows.
    following = {
        "stops": F.col("next") == END, "opens": F.col("next") == OPEN_END, "phrases": F.col("next").startswith(PHRASE),
        "goes_on": ~F.col("next").isin(END, OPEN_END) & ~F.col("next").startswith(PHRASE),
    }
    by_context = known.groupBy("context").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in following.items()])
    by_context = materialize(needed.join(by_context, "context", "left").na.fill(0))
    # How often the words before the last one are followed by a longer word that starts with it: the
    # followers' beginnings of the lengths that are asked for, so that no two lists meet as pairs.
    lasts = asked.select(F.explode(F.array("long_before", "short_before")).alias("context"), "last").groupBy("context", "last").agg(F.count("*").alias("asked"))
    lasts = materialize(lasts)
    lengths = lasts.groupBy("context").agg(F.collect_set(F.length("last")).alias("lengths"))  # distinct lengths of words
    word = F.ltrim(F.col("next"), F.lit(PHRASE))
    words_on = known.where(~F.col("next").isin(END, OPEN_END)).join(lengths, "context")
    beginnings = F.transform(F.filter("lengths", lambda k: k < F.length(word)), lambda k: F.substr(word, F.lit(1), k))
    shown = F.concat(beginnings, F.when(word == NAME, F.array(F.lit(NAME_CUT))).otherwise(F.array().cast("array<string>")))
    parts = words_on.select("context", "n", F.explode(shown).alias("last")).groupBy("context", "last").agg(F.sum("n").alias("longer"))
    parts = materialize(lasts.join(parts, ["context", "last"], "left").na.fill(0).select(F.struct("context", "last").alias("part"), "longer", "asked"))
    looked = asked
    for side in ("long", "short"):
        looked = hot_aware_lookup(looked, by_context.select(F.col("context").alias(side), "asked", *[F.col(c).alias(f"{side}_{c}") for c in following]), side, "asked")
        looked = looked.withColumn("part", F.struct(F.col(f"{side}_before").alias("context"), "last"))
        looked = hot_aware_lookup(looked, parts.select("part", "asked", F.col("longer").alias(f"{side}_longer")), "part", "asked").drop("part")
    n = {c: F.col(c) for c in looked.columns}
    # A full stop, or a comma, after the same words elsewhere: they are whole.
    whole_long, whole_short = (n[f"{side}_stops"] + n[f"{side}_phrases"] for side in ("long", "short"))
    seen_long, seen_short = whole_long + n["long_goes_on"], whole_short + n["short_goes_on"]
    cut = (
        F.when(seen_long >= 3, whole_long < 0.15 * seen_long)
        .when((n["long_longer"] >= 2) & (n["long_longer"] >= n["long_opens"]), True)
        .when(F.col("dangles"), True)
        .when(F.col("alone") & (F.col("words") <= 3), False)
        .when(F.col("alone") & (n["long_opens"] >= 2) & (n["long_goes_on"] == 0), False)
        .when((n["short_longer"] >= 3) & (whole_short == 0), True)
        .when(seen_short >= 3, whole_short < 0.3 * seen_short)
        .otherwise(True)
    )
    by_others = looked.where(cut).select("id", F.lit("truncated").alias("defect"))
    return judged.where("defect <> '?'").select("id", "defect").unionByName(by_others).groupBy("id").agg(F.min("defect").alias("defect"))


def context_filter(needed: DataFrame) -> bytes:
    """A filter of :data:`FILTER_BITS` address bits that has the last two words of every context; a bounded number of words is collected."""
    parts = F.slice(F.split("context", SEPARATOR), 2, LONG)
    ends = F.array_join(F.slice(parts, F.greatest(F.size(parts) - SHORT + 1, F.lit(1)), SHORT), SEPARATOR)
    slot = F.crc32(F.encode(ends, "UTF-8")).bitwiseAND((1 << FILTER_BITS) - 1)
    bytes_ = needed.select((slot / 8).cast("bigint").alias("at"), F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (slot.bitwiseAND(7) + 1).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    out = bytearray(1 << (FILTER_BITS - 3))
    for batch in bytes_.toArrow().to_batches():
        for at, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out[at] = bits
    return bytes(out)
