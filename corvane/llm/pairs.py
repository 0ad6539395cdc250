"""Defective prompt and answer pairs.

A suffix automaton over the prompt's words is traversed with the answer's words; the share of the answer
covered by copied runs tells copies. Refusals are told by a finite automaton over word classes (self,
negation, modal, act, decline, rule, bound): every sentence must decline or be courtesy. A delimiter stack
finds open fences, brackets and strings, and stopword votes name the languages.

Defined cases: a null, blank or missing answer is ``empty``; a null or blank prompt can give neither
``copied`` nor ``wrong_language``; an answer of fewer words than ``MIN_MATCH`` is a copy only of a prompt of
the same words; repeated rows change nothing (the least and greatest ``turn_no`` decide, ties by
``turn_id``); texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.minwise import words

DEFECTS = ("empty", "copied", "refusal", "wrong_language", "truncated")
#: Shortest run of the prompt, in words, that counts as copied; most words of an opening; most other words.
MIN_MATCH, OPENING, LOOSE, LOOSE_SHARE = 3, 8, 4, 0.12

# --- prompt suffix automaton --------------------------------------------------------------------


class SuffixAutomaton:
    """Of a word sequence; linear in its length."""

    def __init__(self, seq: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        last = 0
        for w in seq:
            cur = len(self.next)
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.len.append(self.len[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, seq: list[str], least: int) -> list[bool]:
        """Which words of ``seq`` lie in a run of at least ``least`` words that the automaton's text holds."""
        marks = [False] * len(seq)
        state = length = 0
        done = 0
        for i, w in enumerate(seq):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            else:
                state = length = 0
            if length >= least:
                for k in range(max(done, i - length + 1), i + 1):
                    marks[k] = True
                done = i + 1
        return marks


_JOIN = re.compile(r"(?<=\w)[^\w\s]+(?=\w)")


def _forms(text: str) -> Iterator[list[str]]:
    yield words(text)
    yield words(_JOIN.sub("", text))


def is_copy(prompt: str, answer: str) -> bool:
    """Whether the answer holds nothing but runs of the prompt, apart from an opening and a few words."""
    for p, a in zip(_forms(prompt), _forms(answer)):
        if not a or not p:
            continue
        if len(a) < MIN_MATCH:
            if a == p:
                return True
            continue
        few = max(min(LOOSE, len(a) // 4), LOOSE_SHARE * len(a))
        known = set(p)
        # fewer words outside the prompt than this can never be covered
        if sum(w not in known for w in a) > OPENING + few:
            continue
        marks = SuffixAutomaton(p).covered(a, min(MIN_MATCH, len(p)))
        first = next((i for i, m in enumerate(marks) if m), len(marks))
        if first <= OPENING and first < len(a) / 2 and sum(not m for m in marks[first:]) <= few:
            return True
    return False


# --- refusals -----------------------------------------------------------------------------------

#: Word classes of declining sentences, by stem; a stem ends in * where more may follow.
CLASSES = {
    "S": "i me my myself mine we us our im ill id ive assistant* model ai я мне меня мной мой моя моё моим моих моими мою мы нам нас наш* помощник* ассистент* модель ich mir mich mein* wir uns unser*",
    "N": "not no cannot cant wont couldnt mustnt shouldnt wouldnt dont neither never nothing none unable не нет ни нельзя ничего ничем никак нельзя nicht kein* nichts nie niemals ohne",
    "M": "вынужден* have has нельзя way chance ability can cant cannot could couldnt may might able will wont would wouldnt shall should shouldnt must mustnt unable willing comfortable allowed permitted free going prefer rather supposed дают даёт даст дадут позвол* разреш* положено полагается дозвол* могу можем мог смогу сможем буду будем стану станем способ* готов* вправе имею право права предпоч* возможн* kann können könnte darf dürfen werde werden möchte* in erlaubt gestattet befugt bereit möglich",
    "A": "help* assist* answer* comply do doing fulfil* provid* carry carried take taken undertake act acting action proceed support* respond* discuss* share perform* continue* engage* process* handle execut* offer* give given oblige go помо* ответ* отвеч* сдела* дела* выполн* исполн* обсу* предостав* предпри* да* да́ть брать* взять* браться заним* занять* содейств* обработ* продолж* выда* сообщ* helfen helf* hilfe beantwort* antwort* tun machen ausführ* unterstütz* bereitstell* übernehm* liefern dienen weiterhelf*",
    "K": "keep* prevent* stop* hinder* forbid*",
    "D": "declin* refus* reject* forbid* forbad* forbidden prohibit* disallow* barred abstain* refrain* отказ* отклон* запрещ* запрет* воздерж* отверг* ablehn* lehne verweiger* untersag* verboten verwehrt ab",
    "G": "against violat* contraven* breach* contrary conflict* против* наруш* gegen verstö* verstoß* widersp*",
    "R": "policy policies rule* guideline* principle* instruction* terms standards правил* политик* принцип* инструкц* огранич* услов* richtlinie* regel* vorgab* grundsätz* vorschrift*",
    "O": "outside beyond out off вне предел* рамки рамок за außerhalb jenseits über",
    "B": "scope remit limits bounds mandate purview what responsib* permission* рамки рамок допуст* пределы пределов полномоч* компетенц* дозволен* доступн* недоступ* закрыт* zuständigkeit* rahmen grenze* befugnis* möglichkeiten",
}
#: A self that is not able or willing to act; declining; acting against rules; lying outside bounds.
DECLINES = r"M.{0,2}S.{0,2}N.{0,3}A|N.{0,1}S.{0,1}M.{0,2}A|S.{0,4}M.{0,2}N.{0,6}A|S.{0,4}N.{0,2}M.{0,6}A|A.{0,4}S.{0,3}N.{0,1}M|A.{0,4}S.{0,3}M.{0,1}N|N.{0,3}A.{0,3}M|S.{0,5}M.{0,2}N.{0,8}$|D.{0,8}S|S.{0,8}D|M.{0,3}D|N.{0,2}M.{0,3}S|S.{0,3}N.{0,1}M|G.{0,4}R|O.{0,4}B|B.{0,4}S|S.{0,3}NN.{0,1}A|M.{0,1}N.{0,4}S|R.{0,3}K.{0,1}S|R.{0,3}S.{0,4}N.{0,2}[MA]|R.{0,3}N.{0,2}[MA]|D.{0,4}R"


class DeclineAutomaton:
    """Classes of the words of a sentence, run through the automaton of ``DECLINES``."""

    def __init__(self) -> None:
        self.whole: dict[str, str] = {}
        self.stems = ahocorasick.Automaton()
        for k, names in CLASSES.items():
            for n in names.split():
                if n.endswith("*"):
                    self.stems.add_word(" " + n[:-1], k)
                else:
                    self.whole[n] = self.whole.get(n, "") + k
        self.stems.make_automaton()
        self.declines = re.compile(DECLINES)
        self.known: dict[str, str] = {}

    def classes(self, word: str) -> str:
        if word not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = "".join(dict.fromkeys(self.whole.get(word, "") + "".join(k for _, k in self.stems.iter(" " + word)))) or "."
        return self.known[word]

    def declines_in(self, ws: list[str]) -> bool:
        return self.declines.search("".join(map(self.classes, ws))) is not None


CLOSING = """i hope you understand|human operator should|is there anything else|anything else you need|what i can offer|general advice|other topics|
please contact|please consult|sorry for|i apologize|apologies|i'm sorry|thank you for|thanks for|i appreciate|feel free|let me know|
надеюсь на понимание|чем-то ещё|чем-то еще|обратитесь к|займётся оператор|займется оператор|к оператору|к специалисту|могу предложить|общий совет|общие советы|другие темы|другую тему|прошу прощения|извините|к сожалению|спасибо за|
приношу извинения|сожалею|понимаю задачу|tut mir leid|entschuldig|bitte wenden|ich bitte um verständnis|kann ich sonst|gern helfe ich|leider"""


_AUTO: dict[str, ahocorasick.Automaton | DeclineAutomaton] = {}
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_CONTRACTED = re.compile(r"(?<=\w)'(?=\w)")


def _automata() -> tuple[DeclineAutomaton, ahocorasick.Automaton]:
    if not _AUTO:
        closing = ahocorasick.Automaton()
        for p in CLOSING.replace("\n", "").split("|"):
            closing.add_word(p, p)
        closing.make_automaton()
        _AUTO.update(r=DeclineAutomaton(), c=closing)
    return _AUTO["r"], _AUTO["c"]


def declines(sentence: str) -> bool:
    return _automata()[0].declines_in(words(_CONTRACTED.sub("", sentence.lower().replace("’", "'"))))


def is_refusal(answer: str) -> bool:
    """Whether every sentence declines or is mere courtesy, and at least one declines."""
    other, declined = 0, False
    for part in _SENTENCE.split(answer.lower().replace("’", "'")):
        ws = words(_CONTRACTED.sub("", part))
        if not ws:
            continue
        if _automata()[0].declines_in(ws):
            declined = True
        elif next(_automata()[1].iter(part), None) is None:
            other += len(ws)
            if other > LOOSE:
                return False
    return declined


# --- languages ----------------------------------------------------------------------------------

STOPWORDS = {
    "en": frozenset("the a an and or of to in on at for with from by is are was were be been it this that as not but so than then which what when while because has have had only yet both its under over".split()),
    "de": frozenset("der die das und oder von zu in im auf an am für mit aus bei ist sind war waren wird werden nicht aber als wie wenn dass ein eine einen einem der den dem des wir ihn sie es daher bleibt nach vor ohne während genau".split()),
    "ru": frozenset("и в во не на с со что как по из за к от до для или но а же если то так его её их был была было при без через после перед уже ещё про чтобы рядом раньше только".split()),
}
_ASKED = re.compile(
    r"\b(?:in|into|to|auf|ins?)\s+(?:plain\s+|simple\s+)?(english|russian|german|englisch\w*|russisch\w*|deutsch\w*)\b|\b(по-(?:русски|английски|немецки))\b"
    r"|\bна\s+(?:чист\w+\s+|прост\w+\s+)?(русск\w+|английск\w+|немецк\w+)|\b(english|russian|german)\s+(?:version|answer|summary|reply|translation|please)\b|\btranslat\w+\b|\bперевед\w+\b|\bперевод\w*\b|\bübersetz\w+\b",
    re.I,
)
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_PATHISH = re.compile(r"\S*[/_\\]\S*|\b\S+\.(?:py|md|toml|ya?ml|json|txt|sh)\b")


def language(text: str) -> str | None:
    """en, de or ru by stopword votes, the script deciding where votes are few; None if unclear."""
    ws = words(_PATHISH.sub(" ", _FENCED.sub(" ", text)))
    letters = [w for w in ws if w.isalpha()]
    if len(letters) < 3:
        return None
    cyr = sum("а" <= w[0] <= "я" or w[0] == "ё" for w in letters)
    if cyr * 2 > len(letters):
        return "ru"
    en, de = (sum(w in STOPWORDS[k] for w in letters) for k in ("en", "de"))
    de += sum(any(c in "äöüß" for c in w) for w in letters)
    if en == de:
        return None
    return "en" if en > de else "de"


def asks_other_language(prompt: str) -> bool:
    return _ASKED.search(prompt) is not None


# --- truncation ---------------------------------------------------------------------------------

_PAIR = {")": "(", "]": "[", "}": "{"}
_DANGLING = frozenset(
    """and or but the a an of to in on at for with from by because so that which means if when while than as then yet only its is was are were nor whether until unless
    и или но а что чтобы потому это значит если когда пока то как для при без из за к от до на в во с со не же ли через после перед про затем который которая
    und oder aber der die das dass weil wenn mit von zu im in auf an am für ein eine einen den dem des als wie daher""".split()
)
#: Openings of a clause that cannot end after so few words.
_OPEN_CLAUSE = re.compile(r"(?:\bso that|\bin order to|\bwhich means|\bчтобы|\bтак что|\bэто значит|\bсо? учётом|\bпо мере|\bв случае|\bdamit|\bso dass)(?:\s+\w+){0,2}$", re.I)
_ITEM = re.compile(r"^\s*(?:[-*•]|\d{1,3}[.)])\s+(.*)$")
_COMPLETE_TAIL = re.compile(r"(?:→|->|=>)\s*(?:\S+\s+)?[0-9a-f]{5,40}$|\S*[/\\]\S*\.[A-Za-z]\w{0,5}$|^\s*[-*•]\s+\S+$|^\s*\|.*\|$|</\w+>$|https?://\S+$|^#+ .*$")
_TERMINAL = ".!?…。»)\"'”`*|}];>"


def open_delimiters(code: str) -> bool:
    """Whether brackets or a double-quoted string stay open at the end."""
    stack: list[str] = []
    quoted = False
    skip = False
    for c in code:
        if skip:
            skip = False
        elif quoted:
            skip = c == "\\"
            quoted = c not in '"\n'
        elif c == '"':
            quoted = True
        elif c in "([{":
            stack.append(c)
        elif c in _PAIR and stack and stack[-1] == _PAIR[c]:
            stack.pop()
    return quoted or bool(stack)


def is_truncated(answer: str) -> bool:
    s = answer.rstrip()
    if s.count("```") % 2:
        return True
    blocks = s.split("```")
    if len(blocks) > 1 and not blocks[-1].strip():
        return False
    tail = blocks[-1].strip()
    if tail[:1] in "{[" and open_delimiters(tail):
        return True
    last = tail.split("\n")[-1].strip()
    if _COMPLETE_TAIL.search(last):
        return False
    item = _ITEM.match(last)
    ends = s[-1]
    if ends in _TERMINAL:
        return bool(item) and not words(item.group(1))
    if ends in ",:–—(-[{" or item and not words(item.group(1)):
        return True
    ws = words(last)
    if ws and ws[-1] in _DANGLING or _OPEN_CLAUSE.search(last):
        return True
    sentence = re.split(r"(?<=[.!?…])\s+", last)[-1]
    before = tail[: len(tail) - len(sentence)]
    # prose whose earlier sentences end with a stop and whose last does not
    return re.search(r"[^\W_]{2}[.!?…](?:\s|$)", before) is not None


# --- the operator -------------------------------------------------------------------------------

_NOTHING = frozenset("null none nil na nan undefined empty void blank пусто пустой пустая leer".split())


def is_empty(answer: str | None) -> bool:
    if not answer:
        return True
    ws = words(answer)
    return not ws or len(ws) <= 2 and "".join(ws) in _NOTHING


def defect(prompt: str | None, answer: str | None) -> str | None:
    """The pair's defect; the first of ``DEFECTS`` that holds."""
    if is_empty(answer):
        return "empty"
    asked = bool(prompt and prompt.strip())
    if asked and is_copy(prompt, answer):
        return "copied"
    if is_refusal(answer):
        return "refusal"
    if asked:
        p, a = language(prompt), language(answer)
        if p and a and p != a and not asks_other_language(prompt):
            return "wrong_language"
    return "truncated" if is_truncated(answer) else None


def prompt_answer_pairs(turns: DataFrame) -> DataFrame:
    """(episode_id, prompt, answer): first user turn and last assistant text turn."""
    user = F.col("role") == "user"
    text = (F.col("role") == "assistant") & (F.col("kind") == "text")
    at = F.struct("turn_no", "turn_id")
    return (
        turns.where(user | text)
        .where("episode_id IS NOT NULL")
        .groupBy("episode_id")
        .agg(F.min_by("content", F.when(user, at)).alias("prompt"), F.max_by("content", F.when(text, at)).alias("answer"))
    )


def defects(turns: DataFrame) -> DataFrame:
    """(episode_id, defect) of each defective pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [defect(p, a) for p, a in zip(b["prompt"], b["answer"])]
            out = pd.DataFrame({"episode_id": b["episode_id"], "defect": found})
            yield out[out["defect"].notna()]

    return prompt_answer_pairs(turns).mapInPandas(run, "episode_id string, defect string")
