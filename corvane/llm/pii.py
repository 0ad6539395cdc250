"""Personal data in free text: proposal by pattern, confirmation by checksum, weighing by context.

Patterns propose spans with a score that alone is below ``ACCEPT`` for numbers and for names outside the
lists. Validators lift it (Luhn, mod 97, mod 101, mod 11 of identity numbers; numbering plans of phone
numbers; case agreement of Russian names), so do words near the span (key words of documents, telephone
words, persons' roles and verbs), while words of tickets, builds and the like and ordinary words in a
name lower it. Spans at or above ``ACCEPT`` stand, the higher score winning where spans overlap. Texts
are scanned in a copy of equal length in which look-alike characters and JSON escapes are plain, so
offsets hold for the original.

Ordinary words are the lower-case words of a public tokenizer's vocabulary (``VOCABULARY``, a parameter).
The operators stop where that file is missing or unreadable: without it only names with a listed given name,
an initial or Russian endings are found. Who wants just those names a path without a file; a warning says so.

Defined cases: null, empty and blank texts have no spans; texts of any length are scanned whole;
repeated rows (same ``turn_id``) count once; other columns are ignored or passed through.
"""

from __future__ import annotations

import base64
import os
import re
import warnings
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPT = 0.5
#: Vocabulary whose lower-case words are no names, and the shortest word it tells anything about.
VOCABULARY, LEAST_WORD = "/opt/tokenizers/byte_bpe_50k.tiktoken", 3
TYPES = ("email", "phone", "id_number", "address", "name")

# --- validators ---------------------------------------------------------------------------------


def digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def luhn(d: str) -> bool:
    """Luhn check digit, e.g. Canadian and Swedish personal numbers."""
    if len(d) < 2:
        return False
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def mod97(d: str) -> bool:
    """Two check digits 97 - (rest mod 97), e.g. Belgian and French personal numbers."""
    return len(d) in (11, 15) and 97 - int(d[:-2]) % 97 == int(d[-2:])


def mod101(d: str) -> bool:
    """Russian pension insurance number."""
    return len(d) == 11 and sum(int(c) * (9 - i) for i, c in enumerate(d[:9])) % 101 % 100 == int(d[9:])


def mod11(d: str) -> bool:
    """Russian taxpayer number of a person."""
    if len(d) != 12:
        return False
    w = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
    a = sum(x * int(c) for x, c in zip(w[1:], d)) % 11 % 10
    b = sum(x * int(c) for x, c in zip(w, d)) % 11 % 10
    return a == int(d[10]) and b == int(d[11])


# --- word lists ---------------------------------------------------------------------------------

GIVEN_LATIN = frozenset(
    """adam agnes alan albert alex alexander alice alma amelia amy andrea andreas andrew angela anja anna anne anton
    arthur barbara ben benjamin bernd birgit brian bruno carl carla carlos caroline catherine charles charlotte chris
    christian christine claudia clara daniel david diana dieter dora edda edgar edith edward elena elias elisabeth elizabeth
    ella emil emily emma eric erik ernst eva felix frank franz fred frieda gabriel george georg gerald gisela greta
    hannah hans harald harry heidi heike helen helga henry herbert hugo ida ines ingrid iris isabel ivan ivo jack jacob
    jakob james jan jane jason jennifer jessica joan johan johann john jonas jonathan joseph julia julian jutta karen karin
    karl kate katrin kevin klaus kurt larry laura lars lea lena leo leon leonie linda lisa louis lucas lucy luis lukas
    manfred manuel marco maria marie mark markus martha martin mary matthew matthias max melanie mia michael mira monika
    nadia nancy nicholas nick nicole nina noah nora olaf oliver olivia oscar oskar otto patricia patrick paul peter petra
    philip pia rachel ralf rebecca richard robert roger rosa rufus ruth ryan sabine sally sam samuel sandra sara sarah
    sebastian silas simon sofia sophie stefan stella stephen steven sven susan susanne talia tanja thea theodor thomas tim
    timothy tobias tom ulrich ursula uwe vera victor victoria walter werner wilhelm william wolfgang yvonne zoe""".split()
)
GIVEN_CYRILLIC = frozenset(
    """александр александра алексей алина алиса алла анастасия анатолий андрей анна антон антонина аркадий артём артем богдан
    борис вадим валентин валентина валерий валерия варвара василий василиса вера вероника виктор виктория виталий владимир
    владислав всеволод вячеслав галина геннадий георгий герман глеб григорий давид данила даниил дарья денис диана дмитрий
    евгений евгения егор екатерина елена елизавета ефим жанна захар зинаида зоя иван игорь илья инна иннокентий ирина иосиф
    кира кирилл клавдия константин ксения лариса лев леонид лидия лилия любовь людмила макар максим маргарита марина мария
    марк матвей майя милана михаил надежда наталья наталия никита николай нина нонна оксана олег олеся ольга павел пётр петр
    платон полина прохор раиса регина римма родион роман руслан савелий светлана семён семен сергей софия софья станислав
    степан тамара тарас татьяна тимофей тимур ульяна фаина фёдор федор филипп эдуард элла эльвира эмма юлия юрий яков яна
    ярослав ярослава""".split()
)


def _declined(name: str) -> set[str]:
    """Case forms of a Russian given name."""
    if name[-1] == "а":
        return {name[:-1] + e for e in ("а", "ы", "и", "е", "у", "ой")}
    if name[-1] == "я":
        return {name[:-1] + e for e in ("я", "и", "е", "ю", "ей")}
    if name[-1] in "йь":
        return {name, *(name[:-1] + e for e in ("я", "ю", "ем", "е", "и", "ём"))}
    forms = {name, *(name + e for e in ("а", "у", "ом", "е"))}
    if name == "лев":
        forms |= {"льва", "льву", "львом", "льве"}
    if name in ("пётр", "павел"):
        stem = {"пётр": "петр", "павел": "павл"}[name]
        forms |= {stem + e for e in ("а", "у", "ом", "е")}
    return forms


GIVEN = GIVEN_LATIN | frozenset(f for n in GIVEN_CYRILLIC for f in _declined(n))

#: Words that follow or precede a given name or an initial without being a surname.
NOT_SURNAME = frozenset(
    """the a an and or but if in on at to of for from by with as is are was were be been it its this that these those there
    then than when while where who why how what which will would can could shall should may might must do does did has have
    had not no yes so we you he she they i my your his her our their asked said says sent wants will wrote about after again
    also all any because before both call contact dear each every finally first here hello hi however into last later meanwhile
    moving near next nobody once only over please put remote review run second set since some still such team text thanks
    today tomorrow under until up use used using via well yesterday yet plan board badge mail list box form code
    и в во на не но а к ко с со у о об от до за из по под над при про для без как что чтобы это этот эта эти тот та те
    он она они мы вы я его её их мой наш ваш свой бы ли же или если когда пока где кто чем так уже ещё еще потом затем
    вчера сегодня завтра снова может нужен нужна нужно привет здравствуйте спасибо кандидат команда отчёт отчет смена счёт
    контакт адрес письмо автор""".split()
)
_OPENERS = NOT_SURNAME

# --- patterns -----------------------------------------------------------------------------------

_ODD_CHARS = "＠．＋－‐‑‒–−\u00a0\u2007\u202f\u2009（）０１２３４５６７８９"
_PLAIN = {ord(a): b for a, b in zip(_ODD_CHARS, "@.+------    ()0123456789")}
_ODD = re.compile(f"[{_ODD_CHARS}]")
_ESC = re.compile(r"\\[nrt\"/]")
_INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")

_LOCAL, _LABEL = r"[\w%+\-]+(?:\.[\w%+\-]+)*", r"[^\W_](?:[\w\-]*[^\W_])?"
EMAIL_PLAIN = re.compile(rf"(?<![\w.+%\-])({_LOCAL})@((?:{_LABEL}\.)+[^\W\d_]{{2,24}})(?![\w@])", re.I)
EMAIL_SPACED = re.compile(rf"(?<![\w.+%\-])({_LOCAL}) {{1,2}}@ {{1,2}}({_LABEL}(?: {{0,2}}\. {{0,2}}{_LABEL})*? {{0,2}}\. {{0,2}}[^\W\d_]{{2,24}})(?!\w)", re.I)
EMAIL_WORDS = re.compile(
    rf"(?<![\w.+%\-])({_LOCAL})\s?[\[({{<]\s?(?:at|собака|ät)\s?[\])}}>]\s?"
    rf"({_LABEL}(?:(?:\.|\s?[\[({{<]\s?(?:dot|точка|punkt)\s?[\])}}>]\s?){_LABEL})*(?:\.|\s?[\[({{<]\s?(?:dot|точка|punkt)\s?[\])}}>]\s?)[^\W\d_]{{2,24}})(?!\w)",
    re.I,
)
EMAIL_BARE = re.compile(rf"(?<![\w.+%\-])({_LOCAL}) (?:at|собака) ({_LABEL}(?: (?:dot|точка) {_LABEL})+)(?!\w)", re.I)
#: Accounts of repositories and robots.
SERVICE = frozenset("git hg svn gitlab noreply no-reply donotreply mailer-daemon".split())

_B, _E = r"(?<![\w+.,:/\-])", r"(?![\w]|[.,:/\-]\d)"
PHONE_PLUS = re.compile(r"(?<![\w+])\+ ?\d(?:[ ().\-/]{0,3}\d){7,14}(?: ?(?:x|ext\.? ?|доб\.? ?)\d{1,5})?(?!\d)", re.I)
PHONE_EIGHT = re.compile(rf"{_B}8[ \-]?\(?\d{{3}}\)?[ \-]?\d{{3}}[ \-]?\d{{2}}[ \-]?\d{{2}}(?: ?доб\.? ?\d{{1,5}})?{_E}")
PHONE_NANP = re.compile(rf"{_B}(?:1[ .\-])?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .\-])[2-9]\d\d[ .\-]\d{{4}}(?: ?(?:x|ext\.? ?)\d{{1,5}})?{_E}", re.I)
PHONE_ZERO = re.compile(rf"{_B}0\d{{2,4}}[ /\-]\d{{3,8}}(?:[ \-]\d{{2,4}})?{_E}|{_B}\(0\d{{2,4}}\) ?\d{{3,8}}(?:[ \-]\d{{2,4}})?{_E}")
PHONE_RU10 = re.compile(rf"{_B}\(\d{{3}}\) ?\d{{3}}-\d{{2}}-\d{{2}}{_E}")
PHONE_BARE = re.compile(rf"{_B}[78]?[2-9]\d{{9}}{_E}")


def _dialled(number: str, n: int) -> bool:
    """Numbering plan: trunk or country code and length, or area and exchange codes that do not begin with 0 or 1."""
    d = digits(re.split(r"(?i) ?(?:x|ext|доб)", number)[0])
    if number.lstrip()[:1] == "+":
        return n >= 9 and d[0] != "0"
    if d[0] == "0":
        return n in (10, 11) and d[1] != "0"
    return n == 11 and d[0] in "178" or n == 10 and (d[0] not in "01" and d[3] not in "01" or number[0] == "(")


_PHONES = (
    (PHONE_PLUS, 0.4, _dialled), (PHONE_EIGHT, 0.4, _dialled), (PHONE_NANP, 0.35, _dialled), (PHONE_ZERO, 0.3, _dialled),
    (PHONE_RU10, 0.3, _dialled), (PHONE_BARE, 0.0, _dialled),
)

_ID_KEY = (
    r"ssn|social security(?: (?:number|no\.?|nr\.?))?|my social|passport|driver[’']?s?[’']? licen[cs]e|driving licen[cs]e|"
    r"national id(?:entity)?(?: card)?|national insurance|identity card|id card|insurance number|taxpayer|tax id|tax number|"
    r"personalausweis|reisepass|pass(?:-?nr\.?|nummer)|führerschein|steuer(?:-?id|-?nummer|identifikationsnummer)|sozialversicherungs(?:-?nr\.?|nummer)|rentenversicherungsnummer|"
    r"паспорт[а-яё]*|загранпаспорт[а-яё]*|снилс|инн|водительск[а-яё]+ (?:удостоверени[а-яё]+|прав[а-яё]+)|удостоверени[а-яё]+ личности|"
    r"полис[а-яё]*(?: омс)?|страхов[а-яё]+ (?:номер[а-яё]*|свидетельств[а-яё]+)"
)
_ID_LINK = r"(?:[\s:=#№\"',]|no\.?|nr\.?|number|nummer|is|id|card|номер[а-яё]*|сери[а-яё]+|физлица|гражданина|рф|выдан[а-яё]*){0,8}"
ID_KEYED = re.compile(rf"(?<![^\W_])(?:{_ID_KEY})(?![^\W_]){_ID_LINK}(?<![^\W_])([a-zа-я]{{0,3}} ?\d[\da-z]*(?:[ \-№/]{{1,3}}\d[\da-z]*)*)(?![^\W_])", re.I)
ID_NEAR = re.compile(rf"(?<![^\W_])(?:{_ID_KEY})(?![^\W_])[^\n]{{0,60}}?(?<![\w\-])(\d[\d \-./]{{5,20}}\d)(?![\w\-])", re.I)
ID_KEY_WORD = re.compile(rf"(?<![^\W_])(?:{_ID_KEY})(?![^\W_])", re.I)
ID_FORM = re.compile(r"(?<![\w\-])(\d{3}-\d{3}-\d{3}[ \-]\d{2}|\d{12}|\d{11}|\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2})(?![\w\-])")

_STREET_RU = r"(?:ул\.?|улиц[аеыу]|пр-т|пр-кт|просп\.?|проспект[ае]?|пер\.?|переул(?:ок|ка|ке)|б-р|бульвар[ае]?|шоссе|ш\.|наб\.?|набережн(?:ая|ой)|пл\.?|площад[ьи]|проезд[ае]?|туп\.?|тупик[ае]?|алле[яи]|линия|мкр\.?|микрорайон[ае]?)"
_NAME_RU = r"(?:(?:\d{1,3}-?[а-я]{0,2} )?[А-ЯЁ][А-Яа-яЁё\-]+(?: [А-ЯЁа-яё][А-Яа-яЁё\-]+){0,3})"
ADDR_RU = re.compile(rf"(?<![\w/]){_STREET_RU}\s*{_NAME_RU},?\s*(?:(?:д\.?|дом)\s*)?№?\d{{1,4}}[а-я]?(?![\w])(?:[,/\s\-]*(?:корп\.?|к\.|стр\.|кв\.|оф\.)?\s*\d{{1,4}})*", re.I)
ADDR_RU_SUFFIX = re.compile(rf"(?<![\w/]){_NAME_RU} (?:улица|проспект|переулок|бульвар|шоссе|набережная|площадь|проезд|аллея),?\s*(?:(?:д\.?|дом)\s*)?\d{{1,4}}(?!\w)", re.I)
ADDR_RU_TOWN = re.compile(rf"(?<![^\W_])(?:г\.|гор\.|город|пос\.|с\.|дер\.)\s*{_NAME_RU},\s*{_NAME_RU},?\s*(?:(?:д\.?|дом)\s*)?\d{{1,4}}[а-я]?(?:\s*[-/]\s*\d{{1,4}})?(?!\w)", re.I)
_TOWN_BEFORE = re.compile(r"(?:\d{6},\s*)?(?:(?:г\.|гор\.|город[ае]?|пос\.|дер\.)\s*)?[А-ЯЁ][А-Яа-яЁё\-]+(?: [А-ЯЁ][А-Яа-яЁё\-]+){0,2}\s*,\s*$|\d{6},\s*$")
_TOWN_AFTER = re.compile(r"\s*,\s*(?:(?:г\.|гор\.|город|пос\.|дер\.)\s*)?[А-ЯЁ][А-Яа-яЁё\-]+(?: [А-ЯЁ][А-Яа-яЁё\-]+)?(?:,\s*\d{6})?")
_STREET_EN = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Boulevard|Blvd|Court|Ct|Close|Terrace|Drive|Dr|Way|Place|Pl|Square|Sq|Crescent|Gardens|Row|Grove|Hill|Mews|Parade|Park|Walk|Rise)"
_WORD_EN = r"[A-Z][A-Za-z'’\-]+"
_UNIT_EN = r"(?:Apt|Apartment|Flat|Unit|Suite|Room|#)\.? ?\d+[A-Z]?"
ADDR_EN = re.compile(rf"(?<![\w/\-.])(?:{_UNIT_EN},? )?\d{{1,5}}[A-Za-z]? {_WORD_EN}(?: {_WORD_EN}){{0,2}} {_STREET_EN}\b\.?(?:,? {_UNIT_EN})?,? {_WORD_EN}(?: {_WORD_EN}){{0,2}}(?:,? [A-Z]{{0,3}} ?\d{{4,6}})?")
ADDR_EN_CAPS = re.compile(rf"(?<![\w/\-.])(?:{_UNIT_EN},? )?\d{{1,5}}[A-Z]? [A-Z][A-Z'’\-]+(?: [A-Z'’\-]+){{0,2}} {_STREET_EN}\b\.?(?:,? {_UNIT_EN})?,? [A-Z][A-Z'’\-]+(?: [A-Z'’\-]+){{0,2}},? \d{{4,6}}(?!\w)", re.I)
ADDR_DE = re.compile(
    r"(?<![\w/\-.])[A-ZÄÖÜ][\wÄÖÜäöüß\-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig|pfad|chaussee|hof|wall)\s*\d{1,4} ?[a-z]?,?\s*(?:D-)?\d{4,5}\s+[A-ZÄÖÜ][\wäöüß\-]+",
    re.I,
)

_LETTERS = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_EN_INITIAL = r"(?<![\w.&])[A-Z]\. ?(?:[A-Z]\. ?)?"
NAME_INITIAL_FIRST = re.compile(r"(?<![\w.])([A-ZА-ЯЁ])\. ?(?:[A-ZА-ЯЁ]\. ?)?([A-ZА-ЯЁ][a-zа-яёäöüß]+(?:-[A-ZА-ЯЁ][a-zа-яё]+)?|[A-ZА-ЯЁ]{4,})(?![\w@])")
NAME_INITIAL_LAST = re.compile(r"(?<![\w.])([A-ZА-ЯЁ][a-zа-яё]+(?:-[А-ЯЁ][а-яё]+)?|[А-ЯЁ]{4,}),? ([A-ZА-ЯЁ])\. ?(?:[A-ZА-ЯЁ]\.)?(?!\w)")
_SURNAME_RU = re.compile(r"(?:ов|ев|ёв|ин|ын|ский|цкий|ской|ских|ко|енко|ук|юк|ян|дзе|швили|ич)(?:а|у|ым|ой|е|ом|ого|ому|им)?$|(?:ова|ева|ёва|ина|ына|ская|цкая)$|(?:овой|евой|иной|ской|ову|еву|ину|скую)$")
_PATRONYMIC = re.compile(r"(?:ович|евич|ьич|ич)(?:а|у|ем|е)?$|(?:овн|евн|ичн)(?:а|ы|е|у|ой)$")
_NOT_AFTER_INITIAL = re.compile(r"^(?:the|an?|it|in|on|at|if|is|as|we|no|so|to|of|by|all|and|any|ask|both|but|call|drop|each|every|find|for|from|its|moving|now|once|one|only|our|over|per|pin|see|set|she|he|they|that|then|there|this|those|under|use|what|when|while|why|with|you|your|на|не|но|мы|он|она|они|это|если|когда|как|что|для|при|под|над|под|все|всё|там|тут|так)$", re.I)

#: Words before or after a person: titles, roles and labels, verbs.
_PERSON = re.compile(
    r"\b(?:dr|prof|mr|mrs|ms|herr|frau|doctor|professor|colleague|господин\w*|госпож\w*|коллег\w*)\.?\s*$|"
    r"\b(?:author|owner|assignee|reviewer|contact|from|name|signed|signed-off-by|reported-by|reviewed-by|cc|attn|dear|hi|hello|ask|asked|tell|told|thanks|thank|met|with|by|to|for|of|call|badge|blame|as|and|"
    r"имя|автор|созвон\w*|привет|ответственн\w*|курьер\w*|спроси\w*|от|для|у|с|это|подпись|передай\w*|сообщи\w*|позвони\w*|напиши\w*|von|mit|an|für|hallo|lieber?|bitte|fragt?)\b[\s:=\"'>|,—–-]{1,4}$|"
    r"\(а\)\s$",
    re.I,
)
_PERSON_AFTER = re.compile(r"\W{0,2}\s(?:said|says|asked|asks|wrote|writes|told|called|thinks|suggested|confirmed|approved|reported|сказал\w*|спросил\w*|написал\w*|просил\w*|ответил\w*|сообщил\w*|считает|sagte?|fragte?|schrieb)\b", re.I)
_TITLE = r"[^\W\d_a-zа-яёäöüß][^\W\d_A-ZА-ЯЁÄÖÜ]+(?:['’\-][^\W\d_a-zа-яё][^\W\d_A-ZА-ЯЁ]+)*"
NAME_PAIR = re.compile(rf"(?<![\w.@/\-])({_TITLE}) (?:[A-ZА-ЯЁ]\. )?((?:(?:van|von|de|der|al|bin|da) )?{_TITLE})(?![\w@/])")
_PHONE_CTX = re.compile(r"call|text|phone|tel|mobile|reach|on-call|dial|fax|contact|звон|тел|моб|дежурн|напиши|номер для связи|заявке указан|ruf|erreich|handy", re.I)
_NUMBER_CTX = re.compile(r"(?:ticket|build|offset|serial|order|invoice|token|shard|seed|job|run|step|row|commit|port|version|задач\w*|сборк\w*|смещени\w*|серийн\w*|заказ\w*|накладн\w*|токен\w*|шард\w*|строк\w*|шаг\w*|сид\w*|заявк\w*)[\s:#№\w]{0,24}$", re.I)


class Span(NamedTuple):
    start: int
    end: int
    type: str
    score: float


def plain(text: str) -> str:
    """Equal-length copy with look-alike characters and JSON escapes made plain."""
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_PLAIN)
    if "\\" in text:
        text = _ESC.sub(lambda m: " \n" if m.group(0) in ("\\n", "\\r") else " " + m.group(0)[1:].replace("t", "\t"), text)
    return text


def _emails(s: str, low: str) -> Iterator[Span]:
    pats = [EMAIL_PLAIN] if "@" in s else []
    if " @ " in s or "@ " in s:
        pats.append(EMAIL_SPACED)
    if _AT_WORD.search(s):
        pats.append(EMAIL_WORDS)
    if " dot " in low or " точка " in low:
        pats.append(EMAIL_BARE)
    for p in pats:
        for m in p.finditer(s):
            local, domain = m.group(1).lower(), m.group(2)
            score = 0.9
            if local in SERVICE or s[m.end() : m.end() + 1] == ":" and "/" in s[m.end() : m.end() + 40].split(" ")[0]:
                score -= 0.9
            if domain[0].isdigit() and re.match(r"\d+(?:\.\d+)+", domain):
                score -= 0.9
            yield Span(m.start(), m.end(), "email", score)


def _phones(s: str) -> Iterator[Span]:
    for p, base, plan in _PHONES:
        for m in p.finditer(s):
            n = len(digits(re.split(r"(?i) ?(?:x|ext|доб)", m.group(0))[0]))
            score = base if 9 <= n <= 15 else -1.0
            before = s[max(0, m.start() - 40) : m.start()]
            if plan(m.group(0), n):
                score += 0.3
            if _PHONE_CTX.search(before):
                score += 0.2
            if p is not PHONE_PLUS and _NUMBER_CTX.search(before) and not _PHONE_CTX.search(before[-18:]):
                score -= 0.5
            if ID_KEY_WORD.search(before[-26:]):
                score -= 0.6
            yield Span(m.start(), m.end(), "phone", score)


VALIDATORS: tuple[Callable[[str], bool], ...] = (luhn, mod97, mod101, mod11)


def _ids(s: str, low: str) -> Iterator[Span]:
    if any(k in low for k in _ID_STEMS):
        for m in ID_KEYED.finditer(s):
            d = digits(m.group(1))
            # the key word stands right before the number
            score = 0.3 + 0.4 if 6 <= len(d) <= 16 else 0.0
            yield Span(m.start(), m.end(1), "id_number", score + (0.2 if any(v(d) for v in VALIDATORS) else 0.0))
        for m in ID_NEAR.finditer(s):
            d = digits(m.group(1))
            if 8 <= len(d) <= 16 and any(v(d) for v in VALIDATORS) and not _NUMBER_CTX.search(s[max(0, m.start(1) - 40) : m.start(1)]):
                yield Span(m.start(1), m.end(1), "id_number", 0.3 + 0.3)
    for m in ID_FORM.finditer(s) if _LONG.search(s) else ():
        d = digits(m.group(1))
        score = 0.3
        if mod101(d) and "-" in m.group(1) or mod97(d) and "." in m.group(1):
            score += 0.3
        if _NUMBER_CTX.search(s[max(0, m.start() - 40) : m.start()]):
            score -= 0.5
        yield Span(m.start(1), m.end(1), "id_number", score)


def _addresses(s: str, low: str) -> Iterator[Span]:
    if any(k in low for k in _RU_STEMS):
        for p in (ADDR_RU, ADDR_RU_SUFFIX, ADDR_RU_TOWN):
            for m in p.finditer(s):
                score, start, end = 0.4, m.start(), m.end()
                before, after = _TOWN_BEFORE.search(s[max(0, start - 60) : start]), _TOWN_AFTER.match(s[end : end + 60])
                if p is ADDR_RU_TOWN or before or after:
                    score += 0.4
                if p is not ADDR_RU_TOWN:
                    start -= len(before.group(0)) if before else 0
                    end += after.end() if after else 0
                yield Span(start, end, "address", score)
    if any(k in low for k in _EN_STEMS):
        for p in (ADDR_EN, ADDR_EN_CAPS):
            for m in p.finditer(s):
                yield Span(m.start(), m.end(), "address", 0.8)
    if _ZIP_TOWN.search(s) and any(k in low for k in _DE_STEMS):
        for m in ADDR_DE.finditer(s):
            yield Span(m.start(), m.end(), "address", 0.9)


def _case(w: str) -> str:
    return "T" if w[0].isupper() and (len(w) == 1 or not w.isupper()) else "U" if w.isupper() else "l"


def _surname(w: str) -> bool:
    return len(w) >= 3 and w.lower() not in NOT_SURNAME and w.lower() not in GIVEN


_ENDINGS = (("у", "ю"), ("ову", "еву", "ёву", "ину", "ыну", "ому", "ову", "ской")), (("а", "я"), ("ова", "ева", "ёва", "ина", "ына", "ая", "ого")), (("ой", "ей"), ("овой", "евой", "ёвой", "иной", "ыной", "ской", "цкой")), (
    ("ом", "ем"), ("ым", "им"),
), (("е", "и", "ы"), ("ове", "еве", "ине", "овой", "евой", "иной", "ской", "цкой", "ом"))


def _agree(given: str, surname: str) -> bool:
    """Whether the case endings of a Russian given name and surname go together."""
    for first, last in _ENDINGS:
        if given.endswith(first) and len(given) > 3:
            return surname.endswith(last) or surname[-1] not in "аеиоуыэюяйвнм" and first != ("а", "я")
    return not surname.endswith(("ова", "ева", "ёва", "ина", "ына", "ая"))


def _name_pairs(s: str, ordinary: frozenset[str]) -> Iterator[Span]:
    """Two capitalised words outside the lists: named by what stands beside them and by what they are not."""
    at = 0
    while m := NAME_PAIR.search(s, at):
        at = m.end(1)
        x, y = m.group(1).lower(), m.group(2).lower().split(" ")[-1]
        if x in NOT_SURNAME or y in NOT_SURNAME or min(len(x), len(y)) < 3:
            continue
        cyr = "а" <= x[0] <= "я"
        if cyr != ("а" <= y[0] <= "я"):
            continue
        score = 0.3
        if cyr:
            if not _SURNAME_RU.search(y) or not _agree(x, y):
                continue
        elif not ordinary or x in ordinary or y in ordinary:
            continue
        if _PERSON.search(s[max(0, m.start() - 30) : m.start()]) or _PERSON_AFTER.match(s, m.end()):
            score += 0.3
            at = m.end()
        yield Span(m.start(), m.end(), "name", score)


def ordinary_words(path: str = VOCABULARY) -> frozenset[str]:
    """Lower-case words that a ``.tiktoken`` vocabulary holds whole; empty if there is no such file, an error if it holds none or something else."""
    if not os.path.exists(path):
        return frozenset()
    words = set()
    with open(path, "rb") as f:
        for n, line in enumerate(f, 1):
            try:
                token, rank = line.split()
                w = base64.b64decode(token, validate=True).decode("utf-8", "ignore")
                int(rank)
            except ValueError as e:
                raise ValueError(f"{path}, line {n}: not a token in base64 and its rank") from e
            if w[:1] == " " and len(w) > LEAST_WORD and w[1:].isalpha() and w.islower():
                words.add(w[1:])
    if not words:
        raise ValueError(f"{path} holds no lower-case words")
    return frozenset(words)


def _shipped_words(turns: DataFrame, vocabulary: str | None) -> Broadcast:
    """Ordinary words for the workers; ``VOCABULARY`` has to be there, a path of the caller's own need not."""
    path = VOCABULARY if vocabulary is None else vocabulary
    if not os.path.exists(path):
        if vocabulary is None:
            raise FileNotFoundError(f"no vocabulary {path}: names outside the lists would be left out")
        warnings.warn(f"no vocabulary {path}: names outside the lists are left out", stacklevel=3)
    return turns.sparkSession.sparkContext.broadcast(ordinary_words(path))


def _names(s: str, low_words: list[str]) -> Iterator[Span]:
    if not GIVEN.isdisjoint(low_words):
        toks = [(m.group(0), m.start(), m.end()) for m in _LETTERS.finditer(s)]
        for i, (w, a, b) in enumerate(toks):
            if w.lower() not in GIVEN or (a and s[a - 1] in "@.+_%/\\<=" and s[a - 1] not in "<=") or s[b : b + 1] in ("@", "_", "+", "/"):
                continue
            kind, cyr = _case(w), "а" <= w[0].lower() <= "я" or w[0] in "ёЁ"
            # given [initial or patronymic] surname
            j, end, mid = i + 1, b, False
            while j < len(toks) and j <= i + 2:
                x, xa, xb = toks[j]
                gap = s[end:xa]
                if len(x) == 1 and x.isupper() and s[xb : xb + 1] == "." and gap.isspace() and "\n" not in gap:
                    end, j, mid = xb + 1, j + 1, True
                    continue
                if gap and (not gap.isspace() or "\n" in gap or len(gap) > 3) or not gap:
                    break
                if cyr and not mid and _PATRONYMIC.search(x.lower()) and j + 1 < len(toks) and s[xb : toks[j + 1][1]] == " " and _case(toks[j + 1][0]) == _case(x):
                    end, j, mid = xb, j + 1, True
                    continue
                if s[xb : xb + 1] in ("@", "_", "/") or s[xb : xb + 1] == "." and s[xb + 1 : xb + 2].isalnum() or not _surname(x) or cyr and _PATRONYMIC.search(x.lower()):
                    break
                k = _case(x)
                if k == kind or kind == "T" and k == "U":
                    score = 0.8 if kind == "T" else 0.6 if cyr and _SURNAME_RU.search(x.lower()) or not cyr and len(x) >= 6 else 0.3
                    if kind == "l" and not cyr:
                        score = 0.55 if len(x) >= 6 else 0.2
                    if _PERSON.search(s[max(0, a - 30) : a]):
                        score += 0.1
                    yield Span(a, xb, "name", score)
                break
            # surname[,] given [patronymic]
            if i:
                x, xa, xb = toks[i - 1]
                gap = s[xb:a]
                if gap in (" ", ", ") and _surname(x) and s[xa - 1 : xa] not in ("@", ".", "_", "/", "+"):
                    k = _case(x)
                    patronymic = cyr and i + 1 < len(toks) and s[b : toks[i + 1][1]] == " " and _PATRONYMIC.search(toks[i + 1][0].lower())
                    if cyr and k == kind and gap == " " and kind != "l" and (patronymic or _SURNAME_RU.search(x.lower())):
                        yield Span(xa, toks[i + 1][2] if patronymic else b, "name", 0.85)
                    elif gap == ", " and k == kind == "T" and len(x) >= 4:
                        after = s[b : b + 1]
                        closed = after in ("", "\n", "<", "|", '"', ";", "\t", ".", ")", ",") or re.match(r" (?:[A-ZА-ЯЁ]\.|[a-zа-яё<(|])", s[b : b + 4])
                        yield Span(xa, b, "name", 0.7 if closed else 0.4)
    if _INITIAL.search(s):
        for m in NAME_INITIAL_FIRST.finditer(s):
            x = m.group(2)
            cyr = bool(re.match(r"[А-ЯЁ]", x))
            if cyr != bool(re.match(r"[А-ЯЁ]", m.group(1))) or _NOT_AFTER_INITIAL.match(x) or not _surname(x):
                continue
            score = 0.3
            if cyr:
                score += 0.4 if _SURNAME_RU.search(x.lower()) else 0.0
            else:
                score += 0.3 if len(x) >= 5 else 0.1
            if _PERSON.search(s[max(0, m.start() - 30) : m.start()]):
                score += 0.2
            yield Span(m.start(), m.end(), "name", score)
        for m in NAME_INITIAL_LAST.finditer(s):
            x = m.group(1)
            cyr = bool(re.match(r"[А-ЯЁ]", x))
            if cyr != bool(re.match(r"[А-ЯЁ]", m.group(2))) or not _surname(x):
                continue
            two = m.group(0).count(".") > 1
            score = 0.3 + (0.4 if cyr and _SURNAME_RU.search(x.lower()) else 0.0) + (0.2 if two else 0.0)
            if not cyr:
                score = 0.6 if m.group(0)[len(x) : len(x) + 1] == "," else 0.3
            yield Span(m.start(), m.end(), "name", score)


# Cheap conditions that must hold before the patterns above are tried.
_LONG = re.compile(r"\d[\d ().\-/]{5,}\d")
_INITIAL = re.compile(r"(?<![\w.])[A-ZА-ЯЁ]\.")
_AT_WORD = re.compile(r"[\[({<]\s?(?:at|собака|ät)\s?[\])}>]", re.I)
_ZIP_TOWN = re.compile(r"\d{4,5}\s+[A-ZÄÖÜ]", re.I)
_ID_STEMS = (
    "ssn", "social", "passport", "driver", "driving", "national i", "insurance", "identity", "id card", "taxpayer", "tax id",
    "tax number", "ausweis", "reisepass", "pass-nr", "passnr", "passnummer", "führerschein", "steuer", "versicherungs",
    "паспорт", "снилс", "инн", "удостоверен", "водительск", "полис", "страхов",
)
# what every alternative of the Russian patterns begins with, and of the German one holds
_RU_STEMS = ("ул", "пр-т", "пр-кт", "просп", "пер", "б-р", "бульвар", "шоссе", "ш.", "наб", "пл", "проезд", "туп", "алле", "линия", "мкр", "микрорайон", "г.", "гор.", "город", "пос.", "с.", "дер.")
_EN_STEMS = tuple(
    " " + k
    for k in "street st. st, road rd lane ln avenue ave boulevard blvd court ct close terrace drive dr way place pl square sq crescent gardens row grove hill mews parade park walk rise".split()
)
_DE_STEMS = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer", "steig", "pfad", "chaussee", "hof", "wall")
_WORDS = re.compile(r"[^\W\d_]+")
_HOUSE = re.compile(r"\d")


def find_spans(text: str | None, ordinary: frozenset[str] = frozenset()) -> list[Span]:
    """Accepted, non-overlapping spans in order; ``ordinary`` words are no names."""
    if not text or not text.strip():
        return []
    s = plain(text)
    back = None
    if not text.isascii() and _INVISIBLE.search(s):
        back = [i for i, c in enumerate(s) if not _INVISIBLE.match(c)]
        s = _INVISIBLE.sub("", s)
    low = s.lower()
    found: list[Span] = [*_emails(s, low), *_names(s, _WORDS.findall(low)), *_name_pairs(s, ordinary)]
    if _HOUSE.search(s):
        if _LONG.search(s):
            found += _phones(s)
        found += _ids(s, low)
        found += _addresses(s, low)
    found = sorted((x for x in found if x.score >= ACCEPT), key=lambda x: (-x.score, x.start - x.end, x.start))
    kept: list[Span] = []
    for x in found:
        if all(x.end <= k.start or x.start >= k.end for k in kept):
            kept.append(x)
    kept.sort()
    if back:
        kept = [k._replace(start=back[k.start], end=back[k.end - 1] + 1) for k in kept]
    return kept


def redact(text: str | None, ordinary: frozenset[str] = frozenset()) -> str | None:
    """``text`` with every span replaced by its type in angle brackets; the rest is unchanged."""
    spans = find_spans(text, ordinary)
    if not spans:
        return text
    out, at = [], 0
    for x in spans:
        out += [text[at : x.start], f"<{x.type.upper()}>"]
        at = x.end
    return "".join([*out, text[at:]])


def found_types(turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(turn_id, pii_type): one row for each turn and type that occurs in its content."""
    shipped = _shipped_words(turns, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, kinds = [], []
            for i, t in zip(b["turn_id"], b["content"]):
                for k in {x.type for x in find_spans(t, shipped.value)}:
                    ids.append(i)
                    kinds.append(k)
            yield pd.DataFrame({"turn_id": pd.array(ids, dtype="Int64"), "pii_type": kinds})

    return turns.select("turn_id", "content").where("content IS NOT NULL").mapInPandas(run, "turn_id long, pii_type string").distinct()


def redacted(turns: DataFrame, content: str = "content", vocabulary: str | None = None) -> DataFrame:
    """``turns`` with personal data in ``content`` replaced by placeholders; all other columns as they are."""
    shipped = _shipped_words(turns, vocabulary)

    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        return s.map(lambda t: redact(t, shipped.value), na_action="ignore")

    return turns.withColumn(content, clean(F.col(content)))
