"""Template residue, error pages, script notices and filler in place of content.

Documents fall into sections (by headings), sections into passages (sentences and single lines). Two
positive-unlabelled naive Bayes models are fitted by expectation-maximization: residue against content
over all passages, and unfilled against meant over the passages that hold something shaped like a template
field. Each starts from trusted records (error pages and notices that name a status code or scripts,
repeated filler; passages of nearly nothing but fields, blanks and orders to fill in, against those whose fields all stand in code), gives every unlabelled passage a posterior, and
re-estimates word weights and the classes' shares from round to round. The models decide: a record is out if a
passage with a field is scored as unfilled, or if every worded passage of a section is scored as residue.

The fit uses a bounded sample: ``SAMPLE`` documents and ``SAMPLE_TRUSTED`` possible trusted
ones, drawn by hash. Scoring covers every document whole.

Defined cases: null and blank texts are not residue (there is nothing to exclude); equal texts get equal
decisions; repeated ``doc_id`` rows count once; a class without trusted records is never found; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, SAMPLE_TRUSTED = 4000, 6000
#: Greatest weight of a token that a class never showed, and share of a count from which it counts as shown.
UNSEEN, SHOWN = -1.0, 0.25
#: Passages of more words than this decide over their section; shorter ones are labels.
LABEL = 6
#: Rounds, smoothing, and the first shares: of residue in all passages, of unfilled in prose with a field.
ROUNDS, ALPHA, PRIOR, FIELD_PRIOR = 8, 0.05, 0.03, 0.95

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s+\S.*$")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_SENT = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+")
_CODE_LINE = re.compile(
    r"^\s*(?:import |from \S+ import|def |class |return\b|raise |if .*:$|for .*:$|while .*:$|else:|elif |try:|except|with .*:$|@\w|\$ |>>> |#!|export |echo |cd |sudo |docker |kubectl |helm |"
    r"[\w.\-]+:\s*(?:\{\{|\||>|$|\S+$)|[\w.\[\]]+\s*(?:=|\+=|-=)\s*\S|[{}\[\]();]+\s*$|</?\w+[^>]*>.*|\{%|- \w+:)"
)
_TICKS = re.compile(r"`[^`\n]*`")
_PATH = re.compile(r"\b[\w\-]+(?:/[\w.\-]+)+\b|\b\w+\.(?:py|md|toml|ya?ml|json)\b")
_HEX = re.compile(r"\b(?=\w*\d)[0-9a-fA-F]{6,}\b")
_QUOTE = re.compile(r"«[^»]{2,}»|“[^”]{2,}”|\"[^\"\n]{2,}\"|(?<!\w)'[^'\n]{2,}'(?!\w)")

#: Quoting marks inside a sentence.
_ABOUT = re.compile(r"`[^`]+`|«[^»]{2,}»|“[^”]{2,}”|„[^“”]{2,}[“”]|(?<!\w)'[^'\n]{3,}'(?!\w)")

_RAISED = re.compile(r"(?:traceback|exception|fatal|uncaught|unhandled|error|fehler|ошибка)\b", re.I)

# --- template fields ----------------------------------------------------------------------------

_NAME = r"[^\W\d_][\w\-]*(?:[ _\-][\w\-]+){0,5}"
_HTML = "a abbr b body br button center code col dd details div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input kbd label li link main meta nav ol option p pre script section select small span strong style sub summary sup svg table tbody td textarea tfoot th thead title tr tt u ul video".split()
_EDGE, _AFTER = r"(?<![\w/$.\\])", r"(?![\w/(\[])"
_UPPER = r"[^\W\d_a-zа-яё][^\Wa-zа-яёäöüß]*"
_JINJA = r"(?!\s*(?:end|if|elif|else|for|block|extends|include|import|from|set|macro|call|raw|with|filter)\b|\s*end)"
FIELD = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\{{%{_JINJA}\s*{_NAME}\s*%\}}|\[\[\s*{_NAME}\s*\]\]|<<\s*{_NAME}\s*>>|\$\{{\s*{_NAME}\s*\}}|{_EDGE}\{{{_NAME}\}}{_AFTER}|@@\s*{_NAME}\s*@@|"
    rf"(?<![\w#])#{_UPPER}#(?![\w#])|(?<![\w%])%{_UPPER}%(?![\w%])|(?<![\w$])\${_UPPER}\$(?![\w$])|(?<!\w)__{_UPPER}__(?!\w)|\bX{{2,}}[\-_]{_UPPER}[\-_]X{{2,}}\b|"
    rf"[«\"“]{_NAME}[»\"”]_{{3,}}|\({_NAME}\s*:\s*_{{3,}}\)|\b{_NAME}:\s*_{{4,}}|<!--\s*(?!toc\b|more\b|end\b|begin\b|start\b|\w+-){_NAME}\s*-->|"
    rf"\[(?i:insert|fill|enter|add|your|tbd|todo|replace|вставьте|вставить|заполните|заполнить|укажите|указать|впишите|введите|hier|bitte|ihr|ihre|dein|deine)\s[^\]\n]{{1,60}}\]|"
    rf"\[[^\]\n]{{2,50}}\s(?i:einsetzen|eintragen|einfügen|ausfüllen|angeben|here|здесь)\]|<(?!/?(?i:{'|'.join(_HTML)})\b){_NAME}>"
)


#: What any field begins with, or holds.
_MARKS = ("{", "[[", "<<", "@@", "XX", "__", "<!", "$", "%")
_OPENING = re.compile(r"(?<!\w)#[^\W\d_]|\[[^\W\d_]|<[^\W\d_]")


def fields(passage: str) -> list[str]:
    """What is shaped like a template field, wherever it stands."""
    if "XX" not in passage and not any(c in passage for c in "{[<@#%_«$"):
        return []
    return [m.group(0) for m in FIELD.finditer(passage)]


_NAMED = re.compile(r"\w+")


def field_tokens(passage: Passage) -> set[str]:
    """Marks of the fields of a passage: place, what they open with, and whether there are code spans."""
    text, out = passage.text, set()
    ticks = [m.span() for m in _TICKS.finditer(text)] if "`" in text else []
    for m in FIELD.finditer(text):
        quoted = any(a < m.start() and m.end() < b for a, b in ticks)
        out.add("<code>" if not passage.prose else "<tick>" if quoted else "<prose>")
        out.add("<opens> " + _NAMED.sub("w", m.group(0)[:3]))
    if ticks:
        out.add("<ticks>")
    return out


_ORDER = re.compile(r"_{3,}|^\[(?:insert|fill|enter|add|your|tbd|todo|replace|вставь|вставить|заполн|укаж|указать|впиш|введи|hier|bitte)", re.I)


def trusted_field(text: str) -> bool:
    """Whether a passage is hardly more than fields (half of it, or several), or holds a blank or an order to fill it in."""
    held = fields(text) if "`" not in text else []
    if any(map(_ORDER.search, held)):
        return True
    return len(held) > 1 or 2 * sum(map(len, held)) >= len(text) > 0


# --- passages -----------------------------------------------------------------------------------


class Passage(NamedTuple):
    #: Number of the section, -1 for a heading that may hold a field.
    section: int
    text: str
    prose: bool
    #: Number of the paragraph within the text.
    block: int = 0


def passages(text: str) -> list[Passage]:
    """Sentences and lines of a text with the number of their section; headings open a section."""
    out: list[Passage] = []
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    section, block, fenced, in_code = 0, 0, False, False
    for line in text.replace("\\n", "\n").split("\n") if text[:1] == "{" else text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if not line.strip():
            in_code = False
            block += 1
            continue
        if fenced:
            out.append(Passage(section, line.strip(), False, block))
            continue
        if _HEADING.match(line):
            section += 1
            block += 1
            if "XX" in line or any(c in line for c in "{[<@%_«$") or line.count("#") > 6:
                out.append(Passage(-1, line.strip().lstrip("#").strip(), True))
            continue
        code = bool(_CODE_LINE.match(line)) or in_code and line[:2] == "  "
        in_code = code
        if code:
            stripped = line.strip()
            labelled = re.match(r"^[^\W\d_][\w \-]*:\s+\S", stripped) and not re.search(r"\{\{\s*\.|\{%", stripped)
            out.append(Passage(section, stripped, bool(labelled) and " " in stripped, block))
            continue
        for s in _SENT.split(line.strip()):
            if s.strip():
                out.append(Passage(section, s.strip(), True, block))
    return out


def tokens(p: str) -> set[str]:
    """Words, word pairs and marks of a passage, each once."""
    marks = ["<path>"] if "/" in p and _PATH.search(p) else []
    if "`" in p or _QUOTE.search(p):
        marks.append("<quote>")
    ws = ["<n>" if w.isdigit() else "<hex>" if _HEX.fullmatch(w) else w for w in _WORD.findall(p.lower())]
    if len(ws) >= 4 and len(set(ws)) <= max(2, len(ws) // 3):
        marks.append("<repeat>")
    return {*marks, *ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))}


# --- trusted records ----------------------------------------------------------------------------

#: What makes a short record a trusted one: a status code, denied access, scripts or cookies by name. The rest is learned.
_TRUST = re.compile(
    r"javascript|noscript|\bjs\b|cookies?\b|(?:error|http|fehler|ошибка|status\W+)\s*\W*[45]\d\d\b|^\W*[45]\d\d\W|\"error\"\s*:|access denied|доступ запрещ|zugriff verweigert",
    re.I,
)
_LATIN = frozenset("lorem ipsum dolor amet consectetur adipiscing".split())


def is_filler(p: str) -> bool:
    ws = _WORD.findall(p.lower())
    if len(ws) >= 4 and len(set(ws)) <= max(2, len(ws) // 3) and all(w.isalpha() for w in ws):
        return True
    return len(ws) >= 5 and sum(w in _LATIN for w in ws) >= max(1, 0.1 * len(ws)) and not {"the", "we", "with", "in the", "die", "в", "и"} & set(ws)


def trusted(text: str) -> bool:
    """Whether a whole record is beyond doubt an error page, a notice or filler."""
    ps = [p for p in passages(text) if p.text]
    n = sum(len(_WORD.findall(p.text)) for p in ps)
    if not n:
        return False
    if n <= 60 and len(text) <= 600 and (_RAISED.match(text) or _TRUST.search(text) and not _PATH.search(text)) and not any(map(fields, (p.text for p in ps))):
        return True
    return sum(is_filler(p.text) for p in ps) >= 0.5 * len(ps)


# --- model --------------------------------------------------------------------------------------


class Bayes(NamedTuple):
    """Log weights of tokens for a class against its complement, and log prior odds."""

    weights: dict[str, float]
    prior: float

    def odds(self, held: set[str]) -> float:
        get = self.weights.get
        return self.prior + sum(get(x, 0.0) for x in held)


class Model(NamedTuple):
    """Residue among passages, unfilled fields among passages with fields; None where nothing was trusted."""

    residue: Bayes | None
    unfilled: Bayes | None

    def classify(self, p: Passage, field: bool) -> str:
        """e (residue), t (unfilled template) or n (content)."""
        if field:
            return "t" if self.unfilled and self.unfilled.odds(field_tokens(p)) > 0 else "n"
        if not self.residue or self.residue.odds(tokens(p.text)) <= 0:
            return "n"
        if p.text[:1] not in "{<" and not _RAISED.match(p.text) and (_ABOUT.search(p.text) or "/" in p.text and _PATH.search(p.text)):
            return "n"  # speaks about or quotes such a text
        return "e"


def expect_maximize(known: list[set[str]], unlabelled: list[tuple[set[str], int]], share: float, first: float = 0.0, against: list[set[str]] | None = None, rounds: int = ROUNDS) -> Bayes | None:
    """Naive Bayes of a class from trusted members and unlabelled (tokens, times) of both kinds.

    ``share`` is the first guess of the class's share of the unlabelled, from which every round takes its own;
    ``first`` is the first posterior of each. ``against`` are trusted members of the complement.
    A token that the class never showed counts against it with ``UNSEEN`` at most in weight.
    """
    if not known:
        return None
    total_n = sum(n for _, n in unlabelled)
    post = [first] * len(unlabelled)
    fixed: Counter = Counter(x for g in known for x in g)
    everywhere: Counter = Counter(x for g in against or () for x in g)
    for g, n in unlabelled:
        for x in g:
            everywhere[x] += n
    prior = math.log(share / (1 - share))
    model = None
    for _ in range(rounds):
        pos: Counter = Counter(fixed)
        for (g, n), q in zip(unlabelled, post):
            if q > 1e-3:
                for x in g:
                    pos[x] += n * q
        drawn = {x: pos[x] - fixed[x] for x in pos}
        vocab = set(pos) | set(everywhere)
        sum_pos = sum(pos.values()) + ALPHA * len(vocab)
        sum_neg = sum(everywhere.values()) - sum(drawn.values()) + ALPHA * len(vocab)
        weights = {}
        for x in vocab:
            p = pos.get(x, 0.0)
            w = math.log((p + ALPHA) / sum_pos) - math.log((max(0.0, everywhere.get(x, 0) - drawn.get(x, 0.0)) + ALPHA) / sum_neg)
            w = w if p >= SHOWN else min(UNSEEN, w)
            if abs(w) > 0.05:
                weights[x] = w
        model = Bayes(weights, prior)
        odds = [model.odds(g) for g, _ in unlabelled]
        post = [1 / (1 + math.exp(-max(-50.0, min(50.0, o)))) for o in odds]
        own = sum(q * n for q, (_, n) in zip(post, unlabelled))
        part = min(max((own + 1) / (total_n + len(against or ()) + 2), 1e-6), 1 - 1e-6)
        prior = math.log(part / (1 - part))
    return Bayes(model.weights, prior)


def learn(known: list[str], rest: list[str], rounds: int = ROUNDS) -> Model:
    """Model from the texts of trusted records and of a sample of all records."""
    sure = {t for t in (*known, *rest) if trusted(t)}
    residue = [tokens(p.text) for t in sorted(sure) for p in passages(t) if not fields(p.text)]
    plain: Counter = Counter()
    unfilled, meant, either = [], [], []
    for t in rest:
        if t in sure:
            continue
        for p in passages(t):
            if not fields(p.text):
                plain[p.text] += 1
                continue
            held = field_tokens(p)
            if "<prose>" not in held:
                meant.append(held)
            elif trusted_field(p.text):
                unfilled.append(held)
            else:
                either.append((held, 1))
    seen = [(tokens(p), n) for p, n in sorted(plain.items())]
    return Model(expect_maximize(residue, seen, PRIOR, rounds=rounds), expect_maximize(unfilled, either, FIELD_PRIOR, FIELD_PRIOR, meant, rounds))


def residue_kind(text: str | None, model: Model | None) -> str | None:
    """``template``, ``residue`` or None."""
    if not text or not text.strip() or model is None:
        return None
    kinds: dict[int, list[tuple[str, int, int]]] = defaultdict(list)
    settled = -2
    for p in passages(text):
        f = bool(fields(p.text))
        # nothing that follows a worded passage of content can make its section residue, only a field still counts
        if p.section == settled and not f:
            continue
        c = model.classify(p, f)
        if c == "t":
            return "template"
        n = len(_WORD.findall(p.text))
        if n and p.section >= 0:
            kinds[p.section].append((c, n, p.block))
            if c != "e" and n > LABEL:
                settled = p.section
    for section, ps in kinds.items():
        if _whole(ps):
            return "residue"
        # a section set in front of another's text: its paragraphs follow the heading, the rest is the other's
        lead = [x for x in ps if x[2] == ps[0][2]]
        if section and len(lead) < len(ps) and _whole(lead):
            return "residue"
    return None


def _whole(ps: list[tuple[str, int, int]]) -> bool:
    """Whether worded passages (class, words, paragraph) are residue but for short labels."""
    bad = sum(n for c, n, _ in ps if c == "e")
    worst = max((n for c, n, _ in ps if c != "e"), default=0)
    return bad > 0 and worst <= LABEL and bad >= 0.5 * sum(n for _, n, _ in ps)


# --- the operator -------------------------------------------------------------------------------


def _sample(rows: DataFrame, size: int) -> list[str]:
    """About ``size`` texts of ``rows``, those whose hashed key falls into one residue class."""
    every = max(1, math.ceil(rows.count() / size))
    return sorted(r["text"] for r in rows.where(F.pmod("h", F.lit(every)) == 0).select("text").collect())


def train(documents: DataFrame, sample: int = SAMPLE, sample_trusted: int = SAMPLE_TRUSTED) -> Model:
    """Model from a bounded sample of the documents; both bounds are parameters.

    One sample is drawn from all documents, one from those whose length or wording lets them be trusted
    records. Both are residue classes of a hash, so their expected size does not grow with the input.
    """
    keyed = documents.where("text IS NOT NULL AND trim(text) <> ''").select("text", F.xxhash64("doc_id", "text").alias("h"))
    hopeful = keyed.where((F.length("text") <= 600) | F.lower("text").rlike("lorem|ipsum|рыба"))
    return learn(_sample(hopeful, sample_trusted), _sample(keyed, sample))


def excluded(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, kind) of the documents to leave out."""
    model = model or train(documents)
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kind = [residue_kind(t, shipped.value) for t in b["text"]]
            out = pd.DataFrame({"doc_id": b["doc_id"], "kind": kind})
            yield out[out["kind"].notna()]

    rows = documents.where("doc_id IS NOT NULL").select("doc_id", "text")
    return rows.mapInPandas(run, "doc_id long, kind string").dropDuplicates(["doc_id"])
