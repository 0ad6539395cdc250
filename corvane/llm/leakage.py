"""Evaluation passages in training documents.

Rare n-grams of the test items are seeds: of every window of ``RUN`` item words the n-gram found in
fewest items, every n-gram found in at most ``RARE`` items, and more of the rarest up to so many that a
fifth of the words, changed or left out, cannot destroy them all. Documents are scanned whole for seeds;
a hit joins document and item. A pair is then confirmed by an unbroken run of at least ``RUN`` item
words, or by Smith-Waterman alignment that keeps at least ``KEEP`` of the item's words in order.

The items are a fixed set and are shipped to the tasks after a check of their size (``MAX_ITEMS_MB``);
a larger set is taken in parts of that size, one after the other, each found pair written before the next
part is fetched. Rarity is counted within a part, which can only give more seeds than over all items.

Words are compared without case, punctuation, markup, line prefixes and invisible characters, in two
forms: split at punctuation, and with punctuation inside words removed.

Defined cases: null or blank texts match nothing; repeated ``doc_id`` rows and pairs count once; items
of fewer than three words match where all their words stand in sequence; texts are scanned whole; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.plans.materialize import materialize

N, RUN, RARE, KEEP = 3, 12, 8, 0.8
#: Share of an item's words that seeds must cover in a window before it is aligned, where all its n-grams are seeds.
SEED_SHARE = 0.12
MAX_ITEMS_MB = 64
MATCH, MISMATCH, GAP = 2, -1, -1

_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff]")
_INLINE = re.compile(r"</?(?:a|b|i|u|s|em|strong|span|mark|small|sub|sup|font|code|kbd|tt|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|<!--.*?-->", re.S)
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_SOFT = re.compile(r"\\[nrt]")
_HYPHENATED = re.compile(r"(?<=[^\W\d_])-[ \t]*\n[ \t]*(?:[>#|*]+[ \t]*)?(?=[^\W\d_])")
_PREFIX = re.compile(
    r"(?m)^[ \t]*(?:(?:[>#|*+•\-–—%;!:]+|/{2,}|--)[ \t]*|\(?\[?[A-Za-z]{0,2}\d{1,6}[\])]?[.):|\t]+[ \t]*|\d{1,6}[ \t]{2,}|\[[^\]\n]{1,24}\][ \t]*|"
    r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?\S*[ \t]+|\d\d:\d\d:\d\d\S*[ \t]+|(?:user|assistant|tool|system|human|q|a|info|warn|warning|debug|error)[ \t]*[:|>][ \t]*)+",
    re.I,
)


def normal(text: str) -> str:
    """Lower-case text without markup, line prefixes and invisible characters."""
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m.group(1), 16)), text)
    if "\\" in text:
        text = _SOFT.sub("\n", text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "-\n" in text or "- \n" in text:
        text = _HYPHENATED.sub("", text)
    return _PREFIX.sub(" ", text).lower()


def split_words(low: str) -> list[str]:
    return _WORD.findall(low)


def joined_words(low: str) -> tuple[list[str], list[int]]:
    """Words with inner punctuation removed, and how many split words each stands for."""
    out, weight = [], []
    for t in low.split():
        parts = _WORD.findall(t)
        if parts:
            out.append("".join(parts))
            weight.append(len(parts))
    return out, weight


def longest_run(doc: list[int], item: list[int], hits: list[tuple[int, int]], weight: list[int] | None = None) -> int:
    """Greatest number of consecutive item words in ``doc`` on a diagonal through a hit (doc, item positions)."""
    best = 0
    reach: dict[int, int] = {}
    n, m = len(item), len(doc)
    for p, q in sorted(hits):
        if p < reach.get(p - q, -1):
            continue
        a, b = p, q
        while a > 0 and b > 0 and item[b - 1] == doc[a - 1]:
            a, b = a - 1, b - 1
        first = b
        a, b = p, q
        while a < m and b < n and item[b] == doc[a]:
            a, b = a + 1, b + 1
        reach[p - q] = a + 1
        best = max(best, sum(weight[first:b]) if weight else b - first)
    return best


def smith_waterman(item: np.ndarray, doc: np.ndarray) -> tuple[int, int]:
    """(matched item words, length of the aligned stretch of ``doc``) of the best local alignment.

    Only the last row of scores is kept, with the matches and the beginning of the alignment that ends in
    each place, so the memory grows with ``doc`` alone.
    """
    n, m = len(item), len(doc)
    if not n or not m:
        return 0, 0
    place = np.arange(m + 1)
    h, kept, first = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64), place.copy()
    best = (0, 0, 0)
    for i in range(n):
        same = doc == item[i]
        across, down = h[:-1] + np.where(same, MATCH, MISMATCH), h[1:] + GAP
        diagonal = across >= down
        score = np.r_[0, np.where(diagonal, across, down)]
        kept = np.r_[0, np.where(diagonal, kept[:-1] + same, kept[1:])]
        first = np.r_[0, np.where(diagonal, first[:-1], first[1:])]
        ended = score <= 0
        score[ended], kept[ended], first[ended] = 0, 0, place[ended]
        # words of the document left out: the best place before, less the words between
        level = score - GAP * place
        h = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == h, place, 0))
        h, kept, first = h + GAP * place, kept[source], first[source]
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), int(kept[j]), int(source[j] - first[j]))
    return best[1], best[2]


def dense(ps: list[int], width: int, least: float) -> Iterator[tuple[int, int]]:
    """First and last of the sorted ``ps`` in every maximal window of ``width`` that holds at least ``least``."""
    b = -1
    for a in range(len(ps)):
        last = b
        while b + 1 < len(ps) and ps[b + 1] - ps[a] <= width:
            b += 1
        if b > last and b - a + 1 >= least:
            yield ps[a], ps[b]


def least_seeds(words: int, seeds: int) -> float:
    """Seeds that a copy keeps at least when a fifth of the words is changed or left out (three seeds each)."""
    return max(1.0, min(SEED_SHARE * words - N + 1, seeds - 3 * (1 - KEEP) * words))


def aligned(item: list[int], doc: list[int], ps: list[int], width: int, seeds: int) -> bool:
    """Whether any window of seeds at ``ps`` holds an edited copy of an item with so many ``seeds``."""
    for first, last in dense(ps, width, least_seeds(len(item), seeds)):
        lo, hi = max(0, first - width), last + width
        matched, span = smith_waterman(np.array(item), np.array(doc[lo:hi]))
        if matched >= KEEP * len(item) and span <= 2 * len(item):
            return True
    return False


class Index:
    """Seeds and word ids of the test items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocab: dict[str, int] = {}
        self.ids, self.words, self.joined, self.weights, self.only_joined = [], [], [], [], []
        for i, t in items:
            low = normal(t or "")
            self.ids.append(i)
            self.words.append(self._code(split_words(low)))
            j, w = joined_words(low)
            self.joined.append(self._code(j))
            self.weights.append(w)
            self.only_joined.append(frozenset(x for x, k in zip(j, w) if k > 1))
        self.size = len(self.vocab) + 2
        grams = [self.grams(np.array(w, np.int64)) for w in self.words]
        held = Counter(g for gs in grams for g in set(gs.tolist()))
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.seeds: list[int] = []
        for k, gs in enumerate(grams):
            g = gs.tolist()
            chosen = {p for p, x in enumerate(g) if held[x] <= RARE}
            span = RUN - N + 1
            for s in range(max(1, len(g) - span + 1)) if g else ():
                chosen.add(min(range(s, min(s + span, len(g))), key=lambda p: (held[g[p]], p)))
            enough = int(3 * (1 - KEEP) * len(self.words[k])) + 3
            for p in sorted(range(len(g)), key=lambda p: (held[g[p]], p)):
                if len(chosen) >= enough:
                    break
                chosen.add(p)
            for p in chosen:
                places[g[p]].append((k, p))
            self.seeds.append(len(chosen))
        self.short = [(k, w) for k, w in enumerate(self.words) if 0 < len(w) < N]
        self.keys = np.array(sorted(places), np.int64)
        self.places = [places[k] for k in self.keys.tolist()]
        # the joined form has seeds of its own: those in few items, and of every run of RUN words the rarest
        self.joined_ids = np.array(sorted({self.vocab[w] for ws in self.only_joined for w in ws}), np.int64)
        self.joined_places: dict[tuple[int, ...], list[int]] = defaultdict(list)
        self.joined_grams = [self._runs(k) for k in range(len(items))]
        held_joined = Counter(g for gs in self.joined_grams for g in set(gs))
        for k, gs in enumerate(self.joined_grams):
            if not self.only_joined[k]:
                continue
            seeds = {g for g in gs if held_joined[g] <= RARE}
            for q in range(len(gs)):
                e, n = q, 0
                while e < len(self.joined[k]) and n < RUN:
                    n += self.weights[k][e]
                    e += 1
                own = [gs[x] for x in range(q, e) if x + len(gs[x]) <= e]
                if own:
                    seeds.add(min(own, key=lambda g: (held_joined[g], g)))
            for g in seeds:
                self.joined_places[g].append(k)

    def _runs(self, k: int) -> list[tuple[int, ...]]:
        """Runs of N joined words of an item, shorter where fewer stand for RUN words, by position."""
        item, weight, out = self.joined[k], self.weights[k], []
        for q in range(len(item)):
            n = next((n for n in range(1, N) if sum(weight[q : q + n]) >= RUN), N)
            out.append(tuple(item[q : q + n]))
        return out

    def _code(self, ws: list[str]) -> list[int]:
        return [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]

    def grams(self, w: np.ndarray) -> np.ndarray:
        """Codes of 3-word runs; runs of more words than fit into a number share codes, and are told apart later."""
        if len(w) < N:
            return np.empty(0, np.int64)
        out = w[: len(w) - N + 1].copy()
        for k in range(1, N):
            with np.errstate(over="ignore"):
                out = out * self.size + w[k : len(w) - N + 1 + k]
        return out

    @staticmethod
    def known(w: np.ndarray) -> np.ndarray:
        """Which 3-word runs hold known words only (unknown ones are 0)."""
        ok = w > 0
        return np.logical_and.reduce([ok[k : len(w) - N + 1 + k] for k in range(N)]) if len(w) >= N else np.empty(0, bool)

    def code(self, ws: list[str]) -> list[int]:
        get = self.vocab.get
        return [get(w, 0) for w in ws]

    def batch(self, docs: list[str]) -> Iterator[tuple[int, int]]:
        """(position in ``docs``, item id) of every leak."""
        coded = [self.code(split_words(d)) for d in docs]
        size = np.fromiter((len(c) + 1 for c in coded), np.int64, len(coded))
        flat = np.fromiter((x for c in coded for x in (*c, 0)), np.int64, int(size.sum()))
        g = self.grams(flat)
        found = set()
        for k, ws in self.short:
            hit = np.logical_and.reduce([flat[i : len(flat) - len(ws) + 1 + i] == w for i, w in enumerate(ws)])
            found.update((int(d), k) for d in np.searchsorted(np.cumsum(size), np.flatnonzero(hit), side="right"))
        yield from ((d, self.ids[k]) for d, k in sorted(found))
        if not len(flat) or not len(self.keys) and not self.joined_places:
            return
        at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        pos = np.flatnonzero((self.keys[at] == g) & self.known(flat)) if len(self.keys) else np.empty(0, np.int64)
        start = np.r_[0, np.cumsum(size)]
        which = np.searchsorted(start, pos, side="right") - 1
        hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for p, d in zip(pos.tolist(), which.tolist()):
            for k, q in self.places[at[p]]:
                hits[d, k].append((p - int(start[d]), q))
        # documents with words that an item writes with punctuation are scanned in the joined form too
        for d in np.unique(np.searchsorted(start, np.flatnonzero(np.isin(flat, self.joined_ids)), side="right") - 1).tolist():
            ws = self.code(joined_words(docs[d])[0])
            for g in {g for n in range(1, N + 1) for g in zip(*(ws[i:] for i in range(n)))}:
                for k in self.joined_places.get(g, ()):
                    hits[d, k]  # noqa: B018
        sets: dict[int, frozenset[str]] = {}
        for (d, k), h in hits.items():
            if self.confirmed(docs[d], coded[d], k, h, sets, d):
                yield d, self.ids[k]

    def confirmed(self, low: str, doc: list[int], k: int, hits: list[tuple[int, int]], sets: dict[int, frozenset[str]], d: int) -> bool:
        item = self.words[k]
        if longest_run(doc, item, hits) >= RUN:
            return True
        # windows as long as the item with every third word added
        width = len(item) + len(item) // 3 + 4
        if aligned(item, doc, sorted({p for p, _ in hits}), width, self.seeds[k]):
            return True
        return self._has_joined(low, k, sets, d) and self._joined(low, k)

    def _has_joined(self, low: str, k: int, sets: dict[int, frozenset[str]], d: int) -> bool:
        """Whether the document writes any of the item's punctuated words without the punctuation."""
        if d not in sets:
            sets[d] = frozenset(split_words(low))
        return not self.only_joined[k].isdisjoint(sets[d])

    def _joined(self, low: str, k: int) -> bool:
        ws, weight = joined_words(low)
        doc, item = self.code(ws), self.joined[k]
        where: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for q, g in enumerate(self.joined_grams[k]):
            where[g].append(q)
        hits = [(p, q) for n in {len(g) for g in where} for p, g in enumerate(zip(*(doc[i:] for i in range(n)))) for q in where.get(g, ())]
        if longest_run(doc, item, hits, self.weights[k]) >= RUN:
            return True
        return aligned(item, doc, sorted({p for p, _ in hits}), len(item) + len(item) // 3 + 4, len(self.joined_grams[k]))


_BUILT: dict[str, Index] = {}


def _index(shipped: tuple[str, list[tuple[int, str]]]) -> Index:
    """The index of the shipped items, built once a Python worker."""
    name, rows = shipped
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(rows)
    return _BUILT[name]


def leaks(documents: DataFrame, items: DataFrame, max_items_mb: float = MAX_ITEMS_MB) -> DataFrame:
    """(doc_id, item_id): documents with a passage of an item, each pair once."""
    spark = documents.sparkSession
    bound = max_items_mb * 2**20
    held = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(total // bound) + 1
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", "text")
    out = None
    for part in range(parts):
        own = held if parts == 1 else held.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        shipped = spark.sparkContext.broadcast((uuid.uuid4().hex, sorted((r["item_id"], r["text"]) for r in own.collect())))

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            index = _index(shipped.value)
            for b in batches:
                low = [normal(t) if t else "" for t in b["text"]]
                pairs = list(index.batch(low))
                ids = b["doc_id"].to_numpy()
                yield pd.DataFrame({"doc_id": [ids[d] for d, _ in pairs], "item_id": [i for _, i in pairs]}).astype("int64")

        found = docs.mapInPandas(run, "doc_id long, item_id long")
        if parts > 1:
            found = materialize(found, "leaks")
            shipped.destroy()
        out = found if out is None else out.union(found)
    return out.distinct()
