import random

import numpy as np
import pytest

from corvane.llm import leakage as k

RNG = random.Random(4)
VOCAB = [f"term{i}" for i in range(3000)]
ITEMS = {i: " ".join(RNG.choice(VOCAB) for _ in range(70)) + f" value 33.5 of Case-{i} reached." for i in range(1, 21)}
NOISE = " ".join(RNG.choice(VOCAB) for _ in range(200))
W = {i: t.split() for i, t in ITEMS.items()}


def paraphrase(ws, share, seed=0):
    rng = random.Random(seed)
    out = []
    for w in ws:
        x = rng.random()
        out += [] if x < share / 3 else ["changed"] if x < 2 * share / 3 else [w, "added"] if x < share else [w]
    return " ".join(out)


DOCS = {
    1: (NOISE, set()), 2: (f"{NOISE} {ITEMS[3]} {NOISE}", {3}), 3: (" ".join(W[4][10:22]), {4}), 4: (" ".join(W[4][10:21]), set()), 5: (paraphrase(W[5], 0.15), {5}), 6: (paraphrase(W[6], 0.75), set()),
    7: (ITEMS[7].upper().replace(" ", "\n> "), {7}), 8: ("<p>" + ITEMS[8].replace(" ", " <b>").replace("<b>term", "</b>term") + "</p>", {8}), 9: ("­".join(ITEMS[9]), {9}), 10: (ITEMS[10].replace(".", "").replace("-", ""), {10}),
    11: ("\n".join(f"{i}. {' '.join(W[11][i * 5 : i * 5 + 5])}" for i in range(15)), {11}), 12: (ITEMS[12] + " " + ITEMS[13], {12, 13}), 13: (None, set()), 14: (" \n", set()), 15: ("term1", set()), 16: (NOISE * 150 + ITEMS[14], {14}), 17: (f"{' '.join(W[1][20:31])} x {' '.join(W[1][31:42])}", set()),
}


def test_leaks(spark):
    docs = spark.createDataFrame([(i, t, "e") for i, (t, _) in DOCS.items()] * 2, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(i, t) for i, t in ITEMS.items()] + [(99, None), (98, "two words")], "item_id long, text string")
    got = {tuple(r) for r in k.leaks(docs, items).collect()}
    assert got == {(d, i) for d, (_, s) in DOCS.items() for i in s}
    assert k.leaks(docs.limit(0), items).count() == 0 and k.leaks(docs, items.limit(0)).count() == 0


def test_seeds_reach_every_run():
    index = k.Index(list(ITEMS.items()) + [(50, ITEMS[2])])
    keys = set(index.keys.tolist())
    for w in index.words:
        g = index.grams(np.array(w)).tolist()
        assert all(any(x in keys for x in g[s : s + k.RUN - k.N + 1]) for s in range(len(g) - k.RUN + k.N))


@pytest.mark.parametrize("seed", range(30))
def test_alignment_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, 4, rng.integers(1, 8)), rng.integers(1, 4, rng.integers(1, 9))
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (k.MATCH if a[i - 1] == b[j - 1] else k.MISMATCH), h[i - 1, j] + k.GAP, h[i, j - 1] + k.GAP)
    matched, span = k.smith_waterman(a, b)
    assert k.MATCH * matched >= h.max() and span >= matched and (matched > 0) == (h.max() > 0)


LONG = [f"w{i}" for i in range(40)]
PUNCTUATED = " ".join(f"w{i}" if i % 2 else f"p{i}-q{i}" for i in range(40))
GLUED = [f"w{i}" if i % 2 else f"p{i}q{i}" for i in range(40)]


@pytest.mark.parametrize(
    ("item", "doc"),
    [
        # frequent words only, in a joined run
        (PUNCTUATED, " ".join([f"x{j} {w}" for w in GLUED for j in range(20)] + ["x", *GLUED[4:14], "x"])),
        # an edited joined copy without a seed in the split form
        (PUNCTUATED, " ".join(f"x{i}" if i % 6 == 5 else w for i, w in enumerate(GLUED))),
        # an edited copy behind a denser window that is none
        (" ".join(LONG), " ".join([*(LONG[:11] + ["x"]) * 6, *["y"] * 200, *[f"z{i}" if i % 6 == 5 else w for i, w in enumerate(LONG)]])),
    ],
)
def test_copies_in_long_documents(item, doc):
    assert list(k.Index([(1, item)]).batch(["nothing here", doc])) == [(1, 1)]
    assert list(k.Index([(1, item)]).batch(["nothing here", " ".join(sorted(doc.split(), reverse=True))])) == []


def test_items_of_frequent_grams_only():
    """Every n-gram stands in more than RARE items; a fifth of the words is changed or left out."""
    base = [f"c{i}" for i in range(60)]
    items = [(i, " ".join(base)) for i in range(k.RARE + 3)]
    for offset in range(5):
        doc = " ".join("x" if i % 5 == offset else w for i, w in enumerate(base))
        assert {i for _, i in k.Index(items).batch([doc])} == {i for i, _ in items}
        gone = " ".join(w for i, w in enumerate(base) if i % 5 != offset)
        assert {i for _, i in k.Index(items).batch([gone])} == {i for i, _ in items}


def test_as_many_seeds_as_edits_can_destroy():
    index = k.Index([(i, " ".join(f"c{j}" for j in range(50))) for i in range(20)])
    assert all(n >= 3 * 0.2 * 50 + 3 - 1e-9 for n in index.seeds) and k.least_seeds(50, index.seeds[0]) >= 1


def test_short_items():
    index = k.Index([(1, "alpha beta"), (2, "gamma"), (3, "")])
    assert sorted(index.batch(["x alpha beta", "alpha x beta gamma", "", "beta"])) == [(0, 1), (1, 2)]


def test_many_words_do_not_overflow():
    index = k.Index([(1, " ".join(f"c{i}" for i in range(30)))])
    index.size = 2**40 + 3
    g = index.grams(np.array(index.words[0]))
    index.keys, index.places = np.sort(g), [[(0, int(p))] for p in np.argsort(g)]
    assert list(index.batch([" ".join(f"c{i}" for i in range(30))])) == [(0, 1)]


def test_long_item_in_linear_memory():
    import tracemalloc

    words = [f"l{i}" for i in range(3000)]
    doc = np.array([i if i % 6 else 10**6 for i in range(1, 3001)])
    tracemalloc.start()
    matched, span = k.smith_waterman(np.arange(1, 3001), doc)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert matched == 2500 and span == 2999 and peak < 4 * 2**20
    assert list(k.Index([(1, " ".join(words))]).batch([" ".join(w if i % 6 else "x" for i, w in enumerate(words))])) == [(0, 1)]


def test_items_in_parts(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in DOCS.items()], "doc_id long, text string")
    items = spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")
    got = {tuple(r) for r in k.leaks(docs, items, max_items_mb=0.004).collect()}
    assert got == {(d, i) for d, (_, s) in DOCS.items() for i in s}
