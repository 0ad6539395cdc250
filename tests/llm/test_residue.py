import random

import pytest

from corvane.llm import residue as k

RNG = random.Random(6)
WORDS = "router index batch kernel plan shard reader loss gate window cache mixture trace report segment holdout".split()


def prose(n=6):
    return " ".join(f"The {RNG.choice(WORDS)} {RNG.choice(WORDS)} kept {RNG.randrange(99)} rows while the {RNG.choice(WORDS)} was read again." for _ in range(n))


BAD = ["Access denied\n\nYour session has expired, sign in again.\n\nReference: 5F8AC0E", "This page needs JavaScript to work.", "Please enable JavaScript and reload.", "Error 404\n\nThe page you were looking for does not exist.", '{"status": 502, "error": "The upstream gateway sent an invalid reply."}',
       "Lorem ipsum dolor amet lorem ipsum.\n\nIpsum lorem dolor sit amet ipsum.", "sample text sample text sample text sample text.", "Your browser blocks JavaScript and cookies. Switch to a supported one."]
TEMPLATES = ["{{owner}}", "[[start date]]", "<<run id>>", "${hardware}", "{reviewer}", "@@stand@@", "#RUN_ID#", "%OWNER%", "$OWNER$", "__OWNER__", "«рецензент»_____", "(owner: ______)", "<project name>", "[INSERT OWNER]", "[ВСТАВЬТЕ СТЕНД]", "<!-- owner -->", "{% owner %}", "XX-OWNER-XX"]
FINE = ["Format strings such as `%s` or `{span}` are escaped in tools/x.py.", "Use `${TRACE}` and `${HOME}` in the launcher.", "```jinja\n<td>{{ row.batch }}</td>\n```", "The proxy answered `404 Not Found` until the rule for net/a.py was fixed.", "Owner: the mesh group", "def f(x):\n    return {x}", "We replaced the lorem ipsum blocks in the demo with real cards."]


@pytest.fixture(scope="module")
def docs():
    out = {}
    for i in range(400):
        out[i] = ("content", prose())
    for i, f in enumerate(FINE * 4):
        out[1000 + i] = ("content", f"# {RNG.choice(WORDS)} card\n\n{prose(3)}\n\n{f}\n\n{prose(2)}")
    for i, b in enumerate(BAD * 3):
        out[2000 + i] = ("residue", b)
    for i, b in enumerate(BAD[:2]):
        out[3000 + i] = ("residue", f"# card\n\n## Steps\n\n{prose(2)}\n\n## Scope\n\n{b}\n\n## Method\n\n{prose(2)}")
    for i, t in enumerate(TEMPLATES * 3):
        out[4000 + i] = ("template", f"{prose(2)} Prepared for {t} before the review. {prose(1)}")
    return out


def test_classes(spark, docs):
    df = spark.createDataFrame([(i, t, "x") for i, (_, t) in docs.items()] * 2 + [(9001, None, "x"), (9002, " \n", "x"), (9003, prose(3000), "x")], "doc_id long, text string, kind string")
    rows = k.excluded(df).collect()
    got = {r["doc_id"]: r["kind"] for r in rows}
    assert len(rows) == len(got)
    want = {i: c for i, (c, _) in docs.items() if c != "content"}
    assert {i: c for i, c in got.items() if i not in want} == {}
    assert [i for i in want if i not in got] == []


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string"
    assert k.excluded(spark.createDataFrame([], schema)).count() == 0
    assert k.excluded(spark.createDataFrame([(1, prose())], schema)).count() == 0


@pytest.mark.parametrize("t", TEMPLATES)
def test_fields(t):
    assert k.fields(f"Prepared for {t} before the review.")


@pytest.mark.parametrize("t", ["a <b>bold</b> word", "{% for x in rows %}", "50% of 70% more", "see #412 and #7", "__init__ and __main__", "x = {1, 2}", "«цитата из текста»", "/api/{id}/x", "[link](a.md)"])
def test_no_fields(t):
    assert not k.fields(f"The reader keeps {t} as it is.")


def model_of(bad, content):
    known = [k.tokens(b) for b in [bad] * 4 + BAD * 2]
    return k.Model(k.expect_maximize(known, [(k.tokens(s), 1) for s in content], 0.03), None)


@pytest.mark.parametrize("bad", ["the the the the the the the", "rows batch kept was read while the index"])
def test_evidence_without_a_telling_word(bad):
    """Ordinary words whose pairs or repetition alone say residue."""
    content = [s + "." for s in prose(300).split(". ")] + [f"The index and its batch {i} were read while the rows kept to the plan." for i in range(200)]
    model = model_of(bad, content)
    assert all(model.residue.weights.get(w, 0.0) < 2.0 for w in set(bad.split()))
    assert k.residue_kind(bad, model) == "residue"
    assert k.residue_kind(f"# card\n\n{content[0]}\n\n{bad}", model) is None
    assert k.residue_kind(f"# card\n\n{content[0]}\n\n## Scope\n\n{bad}\n\n{content[1]}", model) == "residue"


def test_model_decides(docs):
    """Without its weights the model finds other records, both of residue and of templates."""
    texts = [t for _, t in docs.values()]
    model = k.learn(texts, texts)
    real = [k.residue_kind(t, model) for t in texts]
    assert real.count("residue") > 20 and real.count("template") > 20
    flat = k.Model(k.Bayes({}, model.residue.prior), k.Bayes({}, model.unfilled.prior))
    other = [k.residue_kind(t, flat) for t in texts]
    assert sum(a != b and a == "residue" for a, b in zip(real, other)) > 20
    assert sum(a is None and b == "template" for a, b in zip(real, other)) > 5


def test_shares_are_estimated():
    known = [{"a", "b"}] * 5
    half = k.expect_maximize(known, [({"a", "b"}, 50), ({"c", "d"}, 50)], 0.03)
    few = k.expect_maximize(known, [({"a", "b"}, 2), ({"c", "d"}, 98)], 0.03)
    assert abs(half.prior) < 0.2 and few.prior < -3 and half.odds({"a", "b"}) > 0 > half.odds({"c", "d"})


def test_learned_phrases():
    """Phrases that no trusted record is known by are learned from those beside them."""
    line = "Your trial is over, subscribe to keep reading."
    pages = [f"Error 40{i % 4}\n\n{line}\n\nReference: 5F8AC0{i}" for i in range(12)]
    texts = pages + [line] + [prose() for _ in range(300)]
    assert not k.trusted(line) and k.residue_kind(line, k.learn(texts, texts)) == "residue"
