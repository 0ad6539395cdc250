import random

import pytest

from corvane.llm import pairs

P = "Explain how the fused kernel works with the quiet loss curve. The cold router moved 41 rows of the shared index before the restart, so the batch plan stays at 33.5."
A = "The kernel joins both passes of the curve. It reads the index once and keeps the plan as it is."


@pytest.mark.parametrize(("prompt", "answer", "want"), [
    (P, A, None), (P, None, "empty"), (P, "", "empty"), (P, " ​\n", "empty"), (P, "...", "empty"), (P, "null", "empty"), (P, "N/A", "empty"), (P, "```\n```", "empty"),
    (P, P, "copied"), (P, "You asked: " + P.lower(), "copied"), (P, P.replace(".", "").replace(",", ""), "copied"), (P, "> " + P.split(".")[0] + ".\n\n" + A, None),
    (P, "I'm sorry, but I can't help with this request. Is there anything else you need?", "refusal"), ("Объясни это. И то тоже, пожалуйста.", "К сожалению, такое я сделать не вправе.", "refusal"),
    (P, "I can't reproduce the failure on the first try, but the fix is in the reader: it now opens the shard once and keeps the index in memory for all legs. The second run was clean.", None),
    (P, "Сборщик открыл индекс и не тронул план, а кэш остался на прежнем месте после рестарта.", "wrong_language"), (P + " Answer in Russian, please.", "Сборщик открыл индекс и не тронул план, а кэш остался на месте.", None),
    (P, "Der Messfühler bleibt bei dem alten Wert und wird nicht mehr auf dem kleinen Rechner geprüft.", "wrong_language"),
    (P, A + " The reader then opens the", "truncated"), (P, A + "\n\n```json\n{\"status\": \"comp", "truncated"), (P, A + "\n1. First step done.\n2. Then we", "truncated"),
    (P, A + "\n\n```python\nf(1)\n```", None), (P, A + "\n\nChanged files:\n- net/a.py\n- docs/b.md", None), (P, A + " docs/adr/x.py → e6efd2a", None), (None, A, None), ("", A, None),
])
def test_defects(prompt, answer, want):
    assert pairs.defect(prompt, answer) == want


def test_automaton_equals_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        p = [rng.choice("abc") for _ in range(rng.randrange(0, 14))]
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 14))]
        for least in (1, 2, 3):
            want = [False] * len(a)
            for i in range(len(a)):
                for j in range(i + least, len(a) + 1):
                    if any(p[k : k + j - i] == a[i:j] for k in range(len(p))):
                        want[i:j] = [True] * (j - i)
            assert pairs.SuffixAutomaton(p).covered(a, least) == want


def test_long_texts():
    w = " ".join(f"w{i}" for i in range(50_000)) + "."
    assert pairs.defect(w, w) == "copied" and pairs.defect(w, "The end is here. All is well.") is None


def test_operator(spark):
    schema = "turn_id long, episode_id string, turn_no int, role string, kind string, content string, prompt string, answer string"
    rows = [(1, "e", 0, "user", "text", P, "", ""), (2, "e", 1, "assistant", "text", A, "", ""), (3, "e", 2, "assistant", "tool_call", "{}", "", ""), (4, "e", 3, "assistant", "text", "...", "", ""),
            (5, "f", 0, "user", "text", P, "", ""), (6, "f", 1, "assistant", "text", A, "", ""), (7, "g", 0, "user", "text", P, "", ""), (8, None, 0, "user", "text", P, "", "")]
    df = spark.createDataFrame(rows + rows, schema)
    assert sorted(tuple(r) for r in pairs.defects(df).collect()) == [("e", "empty"), ("g", "empty")]
    assert pairs.defects(spark.createDataFrame([], schema)).count() == 0


def test_no_size_decides():
    declining = " ".join(["I cannot help with this request, whatever the reason behind the question may be."] * 14)
    assert len(declining.split()) > 160 and pairs.is_refusal(declining)
    assert pairs.defect("Why? Please restart the worker now. It hangs.", "restart the worker now") == "copied"
    assert pairs.defect("yes or no", "yes") is None and pairs.defect("restart now", "Restart now.") == "copied"
    assert pairs.is_refusal("I can't help with this.\n```\n```") and not pairs.is_refusal("I can't open it.\n```\nshard = read(path, index, rows)\n```")


@pytest.mark.parametrize("text", ["That falls outside my remit, so I shall decline.", "We are unable to comply with this.", "I'm afraid I must pass; it would violate the rules set for me.", "My instructions prevent me from answering.", "There is nothing I can do about this.",
    "Это вне моей компетенции.", "Увы, мне запрещено это обсуждать.", "Мы не станем выполнять такое.", "Das darf ich nicht beantworten.", "Dabei werde ich nicht helfen."])
def test_refusals_in_other_words(text):
    assert pairs.is_refusal(text)


@pytest.mark.parametrize("text", ["Nobody rejected the batch; the gate had already cached it.", "The router declined 41 rows and the reader kept the rest.", "Правило отклонило 4 строки после рестарта.", "Set the cap to 37, keep the rule as it is."])
def test_reports_of_refusing_things(text):
    assert not pairs.is_refusal(text)


def test_runs_decide_what_is_copied(monkeypatch):
    """An answer in the prompt's words, but not in its runs, is no copy."""
    rng = random.Random(3)
    w = P.rstrip(".").split()
    other = w[:]
    rng.shuffle(other)
    own = " ".join(other) + "."
    assert pairs.defect(P, P) == "copied" and pairs.defect(P, own) != "copied"
    monkeypatch.setattr(pairs.SuffixAutomaton, "covered", lambda self, seq, least: [w in self.next[0] for w in seq])
    assert pairs.defect(P, own) == "copied"
