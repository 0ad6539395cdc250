import itertools
import random

import numpy as np
import pytest

from corvane.llm import history, minwise, neardup

TURNS = "turn_id long, episode_id string, turn_no int, role string, kind string, content string, node long, keys string"


def turns(spark, texts):
    """Each text split over two turns, delivered twice, with clashing extra columns."""
    rows, k = [], 0
    for e, t in texts.items():
        parts = [None] if t is None else [t[: len(t.split(" ")[0])], t[len(t.split(" ")[0]) + 1 :]] if " " in t else [t]
        for no, c in enumerate(parts):
            k += 1
            rows += [(k, e, no, "user", "text", c, 7, "x")] * 2
    return spark.createDataFrame(rows, TURNS)


def brute(texts, threshold=0.6, n=3):
    sets = {e: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for e, w in ((e, minwise.words(t)) for e, t in texts.items())}
    out = set()
    for a, b in itertools.combinations(sorted(texts), 2):
        u = len(sets[a] | sets[b])
        same = minwise.words(texts[a]) == minwise.words(texts[b]) != []
        if same or u and len(sets[a] & sets[b]) / u >= threshold:
            out.add((a, b))
    return out


def corpus(seed=3, groups=12, singles=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts, k = {}, 0
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(rng.choice([2, 3, 9])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 14))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            k += 1
            texts[f"ep-{rng.randrange(10**6):06d}-{k}"] = " ".join(w)
    for _ in range(singles):
        k += 1
        texts[f"ep-{rng.randrange(10**6):06d}-{k}"] = " ".join(rng.choice(vocab) for _ in range(60))
    return texts


def pairs(spark, texts):
    docs = neardup.episode_texts(turns(spark, texts))
    return {(r["id_a"], r["id_b"]) for r in neardup.similar_pairs(neardup.signed(docs), docs).collect()}


def test_pairs_equal_brute_force(spark):
    texts = corpus()
    want = brute(texts)
    assert len(want) > 40 and pairs(spark, texts) == want


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    texts = {"a": None, "b": "", "c": "  ", "d": "one two", "e": "One, two!", "f": "one", "g": long, "h": long + " tail", "i": "a b c", "j": "A b c", "k": "…"}
    assert pairs(spark, texts) == {("d", "e"), ("g", "h"), ("i", "j")}


def test_large_group_of_near_copies_in_blocks(spark):
    base = [f"v{i}" for i in range(200)]
    texts = {f"e{i:03d}": " ".join(base[: i % 5] + [f"u{i}"] + base[i % 5 :]) for i in range(60)}
    docs = neardup.episode_texts(turns(spark, texts))
    sig = neardup.signed(docs)
    got = neardup.similar_nodes(sig, docs, block=16)
    assert got.count() == len(brute(texts)) == 60 * 59 // 2
    assert neardup.groups(sig, docs).select("group_id").distinct().count() == 1


def test_empty(spark):
    docs = neardup.episode_texts(spark.createDataFrame([], TURNS))
    none = neardup.signed(docs)
    assert neardup.similar_pairs(none, docs).count() == 0 and neardup.groups(none, docs).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    s = minwise.Signer(64, 4)
    for shared in (50, 200, 380):
        a = rng.integers(0, 2**63, 400).astype(np.uint64)
        b = np.r_[a[:shared], rng.integers(0, 2**63, 400 - shared).astype(np.uint64)]
        x = s.signatures([np.unique(a), np.unique(b)])
        assert abs((x[0] == x[1]).mean() - shared / (800 - shared)) < 0.12
    small = s.signatures([np.arange(3, dtype=np.uint64) * np.uint64(2**58), np.empty(0, np.uint64)])
    assert len(set(small[0].tolist())) <= 3 and not len(s.keys([np.empty(0, np.uint64)])[0])


def greedy(texts, batch):
    near = brute(texts)
    link = {e: {b if e == a else a for a, b in near if e in (a, b)} for e in texts}
    accepted, out = set(), set()
    for e in sorted(texts, key=lambda e: (batch[e], e)):
        if batch[e] > min(batch.values()) and link[e] & accepted:
            out.add(e)
        else:
            accepted.add(e)
    return out


def test_history_equals_greedy(spark):
    texts = corpus(seed=8)
    batch = {e: i % 4 for i, e in enumerate(sorted(texts, key=lambda e: e[-1] + e))}
    eps = spark.createDataFrame([(e, b, "x") for e, b in batch.items()] * 2, "id string, batch_no int, text string")
    got = {r["episode_id"] for r in history.rejected(eps, turns(spark, texts)).collect()}
    assert got == greedy(texts, batch) and got


@pytest.mark.parametrize("batches", [[], [0], [None, None]])
def test_history_without_later_batches(spark, batches):
    eps = spark.createDataFrame([(f"e{i}", b) for i, b in enumerate(batches)], "id string, batch_no int")
    assert history.rejected(eps, turns(spark, {"e0": "a b c d"})).count() == 0


def test_groups_are_the_components_of_the_pairs(spark):
    texts = corpus(seed=5)
    docs = neardup.episode_texts(turns(spark, texts))
    got = {r["id"]: r["group_id"] for r in neardup.groups(neardup.signed(docs), docs).collect()}
    parent = {e: e for e in texts}

    def root(e):
        while parent[e] != e:
            e = parent[e]
        return e

    for a, b in brute(texts):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {e: root(e) for e in texts}


@pytest.mark.parametrize("rounds", [1, 2])
def test_bucket_of_unlike_records(spark, rounds):
    """A shared head puts many records into one bucket; the pairs in it are found in few rounds."""
    rng = random.Random(1)
    head = [f"h{i}" for i in range(60)]
    texts, n = {}, 0
    for i in range(14):
        tail = [f"t{i}x{j}" for j in range(50)]
        for k in range(2):
            w = head + tail
            w[70 + k] = f"z{i}{k}"
            texts[f"e{n:02d}"] = " ".join(w)
            n += 1
    rng.shuffle(head)
    docs = neardup.episode_texts(turns(spark, texts))
    node = {r["id"]: r["node"] for r in neardup.signed(docs).collect()}
    got = {frozenset((r["node_a"], r["node_b"])) for r in neardup.similar_nodes(neardup.signed(docs), docs, rounds=rounds, block=4).collect()}
    assert got == {frozenset((node[a], node[b])) for a, b in brute(texts)} and len(got) == 14


def test_few_shingles_fill_every_bin():
    s = minwise.Signer(40, 4)
    one = np.array([123456789], np.uint64)
    assert (s.signatures([one])[0] == s.signatures([one])[0][0]).all() and len(set(s.keys([one, one])[0].tolist())) == 40
    assert s.keys([one])[0].dtype == np.int64


def sig_of(spark, texts):
    docs = neardup.episode_texts(turns(spark, texts))
    return neardup.signed(docs), docs


def test_index_outlives_the_session(spark, tmp_path):
    base = [f"k{i}" for i in range(60)]
    change = lambda k: " ".join(w if i != k else "new" for i, w in enumerate(base))
    path = f"file://{tmp_path}/index"
    sig, docs = sig_of(spark, {"a": " ".join(base), "b": "two words", "c": "alone here " * 20})
    history.HistoryIndex(spark, path).append(sig, docs)
    other = spark.newSession()
    again = history.HistoryIndex(other, path)
    sig, docs = sig_of(other, {"d": change(5), "e": "Two, words!", "f": "something else entirely", "g": None, "h": "something else, entirely"})
    assert {r["id"] for r in history.admit(again, sig, docs).collect()} == {"d", "e", "h"}
    third = history.HistoryIndex(spark.newSession(), path)
    sig, docs = sig_of(spark, {"i": "Something else entirely", "j": "not seen before at all"})
    assert {r["id"] for r in history.admit(third, sig, docs).collect()} == {"i"}
    third.drop()
    sig, docs = sig_of(spark, {"i": "Something else entirely"})
    assert history.admit(history.HistoryIndex(spark, path), sig, docs).count() == 0


def test_probe_reads_the_matching_subfolders_only(spark, tmp_path):
    texts = {f"e{i}": " ".join(f"w{i}x{j}" for j in range(30)) for i in range(200)}
    index = history.HistoryIndex(spark, f"file://{tmp_path}/index", parts=512)
    index.append(*sig_of(spark, texts))
    rows = history._keyed(sig_of(spark, {"n": texts["e7"] + " more"})[0]).withColumn("part", index._part("key"))
    held = index._held("keys", "key long, node long, lead boolean", rows)
    files = len(held.inputFiles())
    read = {f for (f,) in held.select("_metadata.file_name").distinct().collect()}
    assert len(read) <= 40 < files
    sig, docs = sig_of(spark, {"n": texts["e7"] + " more"})
    assert history.admit(index, sig, docs).count() == 1


def test_batches_one_by_one_equal_all_at_once(spark, tmp_path):
    texts = corpus(seed=9, groups=8, singles=10)
    batch = {e: i % 3 for i, e in enumerate(sorted(texts, key=lambda e: e[-1] + e))}
    index = history.HistoryIndex(spark, f"file://{tmp_path}/index")
    got = set()
    for n in range(3):
        sig, docs = sig_of(spark, {e: t for e, t in texts.items() if batch[e] == n})
        if n:
            got |= {r["id"] for r in history.admit(index, sig, docs).collect()}
        else:
            index.append(sig, docs)
    assert got == greedy(texts, batch)
