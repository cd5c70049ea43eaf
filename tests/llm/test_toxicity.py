"""Toxicity scores on planted terms: held-out accuracy, and each step by itself."""

import random

import numpy as np

from peakfield.llm import toxicity
from peakfield.llm.toxicity import Weights, communities, evidence, fit, induced_lexicon, is_held_out, joining, polarity, rates, term_evidence, terms, together, toxicity_digest, training_rows, weigh, without_doubles

from .conftest import frame, prose, rows

BAD = ["vile", "rotten", "nasty", "foul", "grim", "mean", "cruel", "petty", "awful", "gross"]


def planted(n=400):
    r, docs, marks = random.Random(4), [], []
    for i in range(1000, 1000 + n):
        w = prose(i, r.randrange(40, 120)).split()
        toxic = i % 6 == 0
        for _ in range(r.randrange(4, 9) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(["", ",", "!!"]))
        docs.append((i, " ".join(w)))
        marks.append((i, 1, int(toxic or r.random() < 0.03)))
    return docs, marks


def test_held_out(spark):
    docs, marks = planted()
    labels = spark.createDataFrame([*marks, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity_digest(frame(spark, [*rows(), *docs]), labels).collect()
    assert len(got) == len(rows()) + len(docs)
    bad = {i for i, t in docs if i % 6 == 0}
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 and r.held_out == is_held_out(r.doc_id) for r in got)
    held = [r for r in got if r.held_out and (r.doc_id or 0) >= 1000]
    assert len(held) > 50 and sum(r.predicted == (r.doc_id in bad) for r in held) >= 0.97 * len(held)
    assert all(r.predicted == 0 for r in got if r.doc_id is not None and r.doc_id < 1000)


def test_lexicon_holds_bad_words(spark):
    docs, marks = planted()
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    frame_ = frame(spark, docs)
    found = induced_lexicon(frame_, training_rows(frame_, labels))
    assert len(set(found) & set(BAD)) >= 9 and len(set(found) - set(BAD)) <= 1


def test_several_vocabularies(spark):
    """Words of separate tongues, the lesser with one inflected stem: each is judged by its own kind."""
    r, docs, marks = random.Random(8), [], []
    tongues = [(["tar", "mol", "ven", "sip"], BAD, 6), (["qua", "zei", "oxu", "yil"], ["gruntz" + x for x in "abcdefghijklmnop"], 2)]
    for i in range(3000, 3900):
        parts, bad, often = tongues[i % 5 == 0]
        w = ["".join(r.choice(parts) for _ in range(r.randrange(1, 3))) for _ in range(r.randrange(60, 150))]
        toxic = i % 7 == 0
        for _ in range(r.randrange(4, 9) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad))
        docs.append((i, " ".join(w)))
        marks.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = [x for x in toxicity_digest(frame(spark, docs), labels).collect() if x.held_out]
    for lesser in (False, True):
        bad = [x.predicted for x in got if (x.doc_id % 5 == 0) == lesser and x.doc_id % 7 == 0]
        good = [x.predicted for x in got if (x.doc_id % 5 == 0) == lesser and x.doc_id % 7]
        assert len(bad) >= 4 and sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.02 * len(good)


def test_words_without_labels_join(spark):
    """A word that no labelled text holds joins from marked stretches, unless it is in copies alone."""
    r, docs = random.Random(5), []
    for i in range(300):
        w = prose(5000 + i, 80).split()
        if i % 3 == 0:
            w[10:10] = ["vile", "foul", "unheard" if i % 2 else "rotten", "nasty"]
            r.shuffle(w)
        docs.append((i, " ".join(w)))
    copy = prose(1, 60) + " vile copied foul " + prose(2, 60)
    found = joining(frame(spark, [*docs, *((1000 + i, copy) for i in range(50))]), {"vile": 0.9, "foul": 0.9, "nasty": 0.9}, set())
    assert {"unheard", "rotten"} <= set(found) and "copied" not in found and len(found) <= 3


def test_together(spark):
    docs = frame(spark, [(1, "a1 b1 a1"), (2, "b1 c1 " + "x " * 200 + "a1"), (3, None)]).repartition(3)
    both, n = together(docs, ["a1", "b1", "c1"])
    assert n == 3 and both.tolist() == [[2, 1, 0], [1, 2, 1], [0, 1, 1]]


def test_terms():
    assert terms(b"(Fools!)") == ("Fools", "Fool-", "Foo-") and terms(b"..") == () and terms("réeuxs".encode())[1] == "réeux-"
    rated = [("fool-", 10, 50.0), ("fools", 9, 40.0), ("bad-", 20, 60.0), ("badly", 9, 20.0), ("badder", 9, 70.0), ("sole", 5, 30.0)]
    assert without_doubles(rated) == ["fools", "bad-", "badder", "sole"]


def test_weights_of_few_and_many_terms():
    texts_ = ["", "vile", " a  Vile,\tday\n", "évile vilest x", "none here", "\x1c a\x85b"]
    few = weigh(texts_, Weights({"vile": 0.5, "vil-": 0.25}))
    assert few.tolist() == [[0, 0], [1, 0.5], [3, 0.5], [3, 0.25], [2, 0], [len(t.encode().split()) for t in texts_[5:]] + [0]]
    assert (weigh(texts_, Weights({"vile": 0.5, "vil-": 0.25} | {f"zz{i}": 1.0 for i in range(100)})) == few).all()


def test_polarity_and_fit():
    both = np.full((9, 9), 1)
    both[:4, :4] += 60  # a seed, 0, and its community
    both[4:, 4:] += 60  # another, without seeds
    assert len(set(communities(np.where((both > 50) & ~np.eye(9, dtype=bool), both, 0)).tolist())) == 2
    np.fill_diagonal(both, 100)
    p = polarity(both, 300, 1)
    assert p[0] > 0.5 > p[1:4].max() and (p[4:] == 0).all()
    a, b = fit(np.array([[0.0]] * 50 + [[1.0]] * 50), np.array([0.0] * 48 + [1.0] * 52))
    assert 1 / (1 + np.exp(-a)) < 0.1 and 1 / (1 + np.exp(-a - b)) > 0.9
    x = weigh(["", "x1. y1", "x1 x1"], Weights({"x1": 1.0}))
    assert x.tolist() == [[0, 0], [2, 1], [2, 2]]
    high, low = rates(x, np.array([0, 0, 1]))
    assert high > low and (evidence(x, high, low)[2] > evidence(x, high, low)[1]).all() and not evidence(x, high, low)[0].any()


def test_without_labels(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity_digest(empty, none).count() == 0
    assert {(r.score, r.predicted) for r in toxicity_digest(frame(spark, rows()), none).collect()} == {(0.0, 0)}


def test_stretches_with(monkeypatch):
    """Every stretch counts once for each of its words, and no word's stems are looked at."""
    monkeypatch.setattr(toxicity, "terms", None)
    texts = [(prose(i, 150 * i) + " Été, (été) x").strip() for i in range(6)] + ["", " \n"]
    words = sorted({w.strip(".,()") for w in " ".join(texts).lower().split()} - {"x"})[::3] + ["été", "absent"]
    want = dict.fromkeys(words, 0)
    for text in texts:
        ws = toxicity.split(text)
        for lo in range(0, len(ws), toxicity.STRETCH):
            for w in {w.strip(toxicity.ENDS).decode() for w in ws[lo : lo + toxicity.STRETCH]} & set(want):
                want[w] += 1
    got = toxicity.stretches_with([texts[:3], [], texts[3:]], words)
    assert dict(zip(words, got.tolist())) == want and want["absent"] == 0


def test_few_words_are_taken_apart(monkeypatch):
    """Of words that no stem of the lexicon begins, no terms are made, and the weights stay the same."""
    lexicon = {"vile": 0.5, "gruntz-": 0.25, "gruntzab": 1.0, "été": 0.75, "x-y": 0.1, "éco-": 0.3}
    words = sorted({w for i in range(40) for w in prose(i, 200).encode().lower().split()} | {w.encode() for w in ["(vile)", "viler", "gruntzabc", "Gruntzab".lower(), "gru", "été!", "étés", "x-y", "x-", "écot", "éco", "a", ""]})
    want = [next((lexicon[t] for t in terms(w) if t in lexicon), 0.0) for w in words]
    assert sum(x > 0 for x in want) == 6
    asked = []
    monkeypatch.setattr(toxicity, "terms", lambda w: asked.append(w) or terms(w))
    weights = Weights(lexicon)
    assert [weights.of_word[w] for w in words] == want
    assert {w for w in asked if not w.startswith(("gru".encode(), "é".encode()))} == set() and len(asked) < 0.1 * len(words)


def test_term_evidence(spark):
    """Texts and repeats by term, as counted one by one."""
    r, told = random.Random(9), []
    for i in range(120):
        w = [r.choice(["vile", "vilest", "(day)", "days", "Été", "x"]) for _ in range(r.randrange(9))]
        told.append((" ".join(w), r.random() < 0.3))
    want = {}
    for text, toxic in told:
        held = [t for w in toxicity.split(text) for t in terms(w)]
        for t in set(held):
            c = want.setdefault(t, [0, 0, 0, 0])
            c[0 if toxic else 1] += 1
            c[2 if toxic else 3] += held.count(t) > 1
    training = spark.createDataFrame(told, "text string, toxic boolean").repartition(3)
    assert {x.term: [x.a, x.b, x.a2, x.b2] for x in term_evidence(training).collect()} == want
    assert term_evidence(training.where("false")).collect() == []


def test_numbered_as_split():
    """Words by Arrow are those of ``split``, and stretches begin anew with each text."""
    texts = ["", " \n\t", " a  B\x0b\x0cc\r\nd ", "\x1c x\x85\x1fy É z\u2003q", "a", "b " * 450, "  end"]
    size, number, words = toxicity.numbered(toxicity.lowered(texts))
    words = [w.encode() for w in words.to_pylist()]
    assert [words[i] for i in number] == [w for t in texts for w in toxicity.split(t)] and size.tolist() == [len(toxicity.split(t)) for t in texts]
    row, n = toxicity.stretch_of(size)
    assert n == 1 + 1 + 1 + 3 + 1 and np.bincount(row).tolist() == [4, 4, 1, 200, 200, 50, 1]
    assert [len(x) for x in toxicity.numbered(toxicity.lowered([]))] == [0, 0, 0]


def test_few_words_are_looked_up(monkeypatch):
    """Only words that may have a term are looked up one by one, whether texts are looked at or not."""
    weights = Weights({"vile": 0.5, "gruntz-": 0.25})
    texts = [prose(i, 200) + " (Vile) gruntzer" for i in range(20)]
    assert weigh(texts, weights).tolist() == [[len(t.split()), 0.75] for t in texts]
    assert b"(vile)" in weights.of_word and len(weights.of_word) < 20
    few, words = toxicity.stretches_with([texts], ["vile", "gruntzer"]), ["none here", "day"]
    monkeypatch.setattr(toxicity, "LOOKED_FOR", 0)
    assert (weigh([*texts, *words], Weights({"vile": 0.5, "gruntz-": 0.25})) == [*([len(t.split()), 0.75] for t in texts), [2, 0], [1, 0]]).all()
    assert few.tolist() == toxicity.stretches_with([texts, words], ["vile", "gruntzer"]).tolist() == [20, 20]


def test_joining_counts_what_may_join(spark):
    """Words known from too many texts to be marked often enough are not counted; the result is the same."""
    r, docs = random.Random(6), []
    for i in range(230):
        w = prose(7000 + i, 40).split() + (["vile", "foul", "nasty", "rotten" if i % 2 else "common"] if i < 80 else ["common"])
        r.shuffle(w)
        docs.append((i, " ".join(w)))
    docs, lexicon = frame(spark, docs), {"vile": 0.9, "foul": 0.9, "nasty": 0.9}
    held = term_evidence(docs.selectExpr("text", "false as toxic")).selectExpr("term", "a + b as n")
    every = joining(docs, lexicon, set())
    assert "rotten" in every and "common" not in every and joining(docs, lexicon, set(), held) == every
    assert "rotten" not in joining(docs, lexicon, set(), held.selectExpr("term", "n + 1000 as n"))


def test_repeated_ids_bound_nothing(spark, monkeypatch):
    """Where a doc_id has several texts, these are learnt from more often than they are there."""
    given = []
    monkeypatch.setattr(toxicity, "joining", lambda docs, lexicon, judged, held=None: given.append(held) or {})
    pairs, marks = planted()
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    taught = next(i for i, _ in pairs if not is_held_out(i))
    for docs in (pairs, [*pairs, (taught, "another text")]):
        docs = frame(spark, docs)
        induced_lexicon(docs, training_rows(docs, labels))
    assert given[0] is not None and given[1] is None
