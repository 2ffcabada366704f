import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from sparkquarry.llm import toxicity
from tests.llm.odd import ODD_TEXTS

BAD = ["idiot", "scum", "moron", "grumble"]


def corpus():
    rng = random.Random(11)
    syllables = ["an", "the", "er", "tion", "is", "of", "re", "ble", "ing", "st", "id", "io", "mo", "ro", "um", "ta"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(600):
        text = [word() for _ in range(rng.randint(20, 80))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for b in rng.sample(BAD, 1):
                text.insert(rng.randrange(len(text)), b)
        rows.append((i, " ".join(text), "x"))
        labels.append((i, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (5, None), (10**9, 1)], "doc_id long, toxic int")
    return docs, marks, labels, toxicity.learn(docs, marks, toxicity.fold(F.col("doc_id")) != 2)


def test_held_out_accuracy(trained):
    docs, marks, labels, _ = trained
    got = {r.doc_id: r for r in toxicity.report(docs, marks).collect()}
    held = [(got[i].predicted, t) for i, t in labels if got[i].held_out]
    assert len(held) > 100
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_labels_of_held_out_rows_do_not_matter(trained, spark):
    docs, marks, labels, model = trained
    flipped = marks.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.learn(docs, flipped, toxicity.fold(F.col("doc_id")) != 2)
    assert again["stems"] == model["stems"] and np.array_equal(again["costs"], model["costs"])


@pytest.mark.parametrize("text", ["an 1d10t is", "i d i o t", "m.o.r.o.n", "M-O-R-O-N of", "idiooooot", "the (idiot)!", "$cum", "5cum", "m0r0n", "grumb1e", "idiiot", "moorron", "scuum"])
def test_noise_is_undone(trained, text):
    scorer = toxicity.Scorer(trained[3])
    assert scorer.score(pa.array([text]))[0] >= toxicity.THRESHOLD, scorer.reader.restore(text)


def test_clean_texts_stay_clean(trained):
    scorer = toxicity.Scorer(trained[3])
    texts = ["a a a a a a a a", "call 97.51.17.173 or 2390409500648960", "mail7.example.com", "the station is re-opened", *[t or "" for t in ODD_TEXTS]]
    assert (scorer.score(pa.array(texts)) < toxicity.THRESHOLD).all()


def test_words_with_doubled_letters_and_signs_alone(trained):
    reader = toxicity.Scorer(trained[3]).reader
    assert reader.words_of("idiiot")[0] == "idiiot" and "idiot" in reader.words_of("idiiot")
    assert reader.words_of("idiot") == ["idiot"]
    assert reader.words_of("@$$") and all(w.isalpha() for w in reader.words_of("@$$"))
    assert reader.words_of("2024") == reader.words_of("10:30") == reader.words_of("!!!") == reader.words_of("$100") == []


def test_viterbi_finds_the_cheapest_reading():
    """Against all readings of short lattices."""
    rng = np.random.default_rng(1)
    costs = rng.random((toxicity.SIGNS,) * 3)
    reader = toxicity.Reader(costs)

    def cost(options):
        best = None

        def walk(k, a, b, total, word):
            nonlocal best
            if k == len(options):
                total += costs[a][b][0] if b else 0
                best = min(best, total) if best is not None else total
                return
            for letters, noise in options[k]:
                x, y, now = a, b, total + noise
                if letters == " " and y == 0:
                    letters = ""
                for c in letters:
                    now += costs[x][y][toxicity.sign(c)]
                    x, y = y, toxicity.sign(c)
                walk(k + 1, x, y, now, word + letters)

        walk(0, 0, 0, 0.0, "")
        return best

    def read_cost(words):
        return words

    for piece in ["1d1", "m0", "a@b", "5c", "x1l"]:
        options = [reader._options(c, 1, False) for c in piece]
        want = cost(options)
        found = reader._read(piece)
        tried = [o for o in options]
        # The reading's own cost: the cheapest path that spells it.
        spelled = " ".join(found)
        paths = [(0, 0, 0.0, "")]
        for k in range(len(tried)):
            nxt = []
            for a, b, total, word in paths:
                for letters, noise in tried[k]:
                    x, y, now = a, b, total + noise
                    if letters == " " and y == 0:
                        letters = ""
                    for c in letters:
                        now += costs[x][y][toxicity.sign(c)]
                        x, y = y, toxicity.sign(c)
                    nxt.append((x, y, now, word + letters))
            paths = nxt
        own = min(total + (costs[a][b][0] if b else 0) for a, b, total, word in paths if " ".join(word.split()) == spelled)
        assert own == pytest.approx(want)


def test_trigrams_are_those_of_all_texts(spark):
    texts = ["Ab c", None, "", "é1z"]
    got = toxicity.count_trigrams(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1))
    whole = "\n\n" + "\n\n".join(t or "" for t in texts) + "\n"
    want = np.zeros(toxicity.SIGNS**3)
    signs = [toxicity.sign(c.lower()) for c in whole]
    for a, b, c in zip(signs, signs[1:], signs[2:]):
        want[a * toxicity.SIGNS**2 + b * toxicity.SIGNS + c] += 1
    assert np.array_equal(got, want)


def test_stems_and_scores_against_counting(spark, monkeypatch):
    """The stems chosen and every score, counted text by text."""
    monkeypatch.setattr(toxicity, "Z", 1.0)
    rng = random.Random(3)
    mild, bad = [f"{c}word{c}" for c in "abcdefghijklm"], ["vilethug", "vilethings", "grubbler", "snotface"]
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(mild) for _ in range(rng.randint(3, 12))]
        toxic = i % 4 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        if toxic and i % 8 == 0:
            text += [bad[i % 3].replace("e", "3"), "s n o t f a c e"]
        if i % 30 == 1:
            text.append("grubbler")  # now and then in a clean text
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, known, F.lit(True))
    reader = toxicity.Reader(model["costs"])
    toxic_of = {}
    for (_, t), (_, y) in zip(rows, labels, strict=True):
        toxic_of[t] = max(y, toxic_of.get(t, 0))
    marks = {t: set(toxicity.marks_of(reader.restore(t).split())) for t in toxic_of}

    def low(b, g):
        n, p = b + g, b / (b + g)
        return (p + 1 / (2 * n) - (p * (1 - p) / n + 1 / (4 * n * n)) ** 0.5) / (1 + 1 / n)

    counts = {}
    for t, own in marks.items():
        for m in own:
            counts.setdefault(m, [0, 0])[toxic_of[t]] += 1
    rated = {m: low(b, g) for m, (g, b) in counts.items() if b and low(b, g) >= toxicity.THRESHOLD}
    word = lambda m: m.split(" ", 1)[1]
    for m in list(rated):
        times, w = m.split(" ", 1)
        if not w.startswith("="):
            longer = [n for n in counts if n in rated and n.split(" ", 1)[0] == times and word(n) != w and word(n).removeprefix("=").startswith(w)]
            if any(counts[n][1] >= 0.9 * counts[m][1] for n in longer):
                rated[m] = -1.0
    rated = {m: w for m, w in rated.items() if w >= 0}
    want = {m: w for m, w in rated.items() if w >= toxicity.SURE}
    left = [t for t in marks if toxic_of[t]]
    while left:
        gain = {m: low(n, counts[m][0]) for m in rated if (n := sum(m in marks[t] for t in left))}
        if not gain:
            break
        best = max(gain, key=lambda m: (round(gain[m], 12), len(m), m))
        if gain[best] < toxicity.THRESHOLD:
            break
        want[best] = rated[best]
        left = [t for t in left if best not in marks[t]]
    assert model["stems"] == pytest.approx(want) and want
    rest = min(toxicity.THRESHOLD / 3, 1 / (len(marks) + 2))
    for r in toxicity.score(docs, model).collect():
        assert r.score == pytest.approx(max([rest, *(w for m, w in want.items() if m in marks[r.text])])), r.text


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text", 0.5, "x")], "doc_id long, text string, stem string, toxic string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    assert toxicity.score(docs, model, "s").columns == ["doc_id", "text", "stem", "toxic", "s"]
    with pytest.raises(ValueError):
        toxicity.score(docs, model, "toxic")


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.report(docs, none).collect()} == {0.0}
    assert toxicity.report(docs.limit(0), none).count() == 0
