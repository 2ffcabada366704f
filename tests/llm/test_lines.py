import hashlib
import random
import re

import pytest
import xxhash

from sparkquarry.llm import lines


def norm(line):
    return re.sub(r"[ \t\x0b-\r]+", " ", re.sub(r"[!-/:-@\[-`{-~]+", "", line.lower())).strip(" ")


def simhash(text):
    """Of all words; one of more than four letters counts three times."""
    ones, total = [0] * 64, 0
    for w in text.split(" "):
        h, weight = xxhash.xxh64_intdigest(w.encode(), 42), 3 if len(w) > 4 else 1
        total += weight
        for b in range(64):
            ones[b] += weight * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > total)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(docs):
    """All pairs of distinct lines."""
    at = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(norm(line)) >= lines.SHORTEST:
                at.setdefault(norm(line), []).append((i, k))
    root = {n: n for n in at}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names, sims = list(at), {n: simhash(n) for n in at}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (sims[a] ^ sims[b]).bit_count() <= 3 and distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
                root[find(b)] = find(a)
    groups = {}
    for n, places in at.items():
        groups.setdefault(find(n), []).extend(places)
    gone = {p for places in groups.values() for p in sorted(places)[1:]}
    out = {}
    for i, t in docs:
        split = t.split("\n") if t is not None else []
        left = [x for k, x in enumerate(split) if (i, k) not in gone]
        out[i] = (len(split), len(split) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def made_docs():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(4, 80))) for _ in range(40)]
    docs = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(base).split()
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(vocab)
            text = " ".join(line)
            own.append(text.upper() + "." if rng.random() < 0.2 else text)
        docs.append((i, "\n".join(own)))
    return [*docs, (100, None), (101, ""), (102, "short\nshort\n"), (103, "\n\n"), (104, docs[0][1]), (105, "é" * 30 + "\n" + "É" * 30)]


def run(spark, docs):
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_lines string")
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.report(frame).collect()}


def test_against_all_pairs(spark):
    docs = made_docs()
    want = brute(docs)
    assert any(sum(v[1] for v in want.values()) > k for k in (50,))
    assert run(spark, docs) == want


@pytest.mark.parametrize("dense", [1, 3])
def test_crowded_blocks_give_the_same(spark, monkeypatch, dense):
    docs = made_docs()
    monkeypatch.setattr("sparkquarry.llm.buckets.DENSE", dense)
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_masks_cover_three_flips():
    rng = random.Random(1)
    for power, masks, bits in ((3, 14, 32), (4, 140, 48)):
        found = [m % (1 << 64) for m in lines.block_masks(power)]
        assert len(found) == masks and {m.bit_count() for m in found} == {bits}
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(m & flips == 0 for m in found)


def test_distances_after_cutting_common_words(spark):
    rng = random.Random(8)
    vocab = ["ab", "abc", "b", "ca", "cab", "xyzzy"]
    pairs = []
    for i in range(400):
        a = [rng.choice(vocab) for _ in range(rng.randint(1, 14))]
        b = [w for w in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 2)):
            b.insert(rng.randint(0, len(b)), rng.choice(vocab))
        pairs.append((i, -i, " ".join(a), " ".join(b)))
    want = {i for i, _, a, b in pairs if a != b and distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)}
    assert 20 < len(want) < 380
    assert {r.u for r in lines._similar(spark.createDataFrame(pairs, "u long, v long, _a string, _b string")).collect()} == want


def test_simhash_of_lines_of_any_length(spark):
    rng = random.Random(4)
    made = {n: " ".join("w%d" % rng.randint(0, 10**rng.randint(1, 6)) for _ in range(n)) for n in (6, 7, 8, 14, 126, 700, 5_460, 5_461, 17_000)}
    rows = lines.line_table(spark.createDataFrame([(n, t) for n, t in made.items()], "doc_id long, text string")).orderBy("doc_id", "block").collect()
    want = []
    for n, t in made.items():
        w = t.split(" ")
        want += [(n, k, simhash(" ".join(w[k * 5_460 : (k + 1) * 5_460]))) for k in range(-(-n // 5_460))]
    assert [(r.doc_id, r.block, r.sim % (1 << 64)) for r in rows] == want


def test_odd_rows(spark):
    from tests.llm.odd import ODD

    docs = [*ODD, (None, "a line without a number of its own\nkept"), (900, "a line without a number of its own")]
    out = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.n_dropped) for r in lines.report(out).collect()}
    want = brute([(i if i is not None else -1, t) for i, t in docs])
    assert got == {(None if i == -1 else i, v[1]) for i, v in want.items()}


def test_repeated_ids(spark):
    line, other = "one line that a few documents share", "another line that only one of them has"
    docs = [(1, line), (1, line), (1, f"{other}\n{line}"), (2, line)]
    out = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped) for r in lines.report(out).collect())
    assert [g[:2] for g in got] == [(1, 1), (1, 1), (1, 2), (2, 1)]
    # One of the two different texts of document 1 keeps the line, rows alike keep or lose it together.
    assert got[3] == (2, 1, 1) and (got[0][2], got[1][2], got[2][2]) in {(0, 0, 1), (1, 1, 0)}


def test_own_names_are_refused_and_others_pass(spark):
    frame = spark.createDataFrame([(1, "x", 3)], "doc_id long, text string, _lines int")
    with pytest.raises(ValueError):
        lines.without_repeated_lines(frame)
    kept = lines.without_repeated_lines(spark.createDataFrame([(1, "x", 3, 4)], "doc_id long, text string, line int, row int"))
    assert kept.select("line", "row").collect() == [(3, 4)]


def test_lines_of_short_words(spark):
    a = "it is on the mat as it was in the old days of the cat and the dog for all of us to see now and then by the sea in the sun"
    docs = [(0, a), (1, a.replace("sun", "fog")), (2, a.upper() + "!")]
    sims = [simhash(norm(t)) for _, t in docs]
    found = {i: n for i, (_, n, _) in run(spark, docs).items()}
    assert found == {0: 0, 1: int((sims[0] ^ sims[1]).bit_count() <= 3), 2: 1}


def test_one_letter_of_another(spark):
    """All that differs in a few characters and meets is caught, whatever share of the words that is."""
    docs = [(0, "copyright holders all rights reserved 2019"), (1, "copyright holders all rights reserved 2020")]
    close = (simhash(docs[0][1]) ^ simhash(docs[1][1])).bit_count() <= 3
    assert run(spark, docs)[1][1] == int(close)


def test_white_space_does_not_tell_lines_apart(spark):
    line = "seven ordinary words stand within this sentence"
    docs = [(0, line), (1, f"{line}\r\nother"), (2, line.replace(" ", "\t")), (3, line.replace(" ", "  ")), (4, f"\x0b {line} \x0c"), (5, line.replace(" ", " - "))]
    assert {i: n for i, (_, n, _) in run(spark, docs).items()} == {0: 0, **dict.fromkeys(range(1, 6), 1)}
