import random

from sparkquarry.llm import templates
from tests.llm.odd import ODD, frame


def brute_tokens(text):
    import re

    raw = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    out = []
    number = re.compile(r"[$+-]?[0-9]+([.,:/][0-9]+)*(%|st|nd|rd|th)?")
    for i, w in enumerate(raw):
        core = w.strip(templates._EDGE)
        low = core.lower()
        before = raw[i - 1] if i else ""
        if number.fullmatch(core):
            out.append(templates.NUM)
        elif i and low in templates.UNITS and number.fullmatch(before.strip(templates._EDGE)):
            out.append(templates.UNIT)
        elif i and core != low and core[:1] != low[:1] and core != core.upper() and before[-1:] not in ".!?:":
            out.append(templates.NAME)
        else:
            out.append(low)
    return raw, out


def joined_names(raw, tokens):
    """Tokens and their words, a run of names as one."""
    out = []
    for w, t in zip(raw, tokens, strict=True):
        bare = w.strip(templates._EDGE)
        if out and t == templates.NAME == out[-1][0]:
            out[-1] = (t, f"{out[-1][1]} {bare}")
        else:
            out.append((t, bare))
    return out


def brute(docs, items):
    """Every document against every reading of every item at every shift."""
    found = {}
    held = (templates.NUM, templates.UNIT, templates.NAME)
    light = lambda own: 2 * sum(t not in held for t, _ in own) >= len(own)
    read = {}
    for doc_id, doc in docs:
        raw, tokens = brute_tokens(doc)
        bare = [w.strip(templates._EDGE) for w in raw]
        read[doc_id] = joined_names(raw, tokens), [(w.lower(), w) for w in bare]
    for item_id, text in items:
        raw, tokens = brute_tokens(text)
        if len(raw) < templates.LEAST:
            continue
        inside = brute_tokens(f"x {text}")[1][1:]
        bare = [w.strip(templates._EDGE) for w in raw]
        typed = joined_names(raw, tokens)
        within, lead = joined_names(raw, inside), None
        if inside[:2] == [templates.NAME] * 2:
            lead = bare[0] + " "
            within[0] = (templates.NAME, within[0][1][len(lead) :])
        readings = [(typed, 0, None), (within, 0, lead)]
        readings = [r for r in readings if len(r[0]) >= templates.LEAST]
        readings.append(([(w.lower(), w) for w in bare], 1, None))
        for own, k, lead in readings:
            n = min(templates.SPAN, len(own))
            word = [t for t, _ in own]
            for doc_id, _ in docs:
                other = read[doc_id][k]
                theirs = [t for t, _ in other]
                for shift in range(-len(own), len(other)):
                    hit = [p for p in range(len(own) - n + 1) if 0 <= p + shift <= len(other) - n and word[p : p + n] == theirs[p + shift : p + shift + n] and (k or light(own[p : p + n]))]
                    covered = {q for p in hit for q in range(p, p + n)}
                    if not hit or len(covered) < min(templates.COVER, len(own)):
                        continue
                    first = other[shift][1] if lead and 0 in covered else None
                    if first is not None and not first.startswith(lead):
                        continue
                    value = lambda q: first[len(lead) :] if q == 0 and first is not None else other[q + shift][1]  # noqa: B023, E731
                    slots = {(own[q][0], own[q][1], value(q)) for q in range(min(covered), max(covered) + 1) if word[q] in held and word[q] == theirs[q + shift]} if not k else set()
                    if len({s[:2] for s in slots}) == len(slots) == len({(s[0], s[2]) for s in slots}):
                        found[doc_id, item_id] = max(found.get((doc_id, item_id), 0), len(covered))
    return found


def made():
    rng = random.Random(7)
    vocab = ["walks", "bread", "house", "gives", "many", "river", "red", "to", "the", "of", "with"]
    fill = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, f"{fill(6)} {rng.choice(['Tom', 'Ann'])} has {rng.randint(1, 9)} km and {fill(8)} {rng.choice(['Tom', 'Bob'])} {fill(5)}?") for i in range(8)]
    items += [(20, "too short"), (21, None), (22, "six words that are one window"), (23, "1 2 3 4 5 6 7 8 9"), (24, "Paris had 40 towers"), (25, "In the year before the war Paris had 40 towers"),
              (26, "km is what Tom Ann Bob walks to the river of 9 red"),
              (27, "If Tom gives Ann the red house and Tom walks to Bob")]
    docs = []
    for k in range(60):
        text = rng.choice(items)[1] or ""
        if rng.random() < 0.5:
            for old in ("Tom", "Ann", "Bob", "Paris"):
                text = text.replace(old, rng.choice(["Tom", "Eve", "Zoe", "New York", "Rio de Mar"]))
            text = "".join(str(rng.randint(1, 9)) if c.isdigit() else c for c in text)
        if rng.random() < 0.3:
            text = " ".join(text.split()[rng.randint(0, 4) : rng.randint(8, 30)])
        docs.append((k, f"{fill(rng.randint(0, 20))} {text} {fill(rng.randint(0, 20))}".upper() if k % 17 == 0 else f"{fill(9)} {text} {fill(4)}"))
    return [*docs, *[(1000 + i, t) for i, t in ODD if t is None or len(t) < 1000]], items


def run(spark, docs, items):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return {(r.doc_id, r.item_id): r.covered for r in templates.leaks(frame(spark, docs), bench).collect()}


def test_against_brute_force(spark, monkeypatch):
    docs, items = made()
    want = brute(docs, items)
    assert len(want) > 20
    assert run(spark, docs, items) == want


def test_shuffled_when_the_benchmark_is_large(spark, monkeypatch):
    docs, items = made()
    monkeypatch.setattr(templates, "sized", lambda f, *a: f.hint("merge"))
    assert run(spark, docs, items) == brute(docs, items)


def test_slots(spark):
    item = [(1, "If Tom has 5 apples and Tom gives 2 apples to his friend Anna how many km does he walk")]
    docs = [(1, "we ask: If Bob has 7 apples and Bob gives 3 apples to his friend Eve how many km does he walk today"),
            (2, "If Bob has 7 apples and Tim gives 3 apples to his friend Eve how many km does he walk"), (3, item[0][1])]
    bench = spark.createDataFrame(item, "item_id long, text string")
    got = {r.doc_id: r.exact for r in templates.leaks(frame(spark, docs), bench).collect()}
    assert got == {1: False, 3: True}


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "some words that nobody else will ever write down")], "item_id long, text string")
    assert templates.leaks(frame(spark, []), bench).count() == 0
    assert templates.leaks(frame(spark), bench.limit(0)).count() == 0
    assert templates.leaks(frame(spark), bench).count() == 0


def test_verbatim_items_without_enough_literal_words(spark):
    items = [(1, "sum 12 7 19 19 4 15 3 8"), (2, "Anna Bob Carla Dora Emil Franz Gerd"), (3, "Tom has 5 red apples in the house"), (4, "What does he say to Tom Ann Bob Eve Zoe Max")]
    docs = [(i, f"we write {t} today") for i, t in items] + [(11, "we write sum 13 8 20 20 5 16 4 9 today")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.exact): (r.covered, r.item_words) for r in templates.leaks(frame(spark, docs), bench).collect()}
    assert set(got) == {(i, i, True) for i, _ in items}
    assert [got[i, i, True] for i, _ in items] == [(9, 9), (7, 7), (8, 8), (11, 11)]  # word for word all words count


def test_first_word_of_an_item_may_be_a_name_in_the_document(spark):
    bench = spark.createDataFrame([(1, "Tom has 5 red apples in the house of Tom")], "item_id long, text string")
    docs = [(1, "so, Tom has 5 red apples in the house of Tom"), (2, "Q) Bob has 7 red apples in the house of Bob"), (3, "Heading\nTom has 6 red apples in the house of Tom"),
            (4, "Q) Bob has 7 red apples in the house of Tim"), (5, "Look. Tom has 7 red apples in the house of Tom")]
    got = {r.doc_id: r.exact for r in templates.leaks(frame(spark, docs), bench).collect()}
    assert got == {1: True, 2: False, 3: False, 5: False}


def test_copies_of_short_items_are_found_whatever_stands_before(spark):
    """Every item of at least five words, copied word for word: no rule of the operator is used."""
    items = [(1, "In the year before the war Paris had 40 towers"), (2, "Paris and London have 7 bridges"), (3, "Kilometres or miles: which is 12 km longer"), (4, "12 13 14 15 16"), (5, "Tom Ann Bob Eve Zoe"), (6, "km is a unit of what"), (7, "how many towers does it have")]
    before = ["x. ", "Some heading\n", "Q) ", "so, ", "12 ", "It said: ", "", "- ", "Anna "]
    docs = [(100 * i + k, f"{b}{t} and more of it") for i, t in items for k, b in enumerate(before)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in templates.leaks(frame(spark, docs), bench).collect()}
    assert got == {(100 * i + k, i) for i, _ in items for k in range(len(before))}


def test_every_copy_is_found(spark):
    """Items word for word in random surroundings, against plain containment: capitals on either side, names that repeat, long texts."""
    rng = random.Random(11)
    words = ["Anna", "Paris", "who", "went", "to", "the", "12", "km", "river", "Where", "did", "of", "Bob", "If", "7.5", "and", "called"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 24))) + rng.choice(["", "?", "."])) for i in range(40)]
    items.append((99, "Where did Anna go when the red river called and who was it that then called Anna"))
    around = ["", "Anna ", " Chapter", "\nChapter two begins here", ". ", " Bob Paris", "so, ", "12 ", "\n", " and more", "If "]
    docs = []
    for k in range(160):
        own = rng.choice(items)[1]
        docs.append((k, rng.choice(around).lstrip() + " " * rng.randint(0, 1) + own + rng.choice([x if x[:1] in " \n" else f" {x}" for x in around])))
    docs += [(500, items[-1][1] + "\nChapter two begins here"), (501, "some words " * 30_000 + items[-1][1] + " Chapter")]
    parts = lambda t: [w.strip(templates._EDGE).lower() for w in t.split()]
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    want = {(d, i) for d, text in docs for i, item in items if inside(parts(item), parts(text))}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in templates.leaks(frame(spark, docs), bench).collect()}
    assert len(want) > 120 and {(500, 99), (501, 99)} <= want and want <= set(got) and all(got[x] for x in want)


def test_names_of_any_length_fill_a_slot(spark):
    bench = spark.createDataFrame([(1, "In the year before the war Paris had 40 towers")], "item_id long, text string")
    docs = [(1, "Well: in the year before the war New York had 17 towers"), (2, "Well: in the year before the war Stratford Upon Avon had 17 towers"), (3, "Well: in the year before the war had 17 towers")]
    assert {(r.doc_id, r.exact) for r in templates.leaks(frame(spark, docs), bench).collect()} == {(1, False), (2, False)}


def test_rows_that_share_an_id(spark):
    bench = spark.createDataFrame([(1, "how many red towers does the old city have"), (1, "who of them walks to the green river today"), (None, "what do they say about the bread and the house")], "item_id long, text string")
    docs = [(1, "we ask how many red towers does the old city have"), (1, "we ask who of them walks to the green river today"), (None, "we ask what do they say about the bread and the house")]
    got = [(r.doc_id, r.item_id) for r in templates.leaks(frame(spark, docs), bench).collect()]
    assert sorted(got, key=str) == [(1, 1), (None, None)]
