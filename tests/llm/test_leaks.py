import random

import pytest

from stratalog.llm import leaks

from ..conftest import rows

RNG = random.Random(9)
VOCAB = [f"{a}{b}" for a in ("ember", "quarry", "lattice", "harbor", "tariff", "notch", "pulley", "canvas") for b in ("", "s", "ed", "Route", ".go", "_7", "ing")] + "the of and under while before commit revision they hands over".split()
INTRO = "Read this and answer in one line."


def words(n):
    return [RNG.choice(VOCAB) for _ in range(n)]


ITEMS = [(i, (INTRO + " " if i % 2 else "") + " ".join(words(60))) for i in range(40)]


def body(i):
    return ITEMS[i][1].removeprefix(INTRO).split()


def alter(passage, every):
    return [f"zz{k}" if k % every == 3 else w for k, w in enumerate(passage)]


def longest_brute(text, item):
    """The longest window of item words that the text holds in place, one in ten altered, by trying all places."""
    t, w, best = leaks.words_of(text), leaks.words_of(item), 0
    for shift in range(-len(t), len(w)):
        same = [0 <= i - shift < len(t) and t[i - shift] == x for i, x in enumerate(w)]
        best = max(best, leaks.longest_passage(same))
    return best


def test_against_brute_force():
    docs = []
    for k in range(60):
        i, n = RNG.randrange(40), RNG.choice([8, 12, 20, 21, 30, 45])
        at = RNG.randrange(0, 60 - n + 1)
        passage = body(i)[at : at + n]
        if k % 3 == 1:
            passage = alter(passage, 11)
        docs.append(" ".join(words(RNG.randrange(0, 60)) + passage + words(RNG.randrange(0, 60))))
    index = leaks.build_index(leaks.without_instructions(ITEMS))
    got = {(d, i) for d, i, _ in leaks.leaked(docs, index)}
    texts = dict(leaks.without_instructions(ITEMS))
    want = {(d, i) for d, text in enumerate(docs) for i, item in texts.items() if longest_brute(text, item) >= leaks.WORDS}
    assert got == want and len(want) > 25


def test_form_does_not_count():
    p = body(3)[5:40]
    forms = [
        " ".join(p).upper(),
        "\n".join("> " + " ".join(p[i : i + 6]) for i in range(0, 35, 6)),
        "// " + "\r\n// ".join(" ".join(p[i : i + 7]) for i in range(0, 35, 7)),
        " ".join(f"**{w}**," if i % 3 else f"<em>{w}</em>".replace("<em>", "_").replace("</em>", "_") for i, w in enumerate(p)),
        "\u00a0 \t".join(p),
        "".join(w + "\u200b " for w in p),
    ]
    index = leaks.build_index(leaks.without_instructions(ITEMS))
    found = {(d, i) for d, i, _ in leaks.leaked(["intro " + f + " outro" for f in forms], index)}
    assert found == {(d, 3) for d in range(len(forms))}


def test_instructions_and_short_quotes_do_not_count():
    index = leaks.build_index(leaks.without_instructions([(i, "Given all of this, and whatever else you may know about the matter at hand, say in one short line what is to be done about it now. " + " ".join(words(40))) for i in range(5)]))
    text = "Given all of this, and whatever else you may know about the matter at hand, say in one short line what is to be done about it now."
    assert leaks.leaked([text], index) == []
    full = leaks.build_index(leaks.without_instructions(ITEMS))
    assert leaks.leaked([" ".join(words(20) + body(1)[:14] + words(20)), "", None, "short"], full) == []


def test_blocks_nulls_and_repeats(spark):
    text = " ".join(words(9) + body(2)[10:45] + words(9))
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", None), (None, text, "x"), (4, "other " * 5000, "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(*x, "s") for x in ITEMS] + [(99, None, None), (98, "", None)], "item_id long, text string, suite string")
    want = sorted([(1, 2), (1, 2), (None, 2)], key=repr)
    for block in (leaks.BLOCK, 3000):
        assert rows(leaks.find_leaks(docs, items, block).select("doc_id", "item_id")) == want
    assert rows(leaks.find_leaks(docs, items.limit(0))) == rows(leaks.find_leaks(docs.limit(0), items)) == []


def test_long_text_with_far_passages():
    text = " ".join(words(30_000) + body(5)[:30] + words(30_000) + body(6)[20:50])
    index = leaks.build_index(leaks.without_instructions(ITEMS))
    assert {(d, i) for d, i, _ in leaks.leaked([text], index)} == {(0, 5), (0, 6)}


def test_longest_passage():
    for _ in range(200):
        found = [RNG.random() < 0.85 for _ in range(RNG.randrange(0, 50))]
        spans = [b - a for a in range(len(found)) for b in range(a + 1, len(found) + 1) if found[a:b].count(False) * leaks.ONE_IN <= b - a]
        assert leaks.longest_passage(found) == max(spans, default=0)


def test_budget():
    # 18 words of 5 and two of 9 letters, the two altered, and three runs between them: 108 - 7 - 2 * 16 - 3 * 7
    assert leaks.budget([5] * 18 + [9] * 2) == 108 - 7 - 2 * 16 - 3 * 7
    assert leaks.budget([5] * 19) == 0


def lined(p, n, prefix):
    return "\n".join(prefix(k) + " ".join(p[i : i + n]) for k, i in enumerate(range(0, len(p), n)))


PREFIXES = {
    "numbers": lambda k: f"{k + 120}: ",
    "speakers": lambda k: ("user> ", "bot> ")[k % 2],
    "names": lambda k: ("Ann: ", "Bob Smith: ", "x.y: ")[k % 3],
    "levels": lambda k: ("INFO ", "WARN ", "INFO ")[k % 3],
    "times": lambda k: f"2026-01-02T03:04:{k:02d}Z INFO [main] ",
    "clock": lambda k: f"[03:04:{k:02d}] ",
    "list": lambda k: f"{k + 1}. ",
    "letters": lambda k: f"({'abcdefghijklmnopqrstuvwxyz'[k % 26]}) ",
    "tasks": lambda k: "- [x] ",
    "quotes": lambda k: "> > ",
    "comments": lambda k: " * ",
    "rows": lambda k: f"| {k} | ",
    "diff": lambda k: "+ ",
    "roman": lambda k: ("i) ", "ii) ", "iv) ")[k % 3],
}
MARKUP = {
    "em": lambda k, w: f"<em>{w}</em>" if k % 3 == 0 else w,
    "span": lambda k, w: f'<span class="a{k}">{w}</span>' if k % 2 else w,
    "br": lambda k, w: w + ("<br>" if k % 4 == 3 else ""),
    "paragraphs": lambda k, w: w + ("</p>\n<p>" if k % 4 == 3 else ""),
    "links": lambda k, w: f"[{w}](http://a.b/c{k}?d=e)" if k % 3 == 1 else w,
    "entities": lambda k, w: w + ("&nbsp;&mdash;" if k % 3 else ""),
    "comments": lambda k, w: w + (f"<!-- note {k} -->" if k % 5 == 2 else ""),
    "inserted words": lambda k, w: w + (" sic" if k % 10 == 5 else ""),
}


def recall(forms):
    index = leaks.build_index(leaks.without_instructions(ITEMS))
    docs, want = [], set()
    for i in range(20):
        p = body(i)[7:37]
        for f in forms(p):
            want.add((len(docs), i))
            docs.append("intro\n" + f + "\noutro")
    found = {(d, i) for d, i, _ in leaks.leaked(docs, index)}
    return len(found & want) / len(want)


@pytest.mark.parametrize("kind", PREFIXES)
def test_recall_with_prefixes_of_lines(kind):
    assert recall(lambda p: [lined(p, n, PREFIXES[kind]) for n in range(1, 8)]) == 1


@pytest.mark.parametrize("kind", MARKUP)
def test_recall_with_markup(kind):
    assert recall(lambda p: [" ".join(MARKUP[kind](k, w) for k, w in enumerate(p))]) == 1


def test_the_second_reading_takes_nothing_away():
    """Words that look like prefixes stay in the first reading."""
    p = body(4)[5:35]
    p[::3] = [w + ":" for w in p[::3]]
    assert recall(lambda p: ["\n".join(f"{a}: {b} {c}" for a, b, c in zip(p[::3], p[1::3], p[2::3]))]) == 1
