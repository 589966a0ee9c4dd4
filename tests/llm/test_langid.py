import os
import random

import numpy as np
import pytest

from stratalog.llm import langid as L

from ..conftest import rows

#: A few common words of each language, to make sentences of.
WORDS = {
    "en": "the and with from that which when never because people house water under before through should would often every other",
    "de": "der und mit von dass welche wenn niemals weil leute haus wasser unter bevor durch sollte würde oft jede andere",
    "fr": "le et avec depuis que laquelle quand jamais parce gens maison eau sous avant travers devrait serait souvent chaque autre",
    "es": "el y con desde que cual cuando nunca porque gente casa agua bajo antes través debería sería menudo cada otra",
    "pt": "o e com desde que qual quando nunca porque gente casa água sob antes através deveria seria muitas cada outra não então",
    "it": "il e con dalla che quale quando mai perché gente casa acqua sotto prima attraverso dovrebbe sarebbe spesso ogni altra",
    "nl": "de en met van dat welke wanneer nooit omdat mensen huis water onder voordat door zou worden vaak elke andere",
    "pl": "ten i z od że która kiedy nigdy ponieważ ludzie dom woda pod przed przez powinien byłby często każda inna",
}
RNG = random.Random(4)


def sentence(lang, n=12):
    return " ".join(RNG.choice(WORDS[lang].split()) for _ in range(n)).capitalize() + "."


def text(*langs, n=12):
    return " ".join(sentence(x, n) for x in langs)


@pytest.fixture(scope="module")
def model():
    s = [(lang, text(*[lang] * 8)) for lang in L.LANGS for _ in range(12)]
    s += [("en", text(*["de"] * 8)), ("fr", text(*["en"] * 8))]  # wrong labels
    return L.train(s)


def langs(runs, least=1):
    return [L.LANGS[a[1]] for a in runs if a[1] != L.NONE and a[2] >= least]


def test_labels():
    for label, want in (("en", "en"), ("EN", "en"), ("de-AT", "de"), ("pt_BR", "pt"), ("fra", "fr"), (" Dutch ", "nl"), ("Polish", "pl"), ("ger", "de"), ("und", None), ("n/a", None), ("-", None), ("??", None), ("", None), (None, None), ("unknown", None), ("sv", None), ("end", None)):
        assert L.language_of_label(label) == want, label


def test_tokens():
    for code in ("pkg/vault/x.go", "CamelCase", "snake_case", "`x`", "a.b", "12", "f(x)", "http://x", "--flag=1"):
        assert L.token_of(code).words == [], code
    assert L.token_of("Über,").words == ["uber"] and L.token_of("l'été").words == ["l", "ete"]
    assert L.token_of("end.").stop and L.token_of("```go").fence


def test_held_out_accuracy(model):
    tokens, right, n = L.Tokens(model), 0, 0
    for lang in L.LANGS:
        for _ in range(30):
            got = langs(L.passages([text(lang)], tokens)[0])
            right += got == [lang]
            n += 1
    assert right / n >= 0.97
    plain = [text("de").replace("ü", "u"), text("en").upper(), text("pl").translate(str.maketrans("żęśćł", "zescl"))]
    assert [langs(r) for r in L.passages(plain, tokens)] == [["de"], ["en"], ["pl"]]


def test_passages(model):
    t = L.Tokens(model)
    code = "```go\nfunc wenn niemals weil leute haus wasser unter bevor durch sollte oft jede andere\n```"
    docs = [text("en", "en", "de", "en"), text("en") + "\n" + code + "\n" + text("en"), text("en", "en") + " Und mit von. " + text("en"), "", None, " \n", "x/y.go `a` 12", text("fr") + "\n```\n" + text("fr")]
    got = L.passages(docs, t)
    assert langs(got[0]) == ["en", "de", "en"] and langs(got[1]) == ["en"] and langs(got[2], 4) == ["en"]
    assert [langs(r) for r in got[3:7]] == [[], [], [], []]
    assert langs(got[7]) == ["fr"]  # a fence that is not shut hides nothing
    # the same in one batch as alone
    assert [L.passages([d], t)[0] for d in docs] == got


def test_rejection(model):
    r = L.passages(["xqzj wvkt qqzx jjkw zxqv wqxz kkjq vvzx."], L.Tokens(model))[0]
    assert all(a[3] <= 0.98 for a in r)
    assert langs(L.passages([text("en")], L.Tokens(L.train([])))[0]) == []


def test_over_tables(spark, model):
    rows_in = [(1, text("en", "en"), "en"), (2, text("de", "de"), "en"), (3, text("fr", "fr"), None), (4, text("en", "en", "pl", "pl", "en"), "eng"), (5, None, "en"), (6, " ", ""), (7, "Wenn niemals.", None), (2, text("de", "de"), "en"), (8, text(*["it"] * 3000), "Italian")]
    df = spark.createDataFrame([(*r, "clash") for r in rows_in], "doc_id long, text string, lang string, label string")
    found = L.identify(df, model)
    assert found.count() == len(rows_in)
    assert rows(L.mislabelled(found)) == [(2, "de"), (3, "fr"), (4, "en"), (4, "pl")]
    assert rows(L.mislabelled(L.identify(df.limit(0), model))) == []


def test_fit_on_a_bounded_sample(spark):
    df = spark.createDataFrame([(i, text(*[lang] * 4), lang.upper() if i % 7 else "und") for i, lang in enumerate(L.LANGS * 40)], "doc_id long, text string, lang string")
    m = L.fit(df, most=160)
    assert langs(L.passages([text("nl", "nl")], L.Tokens(m))[0]) == ["nl"]
    assert L.fit(df.limit(0)).threshold > 1


def test_decode_keeps_short_changes_out():
    p = np.full((5, 8), 0.01)
    p[:, 0] = 0.93
    p[2, 0], p[2, 1] = 0.01, 0.93
    assert L.decode(p, np.array([9, 9, 2, 9, 9]), 0.5).tolist() == [0] * 5
    assert L.decode(p, np.array([9, 9, 12, 9, 9]), 0.5).tolist() == [0, 0, 1, 0, 0]


def test_decode_finds_a_passage_of_short_segments():
    p = np.full((12, 8), 0.01)
    p[:, 0] = 0.93
    p[4:8, 0], p[4:8, 1] = 0.01, 0.93
    words = np.array([9] * 4 + [3] * 4 + [9] * 4)
    assert L.decode(p, words, 0.5).tolist() == [0] * 4 + [1] * 4 + [0] * 4


def test_catalog_runs(spark):
    from stratalog.llm import catalog

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    for name, columns in (("p3_found", ["path"]), ("p4_found", ["file_id"]), ("p6_ids", ["doc_id", "ids"]), ("p7_found", ["doc_id", "item_id"]), ("p8_found", ["doc_id", "lang"])):
        df = catalog.queries()[name](spark, d)
        assert df.columns == columns
        got = rows(df)
        assert got and len({str(r) for r in got}) == len(got)


def test_languages_that_come_late_are_trained(monkeypatch):
    monkeypatch.setattr(L, "TRAIN_SEGMENTS", 300)
    t = L.Tokens(L.train([(x, text(*[x] * 10)) for x in ["en"] * 100 + ["de"] * 100]))
    assert [langs(r) for r in L.passages([text("en", "en"), text("de", "de")], t)] == [["en"], ["de"]]


def test_the_sample_is_never_empty(spark, monkeypatch):
    """However many labelled rows there are, about as many as asked for are drawn."""
    seen = []
    monkeypatch.setattr(L, "train", lambda samples: seen.append(len(samples)))
    df = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang")
    L.fit(df, most=50)
    L.fit(df.union(df), most=50)
    L.fit(df.limit(40), most=50)
    assert 20 < seen[0] < 100 and 10 < seen[1] < 60 and seen[2] == 40
    # the bound is a whole number of 63 bits: 4000 of 2e11 rows are a share of 2e-8
    assert (4001 * L.MOST_HASH // 200_000_000_000) / L.MOST_HASH == pytest.approx(2e-8, rel=1e-3)


def test_short_segments_are_held_to_the_threshold():
    p = np.full((3, 8), 0.1)
    p[:, 0] = 0.3
    words = np.array([3, 3, 3])
    assert L.decode(p, words, 0.9).tolist() == [L.NONE] * 3
    assert L.decode(p, words, 0.9, np.array([0.3] + [0.1] * 7)).tolist() == [L.NONE] * 3
    assert L.decode(p, words, 0.9, np.array([0.95] + [0.005] * 7)).tolist() == [0] * 3


def test_no_length_of_a_word_is_too_long(model):
    glued = "​".join(text("de", "de").lower().replace(".", "").split()) + "​"
    assert len(glued) > 100 and L.token_of(glued * 3).words
    long = "donaudampfschifffahrtsgesellschaftskapitaen" * 20
    assert len(L.buckets_of(long)) == 1 + sum(len(long) + 2 - n + 1 for n in (2, 3, 4))
    assert L.passages([long], L.Tokens(model))[0][0][2] == 1
