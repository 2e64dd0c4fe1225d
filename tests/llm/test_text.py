from __future__ import annotations

import os

import pytest

from lexiloom.llm.abuse import REVIEW, AbuseModel, AbusiveContent
from lexiloom.llm.language import LanguageModel, asked, guess
from lexiloom.llm.mojibake import Finder, Mojibake, fix
from lexiloom.llm.pairs import PairDefects, is_copy, is_empty, is_refusal


def test_empty_refusal_copy():
    assert all(map(is_empty, [None, "", " \n", "N/A", "[blank]", "-", "<no answer>", "​", "none."]))
    assert not any(map(is_empty, ["No.", "$5", "42", "Yes, by May."]))
    assert is_refusal("I'm sorry, but I can't help with that.") and is_refusal("Hello Ann, No comment. I do not answer such questions.")
    assert not is_refusal("Sorry to hear that. The bank must refund $5 if you ask.") and not is_refusal("I can't say which fund is best for everyone, but a small one usually calls for a cheap fee.")
    assert is_copy("Why did the price of tin fall in May?", "", 'You asked: "Why did the price of tin fall in May?"')
    assert is_copy("Should I sell the bond now?", "", "Should I sell the bond now? Should I sell the bond now?")
    assert not is_copy("Why did the price of tin fall in May?", "", "Why did the price of tin fall in May? Because the mines in the north had been reopened and stocks grew every week.")


def test_language():
    m = LanguageModel([("the price of the house and the garden was fixed", "en"), ("le prix de la maison et du jardin était fixé", "fr")])
    s = m.scores(["the garden and the house", "la maison et le jardin", ""])
    assert m.codes[s[0].argmax()] == "en" and m.codes[s[1].argmax()] == "fr" and s[2].sum() == 0
    assert asked("Translate into German: hello") == {"de"} and asked("hello") == set()
    assert guess("il prezzo della casa è più alto che non di sera") == "it" and guess("x") is None
    assert LanguageModel([]).scores(["a"]).shape == (1, 1)


def test_defects(spark):
    good = ["The fee of the fund is low and the bond is safe.", "Keep the rest for the winter and pay the loan."]
    rows = [(i, f"What is the fee of plan number {i} for the bank?", None, f"{good[i % 2]} The plan of the bank is good for {i} years. Source: own notes") for i in range(40)]
    rows += [(100, "What is a bond?", "", None), (101, "What is a bond?", "", "The fee of the fund is low and the"), (102, "What is the price of a bond in the market?", "", "Le prix de la maison est fixé par une banque qui est dans la ville"),
             (103, "What is a good fund for the winter?", "", "What is a good fund for the winter?"), (104, "What is it?", "", "I cannot assist with this request."), (None, "a", "", "b"), (100, "What is a bond?", "", None), (105, "What is the fee?", "", "$5"), (106, "What is the sum?", "", "$9")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k long, q string, c string, a string, id string")
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the fee of the bank and the price of the bond in the market", "en"), ("le prix de la maison est fixé par une banque dans la ville", "FR"), (None, "en"), ("x", None)] * 5)], "doc_id long, text string, lang string")
    got = {r["id"]: r["defect"] for r in PairDefects(df, docs, "k", "q", "c", "a").defects().collect()}
    assert {k: v for k, v in got.items() if k >= 100} == {100: "empty", 101: "truncated", 102: "language", 103: "copy", 104: "refusal"}
    assert not [k for k in got if k < 100]
    assert PairDefects(df.limit(0), docs.limit(0), "k", "q", "c", "a").defects().count() == 0


ROWS = [("you are a stupid idiot and a coward", True), ("shut up you filthy moron", True), ("what a pathetic loser you are", True), ("go to hell you vile pig", True), ("go to hell you ugly idiot", True), ("shut up you stupid pig", True)] * 2
ROWS += [("the bank raised the fee of the loan", False), ("keep the bond and sell the fund", False), ("this stupid form ate my rows again", False), ("the price of tin fell and the fund lost", False), ("a moderator removed a reply that called people idiots", False), ("are you sure the fee is right", False)] * 4


def test_restores_obfuscated_words():
    m = AbuseModel(ROWS)
    r = m.restorer
    assert r("you st*pid 1d!0t") == "you stupid idiot"
    assert r("s t u p i d idiot") == "stupid idiot"
    assert r("you iiiidiot, m.o.r.o.n") == "you idiot, moron"
    assert r("you іdiоt") == "you idiot"
    assert r("st​upid") == "stupid"
    assert r("pay $4,500 at 3.5pct #gameday @Ann_2") == "pay $4,500 at 3.5pct #gameday @ann_2"


def test_scores(spark):
    m = AbuseModel(ROWS)
    s = m.scores(["sell the bond. shut up you p1g", "the fee of the loan", None, "", "the bank is here. " * 500 + "go to hell you 1di0t"])
    assert s[0] >= REVIEW and s[1] < REVIEW and s[2] == 0 and s[3] == 0 and s[4] >= REVIEW
    assert AbuseModel([]).scores(["x", None]).max() < REVIEW
    texts = spark.createDataFrame([(1, "shut up you stupid idiot", " News "), (1, "shut up you stupid idiot", "news"), (2, "the bank raised the fee of the loan and the fund lost", None), (3, None, "news"), (None, "you idiot", "news")], "id long, text string, score string")
    labelled = spark.createDataFrame([(i, t, int(b)) for i, (t, b) in enumerate(ROWS)] + [(99, "x", None)], "k long, t string, y int")
    a = AbusiveContent([("t", "text", texts, "id", "text", "score")], labelled)
    assert [tuple(r) for r in a.review().collect()] == [("t", "text", 1)]
    assert {r["rec_id"] for r in a.scores().collect()} == {1, 2, 3}
    assert {(r["source"], r["texts"], r["abusive"]) for r in a.rates().collect()} == {("news", 2, 1), (None, 1, 0)}
    assert AbusiveContent([("t", "text", texts.limit(0), "id", "text", None)], labelled).review().count() == 0


def test_corpus_counts_weigh_features(spark):
    m = AbuseModel(ROWS)
    before = m.scores(["you are here"])[0]
    common = ["you are here with the bank"] * 3 + ["are you sure"] * 3
    m.fit(*m.counts(m.ids(common * 50)))
    assert m.scores(["you are here"])[0] < before and m.scores(["shut up you filthy moron"])[0] >= REVIEW
    # of copies one counts; masks longer than any word are none
    texts = spark.createDataFrame([(i, "the bank is here.") for i in range(30)] + [(99, "you " + "*" * 5000 + " pig")], "id long, text string")
    a = AbusiveContent([("t", "text", texts, "id", "text", None)], spark.createDataFrame([(i, t, int(b)) for i, (t, b) in enumerate(ROWS)], "k long, t string, y int"))
    assert a._counted(spark.sparkContext.broadcast(a.model.value), len(a.model.value.features))[1] == 2
    assert a.scores().count() == 31


def test_garbled_runs():
    f = Finder(("cp1252", "latin-1", "cp437", "mac_roman", "cp1251"))
    for text in ("café à l'été", "цена выросла", "€5 – “quoted”", "naïve"):
        for taken in ("cp1252", "cp437", "mac_roman", "cp1251"):
            try:
                bad = text.encode().decode(taken)
            except UnicodeDecodeError:
                continue
            assert f.hits(bad) and f.restore(bad) == text, (text, taken)
        assert not f.hits(text)
    assert not f.hits("If you meet Ã© where é belongs, the file was opened with the wrong code page.")
    assert f.hits("A cafÃ© where é belongs.") and f.hits("lost � here") and not f.hits("SÃO VITÃO ± 3 µ Ðorvik Þing")
    assert fix("Θt", "cp437", "cp1252") == "ét" and fix("漢", "cp437", "cp1252") is None


def test_no_run_of_bytes_breaks_the_decoder():
    import itertools
    import random

    from lexiloom.llm.mojibake import TAKEN_FOR, _table, restore_run

    rnd = random.Random(3)
    high = range(0x80, 0x100)
    runs = [bytes(x) for x in itertools.product((0xC2, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF4, 0xF5), (0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF), (0x80, 0xBF), (0x80, 0xBF))]
    runs += [bytes(rnd.choices(high, k=rnd.randint(2, 4))) for _ in range(3000)]
    for taken in TAKEN_FOR:
        back = {v: k for k, v in _table(taken).items()}
        for raw in runs:
            text = "".join(chr(back[chr(b)]) for b in raw if chr(b) in back)
            if text:
                restore_run(text, (taken,))
    assert restore_run("\u00ed\xa0\u20ac", ("cp1252", "latin-1"))[1] == []  # a surrogate is no character


def test_explanations_are_no_cases():
    f = Finder(("cp1252", "latin-1"))
    assert not f.hits("Quiz, step 8: which sign hides behind Ã©? Right, it is é. We lost much.")
    assert f.look('My export prints "Ã±" for "ñ", which setting is off?') == (False, True)
    assert f.hits("( 1801 â€“ 1951 ) was a clerk. He wrote – much.") and f.hits("behind Ã©? Right. It is é.")
    assert f.restore("naÃƒÆ’Ã‚Â¯ve") == "naïve"  # several times over
    assert not f.hits("é " * 300 + "stands where Ã© is printed") and f.hits("word " * 300 + "cafÃ©")


def test_mojibake_learns_from_twins(spark):
    clean = [f"La région numéro {i} était protégée depuis le mois de février dernier." for i in range(30)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100 + i, clean[i].encode("cp1252").decode("cp437")) for i in range(4)]
    rows += [(200, "Le marché était fermé en février."), (201, "Ouvert en février, protégée ailleurs.".encode("cp1252").decode("cp437")), (202, "Le marché".encode().decode("cp1252")), (203, None), (204, ""), (None, "Ã©"), (202, "Le marché".encode().decode("cp1252"))]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, id string")
    m = Mojibake(df, "doc_id", "text")
    assert ("cp437", "cp1252") in m.learned
    assert {r["id"] for r in m.found().collect()} == {100, 101, 102, 103, 201, 202}
    back = {r["id"]: r["text"] for r in m.restored().collect()}
    assert back[100] == clean[0] and back[201] == "Ouvert en février, protégée ailleurs." and back[202] == "Le marché"
    assert Mojibake(df.limit(0), "doc_id", "text").found().count() == 0


@pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no vocabulary files here")
def test_bpe_equals_the_public_encoder(spark):
    import random

    tiktoken = pytest.importorskip("tiktoken")
    from lexiloom.llm.bpe import PATTERN, encode, load

    e = load()
    ref = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ["", "a" * 3000, "<|endoftext|> hello", " \n\n x", "abab" * 300, "漢字かな 😀🏽 naïve"] + ["".join(rnd.choices("abAB é漢😀 \n\t'\"0.", k=rnd.randint(1, 80))) for _ in range(500)]
    assert [list(x) for x in e.encode_batch(texts)] == [ref.encode_ordinary(t) for t in texts]
    df = spark.createDataFrame([(1, "hello hello", 0), (2, None, 0), (3, "", 0), (1, "hello hello", 0)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode(df, "doc_id", "text").collect())
    assert got == [(1, ref.encode_ordinary("hello hello"))] * 2 + [(2, []), (3, [])]
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def test_copies_do_not_speak_for_their_ending(spark):
    rows = [(i, f"What is the fee of plan {i}?", "", f"The plan costs {i} dollars a year. The bank takes it in May.") for i in range(20)]
    cut = "The plan costs much. Before you sign, compare the total amount and the"
    rows += [(100 + i, f"Is plan {i} good?", "", cut if i else cut.replace("much. ", "much.  ")) for i in range(12)]
    df = spark.createDataFrame(rows, "k long, q string, c string, a string")
    docs = spark.createDataFrame([(1, "the fee of the bank and the price of the bond", "en")], "doc_id long, text string, lang string")
    got = {r["id"]: r["defect"] for r in PairDefects(df, docs, "k", "q", "c", "a").defects().collect()}
    assert got == {100 + i: "truncated" for i in range(12)}


def test_restores_long_passages_whole():
    m = AbuseModel(ROWS)
    r = m.restorer
    plain = "the bank raised the fee of the loan keep the bond and sell the fund " * 3 + "go to hell you stupid pig"
    spaced = " ".join(plain.replace(" ", ""))
    assert len(spaced) > 200 and r(spaced).endswith("go to hell you stupid pig")
    assert r(spaced.replace("b o n d", "b x q z", 1)).endswith("go to hell you stupid pig")
    assert m.scores([spaced])[0] >= REVIEW
    assert r("you st" + "u" * 400 + "pid pig") == "you stupid pig" and r("idiot" + "t" * 3000) == "idiot"
    assert r("qwrtzpsd" * 200) == "qwrtzpsd" * 200


def test_mojibake_in_copies_and_by_a_lone_twin(spark):
    def garble(t: str) -> str:
        return t.encode("cp1252").decode("cp437")

    clean = [f"La région numéro {i} était protégée depuis le mois de février dernier." for i in range(30)]
    rows = list(enumerate(clean)) + [(100 + i, garble(clean[i])) for i in range(4)]
    rows += [(200 + i, garble("Ouvert en février, une région protégée.")) for i in range(40)]  # one garbled text under many keys
    lone = "Le gâteau brûlé mijotait sur le poêle."
    rows += [(300, lone), (301, garble(lone))]
    m = Mojibake(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    back = {r["id"]: r["text"] for r in m.restored().collect()}
    assert set(back) == {100, 101, 102, 103, 301} | set(range(200, 240)) == {r["id"] for r in m.found().collect()}
    assert back[200] == "Ouvert en février, une région protégée." and back[301] == lone


def test_every_labelled_row_is_fitted(spark, monkeypatch):
    monkeypatch.setattr("lexiloom.llm.abuse.TRAINING_ROWS", 5, raising=False)  # a cap, should there be one
    words = [f"{a}{b}r" for a in ("bla", "kno", "sti", "fre") for b in ("mme", "ndo", "sta", "lpi", "que")]
    rows = [(i, f"they call it {words[i // 2]} here.", i % 4 // 2) for i in range(2 * len(words))]
    texts = spark.createDataFrame([(1, "a text.")], "id long, text string")
    a = AbusiveContent([("t", "text", texts, "id", "text", None)], spark.createDataFrame(rows, "k long, t string, y int"))
    assert set(words) <= set(a.model.value.vocabulary)
