"""Leaked passages and moderation."""

import hashlib

import numpy as np
import pytest

from cinelake.llm import leaks, moderation
from tests.compare import DATA

ITEMS = [
    (1, "Read the note. When the baker pauses the race at 9:38, a wandering reflection in the arcade glass shows the keeper holding 37 tickets for the workshop, and nobody asks why."),
    (2, "Read the note. When the host pauses the garden at 1:02, a borrowed reflection in the library glass shows a musician holding 31 tickets for the greenhouse, and nobody asks why."),
    (3, "Read the note. Suppose three students film the quarry every 13 days from 1995, while a pilot films the meadow only when the bridge floods in the late autumn."),
    (4, None), (5, ""),
]
BODY1 = ITEMS[0][1][len("Read the note. ") :]
FILL = "The crew shot the arcade at dawn and hit every mark. "


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id int, score string")
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    return {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items).collect()}


def test_passages(spark):
    w = BODY1.split()
    noisy = " ".join("<b>" + x.upper() + "</b>" if k % 4 == 0 else x.replace("a", "а").replace("e", "é") for k, x in enumerate(w))
    edited = [x for k, x in enumerate(w) if k != 8]
    edited[3], edited[20] = "cat", edited[20] + " extra"
    texts = [
        FILL + BODY1 + FILL, FILL + " ".join(w[4:17]), noisy + FILL, FILL + "\n\n> ".join(edited), BODY1.replace("reflection", "refle​ction").replace(" ", "   "),
        "Read the note. " + FILL, " ".join(w[:7]) + " " + FILL, FILL * 3, None, "", FILL * 4000 + BODY1, ITEMS[2][1] + FILL + BODY1,
        BODY1.replace("arcade", "arc ade"),
    ]
    assert found(spark, texts) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (10, 1), (11, 1), (11, 3), (12, 1)}


def test_no_items_or_documents(spark):
    docs = spark.createDataFrame([(1, BODY1)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:3], "item_id long, text string")
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


def test_items_in_passes(spark, monkeypatch):
    texts = [FILL + BODY1 + FILL, ITEMS[1][1], ITEMS[2][1] + FILL + BODY1]
    want = found(spark, texts)
    monkeypatch.setattr(leaks, "PART_ITEMS", 1)
    assert found(spark, texts) == want == {(0, 1), (1, 2), (2, 1), (2, 3)}


def test_spans_are_merged(spark):
    df = spark.createDataFrame([(1, 1, 0, 9), (1, 2, 5, 14), (1, 3, 15, 20), (1, 1, 40, 50), (2, 1, 3, 4)], "doc_id long, item_id long, first_word long, last_word long")
    assert sorted(map(tuple, leaks.removal_spans(df).select("doc_id", "first_word", "last_word", "items").collect())) == [(1, 0, 20, 3), (1, 40, 50, 1), (2, 3, 4, 1)]


@pytest.mark.parametrize("symbols", [2, 5, 40])
def test_fm_index_against_a_scan(symbols):
    rng = np.random.default_rng(symbols)
    text = rng.integers(0, symbols, 700)
    text[100:160] = text[300:360]
    index = leaks.FMIndex(text, symbols)
    phrases = rng.integers(1, symbols, (60, 3)) if symbols > 2 else np.ones((1, 3), np.int64)
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_fm_index_of_absent_symbols():
    index = leaks.FMIndex(np.array([3, 3, 0, 3]), 9)
    low, high = index.search(np.array([[5, 6, 7], [3, 3, 3], [8, 8, 8]]))
    assert (high - low).tolist() == [0, 0, 0]


BAD = """you are a worthless idiot and everyone here knows it|you are a w0rthle$$ idiiiiot|Shut up you pa*hetic m o r o n|fuсk you and your s####y channel|All Velmarians are v.e.r.m.i.n|they were n@ked and fuuuucking|lösch dich, Ar5chl0ch|eres un id​iota|Espèce de c*****d minable
I know where the editor lives and I will break every bone|he is an absolute di*khead|You brainles bastrd"""
GOOD = """Comments that call other viewers idiots will be removed.|Se borrarán los insultos como idiota.|This encode is garbage and the av1 preset is plain stupid.|The sperm whale appears at 3:10.|Kill the 6226 stale jobs before the next scan.|The naked eye cannot see it.
Dick Whittle is the name of the puppet.|It starts as a race and ends as something closer to silent.|Rate it after watching.|Töte den Prozess 12 vor dem Scan.|The slave drive died, the master drive took over.||!!!|* * *"""


@pytest.mark.parametrize("text", BAD.replace("\n", "|").split("|"))
def test_bad_sentences(text):
    assert moderation.Scorer().text("It was lovely. " + text)[1] >= 1


@pytest.mark.parametrize("text", GOOD.replace("\n", "|").split("|"))
def test_good_sentences(text):
    assert moderation.Scorer().text(text)[1] < 1


def test_half_of_the_samples_not_learnt_from(spark):
    rows = sorted((r.text, r.label) for r in spark.read.parquet(f"{DATA}/moderation_samples.parquet").collect())
    part = lambda t: hashlib.md5(t.encode()).digest()[0] % 2
    scorer = moderation.Scorer(moderation.learn([r for r in rows if not part(r[0])]))
    held = [(scorer.text(t)[1] >= 1, label != "none") for t, label in rows if part(t)]
    bad = sum(b for _, b in held)
    assert sum(f and b for f, b in held) >= 0.9 * bad > 50 and sum(f and not b for f, b in held) == 0


PLAIN_BAD = """I am going to stab you tonight|I'll slit your throat|They should be gassed|Ich bringe dich um, du Ratte|Te voy a matar|Je vais te tuer|What a lazy pig you are|Send me nudes|Those immigrants are vermin|You are a real idoit|She is such a slut"""
PLAIN_GOOD = """The cock crowed at dawn over the farm|The loser of the match shook hands with the winner|A prick of the needle|The rats in the lab were fed twice|He was shot from a low angle|The pig sleeps next to the cow|Dick is my uncle|This part will kill the suspense|The clown walks home in the rain
Slurs are not allowed here, words like idiot are removed|Wir brauchen ein sauberes Bild ohne Rauschen|The set was burned down in 1920|Keep the dog out of our garden|El cerdo come en la granja"""


@pytest.mark.parametrize("text", PLAIN_BAD.split("|"))
def test_plain_bad_sentences(text):
    assert moderation.Scorer().text(text)[1] >= 1


@pytest.mark.parametrize("text", PLAIN_GOOD.replace("\n", "|").split("|"))
def test_plain_good_sentences(text):
    assert moderation.Scorer().text(text)[1] < 1


def test_long_sentences_weigh_less():
    mild = "the ugly cover and the dumb blurb of this stupid book"
    assert moderation.Scorer().text(mild)[1] > 1 > moderation.Scorer().text(mild + " came in the post" * 12)[1]
    assert moderation.Scorer().text("you idiot " + "and so on " * 12)[1] >= 1


def test_what_is_learnt():
    samples = [("Lovely roof. Go and eat your gravel soup.", "abusive")] * 2 + [("eat your gravel soup", "abusive"), ("you eat your gravel soup now", "abusive"), ("Lovely roof.", "none"), ("eat your soup", "none"), (None or "", "none")]
    learnt = dict(moderation.learn(samples))
    assert "your gravel soup" in learnt and "eat your" not in learnt and "lovely rof" not in learnt
    assert moderation.Scorer(tuple(learnt.items())).text("Eat your gravel soup!")[1] >= 1 > moderation.Scorer().text("Eat your gravel soup!")[1]


def test_scores_and_rates(spark):
    df = spark.createDataFrame([(1, "You idiot!", "a", "k"), (2, None, "a", "k"), (3, "", None, "k"), (4, "fine " * 200_000 + "you moron.", "a", "k"), (4, "fine", "a", "k")], "doc_id long, text string, source string, kind string")
    got = moderation.scores(df, keep=(df["source"],))
    assert sorted((r.id, r.flagged) for r in got.collect()) == [(1, True), (2, False), (3, False), (4, False), (4, True)]
    by = {r.source: (r.documents, r.flagged) for r in moderation.rates(got, "source").collect()}
    assert by == {"a": (4, 2), None: (1, 0)}
    assert moderation.scores(df.limit(0)).count() == 0


def test_a_verdict_hangs_on_its_own_text_only(spark):
    texts = ["That man is a bastrd.", "She picks stories and casts whales"] * 500 + [f"You moron of part {i}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flagged = {r.id for r in moderation.scores(df).filter("flagged").collect()}
    assert flagged == set(range(0, 1000, 2)) | set(range(1000, 1020))


def test_longer_passage_with_edits_in_its_middle(spark):
    w = BODY1.split()[9:27]
    for k in (6, 8, 11):  # every 12 of the 18 words hold all three edits
        w[k] = "cat"
    assert found(spark, [FILL + " ".join(w) + " " + FILL]) == {(0, 1)}


SHORT = [
    (11, "Borrowed lanterns drift past harbours"), (12, "A quiet glacier hums under seven wooden bridges"), (13, "Nine violet kettles whistle above the frozen orchard while old sailors trade maps"),
    (14, "Opening words for all. Copper spoons fall."), (15, "Opening words for all. Marble hounds sleep."), (16, "Opening words for all. Paper storms rise."), (17, "Solitary"),
]


@pytest.mark.parametrize("part", [20_000, 1])
def test_short_items_edits_and_opening_lines(spark, monkeypatch, part):
    monkeypatch.setattr(leaks, "PART_ITEMS", part)
    texts = [
        FILL + SHORT[0][1] + ". " + FILL,  # a whole item of five words
        FILL + "a quiet glacier hums over seven wooden bridges " + FILL,  # eight words, one replaced
        FILL + "nine violetkettles whistle above the frozenorchard while old sailors trade " + FILL,  # twelve words, joined twice
        FILL + "Opening words for all. " + FILL,  # an opening line alone
        FILL + "borrowed lanterns drifted past harbours " + FILL,  # one edit in five words is too many
        "a solitary walk", FILL + "copper spoons fall " + FILL, FILL + "a quiet glacier sings over seven wooden bridges " + FILL,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(SHORT, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items).collect()} == {(0, 11), (1, 12), (2, 13), (5, 17), (6, 14)}
