import pytest

from loomgraph.llm.abuse import LOOKALIKES, THRESHOLD, automaton, fold, score, weigh

CASES = [
    "Piss off, nobody asked you.", "what an іdіоt", "You are such a m*r*n!", "G.A.R.B.A.G.E like this, you stupid clown, from a worthless loser", "d​u​m​b and stupid", "ARSCHLOCH!!!",
    "fuuuuck you", "Send me your n@k3d pictures tonight", "They are vermin and should be kept out of every lab", "Ferme ta gueule, pauvre con", "eres un imbécil", "We know your address.", "kill yourself",
]
OTHERS = [
    "", "   ", "The scheduler may kill the process when garbage collection stalls.", "We count how often the word 'scumbag' occurs.", "Raters marked terms such as 'idiot' and 'moron' as insulting.", "A naked-eye comparison of the plots.",
    "The proof is wrong and this experiment is useless as evidence.", "Classifier X confuses erotic fiction with romance.", "Breast cancer images were screened.", "Please don't shoot the messenger.", "The quote \"idiot\" is from the forum.",
]


@pytest.fixture(scope="module")
def lexicon():
    return automaton()


@pytest.mark.parametrize("text", CASES)
def test_cases(lexicon, text):
    assert weigh("A neutral sentence first. " + text + " And one after it.", lexicon)[0] >= THRESHOLD


@pytest.mark.parametrize("text", OTHERS)
def test_others(lexicon, text):
    assert weigh(text, lexicon)[0] < THRESHOLD


def test_folding():
    assert fold("Don't  SAY “сrеtin”.​") == ' dont say " cretin " | '


def test_whole_texts_and_nulls(spark):
    docs = spark.createDataFrame([(1, "word " * 50_000 + "you are an idiot"), (2, None), (3, ""), (1, "fine")], "doc_id long, text string")
    got = sorted((r.doc_id, r.weight >= THRESHOLD) for r in score(docs).collect())
    assert got == [(1, False), (1, True), (2, False), (3, False)] and score(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["Your benchmark is garbage, you idiot", "Nice gradient, moron", "The classifier works, but its author is an idiot and a moron", "You flagged as many as you could, idiot", "In the word list of the second author, as everybody here knows, sits an idiot"])
def test_topic_words_excuse_nothing(lexicon, text):
    assert weigh(text, lexicon)[0] >= THRESHOLD


@pytest.mark.parametrize("text", ["We count mentions of idiot or moron.", "Comments flagged as stupid garbage were kept."])
def test_words_near_a_mention_do_not_count(lexicon, text):
    assert weigh(text, lexicon)[0] < THRESHOLD


LATIN = {c: latin for latin, cs in LOOKALIKES.items() for c in cs}


@pytest.mark.parametrize("letter", sorted(LATIN))
def test_each_lookalike_by_itself(letter):
    assert fold(f"x{letter}z").split() == [f"x{LATIN[letter]}z"] and sum(letter in cs for cs in LOOKALIKES.values()) == 1


@pytest.mark.parametrize("text", ["idiοt", "αsshole", "аsshole", "ⅿoron", "1d10t", "assho1e", "m*r*n", "mo**n", "fuuuuck", "assssshole", "i.d.i.o.t", "m o r o n", "id\u00adiot", "ídïót", "ＩＤＩＯＴ"])
def test_disguises(lexicon, text):
    assert weigh(f"What an {text}.", lexicon)[0] >= THRESHOLD


@pytest.mark.parametrize("text", ["The houses of the city.", "They share a room with us.", "Tools for real humans.", "We never hire.", "The socks, they stink.", "Flowers go die.", "Your code is garbage and the proof is useless."])
def test_fragments_alone_are_no_cases(lexicon, text):
    assert weigh(text, lexicon)[0] < THRESHOLD


def test_long_runs_take_linear_time(lexicon):
    for text in ("a" * 300_000, "a1" * 150_000, "*" * 300_000, "a!" * 150_000, "a." * 150_000, "'" * 300_000):
        assert weigh(text, lexicon)[0] < THRESHOLD
