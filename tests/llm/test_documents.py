"""Problems 6, 7 and 8: encoding, mixing and subjects of documents."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from srclens.llm import encoding, mixing, subjects
from tests.conftest import DATA, rows

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{encoding.DIRECTORY}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return encoding.Encoder()


TEXTS = [None, "", " ", "\n\n  x", "<|endoftext|> it's", "a" * 3000, "ab" * 700 + "aaa" * 9, "日本語テキスト" * 40, "naïve — café’s 😀👩‍👩‍👧", "x = [1, 22, 333]\t\n", "   y"]


def test_encoding(spark, reference):
    df = spark.createDataFrame([(n, t, 1, 2) for n, t in enumerate([*TEXTS, *TEXTS])], "doc_id bigint, text string, ids int, tokens int")
    got = {r.doc_id: r.ids for r in encoding.encode(df).collect()}
    assert got == {n: (reference.encode(t, add_special_tokens=False).ids if t else []) for n, t in enumerate([*TEXTS, *TEXTS])}
    assert {r.doc_id: r.tokens for r in encoding.count_tokens(df).collect()} == {n: len(x) for n, x in got.items()}
    assert all(encoding.decode(got[n]) == t for n, t in enumerate(TEXTS) if t)
    assert encoding.encode(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=60))
def test_encoding_of_any_text(reference, encoder, text):
    assert list(encoder.encode([text])[0]) == reference.encode(text, add_special_tokens=False).ids


def test_encoding_of_long_words(reference, encoder):
    random.seed(9)
    letters = lambda n, chars: "".join(random.choice(chars) for _ in range(n))
    names = "walk token process engine because always data".split()
    texts = [
        letters(20_000, "abcdefghijklmnopqrstuvwxyz"), letters(30_000, "+/ABCDEFGHIJabcdefghij0123456789"), letters(9_000, "日本語文字漢字中国人民大学"), "".join(random.choices(names, k=3000)),
        "a" * 300_000, "abc" * 100_000, "-" * 70_001, " " * 20_000 + "x", ("ab" * 7 + "c") * 3001, letters(257, "ab"), letters(256, "ab"), "x" * 416, "x" * 417,
    ]
    for text in texts:
        assert list(encoder.encode([text])[0]) == reference.encode(text, add_special_tokens=False).ids
    for _ in range(60):
        chars = random.choice(["ab", "abc", "-=", "the ", "日本é"])
        text = (letters(random.randrange(1, 30), chars) * 150 + letters(random.randrange(500), chars))[:4000]
        assert list(encoder.encode([text])[0]) == reference.encode(text, add_special_tokens=False).ids


def test_windows_that_share_no_token(reference, monkeypatch):
    """Chained windows, also where the settled tokens are needed again."""
    monkeypatch.setattr(encoding.Encoder, "_join", lambda self, left, at, right, start: None)
    text = "abcde" * 300 + "xyz" * 200
    assert list(encoding.Encoder().encode([text])[0]) == reference.encode(text, add_special_tokens=False).ids


def documents(spark, data):
    return spark.createDataFrame([(i, t, s, "x", 0) for i, t, s in data], "doc_id bigint, text string, source string, rank string, copies int")


TARGETS = "source string, target_share double, max_repeats int"


def test_mixing(spark):
    random.seed(2)
    word = lambda n: " ".join(random.choice(["tree", "stone", "river", "cloud"]) for _ in range(n))
    data = [(i, word(random.randrange(5, 60)), random.choice(["Read-Me", " read_me", "READ ME"])) for i in range(500)] + [(1000 + i, word(20), "wiki") for i in range(60)] + [(2000 + i, word(20), "rfc") for i in range(10)]
    data += [(3000, None, "wiki"), (3001, "", "wiki"), (3002, "text", None), (3003, "text", "other"), (None, "text", "wiki"), *data[:5]]
    targets = spark.createDataFrame([("read_me", 0.6, 2), ("wiki", 0.2, 1), ("rfc", 0.1, 4), ("absent", 0.1, 3), (None, 0.0, 1)], TARGETS)
    mix, plan = mixing.mixture(documents(spark, data), targets)
    got = {r.source: r for r in mixing.shares(mix, plan).collect()}
    want = {"read_me": 6 / 9, "wiki": 2 / 9, "rfc": 1 / 9, "absent": 0.0}
    assert set(got) == set(want)
    for name, share in want.items():
        assert abs(got[name].actual_share - share) < 0.01, name
        assert got[name].most_copies <= got[name].max_repeats
    again, _ = mixing.mixture(documents(spark, data), targets)
    assert rows(mix, "doc_id", "copies") == rows(again, "doc_id", "copies")
    ids = [r.doc_id for r in mix.collect()]
    assert len(ids) == len(set(ids)) and not {3000, 3001, 3002, 3003} & set(ids)
    assert mixing.mixture(documents(spark, data).limit(0), targets)[0].count() == 0
    assert mixing.mixture(documents(spark, data), targets.limit(0))[0].count() == 0


def test_inclusion_follows_size(spark):
    data = [(i, "tree " * (10 if i % 2 else 40), "a") for i in range(800)] + [(9000 + i, "stone " * 30, "b") for i in range(20)]
    mix, _ = mixing.mixture(documents(spark, data), spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], TARGETS))
    taken = [r.doc_id for r in mix.where("source = 'a'").collect()]
    large = sum(i % 2 == 0 for i in taken)
    assert large > 2 * (len(taken) - large) > 0


def test_sentences():
    text = "# Title\n\n> One is here. Two *is* here!\n```\ncode is not. here\n```\n- Three <b>is</b> here?\n//! Four is \"here.\" Five is here.\nno end"
    assert [" ".join(w) for w in subjects.sentences(text)] == ["one is here", "two is here", "three is here", "four is here", "five is here"]


def test_wrapped_and_unmarked_sentences():
    words = lambda text: [" ".join(w) for w in subjects.sentences(text)]
    assert words("The first sentence runs\nover two lines. The second\nover two more.\n\nleft open\n\nThird here.") == ["the first sentence runs over two lines", "the second over two more", "third here"]
    assert words("# Title\nBegins here.\n- item left open\n- Item that ends.") == ["begins here", "item that ends"]
    assert words("one line of at least six words\nshort line") == ["one line of at least six words"]


def test_calibration_with_mistaken_labels():
    """The cut stays near a fourth though a tenth of the labels is missing and some are wrong."""
    import numpy as np

    rng = np.random.default_rng(3)
    scores = rng.choice([0.0, 0.1, 0.15, 0.28, 0.4, 0.8], (4000, 1)) + rng.normal(0, 0.01, (4000, 1))
    labels = (scores >= 0.25) & (rng.random((4000, 1)) < 0.9) | (rng.random((4000, 1)) < 0.01)
    ((slope, intercept),) = subjects.calibrated(scores, labels)
    assert 0.17 < -intercept / slope < 0.27
    assert np.allclose(subjects.calibrated(np.zeros((0, 2)), np.zeros((0, 2), bool)), [60.0, -60.0 * 0.21])


def _corpus():
    random.seed(4)
    topics = {"Sport": ["goal", "referee", "match", "league"], "Law": ["court", "judge", "statute", "appeal"]}
    common = ["Run the tests first.", "Thanks for the report.", "See the notes below."]
    docs, truth = [], {}
    for i in range(300):
        names = random.sample(list(topics), random.choice([0, 1, 1, 2]))
        body = [f"The {random.choice(topics[n])} meets the {random.choice(topics[n])} here." for n in names for _ in range(4)] + random.choices(common, k=4)
        random.shuffle(body)
        docs.append((i, " ".join(body)))
        truth[i] = set(names)
    return docs, truth


def test_subjects_on_held_out_documents(spark):
    docs, truth = _corpus()
    extra = [(900, None), (901, ""), (902, "no sentence"), (None, "The goal meets the match here."), docs[0]]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs + extra], "doc_id bigint, text string, subject string")
    labels = [(i, n.upper() if i % 7 == 0 else n, "a") for i in range(80) for n in truth[i]] + [(i, None, "a") for i in range(80) if not truth[i]] + [(5, "nonsense", "b"), (None, "Law", "b"), (777, "Law", "c")]
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string")
    names = spark.createDataFrame([("Sport", "x"), ("Law", "y"), (None, "z")], "subject string, description string")
    found = {}
    got = [(r.doc_id, r.subject) for r in subjects.subjects_of(df, names, lab).collect()]
    assert len(got) == len(set(got))
    for i, s in got:
        found.setdefault(i, set()).add(s)
    held = range(80, 300)
    assert sum(found.get(i, set()) == truth[i] for i in held) >= 0.95 * len(held)
    assert not {900, 901, 902} & set(found)
    assert subjects.subjects_of(df, names, lab.limit(0)).count() == 0
    assert subjects.subjects_of(df.limit(0), names, lab).count() == 0


def test_queries_run_on_the_smallest_tables(spark):
    from srclens.llm import queries

    assert {n.split("_")[0] for n in queries.queries()} == {f"p{n}" for n in range(1, 9)}
    got = queries.queries()["p7_shares"](spark, str(DATA))
    assert got.count() == 11
