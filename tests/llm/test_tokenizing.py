import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import tokenizing as T

PATH = f"{T.FOLDER}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{T.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_public_library(reference, text):
    assert T.encoder(PATH).encode(text) == reference(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", " " * 5000, "a" * 20_000, "ab" * 9_000 + "é日", "don't  \n\n stop", "\u0000\u0001", "👩‍💻🇩🇪ﷺ"])
def test_odd_and_long_texts(reference, text):
    assert T.encoder(PATH).encode(text) == reference(text)


def merge_plainly(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        r = [(ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        r = min((x for x in r if x[0] is not None), default=None)
        if r is None:
            return [ranks[p] for p in parts]
        parts[r[1] : r[1] + 2] = [parts[r[1]] + parts[r[1] + 1]]


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=40))
def test_ties_go_to_the_left(word):
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"aa": 3, b"aba": 4, b"bb": 5, b"abab": 6}
    assert T.merge_word(word.encode(), ranks) == merge_plainly(word.encode(), ranks)


def test_empty_and_null_texts(spark):
    d = spark.createDataFrame([(1, ""), (2, None), (3, "hello world"), (3, "hello world")], "doc_id bigint, text string").selectExpr("*", "'x' as ids")
    got = [(r.doc_id, r.ids) for r in T.encode_corpus(d).orderBy("doc_id").collect()]
    assert got == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert T.encode_corpus(d.limit(0)).count() == 0 and T.encode_corpus(d).schema["ids"].dataType.simpleString() == "array<int>"
