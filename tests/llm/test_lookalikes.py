import pytest

from quarryline.llm import lookalikes as L

SAME = [("K", "\u212a"), ("file", "\ufb01le"), ("abc", "\uff41\uff42\uff43"), ("é", "e\u0301"), ("cope", "\u0441\u043e\u0440\u0435"), ("a b", "a\u00a0b"), ("a b", "a\u3000b"), ("ab", "a\u200bb"), ("a-b", "a\u2010b"), ("it's", "it\u02bcs"),
        ("ﬀ", "ff"), ("a\nb", "a\u2028b"), ("a\nb", "a\r\nb"), ("ジ", "シ\u3099"), ("й", "и\u0306"), ("x", "x\ufe0e"), ("e\u0301", "e\u034f\u0301"), ("Hello", "Ηello"), ("1:2", "１：２"), ("I", "\u0406"), ("v", "\u03bd")]
DIFFERENT = [("a", "A"), ("o", "0"), ("l", "1"), ("e", "é"), ("и", "й"), ("rn", "m"), ("a b", "ab"), ("a b", "a  b"), ("a b", "a\nb"), ("x2", "x²"), ("ss", "ß"), ("α", "ά"), ("1", "①")]


#: Pairs of the public table beyond the usual swaps.
SAME += list(zip("αρυγɑɡгıᴏᎪꓮ–", "apuyagrioAA-"))
DIFFERENT += [("œ", "oe"), ("æ", "ae"), ("×", "x"), ("I", "l"), ("|", "l"), ("ă", "ǎ"), ("—", "-"), ("Φ", "O")]


@pytest.fixture(scope="module")
def look(spark):
    across = L.Prototypes(L.confusables(spark))
    return lambda text: L.skeleton(text, across)


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(look, a, b):
    assert look(a) == look(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_other_look(look, a, b):
    assert look(a) != look(b)


def test_consistent_form_keeps_the_script(look):
    assert L.consistent("ｆｉｌｅ\u200b сор\u0435") == "file соре" and L.consistent(None) is None and look("") == ""


DOC = "doc_id bigint, text string, look string, _s string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOC)


def test_pairs(spark):
    d = docs(spark, "cope", "соре", "cope", "cорe", "other", None, "", "\u200b", " ", "Cope")
    got = {(r.doc_id_a, r.doc_id_b) for r in L.lookalike_pairs(d).collect()}
    assert got == {(0, 1), (0, 3), (1, 2), (1, 3), (2, 3)}
    assert L.lookalike_pairs(d.limit(0)).count() == 0


def test_pairs_equal_brute_force(spark, small, look):
    d = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text, look(r.text)) for r in d.select("doc_id", "text").collect() if r.text and look(r.text).strip()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and a[2] == b[2]}
    assert {tuple(r) for r in L.lookalike_pairs(d).collect()} == want


def test_classes(spark):
    got = {r.doc_id: (r.class_id, r.spellings, r.links) for r in L.lookalike_classes(docs(spark, "cope", "соре", "x", None, "cope", "", "\u200b")).collect()}
    assert got == {0: (0, 2, 1), 1: (0, 2, 2), 2: (2, 1, 0), 3: (None, None, 0), 4: (0, 2, 1), 5: (None, None, 0), 6: (None, None, 0)}


def test_links_of_classes_are_the_pairs(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    assert sum(r.links for r in L.lookalike_classes(d).collect()) == 2 * L.lookalike_pairs(d).count()
