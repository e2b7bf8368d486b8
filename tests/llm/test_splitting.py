from datetime import datetime as T

import pytest

from quarryline.llm import splitting as S

FILE = "file_id bigint, path string, text string, arrived_at timestamp_ntz, language string, piece int"
LIMIT = "language string, max_bytes bigint, overlap_bytes bigint"


def check(text, limit, overlap):
    raw, out = text.encode(), S.pieces(text, limit, overlap)
    assert out[0][0] == 0 and out[-1][1] == len(raw)
    for (a, b, _), (c, d, _) in zip(out, out[1:]):
        assert a < c <= b < d and b - c <= overlap + 3
    for a, b, _ in out:
        assert b - a <= limit
        raw[a:b].decode()
    back = raw[: out[0][1]]
    for (_, b, _), (c, d, _) in zip(out, out[1:]):
        back += raw[b:d]
    assert back == raw
    return out


@pytest.mark.parametrize("text", ["def a():\n    x\n\n" * 50, "word " * 300, "x" * 900, "é" * 700, "日本" * 300 + "\n" + "a b", "\n" * 500, "😀" * 200])
@pytest.mark.parametrize("limit, overlap", [(100, 10), (64, 0), (33, 16), (20, 500)])
def test_pieces_cover_the_text(text, limit, overlap):
    check(text, limit, min(overlap, limit // 2))


def test_boundaries_are_natural_where_there_are_any():
    out = check("def a():\n    return 1\n\n\ndef b():\n    return 2\n" * 20, 200, 20)
    assert {w for _, _, w in out[:-1]} == {"block"}
    assert {w for _, _, w in check("word " * 100, 60, 5)[:-1]} == {"token"} and {w for _, _, w in check("x" * 300, 60, 5)[:-1]} == {"hard"}
    assert {w for _, _, w in check(" " * 8 + "\n        ".join(["abc def"] * 60), 60, 5)[:-1]} <= {"line", "token"}


def test_overlap_is_as_asked():
    out = check("a b c d e\n" * 100, 100, 12)
    assert all(b - c == 12 for (_, b, _), (c, _, _) in zip(out, out[1:]))


@pytest.mark.parametrize("overlap", [499, 600, 990])
def test_large_overlaps_are_kept(overlap):
    out = check("a b c d e\n" * 1000, 1000, overlap)
    assert all(b - c == overlap for (_, b, _), (c, _, _) in zip(out, out[1:]))
    check("😀é" * 60, 20, 17)
    with pytest.raises(ValueError):
        S.pieces("x" * 2000, 1000, 1000)


def test_an_earlier_oversized_delivery_does_not_answer(spark):
    rows = [(1, "a.py", "x" * 20, T(2025, 1, 1), "x", 1), (1, "a.py", "x", T(2025, 1, 2), "x", 1), (2, "a.py", "x", T(2025, 1, 1), "x", 1), (2, "a.py", "x" * 11, T(2025, 1, 2), "x", 1)]
    got = S.split_oversized(spark.createDataFrame(rows, FILE), spark.createDataFrame([("py", 10, 2)], LIMIT)).collect()
    assert {r.file_id for r in got} == {2}


def test_no_piece_for_small_empty_or_null_texts(spark):
    rows = [(1, "a.py", "x" * 11), (2, "a.py", "x" * 10), (3, "a.py", ""), (4, "a.py", None), (5, "a.zzz", "x" * 99), (6, None, "x" * 99), (7, "b.py", "é" * 6), (1, "a.py", "x" * 11), (None, "a.py", "x" * 30)]
    f = spark.createDataFrame([(*r, T(2025, 1, 1), "x", 1) for r in rows], FILE)
    limits = spark.createDataFrame([("py", 10, 2)], LIMIT)
    got = S.split_oversized(f, limits).orderBy("file_id", "piece").collect()
    assert [(r.file_id, r.piece, r.start, r.end) for r in got] == [(1, 0, 0, 10), (1, 1, 8, 11), (7, 0, 0, 10), (7, 1, 8, 12)]
    assert S.split_oversized(f.limit(0), limits).count() == 0 and S.split_oversized(f, limits.limit(0)).count() == 0


def test_very_long_text_is_quick():
    assert len(check("x1 " * 400_000, 6000, 400)) > 200
