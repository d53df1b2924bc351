import pytest

from codexmill.llm.splitting import split_texts


def pieces(spark, texts, limit=64, overlap=8):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "id bigint, t string, piece_no int")
    out = {}
    for r in split_texts(df, "id", "t", limit, overlap).collect():
        out.setdefault(r.item_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.piece_no) for k, v in out.items()}


def test_every_text_is_whole_and_within_limits(spark):
    words = " ".join(f"word{i}." if i % 7 == 0 else f"wörd{i}" for i in range(200))
    texts = [None, "", "   ", "short", "x" * 64, "x" * 65, "日" * 500, words, "a\n\n" * 100, "== H ==\ntext\n" * 50, "𝄞é" * 99, "y" * 200_000, "a\r\n\r\nb" * 80]
    got = pieces(spark, texts)
    for i, t in enumerate(texts):
        if not t:
            assert i not in got
            continue
        ps = got[i]
        assert len(ps) == ps[0].n_pieces and (len(ps) == 1) == (len(t.encode()) <= 64)
        assert b"".join(p.piece.encode()[p.overlap_bytes :] for p in ps).decode() == t
        for a, b in zip(ps, ps[1:]):
            assert len(b.piece.encode()) == b.n_bytes <= 64 and 5 <= b.overlap_bytes <= 8
            assert a.piece.encode().endswith(b.piece.encode()[: b.overlap_bytes])
        assert ps[0].overlap_bytes == 0


def test_stronger_boundaries_win(spark):
    heading = "one two. three four\n\n" + "== Head ==\n" + "some words here. " * 4
    para = "one two. three four five\n\nsix seven. eight nine ten eleven twelve thirteen fourteen"
    sentence = "one two three four five. six seven eight nine ten eleven twelve thirteen"
    word = "one two three four five six seven eight nine ten eleven twelve thirteen"
    got = pieces(spark, [heading, para, sentence, word])
    assert [got[i][0].piece for i in range(4)] == ["one two. three four\n\n", "one two. three four five\n\n", "one two three four five. ", "one two three four five six seven eight nine ten eleven twelve "]


def test_bad_limits(spark):
    df = spark.createDataFrame([], "id bigint, t string")
    with pytest.raises(ValueError):
        split_texts(df, "id", "t", 20, 8)
    assert split_texts(df, "id", "t", 64, 8).count() == 0
