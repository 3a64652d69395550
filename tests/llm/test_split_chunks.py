import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm.split_chunks import oversized_ids, split_oversized

SCHEMA = "chunk_id long, doc_id long, content string, token_count int, sequence int, piece string"


def rebuilt(pieces: list[str], overlap: int) -> bytes:
    out, before = b"", None
    for p in pieces:
        b = p.encode()
        if before is not None:
            k = next(k for k in range(min(overlap, len(before)), -1, -1) if before.endswith(b[:k]))
            assert overlap - 3 <= k <= overlap
            b = b[k:]
        out, before = out + b, p.encode()
    return out


def run(spark, rows, **kw):
    return split_oversized(spark.createDataFrame(rows, SCHEMA), **kw).orderBy("doc_id", "sequence").collect()


def test_pieces_round_trip_with_overlap(spark):
    text = "\n\n".join(f"Paragraph {i} says, with care: nothing new. " * (i % 7 + 1) for i in range(60))
    han = "这是一个没有空格的长句子，里面有很多字。" * 90
    hexa = "0123456789abcdef" * 500
    got = run(spark, [(1, 1, text, 0, 0, "x"), (2, 1, han, None, 1, "x"), (3, 2, hexa, 9, 0, "x"), (4, 2, "short", 900, 1, "x")])
    for chunk_id, whole in ((1, text), (2, han), (3, hexa)):
        own = sorted((r for r in got if r.chunk_id == chunk_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(len(r.content.encode()) <= 2048 and r.token_count <= 512 for r in own)
        assert rebuilt([r.content for r in own], 128).decode() == whole
    assert not [r for r in got if r.chunk_id == 4]
    assert [r.sequence for r in got if r.doc_id == 1] == list(range(len([r for r in got if r.doc_id == 1])))


def test_cuts_fall_on_the_strongest_boundary(spark):
    text = ("word " * 250 + "\n\n") * 4
    own = run(spark, [(1, 1, text, 0, 0, None)])
    assert all(r.content.endswith("\n\n") for r in own)


def test_repeats_nulls_ties_and_empty_tables(spark):
    big = "a b " * 700
    rows = [(1, 1, big, 1, 0, None), (1, 1, big, 2, 0, None), (None, None, big, None, None, None), (2, 1, None, None, None, None), (3, 1, "", 0, 0, None)]
    got = run(spark, rows)
    assert sorted({(r.chunk_id, r.piece) for r in got}, key=str) == sorted([(r.chunk_id, r.piece) for r in got], key=str)
    assert {r.chunk_id for r in got} == {1, None}
    assert run(spark, []) == []


def test_a_text_of_exactly_the_limit_stays_whole(spark):
    df = spark.createDataFrame([(1, 1, "x" * 2048, 0, 0, None), (2, 1, "x" * 2049, 0, 0, None)], SCHEMA)
    assert [r.chunk_id for r in oversized_ids(df).collect()] == [2]


def test_bad_overlap_is_refused(spark):
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([], SCHEMA), max_tokens=8, overlap_tokens=8)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), min_size=600, max_size=1500), min_size=1, max_size=3))
def test_any_text_comes_back(spark, texts):
    rows = [(i, 1, t, 0, i, None) for i, t in enumerate(texts)]
    got = run(spark, rows, max_tokens=64, overlap_tokens=8)
    for i, t in enumerate(texts):
        own = [r.content for r in sorted((r for r in got if r.chunk_id == i), key=lambda r: r.piece)]
        if len(t.encode()) > 256:
            assert rebuilt(own, 32).decode() == t
