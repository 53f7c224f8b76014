"""Token counts against the library over whole texts: short chunks, texts without a common token, odd rows."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chalkline.llm.entries import tokenizer_path
from chalkline.llm.tokencount import Pieces, _Unit, count_tokens

MODEL = tokenizer_path("piece_bpe_32k.model")
RUNS = st.one_of(
    st.text(max_size=30),
    st.integers(1, 90).map(lambda n: "a" * n),
    st.integers(1, 60).map(lambda n: " " * n),
    st.lists(st.sampled_from(["ab", "  ", "▁", "é", "\n", "😀", " the", "tion", "<s>", "<0x41>", "xy", "0"]), max_size=40).map("".join),
)


def plain(text):
    return len(Pieces.of(MODEL).model.encode(text or ""))


@given(st.lists(RUNS, min_size=1, max_size=6).map("".join), st.sampled_from([7, 16, 33]), st.sampled_from([1, 3, 7]))
@settings(max_examples=300, deadline=None)
def test_units_of_any_text(text, chunk, overlap):
    unit = None
    for at in range(0, max(len(text), 1), chunk):
        part = text[at : at + chunk + overlap]
        if unit is None:
            unit = _Unit(Pieces.of(MODEL), 0, 0, part, chunk, overlap)
        else:
            unit.add(part)
    assert unit.row_of()[3] == plain(text)


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (50, 3), (1 << 15, 256)])
def test_against_library(spark, chunk, overlap):
    prose = " ".join(f"word{i * 7919 % 50021} thing" for i in range(400))
    texts = [prose, "a" * 3000, "ab" * 1700 + prose, " " * 999, "x" + " " * 500 + prose + "a" * 777, "日本語のテキスト" * 90, "", None, "short", "short", "é\U0001f600" * 300, "<s>" * 200, "\n" * 300]
    rows = [(i if i % 4 else None, t, -i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_tokens int")
    told = count_tokens(df, "text", MODEL, ["doc_id", "N_tokens"], chunk, overlap)
    assert told.columns == ["doc_id", "N_tokens_in", "n_tokens"]
    assert sorted(tuple(r) for r in told.select("N_tokens_in", "n_tokens").collect()) == sorted((-i, plain(t)) for i, t in enumerate(texts))


def test_huge_text_and_empty_table(spark):
    text = "".join(f"Line {i} of a long text, {i * i}.\n" for i in range(60_000)) + "a" * 100_000
    df = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, "text", MODEL, ["doc_id"]).collect()} == {1: plain(text), 2: plain("x")}
    assert count_tokens(df.limit(0), "text", MODEL, ["doc_id"]).collect() == []
