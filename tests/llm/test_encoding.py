import base64

import pytest

from orefield.llm import encoding

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = [
    None, "", " ", "\n\n  x", "Hello, world! It's 9 o'clock; they'll go.", "  leading and trailing  ", "日本語 テキスト ملف naïve café", "a" * 20_000, "<|endoftext|> is text", "MOVE WS-A1 TO B.\r\n\tEND", "rare" + "q" * 70 + " word", "  x　", "😀 emoji 👩‍👩‍👧", "it’s IT'S don't", "0123 4567",
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(encoding.vocabulary_file(), "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("hot", [65_536, 3, 0])
def test_ids_equal_the_library_and_decode_to_the_text(spark, library, monkeypatch, hot):
    monkeypatch.setattr(encoding, "HOT_WORDS", hot)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in [*enumerate(TEXTS), (None, "null id rare0"), (4, TEXTS[4])]], "doc_id bigint, text string, ids string, words string")
    encoded = encoding.encode(df)
    got = sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=str)
    want = sorted(((i, library.encode_ordinary(t or "")) for i, t in [*enumerate(TEXTS), (None, "null id rare0"), (4, TEXTS[4])]), key=str)
    assert got == want
    texts = {r["doc_id"]: r["text"] for r in encoding.decode(encoded).collect()}
    assert texts == {**{i: t or "" for i, t in enumerate(TEXTS)}, None: "null id rare0"}


def test_empty_table(spark):
    assert encoding.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
