"""Byte-level BPE against the library on whole texts, and its round trip."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillspark.llm")
import public_tokenizers as P  # noqa: E402

from quillspark.llm import byte_bpe  # noqa: E402

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import base64

    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_query(spark, library):
    got = {r.doc_id: r for r in byte_bpe.query(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        mine = got[r.doc_id]
        assert (mine.n_tokens, mine.ids_sha256, mine.decoded_sha256) == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest((r.text or "").encode()))


def test_cuts_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART", 7)
    monkeypatch.setattr(byte_bpe, "RUN", 5)
    monkeypatch.setattr(byte_bpe, "_LONG_RUN", byte_bpe.re.compile(f"[{byte_bpe.SPACE}]{{5,}}"))
    codec = byte_bpe.codec(RANKS, P.PATTERN)
    rng = np.random.default_rng(1)
    letters = list("ab 's\n\t\x1c\x85\xa0 ​　Z09²é.!中😀 ") + [" "] * 8
    for _ in range(5_000):
        text = "".join(rng.choice(letters, rng.integers(60)))
        ids = codec.encode(text)
        assert "".join(p for p, _ in byte_bpe.parts(text)) == text
        assert ids.tolist() == library.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", [" " * 1_500_000 + "x", "\n \t" * 500_000, "a" * 1_000_000, "中" * 500_000, "'s" * 500_000, ("ab " * 10 + " " * 30_000) * 20, "é!1 " * 250_000])
def test_long_texts(text, library):
    codec = byte_bpe.codec(RANKS, P.PATTERN)
    ids = codec.encode(text)
    assert codec.decode(ids) == text.encode()
    if "   " not in text and "\n \t" not in text:  # the library alone can't take those
        assert ids.tolist() == library.encode_ordinary(text)


def test_awkward_rows(spark, library):
    rows = [(1, None, "x"), (1, "", "x"), (None, "a <|endoftext|> b", None), (2, "same", "x"), (2, "same", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = byte_bpe.decoded(byte_bpe.encoded(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "raw"]
    got = out.collect()
    assert sorted(bytes(r.raw) for r in got) == sorted((r[1] or "").encode() for r in rows)
    lists = byte_bpe.encoded(df, RANKS, P.PATTERN, packed=False)
    assert sorted(r.ids for r in lists.collect()) == sorted(library.encode_ordinary(r[1] or "") for r in rows)
    assert sorted(bytes(r.raw) for r in byte_bpe.decoded(lists, RANKS, P.PATTERN).collect()) == sorted((r[1] or "").encode() for r in rows)
    null = byte_bpe.decoded(df.select(F.lit(None).cast("binary").alias("ids")), RANKS, P.PATTERN)
    assert {r.raw for r in null.collect()} == {None}
    assert byte_bpe.encoded(df.limit(0), RANKS, P.PATTERN).collect() == []
    same = byte_bpe.encoded(df.select("text"), RANKS, P.PATTERN, ids="text")
    assert same.columns == ["text"] and same.schema["text"].dataType.simpleString() == "binary"


def test_a_slice_of_ids_may_end_inside_a_character(spark, library):
    text = "中😀é"
    df = byte_bpe.encoded(spark.createDataFrame([(text,)], "text string"), RANKS, P.PATTERN)
    halves = [byte_bpe.decoded(df.select(F.substring("ids", at, n).alias("ids")), RANKS, P.PATTERN).first().raw for at, n in ((1, 4), (5, 1 << 20))]
    assert b"".join(map(bytes, halves)) == text.encode()
