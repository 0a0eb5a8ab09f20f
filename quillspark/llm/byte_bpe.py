"""Byte-level BPE by the ``tiktoken`` library and a local rank file, both ways.

``encoded`` adds the ids of each whole text, ``decoded`` turns ids back into raw bytes: a slice of
ids may end inside a character, so bytes are what decoding gives, and text is what the caller makes
of them. Ids are held as little-endian unsigned 32-bit integers in a binary column (4 bytes an id,
digests and slices work on it directly) or, with ``packed=False``, as an array of integers.

The library finds its pre-tokens by one regular expression over the text. It needs a frame of the
stack for every character of a run of white space and dies on a very long one, and its lists grow
with the text. Long texts are therefore cut first, only where the pattern must end a match anyway:

* between a character that isn't white space and white space: no alternative goes on there, none
  looks back, and the only look-ahead is that of white space, which stands behind the cut;
* in a run of white space that is longer than ``RUN``: the pattern takes all of it but the last
  character in one match (all of it at the end of a text), so that match is encoded as one piece.

The ids are thus those of the whole text, whatever the sizes.

Defined cases: null text counts as empty; empty texts have no ids; null ids
decode to null, ids that the rank file lacks raise an error; repeated rows are encoded each; empty
tables stay empty; all other columns are kept, and a column of the name of the result, whatever its
case, is replaced (also where it is the one that is read).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, table

#: Characters of a text that goes to the library in one call, roughly.
PART = 50_000
#: Characters of a run of white space that the library may see.
RUN = 20_000
#: Unicode's White_Space, which is white space to the library's expressions (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BOUNDARY = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
_LONG_RUN = re.compile(f"[{SPACE}]{{{RUN},}}")


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """The text cut at safe boundaries, in order, and for each part whether it is one match."""
    at = 0
    for run in _LONG_RUN.finditer(text):
        last = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((p, False) for p in _between(text, at, run.start()))
        yield text[run.start() : last], True
        at = last
    yield from ((p, False) for p in _between(text, at, len(text)))


def _between(text: str, at: int, end: int) -> Iterator[str]:
    while end - at > PART:
        found = _BOUNDARY.search(text, at + PART, end)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    if at < end:
        yield text[at:end]


class Codec:
    """``encode`` gives a text's ids, ``decode`` the bytes of ids."""

    def __init__(self, file: str, pattern: str):
        import tiktoken

        with open(file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._by_pattern = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._one_piece = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str, one: bool = False) -> np.ndarray:
        return (self._one_piece if one else self._by_pattern).encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= RUN:
            return self._ids(text)
        return np.concatenate([self._ids(*part) for part in parts(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        return self._by_pattern.decode_bytes(ids.tolist())


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(file: str, pattern: str) -> Codec:
    """One per worker, rank file and pattern, kept between tasks."""
    if (file, pattern) not in _CODECS:
        _CODECS[file, pattern] = Codec(file, pattern)
    return _CODECS[file, pattern]


def _mapped(df: DataFrame, column: str, result: str, kind: str, run) -> DataFrame:
    """``df`` with ``result`` made of ``column`` by ``run``, an Arrow array to an Arrow array."""
    kept = [c for c in df.columns if c.lower() != result.lower()]
    read = df.select(*kept, F.col(column).alias(fresh(df, "read")[0]))
    schema = ", ".join([*(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{result}` {kind}"])

    def over(batches):
        for batch in batches:
            *others, values = batch.columns
            yield pa.RecordBatch.from_arrays([*others, run(values)], [*kept, result])

    return read.mapInArrow(lean(over), schema)


def encoded(df: DataFrame, file: str, pattern: str, text: str = "text", ids: str = "ids", packed: bool = True) -> DataFrame:
    """Add the ids of each text by the ranks of ``file``, each match of ``pattern`` separately."""

    def run(texts: pa.Array) -> pa.Array:
        encode = codec(file, pattern).encode
        found = [encode(t.as_py() or "") for t in texts]
        if packed:
            return pa.array([x.astype("<u4", copy=False).tobytes() for x in found], pa.binary())
        return pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))

    return _mapped(df, text, ids, "binary" if packed else "array<int>", run)


def decoded(df: DataFrame, file: str, pattern: str, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """Add the raw bytes of ids, which are held in either of the two forms."""

    def unpacked(x) -> np.ndarray:
        return np.frombuffer(x.as_buffer(), "<u4") if isinstance(x, pa.BinaryScalar) else np.array(x.as_py(), np.uint32)

    def run(rows: pa.Array) -> pa.Array:
        decode = codec(file, pattern).decode
        return pa.array([decode(unpacked(x)) if x.is_valid else None for x in rows], pa.binary())

    return _mapped(df, ids, raw, "binary", run)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), file, pattern).drop("text")
    back = decoded(ids, file, pattern)
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
