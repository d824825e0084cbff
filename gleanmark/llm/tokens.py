"""Token ids of whole corpora with a public byte-level BPE.

Most texts are encoded in one call. A text longer than ``long_chars`` is cut into chunks that are encoded in
parallel as rows of their own and joined as a tree; a run without any place where the tokenizer splits (base64,
a line of one letter) is encoded by halves inside a worker in the same way. Each join re-encodes a window around
the cut that grows until its outer tokens agree with both sides. Agreement is exact, not likely:

* between a character and a white space after it, and between two characters of different class (letter, number,
  other) unless the first is an apostrophe, the tokenizer splits whatever the context, so a window between two such
  places yields the ids of the whole text there;
* inside one unsplit run, a sequence of tokens is the encoding if and only if each adjacent pair encodes to itself,
  so a window is done when the pairs at both its ends do.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files where none is given.
TOKENIZERS = "/opt/tokenizers"
#: Split pattern of the byte-level BPE with 50,257 ids (fixed value of the public tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
LONG_CHARS = 200_000
CHUNK_CHARS = 50_000
#: Longest run, in bytes, that is handed to the BPE in one piece.
PIECE_BYTES = 2_048


@functools.lru_cache(maxsize=2)
def _encoding(ranks_file: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _classes():
    import regex

    return {
        "long": regex.compile(rf"(?:\p{{L}}{{{PIECE_BYTES // 4},}}|\p{{N}}{{{PIECE_BYTES // 4},}}|[^\p{{White_Space}}\p{{L}}\p{{N}}]{{{PIECE_BYTES // 4},}}|\p{{White_Space}}{{{PIECE_BYTES // 4},}})"),
        "split": regex.compile(PATTERN),
        "letter": regex.compile(r"\p{L}"),
        "number": regex.compile(r"\p{N}"),
        "space": regex.compile(r"\p{White_Space}"),
    }


def char_class(c: str) -> str:
    known = _classes()
    return "L" if known["letter"].match(c) else "N" if known["number"].match(c) else "S" if known["space"].match(c) else "P"


def always_split(before: str, after: str) -> bool:
    """Whether the tokenizer splits between the two characters in any context."""
    a, b = char_class(before), char_class(after)
    return a != "S" and (b == "S" or (a != b and before != "'"))


@dataclass
class ByteBpe:
    """Encoder over the ranks of a vocabulary file."""

    ranks_file: bytes
    enc: object = field(init=False)

    def __post_init__(self):
        self.enc = _encoding(self.ranks_file)

    @classmethod
    def load(cls, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> ByteBpe:
        return cls(Path(folder, f"{name}.tiktoken").read_bytes())

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self._may_run_long(text) or not _classes()["long"].search(text):
            return self.enc.encode_to_numpy(text, disallowed_special=()).tolist()
        ids: list[int] = []
        for piece in _classes()["split"].findall(text):
            ids += self.run(piece.encode())
        return ids

    @staticmethod
    def _may_run_long(text: str) -> bool:
        """Cheap and never wrongly false: whether some unsplit run could exceed the piece size."""
        limit = PIECE_BYTES // 4
        if len(text) < limit:
            return False
        lengths = list(map(len, text.split()))
        return max(lengths, default=0) >= limit or len(text) - sum(lengths) >= limit + len(lengths)

    def encode_arrow(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text as one Arrow array; nulls give empty lists."""
        parts = [self._buffer(t.as_py()) for t in texts]
        offsets = np.zeros(len(parts) + 1, dtype=np.int32)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        values = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int32)))

    def _buffer(self, text: str | None) -> np.ndarray:
        if text and not self._may_run_long(text):
            return self.enc.encode_to_numpy(text, disallowed_special=())
        return np.array(self.encode(text), dtype=np.uint32)

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.array([len(self._buffer(t.as_py())) for t in texts], dtype=np.int32)

    def run(self, data: bytes) -> list[int]:
        """Ids of one unsplit run: halves, then their join."""
        if len(data) <= PIECE_BYTES:
            return self.enc._encode_single_piece(data)
        half = len(data) // 2
        return self.join_run(self.run(data[:half]), self.run(data[half:]))

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(self.enc.decode_tokens_bytes(ids))

    def _stands(self, a: int, b: int) -> bool:
        return self.enc._encode_single_piece(self._bytes([a, b])) == [a, b]

    def join_run(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the run whose two parts have the ids ``left`` and ``right``."""
        if not left or not right or self._stands(left[-1], right[0]):
            return left + right
        width = 2
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            data = self._bytes(left[a:] + right[:b])
            if a == 0 and b == len(right):
                return self.enc._encode_single_piece(data)
            middle = self.enc._encode_single_piece(data)
            if (a == 0 or self._stands(left[a - 1], middle[0])) and (b == len(right) or self._stands(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            width *= 2

    def _tokens_to(self, ids: list[int], n_bytes: int) -> int:
        """How many leading tokens make ``n_bytes``; -1 where that isn't a token's end."""
        at = 0
        for k, token in enumerate(self.enc.decode_tokens_bytes(ids)):
            if at == n_bytes:
                return k
            at += len(token)
        return len(ids) if at == n_bytes else -1

    def join(self, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
        """Text and ids of two adjacent parts of a text."""
        (a, a_ids), (b, b_ids) = left, right
        if not a or not b:
            return a + b, a_ids + b_ids
        start = next((i for i in range(len(a) - 1, 0, -1) if always_split(a[i - 1], a[i])), 0)
        stop = next((i for i in range(1, len(b)) if always_split(b[i - 1], b[i])), len(b))
        tail, head = a[start:], b[:stop]
        keep = self._tokens_to(a_ids, len(a[:start].encode()))
        drop = self._tokens_to(b_ids, len(head.encode()))
        same = char_class(a[-1]) == char_class(b[0]) != "S" and len(_classes()["split"].findall(tail)) == 1 == len(_classes()["split"].findall(head)) == len(_classes()["split"].findall(tail[-8:] + head[:8]))
        if keep >= 0 and drop >= 0 and same and "'" not in tail and "'" not in head:
            middle = self.join_run(a_ids[keep:], b_ids[:drop])
        elif keep >= 0 and drop >= 0:
            middle = self.encode(tail + head)
        else:
            return a + b, self.encode(a + b)
        return a + b, a_ids[:keep] + middle + b_ids[drop:]

    def tree(self, parts: list[tuple[str, list[int]]]) -> list[int]:
        """Ids of the text whose adjacent parts are given with their ids."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][1] if parts else []


def _shared(df: DataFrame, folder: str, name: str):
    """The vocabulary file as a broadcast: under 1 MB whatever the data, and executors need no copy of the folder."""
    return df.sparkSession.sparkContext.broadcast(Path(folder, f"{name}.tiktoken").read_bytes())


def encode_corpus(
    df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k", long_chars: int = LONG_CHARS, chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """``key, ids``: the token ids of each row's whole text, without special tokens.

    Null and empty texts give an empty array, blank texts are encoded as they are. Each input row gives one row, also
    where a key repeats; other columns are ignored. Texts up to ``long_chars`` need no shuffle; chunks of longer ones are
    spread over the tasks and brought together per text, whose ids are one value in any case.
    """
    ranks = _shared(df, folder, name)
    kind = dict(df.dtypes)[key]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(ranks.value)
        for batch in batches:
            ids = bpe.encode_arrow(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*batch.schema.names[:-1], "ids"])

    rows = df.select(F.col(key), F.col(text).alias("_text"))
    is_long = F.coalesce(F.length("_text") > long_chars, F.lit(False))
    short = rows.where(~is_long).mapInArrow(encoded, f"`{key}` {kind}, ids array<int>")
    starts = F.sequence(F.lit(0), F.floor((F.length("_text") - 1) / chunk_chars).cast("int"))
    chunks = (
        rows.where(is_long)
        .withColumn("_row", F.monotonically_increasing_id())
        .select(key, "_row", "_text", F.explode(starts).alias("_no"))
        .select(key, "_row", "_no", F.expr(f"substring(_text, _no * {chunk_chars} + 1, {chunk_chars})").alias("_chunk"))
        .repartition("_row", "_no")
        .select(key, "_row", "_no", F.col("_chunk").alias("_part"), "_chunk")
        .mapInArrow(encoded, f"`{key}` {kind}, _row long, _no int, _part string, ids array<int>")
    )

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_no")
        parts = [(t, [int(i) for i in ids]) for t, ids in zip(pdf["_part"], pdf["ids"])]
        return pd.DataFrame({key: pdf[key].iloc[:1], "ids": [ByteBpe(ranks.value).tree(parts)]})

    return short.unionByName(chunks.groupBy("_row").applyInPandas(joined, f"`{key}` {kind}, ids array<int>"))
