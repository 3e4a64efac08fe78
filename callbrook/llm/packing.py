"""Packing by powers of two: a document's tokens are cut into pieces whose lengths are powers of two, largest first.

Every piece is a whole sequence of its own, so no sequence crosses documents and none needs padding.  Pieces of equal length form
a bucket (``bucket`` is the base-two logarithm); a trainer draws each batch from one bucket.

Defined results: a null text is the empty text and gives one piece with the end token; repeated rows give pieces of their own; an
empty table gives none.  Only ``id_col`` and ``text_col`` are read, whatever other columns there are.
"""

from __future__ import annotations

import array
import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Two white-space characters in a row: only these need the pattern's look-ahead.
_RUN = re.compile(r"[\s\x1c-\x1f\x85]{2}")
#: The public pattern of the vocabulary without the look-ahead alternatives, equal where white space stands alone.
_PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


class Encoder:
    """Ids of the public byte-level vocabulary.

    The ranks file holds the same vocabulary as the JSON file and encodes several times faster; texts that contain the name of
    a special token go through the JSON file, which gives it its own id.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        import public_tokenizers as public
        import tiktoken
        with open(public.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        plain, full = (tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={})
                       for name, p in (("plain", _PLAIN), ("full", public.PATTERN)))
        self.plain, self.full = plain.encode_ordinary, full.encode_ordinary
        self.json, self.slow = public.path(f"{vocabulary}.json"), None

    def __call__(self, text: str) -> list[int]:
        if "<|" in text:
            if self.slow is None:
                from tokenizers import Tokenizer
                self.slow = Tokenizer.from_file(self.json)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.full(text) if _RUN.search(text) else self.plain(text)


def cut(n: int, most: int) -> list[int]:
    """Lengths of the pieces of n tokens: whole sequences, then the binary digits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, most: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = True, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset`` and, if asked, ``ids``."""
    if most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(vocabulary)
            for at in range(0, batch.num_rows, 256):  # few texts at a time as Python strings
                keys, texts = (batch.column(k).slice(at, 256).to_pylist() for k in (0, 1))
                rows: list[tuple] = []
                ids: list[np.ndarray] = []
                for key, text in zip(keys, texts, strict=True):
                    tokens = np.frombuffer(array.array("I", encoder(text or "") + [end_id]), np.uint32)
                    start = 0
                    for length in cut(len(tokens), most):
                        part = tokens[start:start + length]
                        rows.append((key, start, length, zlib.crc32(part.astype("<u4", copy=False)), len(tokens)))
                        if with_ids:
                            ids.append(part)
                        start += length
                out = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                    flat = np.concatenate(ids).view(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(out)]
                yield pa.RecordBatch.from_arrays(out, names)

    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(encode, DIGEST + (", ids array<int>" if with_ids else ""))
    return made.withColumns({
        "bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Training files: one folder per length, so that a reader takes batches of equal length."""
    packed.write.partitionBy("bucket").parquet(path)
