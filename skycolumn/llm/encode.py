"""Token ids of whole texts with a public tokenizer of white-space-free words, cached by word.

The tokenizer drops white space and never joins across it, so the ids of a text are the ids of its chunks between
blanks, and most chunks recur. A chunk of printable ASCII and Latin-1 letters is cut into the tokenizer's words by
its fixed pattern and each word is merged by the tokenizer's own model; any other chunk goes through the whole
tokenizer. Both caches are bounded: a full one becomes the older generation, from which what is
used again moves back. The tests compare with the plain call on whole texts.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_BPE = "word_bpe_49k.json"
SEGMENT = 1 << 20
CACHED = 300_000
BATCH_TOKENS = 1 << 20
# The letters and the word pattern of the tokenizer, for lower-case Latin-1 text.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class WordIds(dict):
    """chunk -> little-endian unsigned 32-bit ids; computes what is missing."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _word(self, word: str) -> bytes:
        ids = self.older_words.get(word)
        if ids is None:
            mapped = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
            found = [t.id for t in self.model.tokenize(mapped)]
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(self.words) >= CACHED:
            self.older_words, self.words = self.words, {}
        self.words[word] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is not None:
            pass
        elif _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            known = self.words.get
            ids = b"".join([known(w) or self._word(w) for w in _WORD.findall(chunk.lower())])
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        out, at = [], 0
        while at < len(text):
            end = len(text) if len(text) - at <= SEGMENT else text.find(" ", at + SEGMENT)
            end = len(text) if end < 0 else end
            chunks = text[at:end].replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            out.append(b"".join(map(self.__getitem__, chunks)))
            at = end + 1
        return b"".join(out)


@functools.cache
def word_ids(path: str) -> WordIds:
    """One encoder per Python worker."""
    return WordIds(path)


def encode_rows(docs: DataFrame, doc_id: str, text: str, make, schema: str) -> DataFrame:
    """``make(doc_id, ids)`` yields result rows for each document; rows leave in batches of bounded size."""
    fields = [f.split()[0] for f in schema.split(", ")]
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    path = tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, types = word_ids(path), None
        for batch in batches:
            types = types or [batch.schema.field(0).type, *[{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in schema.split(", ")[1:]]]
            held, size = [], 0
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(value.as_py())
                held += make(key, ids)
                size += len(ids) // 4 + 1
                if size >= BATCH_TOKENS:
                    yield _batch(held, fields, types)
                    held, size = [], 0
            if held:
                yield _batch(held, fields, types)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + schema.split(", ", 1)[1])


def _batch(rows: list[tuple], fields: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=fields)
