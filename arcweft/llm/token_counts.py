"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch lie in one flat array with their lengths; in each round every
pre-token merges its lowest-ranked pair, all at once, and the symbols that are left at the end
are counted.  Two kinds of vocabulary: ``.model`` (sentencepiece BPE) and ``.tiktoken``
(byte-level ranks, cut by a pattern).

Cases: a null or empty text has 0 bytes and 0 tokens; special strings in a text are ordinary
text; repeated rows are counted each; of equal ranks the leftmost pair merges first; a very long
text or word is counted whole; other columns pass through, and an output replaces an input column
of its name; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_texts
from .bpe import Pairs, PieceVocabulary, WordCache, merge_rounds

FIELDS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


@dataclass
class ByteVocabulary:
    """Byte-level BPE: mergeable ranks, and the pattern that cuts a text into pre-tokens."""

    pairs: Pairs
    first: np.ndarray
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteVocabulary:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        found = {}
        for token, r in ranks.items():
            for j in range(1, len(token)):
                a, b = ranks.get(token[:j]), ranks.get(token[j:])
                if a is not None and b is not None:
                    found[a, b] = (r, r)
        first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        return cls(Pairs.build(found, max(ranks.values()) + 1, max(map(len, ranks))), first, pattern)

    def words(self, text: str) -> list[str]:
        import regex

        return regex.findall(self.pattern, text)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbols, counts = merge_rounds(self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)], lengths, self.pairs)
        return symbols.astype(np.int32), counts


def load_vocabulary(path: str, pattern: str | None = None) -> PieceVocabulary | ByteVocabulary:
    if path.endswith(".model"):
        return PieceVocabulary.load(path)
    if path.endswith(".tiktoken") and pattern:
        return ByteVocabulary.load(path, pattern)
    raise ValueError(f"{path}: give a .model file, or a .tiktoken file and its pattern")


def count_tokens(
    docs: DataFrame, vocabulary: str, text: str = "text", pattern: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Add ``n_bytes`` and ``n_tokens`` to the columns in ``keep`` (default: all)."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary, pattern))  # one fixed vocabulary

    def make():
        cache = WordCache(shared.value)

        def work(texts: list[str]) -> list[pa.Array]:
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            return [pa.array(sizes, pa.int64()), pa.array(cache.counts(texts), pa.int64())]

        return work

    keep = docs.columns if keep is None else keep
    rows, out = map_texts(docs, text, FIELDS, make, keep)
    mine = {f.name for f in FIELDS}
    return rows.select(*[f"`{c}`" for c in keep if c.lower() not in mine], f"{out}.n_bytes", f"{out}.n_tokens")


def with_limit(docs: DataFrame, vocabulary: str, limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, and whether the tokens exceed ``limit``."""
    rows = count_tokens(docs, vocabulary, keep=["doc_id"])
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
