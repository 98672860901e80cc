"""SentencePiece encoding and decoding by vectorised merge rounds.

Cases: a null or empty text has no ids and decodes to an empty text; a character without a
piece becomes its UTF-8 bytes' pieces; repeated rows are encoded each; of equal ranks the leftmost
pair merges first; a very long text or word is encoded whole; other columns pass through, and an
output replaces an input column of its name; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_texts
from .bpe import PieceVocabulary, WordCache, list_array

FIELDS = T.StructType(
    [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
)


def encode_decode(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (array<int>) and ``decoded`` (string) to the columns in ``keep`` (default: all)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(PieceVocabulary.load(model))  # one fixed vocabulary

    def make():
        cache = WordCache(vocabulary.value)
        decoder = vocabulary.value.decoder()

        def work(texts: list[str]) -> list[pa.Array]:
            flat, offsets = cache.ids(texts)
            every = flat.tolist()
            bounds = offsets.tolist()
            back = [decoder.text(every[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            return [list_array(flat, np.asarray(offsets)), pa.array(back, pa.string())]

        return work

    keep = docs.columns if keep is None else keep
    rows, out = map_texts(docs, text, FIELDS, make, keep)
    mine = {f.name.lower() for f in FIELDS}
    return rows.select(*[f"`{c}`" for c in keep if c.lower() not in mine], f"{out}.ids", f"{out}.decoded")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: number of ids, and SHA-256 of the ids and of the decoded text."""
    rows = encode_decode(docs, model, keep=["doc_id"])
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
