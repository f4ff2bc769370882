"""Places for callers' own models: embeddings and extracted facts, by callables over Arrow batches.

A callable is shipped to the executors and gets a batch's texts as a list; no service is assumed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import KEYS, extract

Encode = Callable[[list[str]], "list[list[float]]"]
Triples = Callable[[list[str]], "list[list[tuple[str, str, str]]]"]


def embed(docs: DataFrame, encode: Encode, id_: str = "msg_id", size: int | None = None) -> DataFrame:
    """(id, embedding) of each row's text (null: empty); ``size`` is the number of dimensions that is insisted on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = encode([x or "" for x in batch.column(1).to_pylist()])
            if len(vectors) != batch.num_rows or any(size is not None and len(v) != size for v in vectors):
                raise ValueError("the encoder's answer doesn't fit its batch")
            cells = pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), cells], [id_, "embedding"])

    return docs.select(id_, "text").mapInArrow(run, f"{id_} {dict(docs.dtypes)[id_]}, embedding array<float>")


def enrich(docs: DataFrame, triples: Triples, subject: str = "subject") -> DataFrame:
    """(msg_id, subject, relation, object): what the patterns find and what the callable adds, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = triples([x or "" for x in batch.column(1).to_pylist()])
            if len(found) != batch.num_rows:
                raise ValueError("the extractor's answer doesn't fit its batch")
            rows = [(i, *t) for i, ts in zip(batch.column(0).to_pylist(), found, strict=True) for t in ts]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(0).type, *[pa.string()] * 3], strict=True)], ["msg_id", *KEYS])

    more = docs.select("msg_id", "text").mapInArrow(run, f"msg_id {dict(docs.dtypes)['msg_id']}, subject string, relation string, object string")
    whole = more.where(F.col("subject").isNotNull() & F.col("relation").isNotNull() & F.col("object").isNotNull())
    return extract(docs, subject).unionAll(whole).distinct()
