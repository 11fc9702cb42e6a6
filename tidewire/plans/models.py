"""Models and reviewers as replaceable parts: each is made once per task and fed whole Arrow batches.

A model is given as a factory, so that what it loads stays out of the plan.
Where the factory fails, the stub given as ``fallback`` takes its place for
that task, and the version column says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewire.functions.fuzzy import token_set_ratio


class Model(Protocol):
    """Anything that turns texts into one value each."""

    version: str

    def predict(self, texts: Sequence[str]) -> Sequence: ...


class ZeroShot(Model, Protocol):
    """Label scores: predict returns a map of label to score for each text."""


class SentimentClassifier(Model, Protocol):
    """predict returns (label, score) for each text."""


class Embedder(Model, Protocol):
    """predict returns a list of floats of one length for each text."""


class Reranker(Protocol):
    version: str

    def rank(self, query: str, candidates: Sequence[str]) -> list[tuple[str, float]]: ...


class Reviewer(Protocol):
    """A second opinion on a record: a map of fields, and what it cost."""

    reviewer_id: str
    version: str

    def review(self, record: dict) -> dict: ...


class TokenSetReranker:
    """Candidates by token set ratio with the query, best first; equal ones keep their order."""

    version = "token-set/1"

    def rank(self, query: str, candidates: Sequence[str]) -> list[tuple[str, float]]:
        low = (query or "").lower()
        scored = [(c, token_set_ratio(low, c.lower()) / 100.0) for c in candidates]
        return sorted(scored, key=lambda x: -x[1])


def _made(factory: Callable, fallback: Callable | None):
    try:
        return factory()
    except Exception:
        if fallback is None:
            raise
        return fallback()


def with_model(records: DataFrame, factory: Callable[[], Model], column: str, out: str, kind: T.DataType, fallback: Callable[[], Model] | None = None) -> DataFrame:
    """Add ``out`` (of type ``kind``) and ``out``_version: the model's value for the text in ``column``; null texts count as empty."""
    names = records.columns
    where = names.index(column)
    schema = T.StructType([*records.schema.fields, T.StructField(out, kind), T.StructField(f"{out}_version", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        model, arrow = _made(factory, fallback), to_arrow_type(kind)
        for batch in batches:
            values = list(model.predict([t or "" for t in batch.column(where).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow), pa.array([model.version] * batch.num_rows, pa.string())], names=[*names, out, f"{out}_version"])

    return records.mapInArrow(run, schema)


def reranked(records: DataFrame, query: str = "title", candidates: str = "candidate_symbols", factory: Callable[[], Reranker] = TokenSetReranker) -> DataFrame:
    """``records`` with the list ``candidates`` in the reranker's order; lists of one or none stay."""
    names = records.columns
    text, listed = names.index(query), names.index(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            lists = [
                own if own is None or len(own) < 2 else [c for c, _ in model.rank(q or "", own)]
                for q, own in zip(batch.column(text).to_pylist(), batch.column(listed).to_pylist(), strict=True)
            ]
            columns = list(batch.columns)
            columns[listed] = pa.array(lists, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return records.mapInArrow(run, records.schema)


REVIEW = "capture_id string, reviewer_id string, reviewer_version string, payload map<string,string>, error_code string"


class EchoReviewer:
    """The stub: it repeats the record's own verdict."""

    reviewer_id, version = "echo", "echo/1"

    def review(self, record: dict) -> dict:
        return {k: str(record[k]) for k in ("is_finance_relevant", "finance_relevance_score", "sentiment_label") if record.get(k) is not None}


def reviews(records: DataFrame, factory: Callable[[], Reviewer] = EchoReviewer, fallback: Callable[[], Reviewer] | None = None) -> DataFrame:
    """One review of each record; a record that the reviewer fails on has the error's name and no payload, and the others go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reviewer = _made(factory, fallback)
        for batch in batches:
            ids, payloads, errors = [], [], []
            for record in batch.to_pylist():
                ids.append(record["capture_id"])
                try:
                    payloads.append(list(reviewer.review(record).items()))
                    errors.append(None)
                except Exception as error:
                    payloads.append(None)
                    errors.append(type(error).__name__)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array([reviewer.reviewer_id] * n, pa.string()), pa.array([reviewer.version] * n, pa.string()), pa.array(payloads, pa.map_(pa.string(), pa.string())), pa.array(errors, pa.string())],
                names=["capture_id", "reviewer_id", "reviewer_version", "payload", "error_code"],
            )

    return records.mapInArrow(run, REVIEW)
