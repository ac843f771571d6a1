"""Records at the edge of the public API."""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from enum import StrEnum
from typing import Any

from pyspark.sql import Row

from vecspark.errors import BadRequestError
from vecspark.functions import vectors
from vecspark.functions.ids import new_id


def content_md5(text: str) -> str:
    return hashlib.md5(text.strip().encode()).hexdigest()


def ensure_dict(value: Any) -> dict[str, Any]:
    """A dict of nothing, JSON text or anything that can become JSON."""
    if not value:
        return {}
    return json.loads(value) if isinstance(value, str) else json.loads(json.dumps(value, default=str))


def stored_dict(value: Any) -> dict[str, Any]:
    """``ensure_dict`` of a stored row's metadata; empty for broken JSON and
    for what is no object, like ``text.json_object``."""
    try:
        found = ensure_dict(value)
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def _known(cls: type, values: Mapping[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in values.items() if k in cls.__dataclass_fields__}  # extras are ignored


def _stored(row: Row) -> dict[str, Any]:
    values = row.asDict()
    return values | {"metadata": stored_dict(values.get("metadata"))}


def _now() -> int:
    return int(time.time())


@dataclass
class Document:
    """A text or a chunk of one.  The hash always follows the content."""

    content: str
    name: str = ""
    document_id: str = field(default_factory=lambda: new_id("document"))
    content_md5: str = ""
    source_id: str = ""
    chunk_index: int = 0
    is_chunk: bool = False
    total_tokens: int = 0
    metadata: dict[str, Any] = field(default_factory=dict)
    created_at: int = field(default_factory=_now)
    updated_at: int = field(default_factory=_now)

    def __post_init__(self) -> None:
        self.metadata = ensure_dict(self.metadata)
        self.sanitize()

    def sanitize(self, refresh: bool = False, count_tokens: Any = None) -> Document:
        if not self.content or not self.content.strip():
            raise ValueError("a document's content must not be blank")
        self.content_md5 = content_md5(self.content)
        self.name = (self.name or "").strip() or self.content.strip().split("\n\n")[0][:36]
        if refresh:
            self.updated_at = _now()
        if count_tokens is not None:
            self.total_tokens = count_tokens(self.content)
        return self

    @classmethod
    def from_content(cls, content: str, *, name: str | None = None, metadata: Any = None) -> Document:
        return cls(content=content, name=name or "", metadata=metadata)

    @classmethod
    def from_contents(cls, contents: Document | str | Iterable[Document | str]) -> list[Document]:
        """Documents of one or many texts or documents."""
        items = [contents] if isinstance(contents, (str, Document)) else list(contents)
        out = []
        for i, item in enumerate(items):
            if isinstance(item, Document):
                out.append(item.sanitize())
            elif not isinstance(item, str):
                raise TypeError(f"contents[{i}] is neither a text nor a document")
            elif not item.strip():
                raise ValueError(f"contents[{i}] is blank")
            else:
                out.append(cls(content=item, name=item.split("\n")[0][:28].strip(), metadata={"content_length": len(item)}))
        return out

    @classmethod
    def of(cls, value: Document | Mapping[str, Any] | Row) -> Document:
        if isinstance(value, cls):
            return value.sanitize()
        return cls(**_known(cls, _stored(value) if isinstance(value, Row) else value))

    @staticmethod
    def hash_content(text: str) -> str:
        return content_md5(text)

    def to_point(self, *, metadata: Any = None, embedding: Sequence[float] | None = None) -> Point:
        return Point(document_id=self.document_id, content_md5=content_md5(self.content), embedding=embedding,
                     metadata=ensure_dict(metadata))

    def row(self) -> dict[str, Any]:
        return asdict(self) | {"metadata": json.dumps(self.metadata)}


@dataclass
class Point:
    """A vector of a document.  ``embedding`` is held as float32 in base64."""

    document_id: str
    content_md5: str
    point_id: str = field(default_factory=lambda: new_id("point"))
    embedding: str | Sequence[float] | None = None
    metadata: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.metadata = ensure_dict(self.metadata)
        if self.embedding is not None and not isinstance(self.embedding, str):
            values = list(self.embedding)
            self.embedding = vectors.encode_base64(values) if values else None

    @property
    def is_embedded(self) -> bool:
        return self.embedding is not None

    def to_python(self) -> list[float]:
        if self.embedding is None:
            raise ValueError("the point has no embedding")
        return vectors.decode_base64(self.embedding)

    @staticmethod
    def set_embeddings(points: Sequence[Point], contents: Sequence[str], model: Any) -> Sequence[Point]:
        if len(points) != len(contents):
            raise ValueError("as many contents as points are needed")
        if points:
            for p, v in zip(points, model.embed(list(contents))):
                p.embedding = vectors.encode_base64(v)
        return points

    @classmethod
    def of(cls, value: Point | Mapping[str, Any] | Row) -> Point:
        if isinstance(value, cls):
            return value
        return cls(**_known(cls, _stored(value) if isinstance(value, Row) else value))

    def row(self) -> dict[str, Any]:
        return {
            "point_id": self.point_id, "document_id": self.document_id, "content_md5": self.content_md5,
            "embedding": None if self.embedding is None else self.to_python(), "metadata": json.dumps(self.metadata),
        }


@dataclass
class Manifest:
    embedding_model: str
    embedding_dimensions: int
    name: str = "default"
    description: str = ""
    version: str = "1.0.0"
    manifest_table_name: str = "manifest"
    points_table_name: str = "points"
    documents_table_name: str = "documents"


class Encoding(StrEnum):
    PLAINTEXT = "plaintext"
    BASE64 = "base64"
    VECTOR = "vector"


@dataclass
class SearchRequest:
    query: str | Sequence[float]
    top_k: int = 5
    with_embedding: bool = False
    encoding: Encoding | str | None = None

    def __post_init__(self) -> None:
        if self.encoding is not None:
            self.encoding = Encoding(self.encoding)

    @staticmethod
    def to_vectors(requests: SearchRequest | Sequence[SearchRequest], model: Any) -> list[list[float]]:
        """A vector of the model's dimensions per request; texts are embedded
        in one call.  A text without a hint counts as base64 only if it decodes
        to just as many bytes as a vector has."""
        requests = [requests] if isinstance(requests, SearchRequest) else list(requests)
        out: list[list[float] | None] = [None] * len(requests)
        texts: dict[int, str] = {}
        for i, r in enumerate(requests):
            if r.query is None or len(r.query) == 0:
                raise BadRequestError(f"queries[{i}] is empty")
            if not isinstance(r.query, str):
                out[i] = [float(x) for x in r.query]
            elif r.encoding == Encoding.BASE64:
                out[i] = vectors.decode_base64(r.query)
            elif r.encoding == Encoding.VECTOR:
                raise BadRequestError(f"queries[{i}] is text, but its encoding says vector")
            elif r.encoding is None and (found := _as_vector(r.query, model.dimensions)) is not None:
                out[i] = found
            else:
                texts[i] = r.query
        if texts:
            for i, v in zip(texts, model.embed(list(texts.values()))):
                out[i] = [float(x) for x in v]
        for i, v in enumerate(out):
            if len(v) != model.dimensions:
                raise BadRequestError(f"queries[{i}] has {len(v)} dimensions, not {model.dimensions}")
        return out


def _as_vector(text: str, dimensions: int) -> list[float] | None:
    if len(text) <= 12 or len(text) % 4:
        return None
    try:
        values = vectors.decode_base64(text)
    except ValueError:
        return None
    return values if len(values) == dimensions and all(map(math.isfinite, values)) else None


@dataclass
class SearchResult:
    point: Point
    document: Document
    relevance_score: float

    @classmethod
    def from_search_result(cls, value: tuple[Point, Document, float]) -> SearchResult:
        return cls(*value)
