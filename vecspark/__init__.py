"""Documents, embeddings and large-scale text preparation on Spark."""

from vecspark.engine import Engine
from vecspark.models import Document, Manifest, Point, SearchRequest, SearchResult
from vecspark.schema import DOCUMENTS, MANIFEST, POINTS

__version__ = "1.0.0"
__all__ = ["DOCUMENTS", "MANIFEST", "POINTS", "Document", "Engine", "Manifest", "Point", "SearchRequest", "SearchResult"]
