"""A PySpark-native engine for chunking, embedding with fallback, and alignment of embedding spaces."""

from vectorloom.operators.alignment import AlignmentEngine, Diagnostics, Transform
from vectorloom.operators.chunking import Chunker, CustomChunker, FixedChunker, RecursiveChunker, SemanticChunker, get_chunker
from vectorloom.operators.ingest import Ingested, Pipeline, ResumeValidationError, Router
from vectorloom.operators.providers import (
    CohereProvider,
    EmbeddingProvider,
    GoogleProvider,
    HuggingFaceProvider,
    NoProviderAvailableError,
    ProviderError,
    RateLimitExceeded,
    VoyageProvider,
)

__all__ = [
    "AlignmentEngine", "Chunker", "CohereProvider", "CustomChunker", "Diagnostics", "EmbeddingProvider", "FixedChunker", "GoogleProvider",
    "HuggingFaceProvider", "Ingested", "NoProviderAvailableError", "Pipeline", "ProviderError", "RateLimitExceeded", "RecursiveChunker",
    "ResumeValidationError", "Router", "SemanticChunker", "Transform", "VoyageProvider", "get_chunker",
]
