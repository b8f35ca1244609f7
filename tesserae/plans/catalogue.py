"""All named queries of the engine, by topic in the modules imported here."""

from . import corpus_queries, retrieval_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
