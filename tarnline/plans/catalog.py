"""All registered core queries and their oracle SQL."""

from . import answers, chunks, corpus, evaluation, namespaces, retrieval  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
