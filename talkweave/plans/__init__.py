"""Named queries over the tables; importing this package fills the registry."""

from talkweave.plans import (
    audit_queries, catalogue_queries, faq_queries, graph_queries, message_queries, page_queries, similar_queries, text_queries, turn_queries,
)
from talkweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
