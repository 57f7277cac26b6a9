"""Registered queries: importing this package fills the registry."""
from veilframe.plans import registry  # noqa: F401
from veilframe.plans import text_queries, page_queries, box_queries, media_queries, report_queries  # noqa: F401, E401
