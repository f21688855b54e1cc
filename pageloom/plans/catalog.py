"""All core queries: importing this module registers them."""

from pageloom.plans import html_queries, link_queries, merge_queries, more_queries, report_queries, source_queries, text_queries, url_queries  # noqa: F401
from pageloom.plans.registry import ORACLES, QUERIES  # noqa: F401
