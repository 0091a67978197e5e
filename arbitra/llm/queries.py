"""Importing this module registers every query of the subpackage."""

from arbitra.llm import (  # noqa: F401
    centroid_query, chat_query, contamination_query, license_query, mixing_query, packing_query, quality_query, repair_query, simhash_query, substring_query, token_query,
    toxicity_query, url_query,
)
from arbitra.llm.registry import ORACLE, QUERIES  # noqa: F401
