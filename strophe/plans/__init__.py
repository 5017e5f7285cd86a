"""All registered queries, by the area they are from."""

from . import arrange_queries, building_queries, match_queries, melody_queries, mix_queries, run_queries, select_queries, series_queries, signal_queries, song_queries, take_queries, text_queries, theory_queries, timeline_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
