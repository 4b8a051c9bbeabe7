"""Verse queries and their SQL, by name."""

from . import phon_queries, rhyme_queries, sound_queries, statistics_queries, verse_queries  # noqa: F401  all register

QUERIES: dict = verse_queries.QUERIES
ORACLES: dict = verse_queries.ORACLES
