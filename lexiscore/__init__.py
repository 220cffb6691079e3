"""Lexicon-based reputation scores for short texts, as Spark jobs."""

from lexiscore.operators.series import long_form, plot_columns, series, series_all_levels
from lexiscore.plans.ingest import prepare_posts
from lexiscore.plans.reputation import reputation_series, score_posts, shared, stem_vocabulary, term_rows
from lexiscore.session import get_session
from lexiscore.sources.readers import read_lexicon, read_posts_csv, read_posts_parquet
from lexiscore.sources.writers import csv_header, csv_rows, write_table

__all__ = [
    "csv_header",
    "csv_rows",
    "get_session",
    "long_form",
    "plot_columns",
    "prepare_posts",
    "read_lexicon",
    "read_posts_csv",
    "read_posts_parquet",
    "reputation_series",
    "score_posts",
    "series",
    "series_all_levels",
    "shared",
    "stem_vocabulary",
    "term_rows",
    "write_table",
]
