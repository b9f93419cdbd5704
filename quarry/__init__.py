"""quarry: Spark-native operators for building source-code corpora and
evaluating code-generating models.

Layout
------
functions/  column expressions (text rules, code repair, statistics)
sources/    readers and writers (JSON Lines, gzip JSON, file trees, CSV)
operators/  DataFrame -> DataFrame operators (extraction, cleaning,
            corpus preparation, completions, conversations, evaluation)
plans/      fixtures derived from the driver tables and the query registry
streaming/  Structured Streaming operators
"""

from quarry.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
