"""quarry.plans: fixtures derived from the driver tables and the query registry.

Importing this package registers every query module.
"""

from quarry.plans import queries_clean  # noqa: F401
from quarry.plans import queries_eval  # noqa: F401
from quarry.plans import queries_completions  # noqa: F401
from quarry.plans import queries_extract  # noqa: F401
from quarry.plans import queries_sources  # noqa: F401
from quarry.plans import queries_corpus  # noqa: F401
from quarry.plans import queries_conversations  # noqa: F401
