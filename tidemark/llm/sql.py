"""DuckDB SQL of those queries that SQL expresses on whole tables. The others are tested against brute force in tests/llm.

DuckDB has no tokenizers and no models; joins of sets over all pairs and iterated robust estimates are too slow or too sensitive
to the order of sums there.
"""

from . import licenses

ORACLE: dict[str, str] = {"op9_license_scan": licenses.oracle()}
