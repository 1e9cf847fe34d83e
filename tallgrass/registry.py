"""All queries by id and the SQL that gives the same rows."""

from __future__ import annotations

from .functions import inverted_index, matching, periods, text, units, vector_index  # noqa: F401
from .operators import assurance, bills, disclosure, emissions, extraction, extractors, formulas, hierarchy, layout, suppliers, tables  # noqa: F401
from .plans.catalog import ORACLES, QUERIES  # noqa: F401
from .sources import files  # noqa: F401
from .streaming import streams  # noqa: F401
