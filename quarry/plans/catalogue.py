"""All queries outside the llm subpackage."""

from quarry.plans import diffs, forms, joins, matching, papers, people, phrases, records, reports, sequences, sheets, staff, texts  # noqa: F401
from quarry.plans.registry import ORACLES, QUERIES  # noqa: F401
