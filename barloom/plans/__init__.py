"""Named queries over the operators, and the SQL that says what they must return."""

from barloom.plans import checks, decisions, evidence, metrics, research, runner, tables, windows  # noqa: F401  fill the registry
from barloom.plans.base import QUERIES, SQL  # noqa: F401
