"""Every operator bound to the test tables, with the SQL that states the expected result."""

from tallyforge.plans.catalog.base import ORACLES, QUERIES  # noqa: F401
from tallyforge.plans.catalog import (  # noqa: F401  (importing registers the queries)
    sources, profiling, detection, entities, preparation,
    evaluation, business, neighbours, models, flows,
)
