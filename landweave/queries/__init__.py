"""Registered queries and their SQL."""

from landweave.queries import aggregates, composites, filters, further, general, joins, scalars

QUERIES = {**general.QUERIES, **aggregates.reg.queries, **filters.reg.queries, **scalars.reg.queries, **joins.reg.queries, **composites.reg.queries, **further.reg.queries}
ORACLES = {**general.ORACLES, **aggregates.reg.sql, **filters.reg.sql, **scalars.reg.sql, **joins.reg.sql, **composites.reg.sql, **further.reg.sql}
