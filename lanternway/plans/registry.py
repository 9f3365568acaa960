"""All queries of the core and their SQL twins."""

from __future__ import annotations

from lanternway.plans import general, general_sql, network, network_sql, routing, routing_sql, service, service_sql

FLAGSHIP = "p1_found"
QUERIES = {**general.QUERIES, **network.QUERIES, **routing.QUERIES, **service.QUERIES}
ORACLES = {**general_sql.ORACLES, **network_sql.ORACLES, **routing_sql.ORACLES, **service_sql.ORACLES}
