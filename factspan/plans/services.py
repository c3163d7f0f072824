"""Registration graphs and application-domain maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import domains, filters, injection
from ..operators.core import LOC, bounded_section
from ..session import cut_lineage


def di_graph(invocations: DataFrame, ctor_params: DataFrame, limit: int = 200, include_risks: bool = True) -> dict[str, DataFrame]:
    """Registrations, constructor dependencies and risks, each bounded."""
    registrations = cut_lineage(injection.di_registrations(invocations))
    dependencies = cut_lineage(injection.di_dependencies(registrations, ctor_params))
    result = {
        "registrations": bounded_section(registrations, [*injection.REGISTRATION_ORDER, "registration_kind"], limit),
        "dependencies": bounded_section(dependencies, injection.DEPENDENCY_ORDER, limit),
    }
    if include_risks:
        result["risks"] = bounded_section(injection.di_risks(registrations, dependencies), injection.RISK_ORDER, limit)
    return result


ROUTE_ORDER = ["normalized_pattern", "http_methods", "project", *LOC, "handler_id"]
FACT_ORDER = ["option_type", "detail", "config_key", "consumer", "project", *LOC]


def route_map(
    types: DataFrame, methods: DataFrame, invocations: DataFrame, type_edges: DataFrame, fragments=(), kinds=(), auth=None, limit: int = 200
) -> DataFrame:
    found = domains.routes(types, methods, invocations, type_edges)
    return bounded_section(filters.filter_routes(found, fragments, kinds, auth), ROUTE_ORDER, limit)


def route_impact(routes: DataFrame, handlers: DataFrame) -> DataFrame:
    """Routes handled by the asked symbols. ``handlers(target_id, handler_id)``."""
    return handlers.select("target_id", "handler_id").join(routes, "handler_id")


def options_graph(invocations: DataFrame, ctor_params: DataFrame, query: str | None = None, limit: int = 200) -> DataFrame:
    """Option types, bindings, validations and consumers, bounded per section; with a query this is the impact of a setting."""
    facts = domains.filter_options(domains.options_facts(invocations, ctor_params), query)
    return bounded_section(facts, FACT_ORDER, limit, ["section"])


def ef_model(
    types: DataFrame, type_edges: DataFrame, properties: DataFrame, type_interfaces: DataFrame, invocations: DataFrame,
    entity: str | None = None, context: str | None = None, limit: int = 200,
) -> DataFrame:
    """Contexts, sets, entities, configurations and query sites, bounded per section.

    An entity query applies to all but contexts; a context query to contexts and to the sets of matching contexts.
    """
    facts = domains.ef_facts(types, type_edges, properties, type_interfaces, invocations)
    if entity and entity.strip():
        facts = facts.filter((F.col("section") == "context") | filters.symbol_text_matches(entity, ["entity"]))
    if context and context.strip():
        own = filters.symbol_text_matches(context, ["name"])
        owner = filters.symbol_text_matches(context, ["owner"])
        facts = facts.filter(
            F.when(F.col("section") == "context", own).when(F.col("section") == "set", owner).otherwise(F.lit(True))
        )
    return bounded_section(facts, ["name", "entity", "owner", "project", *LOC], limit, ["section"])
