"""Dependency-injection facts: registrations, constructor dependencies, risks, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import lifetime_of
from ..functions.ranks import CONFIDENCE, LIFETIME, SEVERITY, ordered_reasons, rank_of, reasons
from .core import LOC, dedupe_first, join_null_safe, top_per_group

# Prefixes of service types a framework provides.
FRAMEWORK_SERVICES = [
    "Microsoft.Extensions.",
    "Microsoft.AspNetCore.",
    "System.IServiceProvider",
    "System.Func<",
    "System.Collections.Generic.IEnumerable<",
]
OPTION_CALLS = ["Configure", "AddOptions"]
REGISTRATION_ORDER = ["project", "path", "line", "column", "lifetime_rank", "service_type", "implementation_type"]
RISK_ORDER = ["severity_rank", "confidence_rank", "risk_kind", "service_type", "implementation_type", "dependency_type"]
DEPENDENCY_ORDER = ["implementation_type", "parameter_ordinal", "dependency_type", "parameter_name"]


def _first(a: str, n: int) -> Column:
    return F.get(F.col(a), n)


def di_registrations(invocations: DataFrame, include_options: bool = True, include_hosted: bool = True) -> DataFrame:
    """Registration calls: kind, lifetime, service and implementation, factory and instance marks, reasons.

    ``invocations(project, method_name, type_args, typeof_args, descriptor_name, has_factory, instance_type, LOC)``;
    ``descriptor_name`` is the inner call of ``Add(ServiceDescriptor...)``.
    """
    descriptor = (F.col("method_name") == "Add") & F.col("descriptor_name").isNotNull()
    call = F.when(descriptor, F.col("descriptor_name")).otherwise(F.col("method_name"))
    hosted = ~descriptor & (F.col("method_name") == "AddHostedService")
    options = ~descriptor & F.col("method_name").isin(OPTION_CALLS)
    named = invocations.withColumn("__call", call).withColumn("__lifetime", lifetime_of("__call"))
    wanted = F.col("__lifetime") != "unknown"
    if include_hosted:
        wanted = wanted | hosted
    if include_options:
        wanted = wanted | options
    # A hosted or options call is recognised by its name alone, whatever lifetime word it has.
    if not include_hosted:
        wanted = wanted & ~hosted
    if not include_options:
        wanted = wanted & ~options
    first_arg, second_arg = _first("type_args", 0), _first("type_args", 1)
    service = F.coalesce(first_arg, F.when(~hosted & ~options, _first("typeof_args", 0)))
    second = F.coalesce(second_arg, _first("typeof_args", 1))
    one_generic = (F.size("type_args") == 1) & F.col("service_type").isNotNull()
    implementation = F.when(hosted, first_arg).when(
        ~options, F.coalesce(second, F.when(one_generic, F.col("service_type")))
    )
    plain = ~hosted & ~options & ~descriptor
    has_instance = plain & F.col("implementation_type").isNull() & F.col("instance_type").isNotNull()
    codes = reasons(
        (F.lit(True), "iservicecollection-registration-call"),
        (hosted, "hosted-service-registration"),
        (options, "options-registration"),
        (descriptor, "servicedescriptor-call"),
        (~hosted & ~options, F.concat(F.lower("__call"), F.lit("-call"))),
        (plain & F.col("method_name").startswith("TryAdd"), "tryadd-call"),
        (plain & F.coalesce("has_factory", F.lit(False)), "factory-registration"),
        (has_instance, "instance-registration"),
    )
    rows = (
        named.filter(wanted)
        .withColumn("service_type", service)
        .withColumn("implementation_type", implementation)
        .filter(F.col("service_type").isNotNull() | F.col("implementation_type").isNotNull())
        .withColumn("registration_kind", F.when(hosted, "hostedService").when(options, "options").otherwise("service"))
        .withColumn("lifetime", F.when(hosted, "singleton").when(options, "unknown").otherwise(F.col("__lifetime")))
        .withColumn("reason_codes", ordered_reasons(codes))
        .withColumn("instance_type", F.when(has_instance, F.col("instance_type")))
        .withColumn("is_factory", plain & F.coalesce("has_factory", F.lit(False)))
    )
    columns = [
        "registration_kind", "lifetime", "service_type", "implementation_type", "instance_type", "is_factory",
        "reason_codes", "project", *LOC,
    ]
    key = ["project", "path", "line", "column", "lifetime", "service_type", "implementation_type", "registration_kind"]
    rows = dedupe_first(rows.select(*columns), key, ["end_line", "end_column", "instance_type"])
    return rows.withColumn("lifetime_rank", rank_of("lifetime", LIFETIME))


def select_constructor(ctor_params: DataFrame) -> DataFrame:
    """One constructor per type with its parameters: the marked one, else the only public one, else the public one with
    most parameters and earliest, else the only one.

    ``ctor_params(type_id, ctor_ordinal, ctor_access, ctor_line, is_marked, name?, type_fqn?, ordinal?, ...)``; a
    constructor without parameters is one row without a name. Constructors are counted from their distinct headers.
    """
    header = ctor_params.groupBy("type_id", "ctor_ordinal").agg(
        F.count("name").alias("param_count"),
        F.min("ctor_line").alias("ctor_line"),
        F.bool_or(F.coalesce("is_marked", F.lit(False))).alias("is_marked"),
        F.bool_or(F.col("ctor_access") == "Public").alias("is_public"),
    )
    counts = header.groupBy("type_id").agg(
        F.count("*").alias("ctor_count"), F.count_if("is_public").alias("public_count")
    )
    rank = F.when(F.col("is_marked"), 0).when(F.col("is_public"), 1).otherwise(2)
    # Several marked constructors: the earliest; several public ones: the widest, then the earliest.
    width = F.when(F.col("is_marked"), 0).otherwise(-F.col("param_count"))
    ranked = header.withColumn("__rank", rank).withColumn("__width", width)
    best = top_per_group(ranked, ["type_id"], ["__rank", "__width", "ctor_line", "ctor_ordinal"], 1)
    chosen = best.join(counts, "type_id").filter((F.col("__rank") < 2) | (F.col("ctor_count") == 1))
    chosen = chosen.select("type_id", "ctor_ordinal", "param_count", "public_count")
    return ctor_params.join(chosen, ["type_id", "ctor_ordinal"])


def di_dependencies(registrations: DataFrame, ctor_params: DataFrame) -> DataFrame:
    """Edge from each registered implementation to each parameter type of its selected constructor."""
    registered = registrations.filter(F.col("implementation_type").isNotNull()).select("implementation_type").distinct()
    params = select_constructor(ctor_params).filter(F.col("name").isNotNull())
    joined = registered.join(params.withColumnRenamed("type_id", "implementation_type"), "implementation_type")
    bare = F.regexp_replace("type_fqn", "<.*$", "")
    short = F.element_at(F.split(bare, r"\."), -1)
    codes = reasons((F.lit(True), "constructor-parameter"), (F.col("public_count") > 1, "constructor-selection-heuristic"))
    rows = joined.select(
        "implementation_type", F.col("type_fqn").alias("dependency_type"), F.col("name").alias("parameter_name"),
        F.col("ordinal").alias("parameter_ordinal"), F.coalesce("optional", F.lit(False)).alias("is_optional"),
        (short == "IEnumerable").alias("is_enumerable"), short.isin("Func", "Lazy", "IServiceProvider").alias("is_factory_like"),
        codes.alias("reason_codes"),
    )
    key = ["implementation_type", "dependency_type", "parameter_name", "parameter_ordinal"]
    return dedupe_first(rows, key, ["is_optional"])


def di_risks(registrations: DataFrame, dependencies: DataFrame) -> DataFrame:
    """multiple-registrations, captive-dependency and unresolved-service-candidate.

    The first registration of a service or implementation is the first by (path, line, column).
    """
    at = F.struct("path", "line", "column", "lifetime_rank", "lifetime", "service_type", "implementation_type")
    none = F.lit(None).cast("string")
    by_service = (
        registrations.filter(F.col("service_type").isNotNull())
        .groupBy("service_type")
        .agg(F.count("*").alias("n"), F.min(at).alias("first"))
    )
    by_implementation = (
        registrations.filter(F.col("implementation_type").isNotNull())
        .groupBy("implementation_type")
        .agg(F.min(at).alias("own"))
    )

    def risk(df: DataFrame, kind: str, severity: str, confidence: str, service, implementation, dependency) -> DataFrame:
        return df.select(
            F.lit(kind).alias("risk_kind"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"),
            service.alias("service_type"), implementation.alias("implementation_type"), dependency.alias("dependency_type"),
        )

    several = risk(
        by_service.filter(F.col("n") > 1), "multiple-registrations", "info", "high", F.col("service_type"), none, none
    )
    edges = dependencies.select("implementation_type", "dependency_type", "parameter_name", "parameter_ordinal")
    scoped = by_service.filter(F.col("first.lifetime") == "scoped").select(F.col("service_type").alias("dependency_type"))
    single = by_implementation.filter(F.col("own.lifetime") == "singleton")
    captive = edges.join(single, "implementation_type").join(scoped, "dependency_type", "left_semi")
    captive = risk(
        captive, "captive-dependency", "warning", "medium",
        F.col("own.service_type"), F.col("implementation_type"), F.col("dependency_type"),
    )
    known = (
        registrations.select(F.explode(F.array("service_type", "implementation_type")).alias("dependency_type"))
        .filter(F.col("dependency_type").isNotNull())
        .distinct()
    )
    framework = F.lit(False)
    for prefix in FRAMEWORK_SERVICES:
        framework = framework | F.col("dependency_type").startswith(prefix)
    open_edges = edges.filter(~framework).join(known, "dependency_type", "left_anti")
    unresolved = risk(
        open_edges, "unresolved-service-candidate", "warning", "medium", none, F.col("implementation_type"), F.col("dependency_type")
    )
    risks = several.unionByName(captive).unionByName(unresolved)
    return risks.withColumn("severity_rank", rank_of("severity", SEVERITY)).withColumn(
        "confidence_rank", rank_of("confidence", CONFIDENCE)
    )


def where_registered(types: DataFrame, registrations: DataFrame) -> DataFrame:
    """Registrations whose service, implementation or instance is the asked type; one row per registration and type.

    ``types(target_id, type_name)``.
    """
    keys = F.array_distinct(F.array_compact(F.array("service_type", "implementation_type", "instance_type")))
    return registrations.withColumn("type_name", F.explode(keys)).join(types, "type_name")


def registered_dependencies(types: DataFrame, registrations: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Constructor dependencies of the implementations registered for the asked types."""
    hits = where_registered(types, registrations).select("target_id", "implementation_type").distinct()
    return hits.join(dependencies, "implementation_type")


def di_impact(types: DataFrame, registrations: DataFrame, dependencies: DataFrame, risks: DataFrame) -> DataFrame:
    """Registrations, own dependencies, consumers and risks of each asked type as (target, section, name, other) rows."""
    none = F.lit(None).cast("string")
    asked = types.select("target_id", "type_name")
    found = where_registered(types, registrations).select(
        "target_id", F.lit("registration").alias("section"), F.col("service_type").alias("name"),
        F.col("implementation_type").alias("other"), "path", "line",
    )
    own = asked.join(dependencies.withColumnRenamed("implementation_type", "type_name"), "type_name").select(
        "target_id", F.lit("dependency").alias("section"), F.col("dependency_type").alias("name"),
        F.col("parameter_name").alias("other"), none.alias("path"), F.col("parameter_ordinal").alias("line"),
    )
    consumers = (
        asked.join(dependencies.withColumnRenamed("dependency_type", "type_name"), "type_name")
        .select("target_id", "implementation_type")
        .distinct()
        .select(
            "target_id", F.lit("consumer").alias("section"), F.col("implementation_type").alias("name"),
            none.alias("other"), none.alias("path"), F.lit(None).cast("int").alias("line"),
        )
    )
    named = F.array_distinct(F.array_compact(F.array("service_type", "implementation_type", "dependency_type")))
    risky = (
        risks.withColumn("type_name", F.explode(named))
        .join(asked, "type_name")
        .select(
            "target_id", F.lit("risk").alias("section"), F.col("risk_kind").alias("name"),
            F.coalesce("dependency_type", "service_type").alias("other"),
            F.col("implementation_type").alias("path"), F.lit(None).cast("int").alias("line"),
        )
    )
    return found.unionByName(own).unionByName(consumers).unionByName(risky)
