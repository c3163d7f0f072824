"""Application facts derived from types, members, attributes and invocations: routes, options, messages, data model,
framework entrypoints, package use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import auth_state, http_methods, short_attribute
from ..functions.paths import combine_routes, normalize_route
from ..functions.ranks import CONFIDENCE, ordered_reasons, rank_of, reasons
from .core import LOC, dedupe_first
from .graph import closure

# Mapping calls and the verb each declares; attributes that carry a route.
MAP_CALLS = {
    "MapGet": "GET", "MapPost": "POST", "MapPut": "PUT", "MapDelete": "DELETE", "MapPatch": "PATCH",
    "MapMethods": None, "MapFallback": "ANY", "Map": "ANY",
}
ROUTE_ATTRIBUTES = ["Route", "HttpGet", "HttpPost", "HttpPut", "HttpDelete", "HttpPatch", "HttpHead", "HttpOptions"]
CONTROLLER_BASES = ["ControllerBase", "Controller"]


def _named(attributes: str, *names: str) -> Column:
    return F.exists(F.col(attributes), lambda a: short_attribute(a["name"]).isin(*names))


def _templates(attributes: str) -> Column:
    marks = F.filter(F.col(attributes), lambda a: short_attribute(a["name"]).isin(*ROUTE_ATTRIBUTES) & a["first_arg"].isNotNull())
    return F.array_sort(F.array_distinct(F.transform(marks, lambda a: a["first_arg"])))


def inheriting(types: DataFrame, type_edges: DataFrame, names: list[str]) -> DataFrame:
    """Types with a base type, at any depth, whose simple name is one of ``names``. ``type_edges`` has parent_name."""
    base = type_edges.filter(F.col("edge_kind") == "base")
    roots = base.filter(F.col("parent_name").isin(names)).select(F.col("parent_id").alias("node")).distinct()
    below = closure(base, roots.select(F.col("node").alias("target_id"), "node"), "parent_id", "child_id")
    return types.join(below.select(F.col("node").alias("type_id")).distinct(), "type_id", "left_semi")


def _controllers(types: DataFrame, type_edges: DataFrame) -> DataFrame:
    inherited = inheriting(types, type_edges, CONTROLLER_BASES).select("type_id").withColumn("__inherits", F.lit(True))
    marked = types.join(inherited, "type_id", "left")
    is_controller = F.col("type_name").endswith("Controller") | _named("type_attributes", "ApiController") | F.coalesce(
        "__inherits", F.lit(False)
    )
    return marked.withColumn("is_controller", is_controller).drop("__inherits")


def _actions(types: DataFrame, methods: DataFrame, type_edges: DataFrame) -> DataFrame:
    """Public instance methods of classes, not marked as no action, with their type's facts."""
    owners = _controllers(types, type_edges).select("type_id", "type_name", "type_attributes", "is_controller")
    joined = methods.join(owners, "type_id")
    return joined.filter(
        (F.col("accessibility") == "Public") & ~F.col("is_static") & ~_named("attributes", "NonAction")
    )


def routes(types: DataFrame, methods: DataFrame, invocations: DataFrame, type_edges: DataFrame) -> DataFrame:
    """Controller actions and mapping calls: verbs, pattern, authorisation, confidence, reasons.

    ``types(type_id, type_name, type_attributes)``, ``methods(method_id, type_id, name, accessibility, is_static,
    attributes, project, LOC)``; attributes are structs(name, first_arg, policy, roles, schemes). ``invocations(method_name,
    route_arg, verb_args, handler_id, auth_calls, project, LOC of the handler)``.
    """
    actions = _actions(types, methods, type_edges).filter("is_controller")
    verbs = http_methods(F.transform("attributes", lambda a: a["name"]))
    any_verb = F.array(F.lit("ANY"))
    actions = (
        actions.withColumn("__verbs", verbs)
        .withColumn("__type_route", F.get(_templates("type_attributes"), 0))
        .withColumn("__route", F.get(_templates("attributes"), 0))
        .withColumn("auth", auth_state(F.concat("attributes", "type_attributes")))
    )
    evident = (F.size("__verbs") > 0) | F.col("__route").isNotNull() | F.col("__type_route").isNotNull()
    actions = actions.filter(evident | F.col("type_name").endswith("Controller"))
    pattern = combine_routes("__type_route", "__route")
    sure = (F.size("__verbs") > 0) | F.col("__route").isNotNull()
    codes = reasons(
        (F.lit(True), "aspnetcore-controller-type"), (F.lit(True), "controller-action"),
        (F.size("__verbs") > 0, "http-method-attribute"),
    )
    from_types = actions.select(
        F.lit("controller-action").alias("endpoint_kind"),
        F.when(F.size("__verbs") > 0, F.col("__verbs")).otherwise(any_verb).alias("http_methods"),
        pattern.alias("pattern"), normalize_route(pattern).alias("normalized_pattern"),
        F.col("method_id").alias("handler_id"), F.col("auth.kind").alias("auth_kind"), F.col("auth.policies").alias("policies"),
        F.when(sure, "high").otherwise("medium").alias("confidence"), ordered_reasons(codes).alias("reason_codes"),
        "project", *LOC,
    )
    table = F.create_map(*[F.lit(x) for k, v in MAP_CALLS.items() if v for x in (k, v)])
    stated = F.when(F.col("method_name") == "MapMethods", F.col("verb_args")).otherwise(
        F.array(F.try_element_at(table, F.col("method_name")))
    )
    verbs = F.when(F.size(F.coalesce(F.array_compact(stated), F.array().cast("array<string>"))) > 0, F.array_compact(stated)).otherwise(any_verb)
    auth = (
        F.when(F.array_contains("auth_calls", "AllowAnonymous"), "anonymous")
        .when(F.array_contains("auth_calls", "RequireAuthorization"), "required")
        .otherwise("unknown")
    )
    mapped = invocations.filter(F.col("method_name").isin(list(MAP_CALLS)) & F.col("handler_id").isNotNull())
    from_calls = mapped.select(
        F.lit("minimal-api").alias("endpoint_kind"), verbs.alias("http_methods"), F.col("route_arg").alias("pattern"),
        normalize_route("route_arg").alias("normalized_pattern"), "handler_id", F.coalesce(auth, F.lit("unknown")).alias("auth_kind"),
        F.array().cast("array<string>").alias("policies"),
        F.when(F.col("route_arg").isNull(), "medium").otherwise("high").alias("confidence"),
        F.array_sort(F.array(F.lit("minimal-api-map-call"), F.concat(F.lower("method_name"), F.lit("-call")))).alias("reason_codes"),
        "project", *LOC,
    )
    key = ["endpoint_kind", "project", "path", "line", "column", "normalized_pattern", "http_methods"]
    return dedupe_first(from_types.unionByName(from_calls), key, ["handler_id", "confidence"])


OPTION_BINDINGS = {"Configure": "configure", "AddOptions": "add-options", "Bind": "bind"}
OPTION_VALIDATIONS = ["Validate", "ValidateDataAnnotations", "ValidateOnStart"]
OPTION_INTERFACES = ["IOptions", "IOptionsSnapshot", "IOptionsMonitor"]


def options_facts(invocations: DataFrame, ctor_params: DataFrame) -> DataFrame:
    """Option types, bindings with configuration key, validations and constructor consumers in one table by ``section``.

    ``invocations(call_id, parent_call_id, method_name, option_type, first_string, project, LOC)``: a binding's key is its
    own string argument or that of the nested GetSection call. ``ctor_params(type_id, type_fqn, project, LOC)``.
    """
    none = F.lit(None).cast("string")
    calls = invocations.filter(
        F.col("method_name").isin(*OPTION_BINDINGS, *OPTION_VALIDATIONS) & F.col("option_type").isNotNull()
    )
    nested = (
        invocations.filter((F.col("method_name") == "GetSection") & F.col("parent_call_id").isNotNull())
        .groupBy(F.col("parent_call_id").alias("call_id"))
        .agg(F.min(F.struct("line", "column", F.col("first_string").alias("key"))).alias("s"))
        .select("call_id", F.col("s.key").alias("section_key"))
    )
    table = F.create_map(*[F.lit(x) for pair in OPTION_BINDINGS.items() for x in pair])
    bindings = calls.filter(F.col("method_name").isin(list(OPTION_BINDINGS))).join(nested, "call_id", "left").select(
        F.lit("binding").alias("section"), "option_type", F.try_element_at(table, F.col("method_name")).alias("detail"),
        F.coalesce("section_key", "first_string").alias("config_key"), none.alias("consumer"), F.lit("high").alias("confidence"),
        "project", *LOC,
    )
    validations = calls.filter(F.col("method_name").isin(OPTION_VALIDATIONS)).select(
        F.lit("validation").alias("section"), "option_type", F.col("method_name").alias("detail"), none.alias("config_key"),
        none.alias("consumer"), F.lit("medium").alias("confidence"), "project", *LOC,
    )
    shape = r"(?:^|\.)(" + "|".join(OPTION_INTERFACES) + r")<(.*)>$"
    consumers = (
        ctor_params.withColumn("detail", F.regexp_extract("type_fqn", shape, 1))
        .filter(F.col("detail") != "")
        .select(
            F.lit("consumer").alias("section"), F.regexp_extract("type_fqn", shape, 2).alias("option_type"), "detail",
            none.alias("config_key"), F.col("type_id").alias("consumer"), F.lit("high").alias("confidence"), "project", *LOC,
        )
    )
    facts = bindings.unionByName(validations).unionByName(consumers)
    from_calls = calls.select("option_type", "project", *LOC)
    types = from_calls.unionByName(consumers.select("option_type", "project", *LOC)).select(
        F.lit("option").alias("section"), "option_type", none.alias("detail"), none.alias("config_key"),
        none.alias("consumer"), F.lit("high").alias("confidence"), "project", *LOC,
    )
    types = dedupe_first(types, ["option_type"], ["project", *LOC])
    facts = dedupe_first(facts, ["section", "option_type", "detail", "consumer", "path", "line", "column"], ["end_line", "end_column", "config_key"])
    return types.unionByName(facts)


def filter_options(facts: DataFrame, query: str | None) -> DataFrame:
    """Facts whose option type contains the query; bindings also by key, consumers also by consuming type."""
    if not query or not query.strip():
        return facts
    text = query.strip().lower()
    own = F.lower("option_type").contains(text)
    by_key = (F.col("section") == "binding") & F.lower("config_key").contains(text)
    by_consumer = (F.col("section") == "consumer") & F.lower("consumer").contains(text)
    return facts.filter(own | F.coalesce(by_key, F.lit(False)) | F.coalesce(by_consumer, F.lit(False)))


HANDLER_INTERFACES = {"IRequestHandler": "request", "INotificationHandler": "notification"}
SEND_CALLS = {"Send": "send", "Publish": "publish"}
FRAMEWORK_NAMESPACES = ["System.", "Microsoft."]


def message_handlers(type_interfaces: DataFrame) -> DataFrame:
    """Handlers with message and response type. ``type_interfaces(type_id, interface_name, type_args, handle_method_id, project)``."""
    table = F.create_map(*[F.lit(x) for pair in HANDLER_INTERFACES.items() for x in pair])
    rows = type_interfaces.filter(
        F.col("interface_name").isin(list(HANDLER_INTERFACES)) & F.get("type_args", 0).isNotNull()
    ).select(
        F.try_element_at(table, F.col("interface_name")).alias("handler_kind"), F.get("type_args", 0).alias("message_type"),
        F.col("type_id").alias("handler_type"), "handle_method_id", F.get("type_args", 1).alias("response_type"), "project",
    )
    return dedupe_first(rows, ["handler_kind", "message_type", "handler_type"], ["project", "handle_method_id", "response_type"])


def message_sites(invocations: DataFrame) -> DataFrame:
    """Send and publish calls with the first argument type that is not a framework type."""
    own = F.filter("arg_types", lambda t: ~(t.startswith(FRAMEWORK_NAMESPACES[0]) | t.startswith(FRAMEWORK_NAMESPACES[1])))
    table = F.create_map(*[F.lit(x) for pair in SEND_CALLS.items() for x in pair])
    rows = invocations.filter(F.col("method_name").isin(list(SEND_CALLS))).withColumn("message_type", F.get(own, 0))
    rows = rows.filter(F.col("message_type").isNotNull()).select(
        F.try_element_at(table, F.col("method_name")).alias("site_kind"), "message_type", "containing_id", "project", *LOC
    )
    return dedupe_first(rows, ["site_kind", "message_type", "path", "line", "column"], ["end_line", "end_column", "project"])


def message_flow(messages: DataFrame, handlers: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Handlers and send or publish sites of each asked message type, and a warning row where there are none."""
    none = F.lit(None).cast("string")
    asked = messages.select("target_id", "message_type").distinct()
    found = asked.join(handlers, "message_type").select(
        "target_id", F.lit("handler").alias("section"), F.col("handler_kind").alias("kind"), F.col("handler_type").alias("name"),
        none.alias("path"), F.lit(None).cast("int").alias("line"),
    )
    warn = asked.join(handlers, "message_type", "left_anti").select(
        "target_id", F.lit("warning").alias("section"), none.alias("kind"), F.lit("no-handlers-found").alias("name"),
        none.alias("path"), F.lit(None).cast("int").alias("line"),
    )
    result = found.unionByName(warn)
    if sites is not None:
        calls = asked.join(sites, "message_type").select(
            "target_id", F.lit("call-site").alias("section"), F.col("site_kind").alias("kind"), F.col("containing_id").alias("name"), "path", "line"
        )
        silent = asked.join(sites, "message_type", "left_anti").select(
            "target_id", F.lit("warning").alias("section"), none.alias("kind"), F.lit("no-call-sites-found").alias("name"),
            none.alias("path"), F.lit(None).cast("int").alias("line"),
        )
        result = result.unionByName(calls).unionByName(silent)
    return result


QUERYABLES = ["DbSet", "IQueryable"]


def ef_facts(
    types: DataFrame, type_edges: DataFrame, properties: DataFrame, type_interfaces: DataFrame, invocations: DataFrame
) -> DataFrame:
    """Contexts, sets, entities, configurations and query sites in one table by ``section``.

    ``types(type_id, project, LOC)``, ``properties(type_id, name, type_name, type_args, project, LOC)``,
    ``type_interfaces(type_id, interface_name, type_args, project)``, ``invocations(method_name, source_type_name,
    source_type_args, containing_id, project, LOC)``.
    """
    none = F.lit(None).cast("string")
    contexts = inheriting(types, type_edges, ["DbContext"])

    def section(df: DataFrame, label: str, name, entity, owner, confidence: str) -> DataFrame:
        places = [F.col(c) if c in df.columns else F.lit(None).cast("string" if c == "path" else "int").alias(c) for c in LOC]
        return df.select(
            F.lit(label).alias("section"), name.alias("name"), entity.alias("entity"), owner.alias("owner"),
            F.lit(confidence).alias("confidence"), "project", *places,
        )

    set_props = properties.filter((F.col("type_name") == "DbSet") & F.get("type_args", 0).isNotNull()).join(
        contexts.select("type_id"), "type_id", "left_semi"
    )
    configs = type_interfaces.filter((F.col("interface_name") == "IEntityTypeConfiguration") & F.get("type_args", 0).isNotNull())
    entity = F.get("type_args", 0)
    queries = invocations.filter(F.col("source_type_name").isin(QUERYABLES) & F.get("source_type_args", 0).isNotNull())
    rows = section(contexts, "context", F.col("type_id"), none, none, "high")
    rows = rows.unionByName(section(set_props, "set", F.col("name"), entity, F.col("type_id"), "high"))
    rows = rows.unionByName(section(configs, "configuration", F.col("type_id"), entity, none, "high"))
    rows = rows.unionByName(
        section(queries, "query", F.col("method_name"), F.get("source_type_args", 0), F.col("containing_id"), "medium")
    )
    entities = section(set_props, "entity", entity, entity, none, "high").unionByName(
        section(configs, "entity", entity, entity, none, "high")
    )
    entities = dedupe_first(entities, ["entity"], ["project", *LOC])
    rows = dedupe_first(rows, ["section", "name", "entity", "owner", "path", "line", "column"], ["project", "end_line", "end_column"])
    return rows.unionByName(entities)


def entity_impact(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Sets, configurations and query sites of each asked entity. ``entities(target_id, entity)``."""
    return entities.select("target_id", "entity").join(
        facts.filter(F.col("section").isin("set", "configuration", "query")), "entity"
    )


FRAMEWORK_ORDER = ["aspnetcore", "test", "worker", "azure-functions", "grpc", "mediatr", "messaging"]
ENTRYPOINT_REASONS = [
    "aspnetcore-web-project",
    "aspnetcore-controller-type",
    "aspnetcore-http-method-attribute",
    "aspnetcore-route-attribute",
    "aspnetcore-minimal-api-map-call",
    "aspnetcore-middleware-registration",
    "aspnetcore-middleware-invoke-method",
    "public-action-method",
    "test-framework-entrypoint",
    "test-method-attribute",
    "worker-backgroundservice-base",
    "worker-ihostedservice-implementation",
    "worker-executeasync-override",
    "worker-startasync-implementation",
    "worker-addhostedservice-registration",
]
ENTRYPOINT_ORDER = ["framework_rank", "confidence_rank", "project", "path", "line", "column", "entrypoint_kind", "symbol_id"]


def order_entrypoints(items: DataFrame) -> DataFrame:
    """The most confident row per composite key, with the ranks that order entrypoints."""
    framework = F.when(F.col("framework").isin("xunit", "nunit", "mstest"), F.lit("test")).otherwise(F.col("framework"))
    ranked = items.withColumn("confidence_rank", rank_of("confidence", CONFIDENCE)).withColumn(
        "framework_rank", rank_of(framework, FRAMEWORK_ORDER, 100)
    )
    key = ["framework", "entrypoint_kind", "project", "symbol_id", "path", "line", "column"]
    return dedupe_first(ranked, key, ["confidence_rank", "end_line", "end_column"])


def framework_entrypoints(
    types: DataFrame, methods: DataFrame, invocations: DataFrame, type_edges: DataFrame, type_interfaces: DataFrame,
    tests: DataFrame, web_projects: DataFrame, frameworks=("aspnetcore", "test", "worker"),
) -> DataFrame:
    """Controller actions, minimal-API handlers, middleware, background and hosted services, tests."""
    parts = []

    def item(df: DataFrame, kind: str, framework: Column, symbol: str, confidence: Column, *codes) -> None:
        parts.append(
            df.select(
                F.lit(kind).alias("entrypoint_kind"), framework.alias("framework"), F.col(symbol).alias("symbol_id"), "project",
                confidence.alias("confidence"), ordered_reasons(reasons(*codes), ENTRYPOINT_REASONS).alias("reason_codes"), *LOC,
            )
        )

    always = F.lit(True)
    high, medium = F.lit("high"), F.lit("medium")
    if "aspnetcore" in frameworks:
        web = web_projects.select("project").distinct().withColumn("__web", F.lit(True))
        actions = _actions(types, methods, type_edges).join(web, "project", "left").withColumn("web", F.coalesce("__web", F.lit(False)))
        verb = F.size(http_methods(F.transform("attributes", lambda a: a["name"]))) > 0
        routed = _named("attributes", "Route")
        convention = F.col("type_name").endswith("Controller")
        actions = actions.filter(F.col("is_controller") | routed | (convention & F.col("web")))
        confidence = F.when(F.col("is_controller") & (verb | routed), "high").when(convention & F.col("web"), "medium").otherwise("low")
        item(
            actions, "aspnetcore-controller-action", F.lit("aspnetcore"), "method_id", confidence,
            (always, "public-action-method"), (F.col("web"), "aspnetcore-web-project"),
            (F.col("is_controller"), "aspnetcore-controller-type"), (convention, "aspnetcore-controller-name-convention"),
            (verb, "aspnetcore-http-method-attribute"), (routed, "aspnetcore-route-attribute"),
        )
        mapped = invocations.filter(F.col("method_name").isin(list(MAP_CALLS)) & F.col("handler_id").isNotNull())
        item(mapped, "aspnetcore-minimal-api-handler", F.lit("aspnetcore"), "handler_id", high, (always, "aspnetcore-minimal-api-map-call"))
        used = invocations.filter(F.col("method_name") == "UseMiddleware").select(F.get("type_args", 0).alias("type_id")).distinct()
        invoke = methods.filter(F.col("name").isin("Invoke", "InvokeAsync"))
        invoke = dedupe_first(invoke.join(used, "type_id", "left_semi"), ["type_id"], ["name", *LOC])
        item(
            invoke, "aspnetcore-middleware", F.lit("aspnetcore"), "method_id", high,
            (always, "aspnetcore-middleware-registration"), (always, "aspnetcore-middleware-invoke-method"),
        )
        bare = types.join(used, "type_id", "left_semi").join(invoke.select("type_id"), "type_id", "left_anti")
        item(bare, "aspnetcore-middleware", F.lit("aspnetcore"), "type_id", medium, (always, "aspnetcore-middleware-registration"))
    if "worker" in frameworks:
        background = inheriting(types, type_edges, ["BackgroundService"]).select("type_id")
        run = methods.filter(F.col("name") == "ExecuteAsync").join(background, "type_id", "left_semi")
        item(
            run, "worker-backgroundservice-execute", F.lit("worker"), "method_id", high,
            (always, "worker-backgroundservice-base"), (always, "worker-executeasync-override"),
        )
        hosted = type_interfaces.filter(F.col("interface_name") == "IHostedService").select("type_id").distinct()
        start = methods.filter(F.col("name") == "StartAsync").join(hosted, "type_id", "left_semi")
        item(
            start, "worker-ihostedservice-start", F.lit("worker"), "method_id", high,
            (always, "worker-ihostedservice-implementation"), (always, "worker-startasync-implementation"),
        )
        added = invocations.filter(F.col("method_name") == "AddHostedService").select(F.get("type_args", 0).alias("type_id")).distinct()
        item(
            types.join(added, "type_id", "left_semi"), "worker-hosted-service-registration", F.lit("worker"), "type_id", medium,
            (always, "worker-addhostedservice-registration"),
        )
    if "test" in frameworks:
        item(
            tests, "test-method", F.col("framework"), "method_id", high,
            (always, "test-framework-entrypoint"), (always, "test-method-attribute"),
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return order_entrypoints(result)


def package_hints(packages: DataFrame) -> DataFrame:
    """Namespace hint of each asked package: given, else guessed from its first two name parts; none for one part.

    ``packages(target_id, package, hint?)``; several rows of a target may give several hints.
    """
    parts = F.filter(F.split("package", r"\."), lambda p: F.trim(p) != "")
    guess = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), "."))
    confidence = F.when(F.col("hint").isNull(), "low").otherwise("medium")
    reason = F.when(F.col("hint").isNull(), "package-namespace-guess").otherwise("package-namespace-hint")
    return packages.withColumn("confidence", confidence).withColumn("reason", reason).withColumn("hint", F.coalesce("hint", guess))


def package_usage(packages: DataFrame, package_refs: DataFrame, uses: DataFrame) -> DataFrame:
    """Package references (any case) and source uses by namespace hint.

    ``uses(usage_kind, namespace, project, LOC)`` holds imports and symbol references. A use matches a hint when its
    namespace starts with it, or holds it between dots. Distinct namespaces are cut at every character they could start a hint at:
    the prefixes of a namespace of the hints' lengths, and its dotted inner runs, are joined to the hints by equality.
    """
    refs = packages.select("target_id", F.lower("package").alias("__key")).distinct().join(
        package_refs.withColumn("__key", F.lower("name")), "__key"
    ).select(
        "target_id", F.lit("package-reference").alias("usage_kind"), F.col("name").alias("namespace"), F.col("version").alias("detail"),
        F.lit("high").alias("confidence"), F.lit("package-reference").alias("reason"), "project", *[F.lit(None).cast(t).alias(c) for c, t in zip(LOC, ["string"] + ["int"] * 4)],
    )
    hints = package_hints(packages).filter(F.col("hint").isNotNull()).select("target_id", "hint", "confidence", "reason").distinct()
    spaces = uses.select("namespace").distinct().filter(F.length("namespace") > 0)
    n = F.length("namespace")
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.substring("namespace", F.lit(1), k))
    parts = F.split("namespace", r"\.")
    count = F.size(parts)
    inner = F.when(
        count >= 3,
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), count - 1),
                lambda i: F.transform(F.sequence(F.lit(1), count - i), lambda m: F.array_join(F.slice(parts, i, m), ".")),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))
    pieces = spaces.select("namespace", F.explode(F.array_distinct(F.concat(prefixes, inner))).alias("hint"))
    matched = pieces.join(hints, "hint").select("namespace", "target_id", "confidence", "reason").distinct()
    found = matched.join(uses, "namespace").select(
        "target_id", "usage_kind", "namespace", F.lit(None).cast("string").alias("detail"), "confidence", "reason", "project", *LOC
    )
    return refs.unionByName(found)
