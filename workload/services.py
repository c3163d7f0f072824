"""Registrations, dependencies and risks; routes, options, messages, data model, entrypoints, packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspan.functions import names
from factspan.operators import domains, filters, injection
from factspan.plans import services as plans
from factspan.session import cut_lineage

from .registry import query

REGS = """
called AS (
  SELECT *, CASE WHEN contains(method_name, 'Singleton') THEN 'singleton' WHEN contains(method_name, 'Scoped') THEN 'scoped' WHEN contains(method_name, 'Transient') THEN 'transient' ELSE 'unknown' END AS lt FROM f_regs),
regs AS (
  SELECT project, path, line, CASE method_name WHEN 'AddHostedService' THEN 'hostedService' WHEN 'Configure' THEN 'options' ELSE 'service' END AS registration_kind,
    CASE method_name WHEN 'AddHostedService' THEN 'singleton' WHEN 'Configure' THEN 'unknown' ELSE lt END AS lifetime, first_type AS service_type,
    CASE method_name WHEN 'AddHostedService' THEN first_type WHEN 'Configure' THEN NULL ELSE coalesce(second_type, first_type) END AS implementation_type, method_name
  FROM called WHERE lt <> 'unknown' OR method_name IN ('AddHostedService', 'Configure'))"""


def invocations(f):
    none = F.lit(None).cast("string")
    types = F.array_compact(F.array("first_type", "second_type"))
    empty = F.array().cast("array<string>")
    return (
        f.f_regs.withColumn("type_args", types).withColumn("typeof_args", empty).withColumn("descriptor_name", none)
        .withColumn("has_factory", F.lit(False)).withColumn("instance_type", none)
        .withColumn("column", F.lit(1)).withColumn("end_line", F.col("line")).withColumn("end_column", F.lit(9))
    )


def regs(f):
    return injection.di_registrations(invocations(f))


@query("di_registrations", "project s, path s, line i, registration_kind s, lifetime s, service_type s, implementation_type s, reason_codes a, lifetime_rank i", f"""
WITH {REGS}
SELECT_RESULT
SELECT project, path, line, registration_kind, lifetime, service_type, implementation_type,
 list_sort(list_filter(['iservicecollection-registration-call', CASE registration_kind WHEN 'hostedService' THEN 'hosted-service-registration' WHEN 'options' THEN 'options-registration' ELSE concat(lower(method_name), '-call') END,
   CASE WHEN starts_with(method_name, 'TryAdd') THEN 'tryadd-call' END], lambda x: x IS NOT NULL)) AS reason_codes,
 CASE lifetime WHEN 'singleton' THEN 0 WHEN 'scoped' THEN 1 WHEN 'transient' THEN 2 ELSE 3 END AS lifetime_rank FROM regs""")
def _(f):
    return regs(f)


CTORS = """
header AS (SELECT type_id, ctor_ordinal, count(name) AS n, min(ctor_line) AS ctor_line, bool_or(is_marked) AS m, bool_or(ctor_access = 'Public') AS p FROM f_ctors GROUP BY ALL),
counted AS (SELECT *, count(*) OVER (PARTITION BY type_id) AS ctors, count(*) FILTER (p) OVER (PARTITION BY type_id) AS publics,
  row_number() OVER (PARTITION BY type_id ORDER BY CASE WHEN m THEN 0 WHEN p THEN 1 ELSE 2 END, CASE WHEN m THEN 0 ELSE -n END, ctor_line, ctor_ordinal) AS rn FROM header),
picked AS (SELECT * FROM counted WHERE rn = 1 AND (m OR p OR ctors = 1)),
params AS (SELECT c.*, publics FROM f_ctors c JOIN picked k ON k.type_id = c.type_id AND k.ctor_ordinal = c.ctor_ordinal)"""
DEPS = f"""{REGS}, {CTORS},
deps AS (SELECT DISTINCT implementation_type, type_fqn AS dependency_type, name AS parameter_name, ordinal AS parameter_ordinal, publics FROM params p JOIN (SELECT DISTINCT implementation_type FROM regs) r ON r.implementation_type = p.type_id)"""


def ctors(f):
    return f.f_ctors.withColumn("optional", F.lit(False))


@query("select_constructor", "type_id s, ctor_ordinal i, name s, type_fqn s, param_count i, public_count i", f"""
WITH {CTORS}
SELECT_RESULT
SELECT p.type_id, p.ctor_ordinal, name, type_fqn, n AS param_count, p.publics AS public_count FROM params p JOIN picked k ON k.type_id = p.type_id""")
def _(f):
    return injection.select_constructor(f.f_ctors)


def deps(f):
    return injection.di_dependencies(regs(f), ctors(f))


@query("di_dependencies", "implementation_type s, dependency_type s, parameter_name s, parameter_ordinal i, reason_codes a", f"""
WITH {DEPS}
SELECT_RESULT
SELECT implementation_type, dependency_type, parameter_name, parameter_ordinal, CASE WHEN publics > 1 THEN ['constructor-parameter', 'constructor-selection-heuristic'] ELSE ['constructor-parameter'] END AS reason_codes FROM deps""")
def _(f):
    return deps(f)


RISKS = f"""{DEPS},
svc AS (SELECT service_type, count(*) AS n, min(ROW(path, line, CASE lifetime WHEN 'singleton' THEN 0 WHEN 'scoped' THEN 1 WHEN 'transient' THEN 2 ELSE 3 END, lifetime)) AS first FROM regs GROUP BY service_type),
imp AS (SELECT implementation_type, min(ROW(path, line, CASE lifetime WHEN 'singleton' THEN 0 WHEN 'scoped' THEN 1 WHEN 'transient' THEN 2 ELSE 3 END, lifetime, service_type)) AS own FROM regs WHERE implementation_type IS NOT NULL GROUP BY implementation_type),
risks AS (
  SELECT 'multiple-registrations' AS risk_kind, 'info' AS severity, service_type, NULL AS implementation_type, NULL AS dependency_type FROM svc WHERE n > 1
  UNION ALL SELECT 'captive-dependency', 'warning', own[5], d.implementation_type, d.dependency_type FROM deps d JOIN imp i ON i.implementation_type = d.implementation_type JOIN svc s ON s.service_type = d.dependency_type WHERE own[4] = 'singleton' AND first[4] = 'scoped'
  UNION ALL SELECT 'unresolved-service-candidate', 'warning', NULL, implementation_type, dependency_type FROM deps
    WHERE NOT starts_with(dependency_type, 'Microsoft.Extensions.') AND dependency_type NOT IN (SELECT service_type FROM regs) AND dependency_type NOT IN (SELECT implementation_type FROM regs WHERE implementation_type IS NOT NULL))"""


@query("di_risks", "risk_kind s, severity s, service_type s, implementation_type s, dependency_type s", f"""
WITH {RISKS}
SELECT_RESULT
SELECT * FROM risks""")
def _(f):
    registrations = cut_lineage(regs(f))
    return injection.di_risks(registrations, cut_lineage(injection.di_dependencies(registrations, ctors(f))))


TYPES = "SELECT concat('q', CAST(s_suppkey AS {0})) AS target_id, concat('T', CAST(s_suppkey AS {0})) AS type_name FROM supplier"


@query("where_registered", "target_id s, service_type s, implementation_type s, path s, line i", f"""
WITH {REGS}, t AS ({TYPES.format('VARCHAR')})
SELECT_RESULT
SELECT target_id, service_type, implementation_type, path, line FROM t JOIN regs ON service_type = type_name OR implementation_type = type_name""")
def _(f):
    return injection.where_registered(f.sql(TYPES.format("STRING")), regs(f))


@query("di_impact", "target_id s, section s, name s, other s", f"""
WITH {RISKS}, t AS ({TYPES.format('VARCHAR')})
SELECT_RESULT
SELECT target_id, 'registration' AS section, service_type AS name, implementation_type AS other FROM t JOIN regs ON service_type = type_name OR implementation_type = type_name
UNION ALL SELECT target_id, 'dependency', dependency_type, parameter_name FROM t JOIN deps ON implementation_type = type_name
UNION ALL SELECT DISTINCT target_id, 'consumer', implementation_type, NULL FROM t JOIN deps ON dependency_type = type_name
UNION ALL SELECT target_id, 'risk', risk_kind, coalesce(dependency_type, service_type) FROM t JOIN risks ON type_name IN (coalesce(service_type, ''), coalesce(implementation_type, ''), coalesce(dependency_type, ''))""")
def _(f):
    r = cut_lineage(regs(f))
    d = cut_lineage(injection.di_dependencies(r, ctors(f)))
    return injection.di_impact(f.sql(TYPES.format("STRING")), r, d, injection.di_risks(r, d))


@query("di_graph", "section s, position i, name s, other s, total i, truncated b", f"""
WITH {RISKS}, placed AS (
  SELECT 'registrations' AS section, row_number() OVER (ORDER BY project, path, line, CASE lifetime WHEN 'singleton' THEN 0 WHEN 'scoped' THEN 1 WHEN 'transient' THEN 2 ELSE 3 END, service_type, implementation_type NULLS FIRST, registration_kind, method_name) AS position, service_type AS name, implementation_type AS other, count(*) OVER () AS total FROM regs
  UNION ALL SELECT 'dependencies', row_number() OVER (ORDER BY implementation_type, parameter_ordinal, dependency_type, parameter_name), implementation_type, dependency_type, count(*) OVER () FROM deps
  UNION ALL SELECT 'risks', row_number() OVER (ORDER BY CASE severity WHEN 'warning' THEN 1 ELSE 2 END, CASE risk_kind WHEN 'multiple-registrations' THEN 0 ELSE 1 END, risk_kind, service_type NULLS FIRST, implementation_type NULLS FIRST, dependency_type NULLS FIRST), risk_kind, coalesce(implementation_type, service_type), count(*) OVER () FROM risks)
SELECT_RESULT
SELECT section, position, name, other, total, total > 30 AS truncated FROM placed WHERE position <= 30""")
def _(f):
    parts = plans.di_graph(invocations(f), ctors(f), limit=30)
    pick = lambda k, a, b: parts[k].select(F.lit(k).alias("section"), "position", F.col(a).alias("name"), b.alias("other"), "total", "truncated")
    return (
        pick("registrations", "service_type", F.col("implementation_type"))
        .unionByName(pick("dependencies", "implementation_type", F.col("dependency_type")))
        .unionByName(pick("risks", "risk_kind", F.coalesce("implementation_type", "service_type")))
    )


# Application facts from suppliers (types), parts (methods) and line items (calls).
TYPE_SQL = """
SELECT concat('T', CAST(s_suppkey AS {0})) AS type_id, CASE WHEN s_suppkey % 4 = 0 THEN concat('A', CAST(s_suppkey AS {0}), 'Controller') ELSE concat('A', CAST(s_suppkey AS {0})) END AS type_name,
  concat('App', CAST(s_nationkey % 5 AS {0})) AS project, s_suppkey AS k, s_nationkey AS nk FROM supplier"""
METHOD_SQL = """
SELECT concat('M', CAST(p_partkey AS {0})) AS method_id, concat('T', CAST(p_partkey % (SELECT count(*) FROM supplier) AS {0})) AS type_id,
  CASE WHEN p_partkey % 41 = 1 THEN 'ExecuteAsync' WHEN p_partkey % 41 = 2 THEN 'StartAsync' WHEN p_partkey % 41 = 3 THEN 'InvokeAsync' ELSE p_name END AS name,
  CASE WHEN p_partkey % 5 = 0 THEN 'Internal' ELSE 'Public' END AS accessibility, p_partkey % 13 = 0 AS is_static, concat('App', CAST(p_partkey % 5 AS {0})) AS project,
  concat('src/m', CAST(p_partkey % 50 AS {0}), '.cs') AS path, CAST(p_partkey AS INT) AS line, p_partkey AS k, p_brand AS route, p_type FROM part"""
CALL_SQL = """
SELECT concat('K', CAST(l_orderkey AS {0}), '/', CAST(l_partkey AS {0}), '/', CAST(l_suppkey AS {0}), '/', CAST(l_linenumber AS {0})) AS call_id,
  CASE l_partkey % 23 WHEN 0 THEN 'MapGet' WHEN 1 THEN 'MapMethods' WHEN 2 THEN 'MapFallback' WHEN 3 THEN 'UseMiddleware' WHEN 4 THEN 'AddHostedService' WHEN 5 THEN 'Configure' WHEN 6 THEN 'Bind' WHEN 7 THEN 'ValidateOnStart'
    WHEN 8 THEN 'GetSection' WHEN 9 THEN 'Send' WHEN 10 THEN 'Publish' WHEN 11 THEN 'Where' ELSE 'Other' END AS method_name,
  concat('App', CAST(l_suppkey % 5 AS {0})) AS project, concat('src/c', CAST(l_orderkey % 300 AS {0}), '.cs') AS path, l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, CAST(l_orderkey AS INT) AS line, CAST(l_linenumber AS INT) AS column_no, CAST(l_partkey AS INT) AS end_column FROM lineitem"""


def _attrs(*pairs):
    """Array of attribute structs from (condition, name, first argument, policy)."""
    none = F.lit(None).cast("string")
    items = [
        F.when(cond, F.struct(F.lit(name).alias("name"), (arg if arg is not None else none).alias("first_arg"), (policy if policy is not None else none).alias("policy"), none.alias("roles"), none.alias("schemes")))
        for cond, name, arg, policy in pairs
    ]
    return F.array_compact(F.array(*items))


def types(f):
    df = f.sql(TYPE_SQL.format("STRING"))
    attrs = _attrs(
        (F.col("k") % 3 == 0, "ApiControllerAttribute", None, None), (F.col("k") % 2 == 0, "Route", F.concat(F.lit("t"), F.col("nk").cast("string"), F.lit("/")), None),
        (F.col("k") % 7 == 0, "Authorize", None, F.lit("Admin")),
    )
    df = df.withColumn("type_attributes", attrs).withColumn("path", F.concat(F.lit("src/t"), F.col("nk").cast("string"), F.lit(".cs")))
    for c in ("line", "column", "end_line", "end_column"):
        df = df.withColumn(c, F.col("k").cast("int"))
    return df.drop("k", "nk")


def methods(f):
    df = f.sql(METHOD_SQL.format("STRING"))
    attrs = _attrs(
        (F.col("k") % 6 == 0, "HttpGetAttribute", F.col("route"), None), (F.col("k") % 6 == 1, "HttpPost", None, None), (F.col("k") % 9 == 0, "RouteAttribute", F.concat(F.lit("/"), "p_type"), None),
        (F.col("k") % 17 == 0, "NonAction", None, None), (F.col("k") % 19 == 0, "AllowAnonymous", None, None), (F.col("k") % 23 == 0, "Authorize", F.lit("Read"), None),
    )
    df = df.withColumn("attributes", attrs)
    return df.withColumn("column", F.lit(1)).withColumn("end_line", F.col("line")).withColumn("end_column", F.lit(2)).drop("k", "route", "p_type")


def type_edges(f):
    return f.sql(
        "SELECT concat('T', CAST(s_suppkey AS STRING)) AS child_id, CASE WHEN s_suppkey % 10 = 1 THEN 'X' ELSE concat('T', CAST(CAST((s_suppkey - s_suppkey % 3) / 3 AS BIGINT) AS STRING)) END AS parent_id, "
        "CASE WHEN s_suppkey % 30 = 1 THEN 'ControllerBase' WHEN s_suppkey % 30 = 11 THEN 'BackgroundService' WHEN s_suppkey % 30 = 21 THEN 'DbContext' ELSE 'T' END AS parent_name, 'base' AS edge_kind FROM supplier WHERE s_suppkey > 0"
    ).withColumn("parent_id", F.when(F.col("parent_name") != "T", F.concat(F.lit("X"), "parent_name")).otherwise(F.col("parent_id")))


INHERIT = """
te AS (SELECT concat('T', CAST(s_suppkey AS VARCHAR)) AS c, CASE WHEN s_suppkey % 30 = 1 THEN 'XControllerBase' WHEN s_suppkey % 30 = 11 THEN 'XBackgroundService' WHEN s_suppkey % 30 = 21 THEN 'XDbContext' ELSE concat('T', CAST(CAST((s_suppkey - s_suppkey % 3) / 3 AS BIGINT) AS VARCHAR)) END AS p FROM supplier WHERE s_suppkey > 0),
inh AS (SELECT c, p AS root FROM te WHERE starts_with(p, 'X') UNION SELECT te.c, inh.root FROM inh JOIN te ON te.p = inh.c)"""
ACTIONS = f"""{INHERIT},
ty AS (SELECT t.*, k % 4 = 0 OR k % 3 = 0 OR type_id IN (SELECT c FROM inh WHERE root = 'XControllerBase') AS is_controller, CASE WHEN k % 2 = 0 THEN concat('t', CAST(nk AS VARCHAR), '/') END AS troute, k % 7 = 0 AS tauth FROM ({TYPE_SQL.format('VARCHAR')}) t),
me AS ({METHOD_SQL.format('VARCHAR')}),
act AS (SELECT m.*, ty.type_name, is_controller, troute, tauth, CASE WHEN m.k % 6 = 0 THEN 'GET' WHEN m.k % 6 = 1 THEN 'POST' END AS verb,
   CASE WHEN m.k % 6 = 0 AND m.k % 9 = 0 THEN least(route, concat('/', p_type)) WHEN m.k % 6 = 0 THEN route WHEN m.k % 9 = 0 THEN concat('/', p_type) END AS mroute
  FROM me m JOIN ty ON ty.type_id = m.type_id WHERE accessibility = 'Public' AND NOT is_static AND m.k % 17 <> 0),
calls AS ({CALL_SQL.format('VARCHAR')})"""


def calls(f):
    df = f.sql(CALL_SQL.format("STRING"))
    none = F.lit(None).cast("string")
    return (
        df.withColumn("end_line", F.col("line"))
        .withColumn("handler_id", F.when(F.col("ok") % 11 != 0, F.concat(F.lit("H"), F.col("sk").cast("string"))))
        .withColumn("route_arg", F.when(F.col("ok") % 5 != 0, F.concat(F.lit("x//"), F.col("sk").cast("string"))))
        .withColumn("verb_args", F.when(F.col("ok") % 3 == 0, F.array(F.lit("PUT"), F.lit("GET"))))
        .withColumn("auth_calls", F.array_compact(F.array(F.when(F.col("ok") % 4 == 0, "RequireAuthorization"), F.when(F.col("ok") % 8 == 0, "AllowAnonymous"))))
        .withColumn("type_args", F.array(F.concat(F.lit("T"), F.col("sk").cast("string"))))
        .withColumn("option_type", F.when(F.col("ok") % 6 != 0, F.concat(F.lit("O"), (F.col("sk") % 40).cast("string"))))
        .withColumn("first_string", F.when(F.col("ok") % 2 == 0, F.concat(F.lit("k"), (F.col("ok") % 9).cast("string"))))
        .withColumn("parent_call_id", none)
        .withColumn("arg_types", F.array(F.lit("System.Threading.CancellationToken"), F.concat(F.lit("Msg"), (F.col("sk") % 30).cast("string"))))
        .withColumn("containing_id", F.concat(F.lit("M"), F.col("pk").cast("string")))
        .withColumn("source_type_name", F.when(F.col("ok") % 3 == 0, "IQueryable").otherwise("List"))
        .withColumn("source_type_args", F.array(F.concat(F.lit("E"), (F.col("sk") % 25).cast("string"))))
    )


ROUTES = f"""{ACTIONS},
routes AS (
  SELECT 'controller-action' AS endpoint_kind, [coalesce(verb, 'ANY')] AS http_methods, CASE WHEN troute IS NULL THEN mroute WHEN mroute IS NULL THEN troute ELSE concat(rtrim(troute, '/'), '/', ltrim(mroute, '/')) END AS pattern, method_id AS handler_id,
    CASE WHEN k % 19 = 0 THEN 'anonymous' WHEN k % 23 = 0 OR tauth THEN 'required' ELSE 'unknown' END AS auth_kind,
    CASE WHEN k % 19 = 0 THEN [] ELSE list_filter([CASE WHEN k % 23 = 0 THEN 'Read' END, CASE WHEN tauth THEN 'Admin' END], lambda x: x IS NOT NULL) END AS policies,
    CASE WHEN verb IS NOT NULL OR mroute IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence, path, line, 1 AS col, project
  FROM act WHERE is_controller AND (verb IS NOT NULL OR mroute IS NOT NULL OR troute IS NOT NULL OR ends_with(type_name, 'Controller'))
  UNION ALL SELECT 'minimal-api', CASE method_name WHEN 'MapGet' THEN ['GET'] WHEN 'MapFallback' THEN ['ANY'] ELSE CASE WHEN ok % 3 = 0 THEN ['PUT', 'GET'] ELSE ['ANY'] END END,
    CASE WHEN ok % 5 <> 0 THEN concat('x//', CAST(sk AS VARCHAR)) END, concat('H', CAST(sk AS VARCHAR)), CASE WHEN ok % 8 = 0 THEN 'anonymous' WHEN ok % 4 = 0 THEN 'required' ELSE 'unknown' END, [],
    CASE WHEN ok % 5 = 0 THEN 'medium' ELSE 'high' END, path, line, column_no, project FROM calls WHERE method_name IN ('MapGet', 'MapMethods', 'MapFallback') AND ok % 11 <> 0),
uroutes AS (SELECT endpoint_kind, http_methods, pattern, CASE WHEN trim(coalesce(pattern, '')) <> '' THEN regexp_replace(concat('/', trim(pattern)), '/+', '/', 'g') END AS normalized_pattern, handler_id, auth_kind, policies, confidence, path, line, col,
  row_number() OVER (PARTITION BY endpoint_kind, project, path, line, col, regexp_replace(concat('/', pattern), '/+', '/', 'g'), http_methods ORDER BY handler_id, confidence) AS rn FROM routes)"""


def routes(f):
    return domains.routes(types(f), methods(f), calls(f), type_edges(f))


@query("routes", "endpoint_kind s, http_methods a, pattern s, normalized_pattern s, handler_id s, auth_kind s, policies a, confidence s, path s, line i", f"""
WITH RECURSIVE {ROUTES}
SELECT_RESULT
SELECT endpoint_kind, http_methods, pattern, normalized_pattern, handler_id, auth_kind, policies, confidence, path, line FROM uroutes WHERE rn = 1""")
def _(f):
    return routes(f)


@query("filter_routes", "handler_id s, normalized_pattern s, auth_kind s, path s, line i", f"""
WITH RECURSIVE {ROUTES}
SELECT_RESULT
SELECT handler_id, normalized_pattern, auth_kind, path, line FROM uroutes WHERE rn = 1 AND endpoint_kind = 'controller-action' AND auth_kind = 'required' AND (contains(lower(coalesce(normalized_pattern, '')), 'brand#1') OR contains(lower(coalesce(normalized_pattern, '')), 't2'))""")
def _(f):
    return filters.filter_routes(routes(f), ["Brand#1", "T2"], ["controller-action"], "required")


def _calls(f, *names_):
    """Calls of the named kinds that happen once at a place."""
    return calls(f).filter(F.col("method_name").isin(*names_))


OPTIONS = f"""
calls AS ({CALL_SQL.format('VARCHAR')}),
oc AS (SELECT *, concat('O', CAST(sk % 40 AS VARCHAR)) AS option_type FROM calls WHERE method_name IN ('Configure', 'Bind', 'ValidateOnStart') AND ok % 6 <> 0),
pars AS (SELECT DISTINCT concat('T', CAST(p_partkey % 300 AS VARCHAR)) AS type_id, concat('O', CAST(p_size AS VARCHAR)) AS option_type, concat('src/', CAST(p_partkey % 50 AS VARCHAR), '.cs') AS path, CAST(p_size AS INT) AS line FROM part),
facts AS (
  SELECT DISTINCT CASE method_name WHEN 'ValidateOnStart' THEN 'validation' ELSE 'binding' END AS section, option_type, CASE method_name WHEN 'Configure' THEN 'configure' WHEN 'Bind' THEN 'bind' ELSE method_name END AS detail, NULL AS consumer, path, line, column_no AS col FROM oc
  UNION ALL SELECT 'consumer', option_type, 'IOptions', type_id, path, line, 1 FROM pars
  UNION ALL SELECT DISTINCT 'option', option_type, NULL, NULL, NULL, NULL, NULL FROM (SELECT option_type FROM oc UNION SELECT option_type FROM pars) o)"""


def options(f):
    pars = f.sql(
        "SELECT DISTINCT concat('T', CAST(p_partkey % 300 AS STRING)) AS type_id, concat('Microsoft.Extensions.Options.IOptions<O', CAST(p_size AS STRING), '>') AS type_fqn, 'App' AS project, "
        "concat('src/', CAST(p_partkey % 50 AS STRING), '.cs') AS path, CAST(p_size AS INT) AS line, 1 AS column_no, 1 AS end_line, 1 AS end_column FROM part"
    )
    return domains.options_facts(calls(f), pars)


@query("options_facts", "section s, option_type s, detail s, consumer s, path s, line i", f"""
WITH {OPTIONS}
SELECT_RESULT
SELECT section, option_type, detail, consumer, path, line FROM facts""")
def _(f):
    place = lambda c: F.when(F.col("section") != "option", F.col(c))
    return options(f).withColumn("path", place("path")).withColumn("line", place("line"))


@query("filter_options", "section s, option_type s, consumer s, path s, line i", f"""
WITH {OPTIONS}
SELECT_RESULT
SELECT section, option_type, consumer, path, line FROM facts WHERE section <> 'option' AND section <> 'binding' AND (contains(option_type, 'O3') OR contains(coalesce(consumer, ''), 'O3'))""")
def _(f):
    return domains.filter_options(options(f), " o3 ").filter("section <> 'option' AND section <> 'binding'")


HANDLERS = "SELECT concat('T', CAST(s_suppkey AS {0})) AS type_id, CASE s_suppkey % 3 WHEN 0 THEN 'IRequestHandler' WHEN 1 THEN 'INotificationHandler' ELSE 'IDisposable' END AS interface_name, concat('Msg', CAST(s_nationkey AS {0})) AS message, CASE WHEN s_suppkey % 2 = 0 THEN concat('R', CAST(s_nationkey AS {0})) END AS response FROM supplier"


def interfaces(f):
    df = f.sql(HANDLERS.format("STRING"))
    return df.select(
        "type_id", "interface_name", F.array_compact(F.array("message", "response")).alias("type_args"), F.concat(F.lit("H"), "type_id").alias("handle_method_id"), F.lit("App").alias("project")
    )


MESSAGES = f"""
calls AS ({CALL_SQL.format('VARCHAR')}),
handlers AS (SELECT CASE interface_name WHEN 'IRequestHandler' THEN 'request' ELSE 'notification' END AS kind, message AS message_type, type_id AS handler_type, response FROM ({HANDLERS.format('VARCHAR')}) h WHERE interface_name <> 'IDisposable'),
sites AS (SELECT CASE method_name WHEN 'Send' THEN 'send' ELSE 'publish' END AS kind, concat('Msg', CAST(sk % 30 AS VARCHAR)) AS message_type, path, line, column_no, min(end_column) AS ec FROM calls WHERE method_name IN ('Send', 'Publish') GROUP BY ALL)"""


@query("message_facts", "part s, kind s, message_type s, name s, line i", f"""
WITH {MESSAGES}
SELECT_RESULT
SELECT 'handler' AS part, kind, message_type, handler_type AS name, CAST(NULL AS INT) AS line FROM handlers UNION ALL SELECT 'site', kind, message_type, path, line FROM sites""")
def _(f):
    handlers = domains.message_handlers(interfaces(f)).select(
        F.lit("handler").alias("part"), F.col("handler_kind").alias("kind"), "message_type", F.col("handler_type").alias("name"), F.lit(None).cast("int").alias("line")
    )
    sites = domains.message_sites(calls(f)).select(F.lit("site").alias("part"), F.col("site_kind").alias("kind"), "message_type", F.col("path").alias("name"), "line")
    return handlers.unionByName(sites)


@query("message_flow", "target_id s, section s, kind s, name s, path s, line i", f"""
WITH {MESSAGES}, asked AS (SELECT concat('q', CAST(p AS VARCHAR)) AS target_id, concat('Msg', CAST(p AS VARCHAR)) AS message_type FROM (SELECT DISTINCT p_size AS p FROM part) x)
SELECT_RESULT
SELECT target_id, 'handler' AS section, kind, handler_type AS name, NULL AS path, CAST(NULL AS INT) AS line FROM asked a JOIN handlers h ON h.message_type = a.message_type
UNION ALL SELECT target_id, 'warning', NULL, 'no-handlers-found', NULL, NULL FROM asked WHERE message_type NOT IN (SELECT message_type FROM handlers)
UNION ALL SELECT target_id, 'call-site', kind, NULL, path, line FROM asked a JOIN sites s ON s.message_type = a.message_type
UNION ALL SELECT target_id, 'warning', NULL, 'no-call-sites-found', NULL, NULL FROM asked WHERE message_type NOT IN (SELECT message_type FROM sites)""")
def _(f):
    asked = f.sql("SELECT DISTINCT concat('q', CAST(p_size AS STRING)) AS target_id, concat('Msg', CAST(p_size AS STRING)) AS message_type FROM part")
    sites = domains.message_sites(calls(f)).withColumn("containing_id", F.lit(None).cast("string"))
    return domains.message_flow(asked, domains.message_handlers(interfaces(f)), sites)


EF = f"""{INHERIT}, calls AS ({CALL_SQL.format('VARCHAR')}),
props AS (SELECT concat('T', CAST(p_partkey % 100 AS VARCHAR)) AS type_id, concat(p_name, CAST(p_partkey AS VARCHAR)) AS name, concat('E', CAST(p_size AS VARCHAR)) AS entity, concat('src/p', CAST(p_partkey % 10 AS VARCHAR), '.cs') AS path, CAST(p_partkey AS INT) AS line FROM part),
sets AS (SELECT p.* FROM props p WHERE type_id IN (SELECT c FROM inh WHERE root = 'XDbContext')),
cfg AS (SELECT concat('T', CAST(s_suppkey AS VARCHAR)) AS type_id, concat('E', CAST(s_nationkey AS VARCHAR)) AS entity FROM supplier),
q AS (SELECT DISTINCT method_name, concat('E', CAST(sk % 25 AS VARCHAR)) AS entity, concat('M', CAST(pk AS VARCHAR)) AS owner, path, line, column_no FROM calls WHERE ok % 3 = 0),
facts AS (
  SELECT 'context' AS section, concat('T', CAST(s_suppkey AS VARCHAR)) AS name, NULL AS entity, NULL AS owner, CAST(NULL AS INT) AS line FROM supplier WHERE concat('T', CAST(s_suppkey AS VARCHAR)) IN (SELECT c FROM inh WHERE root = 'XDbContext')
  UNION ALL SELECT 'set', name, entity, type_id, line FROM sets UNION ALL SELECT 'configuration', type_id, entity, NULL, NULL FROM cfg
  UNION ALL SELECT 'query', method_name, entity, owner, line FROM q UNION ALL SELECT DISTINCT 'entity', entity, entity, NULL, CAST(NULL AS INT) FROM (SELECT entity FROM sets UNION SELECT entity FROM cfg) e)"""


def ef(f):
    props = f.sql(
        "SELECT concat('T', CAST(p_partkey % 100 AS STRING)) AS type_id, concat(p_name, CAST(p_partkey AS STRING)) AS name, 'DbSet' AS type_name, array(concat('E', CAST(p_size AS STRING))) AS type_args, 'App' AS project, "
        "concat('src/p', CAST(p_partkey % 10 AS STRING), '.cs') AS path, CAST(p_partkey AS INT) AS line, 1 AS column_no, 1 AS end_line, 1 AS end_column FROM part"
    )
    cfg = f.sql("SELECT concat('T', CAST(s_suppkey AS STRING)) AS type_id, 'IEntityTypeConfiguration' AS interface_name, array(concat('E', CAST(s_nationkey AS STRING))) AS type_args, 'App' AS project FROM supplier")
    return domains.ef_facts(types(f), type_edges(f), props, cfg, calls(f))


@query("ef_facts", "section s, name s, entity s, owner s, line i", f"""
WITH RECURSIVE {EF}
SELECT_RESULT
SELECT * FROM facts""")
def _(f):
    return ef(f).withColumn("line", F.when(F.col("section").isin("set", "query"), F.col("line")))


@query("entity_impact", "target_id s, section s, name s, owner s, line i", f"""
WITH RECURSIVE {EF}
SELECT_RESULT
SELECT concat('n', CAST(n_nationkey AS VARCHAR)) AS target_id, section, name, owner, line FROM nation JOIN facts ON entity = concat('E', CAST(n_nationkey AS VARCHAR)) WHERE section IN ('set', 'configuration', 'query')""")
def _(f):
    asked = f.sql("SELECT concat('n', CAST(n_nationkey AS STRING)) AS target_id, concat('E', CAST(n_nationkey AS STRING)) AS entity FROM nation")
    return domains.entity_impact(asked, ef(f)).withColumn("line", F.when(F.col("section").isin("set", "query"), F.col("line")))


ENTRY = f"""{ACTIONS},
hosted AS (SELECT concat('T', CAST(s_suppkey AS VARCHAR)) AS c FROM supplier),
mw AS (SELECT DISTINCT concat('T', CAST(sk AS VARCHAR)) AS c FROM calls WHERE method_name = 'UseMiddleware'),
inv AS (SELECT type_id, (min(ROW(name, path, line, method_id)))[4] AS method_id FROM me WHERE name = 'InvokeAsync' AND type_id IN (SELECT c FROM mw) GROUP BY type_id),
eps AS (
  SELECT 'aspnetcore-controller-action' AS kind, method_id AS symbol_id, CASE WHEN is_controller AND (verb IS NOT NULL OR k % 9 = 0) THEN 'high' WHEN ends_with(type_name, 'Controller') AND project IN ('App1', 'App2') THEN 'medium' ELSE 'low' END AS confidence FROM act
    WHERE is_controller OR k % 9 = 0 OR (ends_with(type_name, 'Controller') AND project IN ('App1', 'App2'))
  UNION ALL SELECT DISTINCT 'aspnetcore-minimal-api-handler', concat('H', CAST(sk AS VARCHAR), '@', path, ':', CAST(line AS VARCHAR), ':', CAST(column_no AS VARCHAR), project), 'high' FROM calls WHERE method_name IN ('MapGet', 'MapMethods', 'MapFallback') AND ok % 11 <> 0
  UNION ALL SELECT 'aspnetcore-middleware', method_id, 'high' FROM inv
  UNION ALL SELECT 'aspnetcore-middleware', type_id, 'medium' FROM ty WHERE type_id IN (SELECT c FROM mw) AND type_id NOT IN (SELECT type_id FROM inv)
  UNION ALL SELECT 'worker-backgroundservice-execute', method_id, 'high' FROM me WHERE name = 'ExecuteAsync' AND type_id IN (SELECT c FROM inh WHERE root = 'XBackgroundService')
  UNION ALL SELECT 'worker-ihostedservice-start', method_id, 'high' FROM me WHERE name = 'StartAsync' AND type_id IN (SELECT c FROM hosted)
  UNION ALL SELECT 'worker-hosted-service-registration', type_id, 'medium' FROM ty WHERE type_id IN (SELECT concat('T', CAST(sk AS VARCHAR)) FROM calls WHERE method_name = 'AddHostedService')
  UNION ALL SELECT 'test-method', method_id, 'high' FROM me WHERE k % 12 = 5)"""


@query("framework_entrypoints", "kind s, symbol_id s, confidence s", f"""
WITH RECURSIVE {ENTRY}
SELECT_RESULT
SELECT * FROM eps""")
def _(f):
    hosted = f.sql("SELECT concat('T', CAST(s_suppkey AS STRING)) AS type_id, 'IHostedService' AS interface_name FROM supplier")
    web = f.sql("SELECT concat('App', CAST(r_regionkey AS STRING)) AS project FROM region WHERE r_regionkey IN (1, 2)")
    tests = methods(f).filter(F.col("line") % 12 == 5).withColumn("framework", F.lit("xunit"))
    found = domains.framework_entrypoints(types(f), methods(f), calls(f), type_edges(f), hosted, tests, web)
    at = F.concat(F.col("symbol_id"), F.lit("@"), "path", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"), "project")
    return found.withColumn("kind", F.col("entrypoint_kind")).withColumn(
        "symbol_id", F.when(F.col("kind") == "aspnetcore-minimal-api-handler", at).otherwise(F.col("symbol_id"))
    )


@query("package_usage", "target_id s, usage_kind s, namespace s, confidence s, reason s, line i", """
WITH asked AS (SELECT DISTINCT p_brand AS target_id, concat(p_type, '.', p_brand, '.Core') AS package, CASE WHEN p_size % 2 = 0 THEN concat(substr(p_type, 1, 4)) END AS hint FROM part),
hints AS (SELECT DISTINCT target_id, coalesce(hint, concat(split_part(package, '.', 1), '.', split_part(package, '.', 2))) AS hint, CASE WHEN hint IS NULL THEN 'low' ELSE 'medium' END AS confidence,
  CASE WHEN hint IS NULL THEN 'package-namespace-guess' ELSE 'package-namespace-hint' END AS reason FROM asked),
uses AS (SELECT concat(CASE WHEN p_partkey % 3 = 0 THEN 'Root.' ELSE '' END, p_type, '.', p_brand, '.', split_part(p_name, ' ', 1)) AS namespace, CAST(p_partkey AS INT) AS line FROM part),
matched AS (SELECT DISTINCT target_id, namespace, confidence, reason FROM hints JOIN (SELECT DISTINCT namespace FROM uses) u ON starts_with(namespace, hint) OR contains(namespace, concat('.', hint, '.')))
SELECT_RESULT
SELECT DISTINCT target_id, 'package-reference' AS usage_kind, upper(package) AS namespace, 'high' AS confidence, 'package-reference' AS reason, CAST(NULL AS INT) AS line FROM asked
UNION ALL SELECT target_id, 'using-directive', m.namespace, confidence, reason, line FROM matched m JOIN uses u ON u.namespace = m.namespace""")
def _(f):
    asked = f.sql("SELECT DISTINCT p_brand AS target_id, concat(p_type, '.', p_brand, '.Core') AS package, CASE WHEN p_size % 2 = 0 THEN concat(substr(p_type, 1, 4)) END AS hint FROM part")
    refs = f.sql("SELECT DISTINCT concat(p_type, '.', p_brand, '.Core') AS name, '1.0' AS version, 'App' AS project FROM part")
    uses = f.sql(
        "SELECT 'using-directive' AS usage_kind, concat(CASE WHEN p_partkey % 3 = 0 THEN 'Root.' ELSE '' END, p_type, '.', p_brand, '.', split_part(p_name, ' ', 1)) AS namespace, 'App' AS project, 'p' AS path, "
        "CAST(p_partkey AS INT) AS line, 1 AS column_no, 1 AS end_line, 1 AS end_column FROM part"
    )
    return domains.package_usage(asked, refs.withColumn("name", F.upper("name")), uses)


@query("symbol_text_filter", "symbol_id s, container s, fqn s", """
SELECT symbol_id, container, fqn FROM f_decls WHERE contains(lower(name), '1 r') OR contains(lower(coalesce(container, '')), 'd.12') OR contains(lower(coalesce(fqn, '')), 'green')""")
def _(f):
    first = filters.filter_symbol_text(f.f_decls, "1 R", ["name"])
    second = filters.filter_symbol_text(f.f_decls, " D.12", ["container"])
    third = filters.filter_symbol_text(f.f_decls, "Green", ["fqn"])
    return first.unionByName(second).unionByName(third).distinct()


@query("attribute_functions", "method_id s, verbs a, auth_kind s, policies a, shorts a, lifetime s, framework s", f"""
WITH me AS ({METHOD_SQL.format('VARCHAR')})
SELECT_RESULT
SELECT method_id, list_filter([CASE WHEN k % 6 = 0 THEN 'GET' END, CASE WHEN k % 6 = 1 THEN 'POST' END], lambda x: x IS NOT NULL) AS verbs,
 CASE WHEN k % 19 = 0 THEN 'anonymous' WHEN k % 23 = 0 THEN 'required' ELSE 'unknown' END AS auth_kind, CASE WHEN k % 19 <> 0 AND k % 23 = 0 THEN ['Read'] ELSE [] END AS policies,
 list_filter([CASE WHEN k % 6 = 0 THEN 'HttpGet' END, CASE WHEN k % 6 = 1 THEN 'HttpPost' END, CASE WHEN k % 9 = 0 THEN 'Route' END, CASE WHEN k % 17 = 0 THEN 'NonAction' END, CASE WHEN k % 19 = 0 THEN 'AllowAnonymous' END, CASE WHEN k % 23 = 0 THEN 'Authorize' END], lambda x: x IS NOT NULL) AS shorts,
 CASE p_type WHEN 'ECONOMY' THEN 'singleton' WHEN 'STANDARD' THEN 'scoped' ELSE 'unknown' END AS lifetime, CASE k % 4 WHEN 0 THEN 'net8.0-x' WHEN 1 THEN 'net8.0' WHEN 2 THEN 'net4.7.2' ELSE 'netcoreapp3.1' END AS framework FROM me""")
def _(f):
    df = methods(f).join(f.sql(METHOD_SQL.format("STRING")).select("method_id", "k", "p_type"), "method_id")
    auth = names.auth_state("attributes")
    simple = F.transform("attributes", lambda a: a["name"])
    method = F.when(F.col("p_type") == "ECONOMY", "AddSingletonThing").when(F.col("p_type") == "STANDARD", "TryAddScoped").otherwise("Add")
    project = F.when(F.col("k") % 4 == 0, "App (net8.0-x)").otherwise("App")
    symbols = F.when(F.col("k") % 4 == 1, F.array(F.lit("NETSTANDARD2_0"), F.lit("DEBUG"), F.lit("NET8_0"))).when(
        F.col("k") % 4 == 2, F.array(F.lit("NET472"), F.lit("TRACE"))
    ).otherwise(F.array(F.lit("NETCOREAPP3_1")))
    return df.select(
        "method_id", names.http_methods(simple).alias("verbs"), auth["kind"].alias("auth_kind"), auth["policies"].alias("policies"),
        F.transform(simple, names.short_attribute).alias("shorts"), names.lifetime_of(method).alias("lifetime"), names.target_framework(project, symbols).alias("framework"),
    )
