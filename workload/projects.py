"""Diff text, project files, build-file coverage, project graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspan.operators import filters
from factspan.plans import repositories as plans
from factspan.sources import diffs, projects

from .registry import query

# One diff per customer; one file per order, its form by the order's number.
DIFFS = r"""
SELECT concat('c', CAST(o_custkey AS STRING)) AS change_id, array_join(sort_array(collect_list(body)), '\n') AS text FROM (
  SELECT o_custkey, CASE o_orderkey % 4
    WHEN 0 THEN concat('diff --git a/', p, ' b/', p, '\n--- a/', p, '\n+++ b/', p, '\n@@ -', l, ',2 +', l, ',', CAST(o_orderkey % 7 AS STRING), ' @@ ctx\n a\n--- fake\n+++ fake\n@@ -9 +', l, ' @@')
    WHEN 1 THEN concat('diff --git a/', p, ' b/', p, '\nnew file mode 100644\n--- /dev/null\n+++ b/', p, '\n@@ -0,0 +1,', l, ' @@\n+x')
    WHEN 2 THEN concat('diff --git a/', p, ' b/', p, '\r\ndeleted file mode 100644\r\n--- a/', p, '\r\n+++ /dev/null\r\n@@ -1,', l, ' +0,0 @@\r\n-x')
    ELSE concat('diff --git a/old/', p, ' b/', p, '\nsimilarity index 90%\nrename from old/', p, '\nrename to ', p, '\n--- a/old/', p, '\n+++ b/', p, '\n@@ -', l, ' +', l, ' @@\n') END AS body
  FROM (SELECT *, concat('src/', CAST(o_orderkey AS STRING), '.cs') AS p, CAST(o_orderkey % 90 + 1 AS STRING) AS l FROM orders) o) x
GROUP BY o_custkey"""
HUNKS = """
hunks AS (
  SELECT concat('c', CAST(o_custkey AS VARCHAR)) AS change_id, concat('src/', CAST(o_orderkey AS VARCHAR), '.cs') AS path, 0 AS hunk_no, CASE o_orderkey % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE o_orderkey % 90 + 1 END AS old_start,
    CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN o_orderkey % 90 + 1 ELSE 1 END AS old_count, CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE o_orderkey % 90 + 1 END AS new_start,
    CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 7 WHEN 1 THEN o_orderkey % 90 + 1 WHEN 2 THEN 0 ELSE 1 END AS new_count FROM orders
  UNION ALL SELECT concat('c', CAST(o_custkey AS VARCHAR)), concat('src/', CAST(o_orderkey AS VARCHAR), '.cs'), 1, 9, 1, o_orderkey % 90 + 1, 1 FROM orders WHERE o_orderkey % 4 = 0)"""


@query("parse_diff_files", "change_id s, path s, old_path s, status s", """
SELECT concat('c', CAST(o_custkey AS VARCHAR)) AS change_id, concat('src/', CAST(o_orderkey AS VARCHAR), '.cs') AS path, CASE WHEN o_orderkey % 4 = 3 THEN concat('old/src/', CAST(o_orderkey AS VARCHAR), '.cs') END AS old_path,
 CASE o_orderkey % 4 WHEN 0 THEN 'modified' WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' ELSE 'renamed' END AS status FROM orders""")
def _(f):
    return diffs.parse_diff_files(f.sql(DIFFS))


@query("parse_diff_hunks", "change_id s, path s, hunk_no i, old_start i, old_count i, new_start i, new_count i", f"""
WITH {HUNKS}
SELECT_RESULT
SELECT * FROM hunks""")
def _(f):
    return diffs.parse_diff_hunks(f.sql(DIFFS))


UNTRACKED = """
SELECT concat('c', CAST(c_custkey AS {0})) AS change_id, CASE WHEN c_custkey % 2 = 0 THEN concat('new/', CAST(c_custkey AS {0}), '.cs') ELSE concat('src/', CAST(c_custkey AS {0}), '.cs') END AS path, CAST(c_custkey % 80 + 1 AS INT) AS line_count FROM customer"""


@query("with_untracked", "change_id s, path s, status s, hunk_count i, new_lines i", f"""
WITH {HUNKS}, u AS ({UNTRACKED.format('VARCHAR')}),
files AS (SELECT concat('c', CAST(o_custkey AS VARCHAR)) AS change_id, concat('src/', CAST(o_orderkey AS VARCHAR), '.cs') AS path, CASE o_orderkey % 4 WHEN 0 THEN 'modified' WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' ELSE 'renamed' END AS status FROM orders),
fresh AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.change_id = u.change_id AND f.path = u.path)),
allf AS (SELECT * FROM files UNION ALL SELECT change_id, path, 'added' FROM fresh),
allh AS (SELECT change_id, path, new_count FROM hunks UNION ALL SELECT change_id, path, line_count FROM fresh)
SELECT_RESULT
SELECT a.change_id, a.path, status, count(*) AS hunk_count, sum(new_count) AS new_lines FROM allf a JOIN allh h ON h.change_id = a.change_id AND h.path = a.path GROUP BY ALL""")
def _(f):
    text = f.sql(DIFFS)
    files, hunks = diffs.with_untracked(diffs.parse_diff_files(text), diffs.parse_diff_hunks(text), f.sql(UNTRACKED.format("STRING")))
    counts = hunks.groupBy("change_id", "path").agg(F.count("*").alias("hunk_count"), F.sum("new_count").alias("new_lines"))
    return files.join(counts, ["change_id", "path"])


# One project per supplier, in the folder of its nation and region; every nation and region may hold shared build files.
PROJECT_FILES = r"""
SELECT 'r' AS repo, concat('src/', CAST(n.n_regionkey AS STRING), '/', n.n_name, '/P', CAST(s.s_suppkey AS STRING), '/P', CAST(s.s_suppkey AS STRING), '.csproj') AS path,
  CASE WHEN s.s_suppkey % 13 = 0 THEN '<Project' ELSE concat('<Project Sdk="Microsoft.NET.Sdk', CASE WHEN s.s_suppkey % 5 = 0 THEN '.Web' ELSE '' END, '"><PropertyGroup>',
    CASE WHEN s.s_suppkey % 3 = 0 THEN '<OutputType>Exe</OutputType>' ELSE '' END, '<TargetFrameworks>net8.0; net6.0;net8.0</TargetFrameworks>', CASE WHEN s.s_suppkey % 7 = 0 THEN '<PackAsTool>True</PackAsTool>' ELSE '' END,
    CASE WHEN s.s_suppkey % 4 = 0 THEN '<Nullable>enable</Nullable>' ELSE '' END, '</PropertyGroup><ItemGroup>', CASE WHEN s.s_suppkey % 6 = 0 THEN '<PackageReference Include="XUnit" Version="2.1" />' ELSE '' END,
    '<PackageReference Include="Lib.Core" /><PackageReference Include="Other"><Version> 4.2 </Version></PackageReference></ItemGroup>',
    CASE WHEN s.s_suppkey % 9 = 2 THEN '<Choose><When Condition="$(A) == 1"><ItemGroup><PackageReference Include="Chosen" Version="3"/></ItemGroup></When></Choose><!-- <PackageReference Include="Not"/> -->'
      WHEN s.s_suppkey % 9 = 4 THEN '<Target Name="t"><ItemGroup><PackageReference Include="Built" Version="5"/></ItemGroup></Target>' ELSE '' END, '<ItemGroup><ProjectReference Include="..\\..\\..\\..\\src\\.\\',
    CAST(m.n_regionkey AS STRING), '\\', m.n_name, '\\P', CAST(t.s_suppkey AS STRING), '\\P', CAST(t.s_suppkey AS STRING), CASE WHEN s.s_suppkey % 8 = 1 THEN 'x' ELSE '' END, '.csproj" /></ItemGroup></Project>') END AS xml
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN supplier t ON t.s_suppkey = CAST((s.s_suppkey - s.s_suppkey % 2) / 2 AS BIGINT) JOIN nation m ON m.n_nationkey = t.s_nationkey"""
CENTRAL_FILES = r"""
SELECT 'r' AS repo, concat('src/', CAST(n_regionkey AS STRING), '/', n_name, '/Directory.Packages.props') AS path,
  concat('<Project><PropertyGroup><ManagePackageVersionsCentrally>true</ManagePackageVersionsCentrally></PropertyGroup><ItemGroup><PackageVersion Include="Lib.Core" Version="n', CAST(n_nationkey AS STRING), '" /></ItemGroup></Project>') AS xml FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT 'r', concat('src/', CAST(r_regionkey AS STRING), '/Directory.Packages.props'), concat('<Project><ItemGroup><PackageVersion Include="Lib.Core" Version="r', CAST(r_regionkey AS STRING), '" /></ItemGroup></Project>') FROM region
UNION ALL SELECT 'r', concat('src/', CAST(n_regionkey AS STRING), '/', n_name, '/obj/Directory.Build.props'), '<Project />' FROM nation
UNION ALL SELECT concat('q', CAST(n_nationkey AS STRING)), 'Directory.Packages.props', '<Project />' FROM nation"""
PROJECTS = """
pr AS (SELECT s_suppkey AS k, concat('src/', CAST(n_regionkey AS VARCHAR), '/', n_name, '/P', CAST(s_suppkey AS VARCHAR), '/P', CAST(s_suppkey AS VARCHAR), '.csproj') AS path, n_nationkey AS nk, n_regionkey AS rk, n_name, s_suppkey % 13 = 0 AS broken FROM supplier JOIN nation ON n_nationkey = s_nationkey),
ids AS (SELECT *, concat('project:', path, ':') AS project_id FROM pr)"""


def files(f):
    return f.sql(PROJECT_FILES)


@query("read_projects", "path s, sdk s, output_type s, nullable s, frameworks a, pack_as_tool b, warning s", f"""
WITH {PROJECTS}
SELECT_RESULT
SELECT path, CASE WHEN broken THEN NULL WHEN k % 5 = 0 THEN 'Microsoft.NET.Sdk.Web' ELSE 'Microsoft.NET.Sdk' END AS sdk, CASE WHEN NOT broken AND k % 3 = 0 THEN 'Exe' END AS output_type, CASE WHEN NOT broken AND k % 4 = 0 THEN 'enable' END AS nullable,
 CASE WHEN broken THEN [] ELSE ['net6.0', 'net8.0'] END AS frameworks, NOT broken AND k % 7 = 0 AS pack_as_tool, CASE WHEN broken THEN 'project-file-parse-failed' END AS warning FROM ids""")
def _(f):
    return projects.read_projects(files(f)).withColumnRenamed("target_frameworks", "frameworks")


@query("inherit_central_versions", "project_id s, name s, version s, is_central b", f"""
WITH {PROJECTS}
SELECT_RESULT
SELECT project_id, 'XUnit' AS name, '2.1' AS version, false AS is_central FROM ids WHERE NOT broken AND k % 6 = 0 UNION ALL SELECT project_id, 'Other', '4.2', false FROM ids WHERE NOT broken
UNION ALL SELECT project_id, CASE k % 9 WHEN 2 THEN 'Chosen' ELSE 'Built' END, CASE k % 9 WHEN 2 THEN '3' ELSE '5' END, false FROM ids WHERE NOT broken AND k % 9 IN (2, 4)
UNION ALL SELECT project_id, 'Lib.Core', CASE WHEN nk % 3 = 0 THEN concat('n', CAST(nk AS VARCHAR)) ELSE concat('r', CAST(rk AS VARCHAR)) END, true FROM ids WHERE NOT broken""")
def _(f):
    return projects.inherit_central_versions(projects.read_package_refs(files(f)), projects.read_central_versions(f.sql(CENTRAL_FILES)))


@query("config_file_coverage", "config_path s, kind s, project_id s", f"""
WITH {PROJECTS}
SELECT_RESULT
SELECT concat('src/', CAST(n.n_regionkey AS VARCHAR), '/', n.n_name, '/Directory.Packages.props') AS config_path, 'Directory.Packages.props' AS kind, project_id FROM nation n LEFT JOIN ids ON nk = n_nationkey WHERE n_nationkey % 3 = 0
UNION ALL SELECT concat('src/', CAST(r_regionkey AS VARCHAR), '/Directory.Packages.props'), 'Directory.Packages.props', project_id FROM region LEFT JOIN ids ON rk = r_regionkey
UNION ALL SELECT 'Directory.Packages.props', 'Directory.Packages.props', NULL FROM nation""")
def _(f):
    return projects.config_file_coverage(f.sql(CENTRAL_FILES), projects.read_projects(files(f)))


@query("central_management", "repo s, enabled b, file_count i, first_file s", """
SELECT 'r' AS repo, true AS enabled, (SELECT count(*) FROM nation WHERE n_nationkey % 3 = 0) + (SELECT count(*) FROM region) AS file_count,
 (SELECT min(p) FROM (SELECT concat('src/', CAST(n_regionkey AS VARCHAR), '/', n_name, '/Directory.Packages.props') AS p FROM nation WHERE n_nationkey % 3 = 0 UNION SELECT concat('src/', CAST(r_regionkey AS VARCHAR), '/Directory.Packages.props') FROM region) x) AS first_file
UNION ALL SELECT concat('q', CAST(n_nationkey AS VARCHAR)), false, 1, 'Directory.Packages.props' FROM nation""")
def _(f):
    return projects.central_management(f.sql(CENTRAL_FILES))


CLASSES = f"""{PROJECTS}, cls AS (SELECT *, CASE WHEN NOT broken AND k % 6 = 0 THEN 'test' WHEN NOT broken AND k % 7 = 0 THEN 'tooling' WHEN NOT broken AND k % 3 = 0 THEN 'executable' ELSE 'library' END AS kind,
 list_filter([CASE WHEN NOT broken AND k % 6 = 0 THEN 'xunit-package' END, CASE WHEN NOT broken AND k % 7 = 0 THEN 'pack-as-tool' END, CASE WHEN NOT broken AND k % 3 = 0 THEN 'output-type-exe' ELSE 'output-type-library' END, CASE WHEN NOT broken AND k % 5 = 0 THEN 'sdk-web' END], lambda x: x IS NOT NULL) AS reason_codes FROM ids),
edges AS (SELECT a.project_id AS from_project_id, CASE WHEN a.k % 8 <> 1 THEN b.project_id END AS to_project_id, CASE WHEN a.k % 8 = 1 THEN replace(b.path, '.csproj', 'x.csproj') ELSE b.path END AS path
  FROM ids a JOIN ids b ON b.k = (a.k - a.k % 2) // 2 WHERE NOT a.broken)"""


def graph(f):
    return plans.repo_graph(files(f), f.sql(CENTRAL_FILES))


@query("classify_projects", "project_id s, kind s, confidence s, reason_codes a", f"""
WITH {CLASSES}
SELECT_RESULT
SELECT project_id, kind, CASE kind WHEN 'library' THEN 'medium' ELSE 'high' END AS confidence, reason_codes FROM cls""")
def _(f):
    return graph(f)["projects"]


@query("project_edges", "from_project_id s, to_project_id s, path s", f"""
WITH {CLASSES}
SELECT_RESULT
SELECT * FROM edges""")
def _(f):
    return graph(f)["edges"]


@query("test_relationships", "from_project_id s, to_project_id s, confidence s, reason_codes a", f"""
WITH {CLASSES}
SELECT_RESULT
SELECT DISTINCT from_project_id, to_project_id, 'high' AS confidence, ['project-reference-to-production', 'test-project-classification', 'xunit-package'] AS reason_codes
FROM edges e JOIN cls a ON a.project_id = from_project_id JOIN cls b ON b.project_id = to_project_id WHERE a.kind = 'test' AND b.kind NOT IN ('test', 'benchmark', 'unknown')""")
def _(f):
    found = graph(f)
    return found["test_relationships"]


@query("scope_to_projects", "repo s, path s", """
SELECT DISTINCT lang AS repo, d.path FROM f_docs d JOIN documents s ON s.doc_id = d.doc_id WHERE starts_with(d.path, concat('/work/', lang, '/src1/')) OR starts_with(d.path, concat('/work/', lang, '/src3/'))""")
def _(f):
    owners = f.f_docs.select("repo").distinct().withColumn("n", F.explode(F.array(F.lit("src1"), F.lit("src3"))))
    owners = owners.select("repo", F.concat(F.lit("/work/"), "repo", F.lit("/"), "n", F.lit("/x.csproj")).alias("path"))
    return filters.scope_to_projects(f.f_docs.select("repo", "path").distinct(), owners)


@query("resolve_project_filters", "filter s, status s, match_count i, project_id s", """
WITH proj AS (SELECT CAST(c_custkey AS VARCHAR) AS project_id, concat('src/', c_name, '.csproj') AS path, c_mktsegment AS name FROM customer UNION ALL SELECT concat('s', s_suppkey), concat('src/', s_name, '.csproj'), s_name FROM supplier),
asked AS (SELECT DISTINCT c_mktsegment AS filter FROM customer UNION SELECT s_name FROM supplier UNION SELECT concat('src/', c_name, '.csproj') FROM customer UNION SELECT concat('other/', n_name) FROM nation UNION SELECT n_name FROM nation UNION SELECT concat(s_name, '.csproj') FROM supplier),
by_path AS (SELECT filter, project_id FROM asked JOIN proj ON path = filter),
hits AS (SELECT * FROM by_path UNION ALL SELECT filter, project_id FROM asked JOIN proj ON name = filter WHERE NOT contains(filter, '/') AND NOT ends_with(filter, '.csproj') AND filter NOT IN (SELECT filter FROM by_path)),
n AS (SELECT filter, count(*) AS c, min(project_id) AS p FROM hits GROUP BY filter)
SELECT_RESULT
SELECT a.filter, CASE WHEN c IS NULL THEN 'unknown' WHEN c > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, coalesce(c, 0) AS match_count, CASE WHEN c = 1 THEN p END AS project_id FROM asked a LEFT JOIN n ON n.filter = a.filter""")
def _(f):
    proj = f.sql(
        "SELECT CAST(c_custkey AS STRING) AS project_id, concat('src/', c_name, '.csproj') AS path, c_mktsegment AS name FROM customer UNION ALL "
        "SELECT concat('s', CAST(s_suppkey AS STRING)), concat('src/', s_name, '.csproj'), s_name FROM supplier"
    )
    asked = f.sql(
        "SELECT c_mktsegment AS filter FROM customer UNION SELECT s_name FROM supplier UNION SELECT concat('src/', c_name, '.csproj') FROM customer UNION "
        "SELECT concat('other/', n_name) FROM nation UNION SELECT n_name FROM nation UNION SELECT concat(s_name, '.csproj') FROM supplier"
    )
    return filters.resolve_project_filters(asked, proj)
