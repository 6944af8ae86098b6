"""Registered queries: contacts of organisations (nations) from customers, suppliers and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.operators import contacts as K
from spoor.plans.corpus import Corpus, Query

MAIL = "concat(CASE WHEN c_custkey % 10 = 0 THEN 'noreply' ELSE concat('c', c_custkey % 60) END, CASE WHEN c_custkey % 4 = 1 THEN 'S' ELSE 's' END, c_custkey % 17, '@', CASE c_custkey % 3 WHEN 0 THEN 'gmail.com' WHEN 1 THEN concat(lower(c_mktsegment), '.example.com') ELSE 'corp.example.org' END)"
LOGIN = "concat(CASE WHEN s_suppkey % 5 = 0 THEN 'lead s' ELSE 's' END, s_suppkey % 17)"


def commits(c: Corpus):
    return c.table("customer").select(F.expr("concat('org_', c_nationkey)").alias("repo_id"), F.col("c_custkey").alias("ord"), F.expr(MAIL).alias("email"))


def people(c: Corpus):
    return c.table("supplier").select(F.expr("concat('org_', s_nationkey)").alias("repo_id"), F.col("s_suppkey").alias("ord"), F.expr(LOGIN).alias("login"), F.expr("s_suppkey * 7 % 150").alias("contributions"))


def orgs(c: Corpus):
    return c.table("nation").select(F.expr("concat('org_', n_nationkey)").alias("repo_id"), F.expr("CASE WHEN n_nationkey % 4 > 0 THEN concat(CASE WHEN n_nationkey % 5 = 0 THEN 'no-reply' ELSE 'info' END, '@', lower(replace(n_name, ' ', '')), '.example.org') END").alias("email"), F.col("n_name").alias("name"))


def manifests(c: Corpus):
    return c.table("documents").select(F.expr("concat('org_', doc_id % 25)").alias("repo_id"), F.col("text").alias("content"))


_WHO = (
    f"ml AS MATERIALIZED (SELECT * FROM (SELECT concat('org_', c_nationkey) AS repo_id, c_custkey AS ord, {MAIL} AS email FROM customer) WHERE NOT contains(email, 'noreply') QUALIFY row_number() OVER (PARTITION BY repo_id, lower(email) ORDER BY ord) = 1), "
    f"pe AS MATERIALIZED (SELECT *, first_value(login) OVER (PARTITION BY repo_id ORDER BY nth) AS top FROM (SELECT concat('org_', s_nationkey) AS repo_id, s_suppkey AS nth, {LOGIN} AS login, s_suppkey * 7 % 150 AS contributions FROM supplier)), "
    "mk AS (SELECT pe.*, min(ord) AS ord FROM pe JOIN ml ON ml.repo_id = pe.repo_id AND contains(lower(string_split(email, '@')[1]), lower(login)) GROUP BY ALL), "
    "wh AS (SELECT repo_id, ord, arg_max(login, nth) AS name, arg_max(CASE WHEN login LIKE 'lead %' THEN 'lead' WHEN login = top OR contributions > 100 THEN 'maintainer' WHEN contributions > 10 THEN 'developer' ELSE 'contributor' END, nth) AS role FROM mk GROUP BY ALL), "
    "ct AS MATERIALIZED (SELECT ml.repo_id, ml.ord, email, 'git_commits' AS source, lower(string_split(email, '@')[2]) AS domain, lower(string_split(email, '@')[2]) IN (" + ", ".join(f"'{d}'" for d in K.PERSONAL) + ") AS is_personal, coalesce(role, 'contributor') AS role, name FROM ml LEFT JOIN wh USING (repo_id, ord)), "
    "og AS (SELECT concat('org_', n_nationkey) AS repo_id, CAST(0 AS BIGINT) AS ord, 'info@' || lower(replace(n_name, ' ', '')) || '.example.org' AS email, 'github_org' AS source, lower(replace(n_name, ' ', '')) || '.example.org' AS domain, false AS is_personal, 'org_contact' AS role, n_name AS name FROM nation WHERE n_nationkey % 4 > 0 AND n_nationkey % 5 > 0), "
    "mn AS MATERIALIZED (SELECT repo_id, ord, email, 'pyproject_toml' AS source, lower(string_split(email, '@')[-1]) AS domain, lower(string_split(email, '@')[-1]) IN (" + ", ".join(f"'{d}'" for d in K.PERSONAL) + ") AS is_personal, 'package_author' AS role, CAST(NULL AS VARCHAR) AS name "
    "FROM (SELECT concat('org_', doc_id % 25) AS repo_id, unnest(m) AS email, CAST(generate_subscripts(m, 1) - 1 AS BIGINT) AS ord FROM (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}') AS m FROM documents)) WHERE NOT regexp_matches(lower(email), '(noreply|no-reply|users\\.noreply\\.github\\.com)')), "
)
_BEST = (
    "al AS (SELECT *, 0 AS rank FROM ct UNION ALL SELECT *, 1 FROM og UNION ALL SELECT *, 2 FROM mn), on1 AS MATERIALIZED (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY repo_id, lower(email) ORDER BY rank, ord, email) = 1), "
    "bs AS (SELECT repo_id, email, role, count(*) OVER (PARTITION BY repo_id) AS contacts FROM on1 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY is_personal, coalesce(list_position(" + repr(K.RANKS) + ", role), 6), email) = 1), "
    "cd AS (SELECT repo_id, domain FROM (SELECT repo_id, domain, count(*) AS n FROM on1 WHERE NOT is_personal AND domain <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, domain DESC) = 1) "
    "SELECT bs.repo_id, contacts, email AS best_email, role AS best_role, domain AS corporate_domain FROM bs LEFT JOIN cd USING (repo_id)"
)
_COLS = "repo_id, ord, email, source, domain, is_personal, role, name"

QUERIES = [
    Query("j24_contributor_contacts", lambda c: K.from_contributors(commits(c), people(c)), "WITH " + _WHO.rstrip(", ") + f" SELECT {_COLS} FROM ct"),
    Query("j25_org_contacts", lambda c: K.from_org(orgs(c)), "WITH " + _WHO.rstrip(", ") + f" SELECT {_COLS} FROM og"),
    Query("j23_manifest_contacts", lambda c: K.from_manifest(manifests(c)), "WITH " + _WHO.rstrip(", ") + f" SELECT {_COLS} FROM mn"),
    Query("j31_extracted_contacts", lambda c: K.extracted(K.from_contributors(commits(c), people(c)), K.from_org(orgs(c)), K.from_manifest(manifests(c))), "WITH " + _WHO + _BEST),
]
