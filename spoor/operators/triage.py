"""What a repository's file list says: where it can be started, what it may do without, how mature it is.

Files are a tall table (repo_id, path); one pass turns each path into marks, and sums or ranks per repository
follow. No list of files is held in one value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spoor.functions.stats import bool_or

# fixed values: files that start a program, with the confidence that they do
START_FILES = {"main.py": 0.85, "app.py": 0.8, "run.py": 0.75, "cli.py": 0.7}
CLI, PACKAGE, EXAMPLE, TEST = 0.9, 0.85, 0.6, 0.5
# fixed values: paths and words of the maturity signals
CI_PATHS = [".github/workflows", ".circleci", "Jenkinsfile", ".travis.yml", ".gitlab-ci.yml", "azure-pipelines.yml", "bitbucket-pipelines.yml"]
CONTAINER_FILES = ["Dockerfile", "docker-compose.yml", "docker-compose.yaml", "k8s/", "kubernetes/", "helm/", "Chart.yaml"]
MONITORING_WORDS = ["prometheus", "grafana", "datadog", "newrelic", "sentry", "opentelemetry", "otel", "jaeger"]
SECRET_WORDS = ["vault", "aws-secretsmanager", "sops", ".sealed-secret", "external-secrets", "doppler"]
LICENSES = ["mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "mpl-2.0", "lgpl-2.1", "lgpl-3.0", "isc"]
TEST_FOLDERS = ["tests", "test", "spec", "__tests__", "testing"]
DEPLOY_WORDS = r"(?i)\b(deploy|deployment|production|staging|infrastructure|terraform|pulumi|cloudformation)\b"


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def entry_points(files: DataFrame, packages: DataFrame, commands: DataFrame) -> DataFrame:
    """(repo_id, rank, path, strategy, confidence, command): ways to start each repository, most likely first.

    files(repo_id, path), packages(repo_id, primary_package), commands(repo_id, ord, entry_point) from its manifest. Of the
    test files only the first by name counts. Equal confidence: commands, then start files, package, examples, tests, by
    order or name. A path counts once, with or without './' in front.
    """
    p = files.filter("path IS NOT NULL").select("repo_id", _plain(F.col("path")).alias("path")).distinct()
    low, python = F.lower("path"), F.col("path").endswith(".py")
    known = F.lit(None).cast("double")
    for name, c in START_FILES.items():
        known = F.when(F.col("path") == name, F.lit(c)).otherwise(known)
    row = lambda strategy, confidence, order, tie, command: [F.lit(strategy).alias("strategy"), confidence.alias("confidence"), F.lit(order).alias("part"), tie.alias("tie"), command.alias("command")]
    run = F.concat(F.lit("python "), "path")
    start = p.filter(known.isNotNull()).select("repo_id", "path", *row("standard_file", known, 1, F.col("path"), run))
    package = packages.filter("primary_package <> ''").withColumn("path", F.concat("primary_package", F.lit("/__main__.py"))).join(p, ["repo_id", "path"], "left_semi")
    package = package.select("repo_id", "path", *row("package_main", F.lit(PACKAGE), 2, F.col("path"), F.concat(F.lit("python -m "), "primary_package")))
    shown = p.filter(python & (low.contains("example") | low.contains("demo"))).select("repo_id", "path", *row("example_script", F.lit(EXAMPLE), 3, F.col("path"), run))
    tests = p.filter(python & low.contains("test")).groupBy("repo_id").agg(F.min("path").alias("path"))
    tests = tests.select("repo_id", "path", *row("test_execution", F.lit(TEST), 4, F.col("path"), F.concat(F.lit("pytest "), "path", F.lit(" -x --timeout=120"))))
    module = F.replace(F.substring_index("entry_point", ":", 1), F.lit("."), F.lit("/"))
    told = commands.select("repo_id", F.col("entry_point").alias("path"), *row("cli_entry_point", F.lit(CLI), 0, F.lpad(F.col("ord").cast("string"), 12, "0"), F.concat(F.lit("python -m "), module)))
    out = told.unionByName(start).unionByName(package).unionByName(shown).unionByName(tests)
    order = W.partitionBy("repo_id").orderBy(F.desc("confidence"), "part", "tie")
    return out.withColumn("rank", F.row_number().over(order)).select("repo_id", "rank", "path", "strategy", "confidence", "command")


def optional_dependencies(extras: DataFrame) -> DataFrame:
    """(repo_id, dependency) that stand in any optional group; extras(repo_id, extra, dependencies)."""
    return extras.select("repo_id", F.explode("dependencies").alias("dependency")).filter("dependency IS NOT NULL").distinct()


def _starts(path: Column, heads: list[str]) -> Column:
    return sum((path.startswith(h).cast("int") for h in heads), F.lit(0)) > 0


def _holds(path: Column, words: list[str]) -> Column:
    return F.lower(path).rlike("|".join(map(re.escape, words)))


def maturity_scores(repos: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """(repo_id, org_signals, code_maturity, production_signals), at most 30, 35 and 35.

    repos(repo_id, is_organization, website, homepage, public_repos, contributors, pushed_at, readme, license); files(repo_id,
    path). Public repositories and the website count for organisations with a profile (public_repos not null); a homepage
    stands in for the website. Nulls count as absent.
    """
    p = F.col("path")
    folder = F.lit(False)
    for t in TEST_FOLDERS:
        folder = folder | (p == t) | p.startswith(f"{t}/")
    marks = {"ci": _starts(p, CI_PATHS), "container": _starts(p, CONTAINER_FILES), "monitoring": _holds(p, MONITORING_WORDS), "env": p.isin(".env", ".env.example"), "secrets": _holds(p, SECRET_WORDS), "tests": folder}
    seen = files.filter(p.isNotNull()).groupBy("repo_id").agg(*[bool_or(m).alias(n) for n, m in marks.items()])
    d = repos.join(seen, "repo_id", "left").fillna(False, list(marks))
    points = lambda n, cond: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    told = F.when(F.col("public_repos").isNotNull() & (F.coalesce("website", F.lit("")) != ""), True).otherwise(F.coalesce("homepage", F.lit("")) != "")
    people = F.coalesce("contributors", F.lit(0))
    org = points(10, F.col("is_organization")) + points(10, told) + points(5, F.col("public_repos") >= 10) + points(5, people >= 5)
    fresh = F.col("pushed_at").cast("timestamp") > now - F.expr("INTERVAL 90 DAYS")
    code = points(10, F.col("ci")) + points(5, F.col("container")) + points(5, F.col("monitoring")) + points(5, people >= 3) + points(5, fresh)
    live = points(10, F.col("readme").rlike(DEPLOY_WORDS)) + points(5, F.col("env")) + points(5, F.col("secrets")) + points(5, F.lower("license").isin(LICENSES)) + points(5, F.col("tests"))
    cap = lambda s, n: F.least(s, F.lit(n)).cast("int")
    return d.select("repo_id", cap(org, 30).alias("org_signals"), cap(code, 35).alias("code_maturity"), cap(live, 35).alias("production_signals"))
