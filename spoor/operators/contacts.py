"""E-mail extraction from text, with role, domain and priority rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: address patterns, personal mail domains and role words
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
NO_REPLY = r"(?i)(noreply|no-reply|users\.noreply\.github\.com)"
PERSONAL = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "live.com", "aol.com", "icloud.com", "me.com", "mail.com", "protonmail.com", "proton.me", "yandex.com", "gmx.com", "zoho.com",
            "fastmail.com", "tutanota.com", "hey.com", "pm.me", "msn.com", "qq.com", "163.com", "126.com", "sina.com"]
ROLES = [("cto", r"(?i)\bcto\b"), ("founder", r"(?i)\bfounder\b"), ("lead", r"(?i)\b(lead|principal|staff|senior)\b"), ("maintainer", r"(?i)\b(maintainer|owner)\b"), ("developer", r"(?i)\b(dev|developer|engineer|contributor)\b")]
RANKS = ["cto", "founder", "lead", "maintainer", "developer", "contributor"]


def is_noreply(email: Column) -> Column:
    return email.rlike(NO_REPLY)


def email_domain(email: Column) -> Column:
    return F.when(email.contains("@"), F.lower(F.substring_index(email, "@", -1))).otherwise("")


def is_personal(email: Column) -> Column:
    return email_domain(email).isin(PERSONAL)


def text_emails(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, email): addresses in whole texts, no-reply ones left out."""
    e = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)))).alias("email"))
    return e.filter(~is_noreply(F.col("email")))


def role_of(login: Column, bio: Column, contributions: Column, top: Column) -> Column:
    text = F.concat_ws(" ", login, bio)
    out = None
    for r, rx in ROLES:
        out = F.when(text.rlike(rx), r) if out is None else out.when(text.rlike(rx), r)
    return out.when(top | (contributions > 100), "maintainer").when(contributions > 10, "developer").otherwise("contributor")


def merged_contacts(*sources: DataFrame) -> DataFrame:
    """Contacts (repo_id, email, role) of sources in order; the first source wins per address."""
    out = None
    for rank, s in enumerate(sources):
        s = s.select("repo_id", "email", "role", F.lit(rank).alias("source"))
        out = s if out is None else out.unionByName(s)
    return out.groupBy("repo_id", F.lower("email").alias("email")).agg(F.min_by("role", F.struct("source", "role")).alias("role"), F.min("source").alias("source"))


def best_contact(contacts: DataFrame) -> DataFrame:
    """One contact per repository: real before no-reply, corporate before personal, then role rank."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.col("role")), F.lit(0)), F.lit(len(RANKS)))  # other roles rank last
    key = F.struct(is_noreply(F.col("email")).alias("n"), is_personal(F.col("email")).alias("p"), rank.alias("r"), F.col("email"))
    return contacts.groupBy("repo_id").agg(F.min_by(F.struct("email", "role"), key).alias("c")).select("repo_id", "c.email", "c.role")


def corporate_domain(contacts: DataFrame) -> DataFrame:
    """The most frequent non-personal domain per repository."""
    d = contacts.select("repo_id", email_domain(F.col("email")).alias("domain"), is_personal(F.col("email")).alias("p")).filter("NOT p AND domain <> ''").groupBy("repo_id", "domain").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("repo_id").agg(F.max_by("domain", F.struct("n", "domain")).alias("corporate_domain"))


# ---- contacts by source -----------------------------------------------------------
def _contact(email: Column, source: str, role: Column, name: Column) -> list[Column]:
    return [email.alias("email"), F.lit(source).alias("source"), email_domain(email).alias("domain"), is_personal(email).alias("is_personal"), role.alias("role"), name.cast("string").alias("name")]


def from_contributors(emails: DataFrame, contributors: DataFrame) -> DataFrame:
    """Commit addresses with role and name of the contributor whose login their local part holds.

    emails(repo_id, ord, email), contributors(repo_id, ord, login, contributions). Addresses count once whatever their
    case, no-reply ones not at all. A contributor marks the first address that holds the login (without case; an empty
    login is held by all); of several contributors the last in order names an address. The first contributor is the
    top one. Null logins and addresses are left out. The holding is found by an index of character triples.
    """
    from spoor.operators.resolve import containing
    from spoor.session import land

    mail = emails.filter(F.col("email").isNotNull() & ~is_noreply(F.col("email"))).withColumn("plain", F.lower("email"))
    mail = mail.groupBy("repo_id", "plain").agg(F.min_by(F.struct("ord", "email"), F.struct("ord", "email")).alias("m")).select("repo_id", "m.ord", "m.email", F.substring_index("plain", "@", 1).alias("local"))
    mail = land(mail, "commit_addresses")
    people = contributors.filter("login IS NOT NULL").select("repo_id", F.col("ord").alias("at"), "login", F.coalesce("contributions", F.lit(0)).alias("contributions"), F.lower("login").alias("small"))
    top = contributors.groupBy("repo_id").agg(F.min_by("login", "ord").alias("top"))
    people = land(people.join(top, "repo_id"), "contributors")
    held = containing(people.select("repo_id", "small").distinct(), mail.select("repo_id", "local").distinct(), ["repo_id"], "small", "local").filter(F.contains(F.col("local"), F.col("small")))
    first = held.join(mail.select("repo_id", "local", "ord"), ["repo_id", "local"]).groupBy("repo_id", "small").agg(F.min("ord").alias("ord"))
    marks = people.join(first, ["repo_id", "small"]).withColumn("role", role_of(F.col("login"), F.lit(""), F.col("contributions"), F.col("login") == F.col("top")))
    last = marks.groupBy("repo_id", "ord").agg(F.max_by(F.struct("role", "login"), F.struct("at", "login")).alias("who"))
    out = mail.join(last, ["repo_id", "ord"], "left")
    return out.select("repo_id", "ord", *_contact(F.col("email"), "git_commits", F.coalesce("who.role", F.lit("contributor")), F.col("who.login")))


def from_org(orgs: DataFrame) -> DataFrame:
    """The address of an organisation's profile; orgs(repo_id, email, name)."""
    some = orgs.filter(F.col("email").isNotNull() & (F.col("email") != "") & ~is_noreply(F.col("email")))
    return some.select("repo_id", F.lit(0).cast("long").alias("ord"), *_contact(F.col("email"), "github_org", F.lit("org_contact"), F.col("name")))


def from_manifest(files: DataFrame) -> DataFrame:
    """Every address in a package file, in order, repeats included; files(repo_id, content)."""
    found = files.select("repo_id", F.posexplode(F.regexp_extract_all("content", F.lit(EMAIL), F.lit(0))).alias("ord", "email")).filter(~is_noreply(F.col("email")))
    return found.select("repo_id", F.col("ord").cast("long").alias("ord"), *_contact(F.col("email"), "pyproject_toml", F.lit("package_author"), F.lit(None)))


def extracted(*sources: DataFrame) -> DataFrame:
    """(repo_id, contacts, best email and role, corporate_domain): the sources in order, an address from the first that has it.

    The corporate domain is the one most contacts outside personal mail use, ties to the later name.
    """
    ranked = None
    for rank, s in enumerate(sources):
        s = s.select("repo_id", "email", "role", "domain", "is_personal", F.lit(rank).alias("rank"), "ord")
        ranked = s if ranked is None else ranked.unionByName(s)
    one = ranked.groupBy("repo_id", F.lower("email").alias("address")).agg(F.min_by(F.struct("email", "role"), F.struct("rank", "ord", "email")).alias("c")).select("repo_id", "c.*")
    out = one.groupBy("repo_id").agg(F.count(F.lit(1)).alias("contacts")).join(best_contact(one), "repo_id").join(corporate_domain(one), "repo_id", "left")
    return out.select("repo_id", "contacts", F.col("email").alias("best_email"), F.col("role").alias("best_role"), "corporate_domain")
