"""Contacts against a plain loop over contributors and addresses."""

import random

from pyspark.sql import functions as F

from spoor.operators import contacts as K


def plain(mails, people):
    out = {}
    for repo in {m[0] for m in mails}:
        seen, kept = set(), []
        for _, ord_, email in sorted((m for m in mails if m[0] == repo), key=lambda m: m[1]):
            if email and "noreply" not in email.lower() and email.lower() not in seen:
                seen.add(email.lower())
                kept.append([ord_, email, "contributor", None])
        mine = sorted((p for p in people if p[0] == repo), key=lambda p: p[1])
        for i, (_, _, login, n) in enumerate(mine):
            if login is None:
                continue
            words = login.split(" ")
            role = "lead" if "lead" in words else "maintainer" if login == mine[0][2] or n > 100 else "developer" if n > 10 else "contributor"
            for k in kept:
                if login.lower() in k[1].split("@")[0].lower():
                    k[2:] = [role, login]
                    break
        for k in kept:
            out[repo, k[0]] = tuple(k[1:])
    return out


def test_contributors(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abC") for _ in range(rng.randint(0, n)))
    mails = [(f"r{rng.randrange(4)}", i, rng.choice([f"{word(6)}@x.org", f"{word(5)}@gmail.com", "noreply@x.org", None])) for i in range(120)]
    people = [(f"r{rng.randrange(4)}", i, rng.choice([word(4), word(3), "lead " + word(1), None]), rng.choice([0, 20, 300])) for i in range(60)]
    got = K.from_contributors(spark.createDataFrame(mails, "repo_id string, ord long, email string"), spark.createDataFrame(people, "repo_id string, ord long, login string, contributions int"))
    assert {(r["repo_id"], r["ord"]): (r["email"], r["role"], r["name"]) for r in got.collect()} == plain(mails, people)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_sources_in_order(spark):
    org = K.from_org(spark.createDataFrame([("r", "Info@a.io", "A"), ("s", "no-reply@a.io", "B"), ("t", "", "C"), ("u", None, "D")], "repo_id string, email string, name string"))
    doc = K.from_manifest(spark.createDataFrame([("r", "x <info@A.io> me@gmail.com"), ("s", None), ("v", "q@b.dev, z@b.dev")], "repo_id string, content string"))
    got = {r["repo_id"]: tuple(r)[1:] for r in K.extracted(org, doc).collect()}
    assert got == {"r": (2, "Info@a.io", "org_contact", "a.io"), "v": (2, "q@b.dev", "package_author", "b.dev")}
    assert K.extracted(org.filter(F.lit(False)), doc.filter(F.lit(False))).count() == 0
