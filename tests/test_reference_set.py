"""Reference set and lazy greedy selection against plain versions."""

import random
from collections import Counter

from pyspark.sql import functions as F

from spoor.operators import reference_set as R
from spoor.operators import selection as N
from spoor.operators.greedy import lazy_greedy

SCHEMA = "repo_id string, agent_count int, crew_sizes array<int>, frameworks array<string>, finding_rules array<string>, tool_count int, deployment_score int, has_lockfile boolean, has_container boolean, has_guardrails boolean, diameter int"


def some_repos(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rules = sorted({f"{rng.choice(['A', 'B', 'TELEMETRY', 'C-X'])}-{rng.randrange(9)}" for _ in range(rng.randrange(5))})
        rows.append((f"r{i:04d}", rng.choice([None, 0, 1, 2, 3, 6, 12, 20, 40, 300]), rng.choice([None, [], [2, 5], [60]]), rng.choice([None, [], ["LangGraph"], ["x", "AutoGen"], ["CrewAI"], ["LangChain", "CrewAI"], ["LangChain"]]),
                     rng.choice([None, rules, rules, rules]), rng.choice([None, 0, 2]), rng.choice([None, 0, 1, 4, 7]), rng.choice([None, True, False]), rng.random() < 0.3, rng.choice([None, True, False, False]), rng.choice([None, 1, 4])))
    return rows


def plain_set(rows, target, floors):
    """The whole choice in loops over dictionaries."""
    names = SCHEMA.replace("<int>", "").replace("<string>", "")
    cols = [c.split()[0] for c in names.split(", ")]
    pool, best = [], {}
    for r in (dict(zip(cols, x)) for x in rows):
        seen = r["agent_count"] or 0
        raw = max(r["crew_sizes"]) if seen < 2 and r["crew_sizes"] else seen
        fws, rules = r["frameworks"] or [], r["finding_rules"] or []
        fw = next((f for f in fws if f in R.FRAMEWORK_SHARE), fws[0] if fws else "none")
        if raw < 2 or fw not in R.FRAMEWORK_SHARE or ((r["tool_count"] or 0) < 1 and raw < 3):
            continue
        telling = [x for x in rules if not x.startswith("TELEMETRY")]
        d = r | {"fw": fw, "ac": min(raw, 50), "rules": rules, "telling": telling, "prefixes": {x.rsplit("-", 1)[0] for x in rules}}
        key = (fw, d["ac"], tuple(rules))
        if key not in best or (-(r["deployment_score"] or 0), r["repo_id"]) < (-(best[key]["deployment_score"] or 0), best[key]["repo_id"]):
            best[key] = d
    pool = sorted(best.values(), key=lambda d: d["repo_id"])
    held = Counter(x for d in pool for x in d["rules"])

    def score(d, chosen):
        if not d["telling"]:
            found = -10
        else:
            found = sum(6 if held[x] < 50 else 3 if held[x] < 200 else 1 if held[x] < 500 else 0 for x in d["telling"])
            found = min(35, found + {5: 15, 4: 10, 3: 5}.get(min(5, len(d["prefixes"])), 0))
        ac = d["ac"]
        arch = 4 if ac == 2 else 20 if ac <= 7 else 18 if ac <= 15 else 12 if ac <= 30 else 6
        arch = min(30, arch + 5 * ((d["diameter"] or 0) > 2) + 5 * bool(d["has_guardrails"]))
        run = min(15, min(10, 2 * (d["deployment_score"] or 0)) + 3 * bool(d["has_lockfile"]) + 2 * bool(d["has_container"]))
        gap = R.FRAMEWORK_SHARE[d["fw"]] - chosen[d["fw"]] / max(1, sum(chosen.values()))
        return found + arch + run + (min(20, int(gap * 200)) if gap > 0 else 0)

    order = sorted(pool, key=lambda d: (-score(d, Counter()), d["repo_id"]))
    chosen, ranked = Counter(), []
    for d in order:
        if len(ranked) >= target * 1.3:
            break
        ranked.append([score(d, chosen), d, None])
        chosen[d["fw"]] += 1
    picked = sorted(ranked, key=lambda x: -x[0])[:target]
    taken = {x[1]["repo_id"] for x in picked}
    groups = [
        [(f"framework_floor:{f}", lambda d, f=f: d["fw"] == f, floors["per_framework"]) for f in sorted(R.FRAMEWORK_SHARE)],
        [(f"finding_prefix_floor:{p}", lambda d, p=p: p in d["prefixes"], floors["per_prefix"]) for p in sorted({p for d in pool for p in d["prefixes"]})],
        [("guardrail_floor", lambda d: bool(d["has_guardrails"]), floors["with_guardrails"])],
    ]
    for group in groups:
        lacks = [least - sum(cond(x[1]) for x in picked) for _, cond, least in group]
        for (name, cond, _), need in zip(group, lacks):
            more = sorted((d for d in pool if cond(d) and d["repo_id"] not in taken), key=lambda d: (-len(d["telling"]), d["repo_id"]))
            for d in more[: max(0, need)]:
                picked.append([0, d, name])
                taken.add(d["repo_id"])
    picked.sort(key=lambda x: -x[0])
    if len(picked) > target:
        kept, out = Counter(), []
        for x in picked:
            if kept[x[1]["fw"]] < int(target * R.FRAMEWORK_SHARE[x[1]["fw"]] * 1.1):
                kept[x[1]["fw"]] += 1
                out.append(x)
        picked = out[:target]
    turn = Counter()
    out = {}
    for s, d, fill in picked:
        out[d["repo_id"]] = (s, fill, "AB"[turn[d["fw"]] % 2])
        turn[d["fw"]] += 1
    return out


def test_reference_set(spark):
    for n, target, floors in ((600, 40, {"per_framework": 9, "per_prefix": 22, "with_guardrails": 20}), (60, 500, {"per_framework": 3, "per_prefix": 5, "with_guardrails": 9})):
        rows = some_repos(n)
        got = R.choose(spark.createDataFrame(rows, SCHEMA), target=target, **floors).collect()
        want = plain_set(rows, target, floors)
        assert {r["repo_id"]: (r["score"], r["coverage_fill"], r["split"]) for r in got} == want
        assert any(f for _, f, _ in want.values()) or n < 100
    assert R.choose(spark.createDataFrame([], SCHEMA), target=5).count() == 0


def test_lazy_greedy_reads_little_and_equals_full_scoring(spark):
    rng = random.Random(7)
    rows = [(f"r{i:05d}", rng.choice("abcdef"), rng.random(), rng.choice([None, *[f"t{j}" for j in range(60)]])) for i in range(3000)]
    df = spark.createDataFrame(rows, "repo_id string, kind string, quality double, topo string")

    def value(counts):
        v = F.lit(0.0)
        for k in "abcdef":
            v = F.when(F.col("kind") == k, 1.0 / (1 + counts.get(k, 0))).otherwise(v)
        return v + F.col("quality") + F.when(F.col("_seen"), 0.0).otherwise(0.5)

    seen = []
    got = lazy_greedy(df, 60, lambda n: 1 if n < 5 else 10, value, lambda d: d.groupBy(F.col("kind").alias("key")).agg(F.count("*").alias("n")), "topo", block=200, on_round=lambda read, total: seen.append(read / total))
    counts, topos, left, want = Counter(), set(), list(rows), []
    while len(want) < 60:
        worth = lambda r: round(1.0 / (1 + counts[r[1]]) + r[2] + (0.0 if r[3] in topos and r[3] else 0.5), 9)
        now = sorted(left, key=lambda r: (-worth(r), r[0]))[: 1 if len(want) < 5 else min(10 - (len(want) - 5) % 10, 60 - len(want))]
        now = now[:10]
        want += [r[0] for r in now]
        counts.update(r[1] for r in now)
        topos |= {r[3] for r in now if r[3]}
        left = [r for r in left if r not in now]
    assert [r["repo_id"] for r in got.orderBy("pick").collect()] == want
    assert sum(seen) / len(seen) < 0.5


def test_discovery_of_few(spark):
    cols = "repo_id string, framework string, agent_count int, finding_ids array<string>, present_control_types array<string>, topology_hash string, estimated_runnability double, xcomp_findings array<string>"
    rows = [(f"r{i}", "crewai" if i % 2 else "agno", i % 9, ["STRAT-DC-001"][: i % 2], [], f"t{i % 3}" if i % 4 else "", 0.1 * (i % 7), []) for i in range(12)]
    got = N.select_for_discovery(spark.createDataFrame(rows, cols), 30)
    assert sorted(r["pick"] for r in got.collect()) == list(range(1, 13))
    assert N.select_for_discovery(spark.createDataFrame([], cols), 5).count() == 0
