"""Matches of graphs are found by shape; no behavior of the known graphs is computed for them."""

from __future__ import annotations

from spoor.operators import fingerprint as I
from spoor.operators import risk as P
from spoor.plans import q_matching as Q
from spoor.plans.corpus import Corpus
from spoor.plans.q_knowledge import classified, patterns
from spoor.session import shuffled_joins

SF = "/root/testdata/sf0.001"


def test_matches_leave_behavior_alone(spark):
    shuffled_joins(spark)
    c = Corpus(spark, SF)
    cols = ["repo_id", "pattern_id", "match_type", "similarity_score"]
    got = sorted(map(tuple, Q.matches(c).select(*cols).collect()))
    assert "events" not in vars(c) and not {"patterns", "node_behavior", "repo_behavior", "motif_nodes"} & set(c._kept)
    assert {r[2] for r in got} == {"exact_motif", "structural_similarity", "archetype"} and len({r[:2] for r in got}) == len(got)

    kb = patterns(c)  # with behavior, the best score per graph and pattern
    exact = P.exact_matches(I.repo_motifs(Q.trade_flags(c), c.trade_nodes), kb)
    shape = P.archetype_matches(Q.trade_classified(c), I.archetype_prevalence(classified(c)), kb)
    assert got == sorted(map(tuple, P.best_matches(exact, Q.similar(c), shape).select(*cols).collect()))
