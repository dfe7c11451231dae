"""The audit and its summary hold every finding: all cycles of large parts, and all subjects of a kind."""

from lodestone.plans import graphs
from lodestone.runtime import bounded
from lodestone.sources.fixtures import Tables
from tests.conftest import SF

#: A part of 30 claims with two cycles: a ring, and one that takes a shorter way.
RING = [(f"k{i:02d}", f"k{(i + 1) % 30:02d}") for i in range(30)] + [("k03", "k28")]
CYCLES = {">".join(f"k{i:02d}" for i in range(30)), ">".join(f"k{i:02d}" for i in (0, 1, 2, 3, 28, 29))}


def tables(spark):
    t = Tables(bounded(spark), SF)
    t.claim_links = spark.createDataFrame([(f"l{k}", u, v, "contradicts", 0.5) for k, (u, v) in enumerate(RING)], "id string, source_claim_id string, target_claim_id string, link_type string, confidence double")
    return t


def test_a_summary_counts_every_cycle_of_a_large_part(spark):
    assert {r.kind: r.n for r in graphs.g11s(tables(spark)).collect()}["contradiction_cycle"] == 2


def test_an_audit_lists_every_finding(spark):
    rows = graphs.g11(tables(spark)).collect()
    held = {}
    for r in rows:
        held.setdefault(r.kind, []).append(r)
    assert set(CYCLES) == {r.subject for r in held["contradiction_cycle"]}
    assert len(held["orphan_entity"]) > 20
    assert all(r.total == len(found) for found in held.values() for r in found)
