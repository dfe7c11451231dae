"""What follows a promotion: links in both directions, other scopes, equal hashes, odd vectors, ties."""

import datetime

from lodestone.operators.promotion import after_promotion, promoted_vectors

DAY = datetime.datetime(2024, 1, 1)


def vector(cosine):
    return [cosine, (1 - cosine * cosine) ** 0.5]


def test_similar_and_suggested(spark):
    rows = [("a", "p", "h", DAY, [1.0, 0.0])]
    rows += [("same", "p", "h", DAY, vector(0.99)), ("near", "p", "n", DAY, vector(0.9)), ("far", "q", "f", DAY, vector(0.9))]
    rows += [(f"s{i}", "q", f"s{i}", DAY + datetime.timedelta(i % 2), vector(0.5)) for i in range(7)]
    rows += [("nil", "p", "x", DAY, [0.0, 0.0]), ("none", "p", "y", DAY, None), ("empty", "p", "z", DAY, [])]
    kinds = "id string, scope string, hash string, created_at timestamp_ntz, embedding array<double>"
    table = spark.createDataFrame(rows, kinds)
    asked = spark.createDataFrame([("a", "p", "h", [1.0, 0.0], True), ("near", "p", "n", vector(0.9), False), ("none", "p", "y", None, True)], "id string, scope string, hash string, embedding array<double>, is_new boolean")
    links = spark.createDataFrame([("a", "s1"), ("s3", "a"), ("a", "s1")], "source_claim_id string, target_claim_id string")
    alike, free = after_promotion(asked, table.union(table), links)
    got = {(r.id, r.other, round(r.similarity, 6)) for r in alike.collect()}
    assert {g for g in got if g[0] == "a"} == {("a", "near", 0.9)} and ("near", "a", 0.9) in got
    # The newest of equal scores first, then the smallest id; linked ones left out.
    assert [(r.id, r.target, r.score) for r in sorted(free.collect(), key=lambda r: r.place)] == [("a", s, 0.75) for s in ("s5", "s0", "s2", "s4", "s6")]
    none = after_promotion(asked.limit(0), table, links)
    assert none[0].count() == 0 and none[1].count() == 0
    assert after_promotion(asked, table.limit(0), links)[1].count() == 0


def test_confidential_texts_are_redacted(spark):
    rows = spark.createDataFrame([("a", "mail to bo@ex.org now", "pii"), ("b", "mail to [REDACTED] now", "public"), ("c", "mail to bo@ex.org now", "public"), ("d", "mail to bo@ex.org now", None)], "id string, text string, boundary_class string")
    got = {r.id: r.embedding for r in promoted_vectors(rows).collect()}
    assert got["a"] == got["b"] == got["d"] != got["c"]
