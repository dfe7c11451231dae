"""Policy documents in columns: what is wrong with one, and the search settings it stands for.

A document is a VARIANT column (``F.try_parse_json``). Rules are a table of paths, so a table of policies is checked in
one projection without Python. A document that is no object, or no JSON at all, has one error and the default settings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, domains and defaults of a policy document.
SCOPE_NAMES = ["session", "project", "principle"]
HYBRID_NUMBERS = ["alpha", "threshold", "k_txt", "k_vec", "k_final", "recency_half_life_days"]
HYBRID_OBJECTS = ["mmr", "query_expansion", "feedback_boost", "topology"]
TOPOLOGY_KEYS = ["enabled", "mode", "seed_k", "max_hops", "hop_decay", "include_paths", "edge_policy"]
EDGE_KEYS = ["weight", "direction", "action"]
DIRECTIONS = ["forward", "both"]
ACTIONS = ["boost", "flag_conflict", "shadow_old"]
EDGES = {
    "supports": (0.9, "forward", "boost"),
    "extends": (0.7, "forward", "boost"),
    "related": (0.35, "both", "boost"),
    "contradicts": (0.15, "both", "flag_conflict"),
    "supersedes": (1.0, "forward", "shadow_old"),
}
FEEDBACK_FIELDS = ["helpful_weight", "harmful_weight", "outdated_weight", "duplicate_weight", "min_multiplier", "max_multiplier"]

HYBRID = "$.retrieval.hybrid"
TOPOLOGY = HYBRID + ".topology"


def at(document: Column, path: str) -> Column:
    """What stands at a path, as VARIANT; null if nothing does (a JSON null is something)."""
    return F.try_variant_get(document, path, "variant")


def _is(value: Column, *kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike("^(" + "|".join(kinds) + r")\b"), F.lit(False))


def is_number(value: Column) -> Column:
    """A finite number; one too large for a double is none."""
    finite = F.abs(F.try_variant_get(value, "$", "double")) < float("inf")
    return F.coalesce(F.when(_is(value, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), finite), F.lit(False))


def number_of(value: Column) -> Column:
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


def text_of(value: Column) -> Column:
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def truth_of(value: Column) -> Column:
    return F.when(_is(value, "BOOLEAN"), F.try_variant_get(value, "$", "boolean"))


def given(value: Column) -> Column:
    """Present and neither null, zero, false nor an empty string."""
    empty = F.coalesce(number_of(value) == 0, text_of(value) == "", ~truth_of(value), F.lit(False))
    return value.isNotNull() & ~_is(value, "VOID") & ~empty


def _members(value: Column) -> Column:
    """An object as a map; null for anything else."""
    return F.when(_is(value, "OBJECT"), F.try_variant_get(value, "$", "map<string,variant>"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _unknown(field: str, value: Column, allowed: list[str]) -> Column:
    others = F.array_except(F.map_keys(_members(value)), F.array(*map(F.lit, allowed)))
    return F.coalesce(F.transform(others, lambda k: F.concat(F.lit(field + "."), k, F.lit(" is not allowed"))), _none())


def _typed(field: str, value: Column, rule: str | list[str]) -> list[Column]:
    """Messages about a value that is present; a list is the domain of a string."""
    if isinstance(rule, list):
        bad, what = ~F.coalesce(text_of(value).isin(*rule), F.lit(False)), "one of " + ", ".join(rule)
    else:
        bad = {"number": ~is_number(value), "integer": ~is_number(value), "boolean": ~_is(value, "BOOLEAN"), "object": ~_is(value, "OBJECT")}[rule]
        what = "number" if rule == "integer" else rule
    out = [F.when(value.isNotNull() & bad, F.lit(f"{field} must be {what}"))]
    if rule == "integer":
        out.append(F.when(number_of(value) != F.floor(number_of(value)), F.lit(f"{field} must be integer")))
    return out


def _boundary(v: Column) -> tuple[list[Column], list[Column]]:
    own, scopes, classes = at(v, "$.boundary"), at(v, "$.boundary.scopes"), at(v, "$.boundary.boundary_classes")
    is_object = _is(own, "OBJECT")
    said = [F.when(~given(own), F.lit("boundary missing")), F.when(~is_object, F.lit("boundary must be object"))]
    said += [F.when(is_object & ~given(x), F.lit(f"{name} missing")) for name, x in (("scopes", scopes), ("boundary_classes", classes))]
    for name in SCOPE_NAMES:
        scope = at(scopes, f"$.{name}")
        ttl = F.when(text_of(at(scope, "$.ttl")).isNull(), F.lit(f"scopes.{name}.ttl must be string"))
        said.append(F.when(is_object & given(scopes), F.when(~given(scope), F.lit(f"scopes.{name} missing")).otherwise(ttl)))
    said.append(F.when(is_object & given(classes) & ~_is(classes, "OBJECT"), F.lit("boundary_classes must be object")))

    def of_class(e: Column) -> Column:
        allow, redact = at(e["value"], "$.allow"), at(e["value"], "$.redact")
        name = F.concat(F.lit("boundary_classes."), e["key"])
        bad = [F.when(~_is(allow, "ARRAY"), F.concat(name, F.lit(".allow must be array"))), F.when(given(redact) & ~_is(redact, "ARRAY"), F.concat(name, F.lit(".redact must be array")))]
        return F.array_compact(F.array(*bad))

    return said, [F.coalesce(F.flatten(F.transform(F.map_entries(_members(classes)), of_class)), _none())]


def _topology(v: Column) -> tuple[list[Column], list[Column]]:
    top, edges = at(v, TOPOLOGY), at(v, TOPOLOGY + ".edge_policy")
    rules = {"enabled": "boolean", "mode": ["walk"], "seed_k": "integer", "max_hops": "integer", "hop_decay": "number", "include_paths": "boolean", "edge_policy": "object"}
    said = [m for k, rule in rules.items() for m in _typed(f"topology.{k}", at(top, f"$.{k}"), rule)]
    hops, decay = number_of(at(top, "$.max_hops")), number_of(at(top, "$.hop_decay"))
    said.append(F.when((hops == F.floor(hops)) & ~hops.between(0, 2), F.lit("topology.max_hops must be between 0 and 2")))
    said.append(F.when((decay <= 0) | (decay > 1), F.lit("topology.hop_decay must be greater than 0 and at most 1")))
    lists = [_unknown("retrieval.hybrid.topology", top, TOPOLOGY_KEYS), _unknown("topology.edge_policy", edges, list(EDGES))]
    for kind in EDGES:
        edge, name = at(edges, f"$.{kind}"), f"topology.edge_policy.{kind}"
        said += _typed(name, edge, "object")
        said += [m for k, rule in (("weight", "number"), ("direction", DIRECTIONS), ("action", ACTIONS)) for m in _typed(f"{name}.{k}", at(edge, f"$.{k}"), rule)]
        lists.append(_unknown(name, edge, EDGE_KEYS))
    return said, lists


def policy_errors(document: Column) -> Column:
    """All that is wrong with a policy document: messages, each once, in alphabetical order; empty if it is valid.

    Keys that are not known are refused under ``retrieval`` and what lies in it; elsewhere they are let through. Boundary
    classes that are no object are one error. Values are judged where they stand: below something that is no object nothing is.
    """
    retrieval, hybrid, maintenance = at(document, "$.retrieval"), at(document, HYBRID), at(document, "$.maintenance")
    said, lists = _boundary(document)
    more, more_lists = _topology(document)
    said, lists = said + more, lists + more_lists
    said.append(F.when(text_of(at(document, "$.version")).isNull(), F.lit("version must be string")))
    said += _typed("retrieval", retrieval, "object") + _typed("retrieval.hybrid", hybrid, "object") + _typed("maintenance", maintenance, "object")
    said += [m for k in HYBRID_NUMBERS for m in _typed(f"retrieval.hybrid.{k}", at(hybrid, f"$.{k}"), "number")]
    said += [m for k in HYBRID_OBJECTS for m in _typed(f"retrieval.hybrid.{k}", at(hybrid, f"$.{k}"), "object")]
    said += [m for k, rule in (("hints_enabled", "boolean"), ("similarity_threshold", "number"), ("stale_days", "number")) for m in _typed(f"maintenance.{k}", at(maintenance, f"$.{k}"), rule)]
    lists += [_unknown("retrieval", retrieval, ["hybrid"]), _unknown("retrieval.hybrid", hybrid, HYBRID_NUMBERS + HYBRID_OBJECTS)]
    found = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*said)), *lists)))
    return F.when(_is(document, "OBJECT"), found).otherwise(F.array(F.lit("policy must be object")))


def _limit(value: Column, default: int) -> Column:
    n = number_of(value)
    return F.coalesce(F.when(n > 0, F.greatest(F.lit(1), F.floor(n).cast("int"))), F.lit(default))


def search_settings(document: Column) -> Column:
    """The settings a policy document gives a search; whatever is absent, of another type or out of range takes its default.

    struct(alpha, threshold, k_text, k_vec, mmr, expansion, feedback, topology); the last four are null where they are off.
    Expansion, feedback and order by difference are off unless enabled is true, the walk is on unless it is false.
    """
    hybrid, top = at(document, HYBRID), at(document, TOPOLOGY)

    def where_on(name: str, fields: list[Column]) -> Column:
        return F.when(truth_of(at(hybrid, f"$.{name}.enabled")), F.struct(*fields)).alias({"query_expansion": "expansion", "feedback_boost": "feedback"}.get(name, name))

    share, decay = number_of(at(hybrid, "$.mmr.lambda")), number_of(at(top, "$.hop_decay"))
    mmr = [F.coalesce(F.when((share > 0) & (share < 1), share), F.lit(0.72)).alias("share"), _limit(at(hybrid, "$.mmr.max_candidates"), 48).alias("candidates")]
    sizes = (("max_seed_entities", 3), ("max_related_entities", 8), ("max_expansion_terms", 6))
    expansion = [_limit(at(hybrid, f"$.query_expansion.{k}"), n).alias(k) for k, n in sizes]
    feedback = [number_of(at(hybrid, f"$.feedback_boost.{k}")).alias(k) for k in FEEDBACK_FIELDS]

    def edge(kind: str) -> Column:
        weight, direction, action = EDGES[kind]
        own = at(top, f"$.edge_policy.{kind}")
        w, d, a = number_of(at(own, "$.weight")), text_of(at(own, "$.direction")), text_of(at(own, "$.action"))
        return F.struct(
            F.coalesce(F.when(w >= 0, w), F.lit(weight)).alias("weight"),
            F.coalesce(F.when(d.isin(*DIRECTIONS), d), F.lit(direction)).alias("direction"),
            F.coalesce(F.when(a.isin(*ACTIONS), a), F.lit(action)).alias("action"),
        )

    edges = F.create_map(*[x for kind in EDGES for x in (F.lit(kind), edge(kind))])
    walk = F.struct(
        _limit(at(top, "$.seed_k"), 6).alias("seed_k"), F.least(F.lit(2), _limit(at(top, "$.max_hops"), 2)).alias("max_hops"),
        F.coalesce(F.when((decay > 0) & (decay <= 1), decay), F.lit(0.75)).alias("hop_decay"),
        F.coalesce(truth_of(at(top, "$.include_paths")), F.lit(True)).alias("include_paths"), edges.alias("edges"),
    )
    return F.struct(
        F.coalesce(number_of(at(hybrid, "$.alpha")), F.lit(0.65)).alias("alpha"), F.coalesce(number_of(at(hybrid, "$.threshold")), F.lit(0.15)).alias("threshold"),
        _limit(at(hybrid, "$.k_txt"), 128).alias("k_text"), _limit(at(hybrid, "$.k_vec"), 256).alias("k_vec"),
        where_on("mmr", mmr), where_on("query_expansion", expansion), where_on("feedback_boost", feedback),
        F.when(F.coalesce(truth_of(at(top, "$.enabled")), F.lit(True)), walk).alias("topology"),
    )
