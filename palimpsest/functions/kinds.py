"""The closed vocabulary of relations and entity kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CANONICAL = [
    "mentions", "relates_to", "caused", "prevents", "mitigates", "fixes", "enables", "triggers", "contains", "part_of", "depends_on", "has_attribute",
    "uses", "produces", "stores", "exposes", "connects_to", "routes_to", "implements", "defines", "configures", "validates", "calls", "references",
    "documents", "decided", "contradicts", "alternative_to", "replaces", "located_in", "happened_at", "works_for", "owned_by", "prefers", "avoids",
    "changed_from", "lives_in", "current_role", "current_employer", "current_address", "married_to", "reports_to",
]
# fmt: off
SYNONYMS = {
    "related_to": "relates_to",
    "used_in": "uses", "uses_provider": "uses", "uses_service": "uses", "used_for": "uses", "can_use": "uses", "uses_technology": "uses",
    "used": "uses", "uses_flag": "uses", "uses_mode": "uses", "uses_config": "uses", "uses_parameter": "uses", "will_use": "uses",
    "includes": "contains", "has_component": "contains", "has_part": "contains", "has_phase": "contains", "has_route": "contains",
    "has_property": "contains", "has_method": "contains", "has_column": "contains", "has_service": "contains", "has_instance": "contains",
    "has_command": "contains", "has_mode": "contains", "has_feature": "contains", "has_link": "contains",
    "implemented_in": "located_in", "stored_in": "located_in", "stores_in": "located_in", "documented_in": "located_in", "tested_in": "located_in",
    "deployed_on": "located_in", "runs_on": "located_in", "tested_on": "located_in", "validated_on": "located_in", "applied_in": "located_in",
    "deployed_to": "located_in", "configured_in": "located_in", "locates_in": "located_in", "implemented_on": "located_in",
    "belongs_to": "part_of", "is_instance_of": "part_of", "instance_of": "part_of", "is_type_of": "part_of", "is_a": "part_of",
    "version_of": "part_of", "endpoint_of": "part_of", "member_of": "part_of",
    "creates": "produces", "created": "produces", "produced": "produces", "generates": "produces", "generated": "produces", "outputs": "produces",
    "executes": "calls", "performs": "calls", "runs": "calls", "dispatches": "calls", "executes_after": "calls", "performed": "calls",
    "requires": "depends_on", "based_on": "depends_on", "gated_by": "depends_on", "needs": "depends_on", "constrained_by": "depends_on",
    "requires_env": "depends_on", "alternatively_requires": "depends_on",
    "routes": "routes_to", "redirects_to": "routes_to", "feeds_into": "routes_to", "uploads_to": "routes_to", "writes_to": "routes_to",
    "sends": "routes_to", "dispatches_to": "routes_to", "sends_to": "routes_to", "syncs_to": "routes_to", "pushes_to": "routes_to",
    "persists_to": "routes_to", "outputs_to": "routes_to", "backed_up_to": "routes_to", "added_to": "routes_to", "copied_to": "routes_to",
    "routed_to": "routes_to",
    "checks": "validates", "verifies": "validates", "verifies_quota": "validates", "evaluates": "validates", "monitors": "validates",
    "detects": "validates", "confirms": "validates", "tested": "validates", "tests": "validates",
    "resolves": "fixes", "solves": "fixes", "addresses": "fixes", "resolved": "fixes", "fixed": "fixes", "fixed_in": "fixes",
    "points_to": "references", "links_to": "references", "refers_to": "references",
    "integrates_with": "connects_to", "connects": "connects_to", "connected": "connects_to", "connects_via": "connects_to", "binds_to": "connects_to",
    "causes": "caused", "resulted_in": "caused", "produced_result": "caused",
    "has_quota": "has_attribute", "has_capability": "has_attribute", "has_flag": "has_attribute", "has_permission": "has_attribute",
    "has_credential": "has_attribute", "has_capital": "has_attribute",
    "protects": "prevents", "guards": "prevents", "blocks": "prevents", "excludes": "prevents",
    "allows": "enables", "authorizes": "enables", "unlocks": "enables", "grants": "enables",
    "describes": "documents", "states": "documents", "stated": "documents",
    "specifies": "defines", "defines_service": "defines", "defines_limits": "defines",
    "specializes_in": "works_for",
    "implemented_as": "implements", "implemented": "implements",
    "differs_from": "contradicts", "contrasts_with": "contradicts", "violates": "contradicts", "incompatible_with": "contradicts",
    "falls_back_to": "alternative_to", "fallback_to": "alternative_to", "variant_of": "alternative_to",
    "merged_into": "replaces",
    "configured_with": "configures",
    "persists": "stores", "saved_as": "stores", "writes": "stores",
    "exposes_endpoint": "exposes", "exposed_as": "exposes",
    "happens_at": "happened_at", "scheduled_for": "happened_at",
    "triggers_at": "triggers",
    "decided_at": "decided",
}
# fmt: on
ONE_TO_ONE = ["located_in", "lives_in", "works_for", "current_role", "current_employer", "current_address", "married_to", "reports_to"]
WALKED = ["caused", "depends_on", "fixes", "prevents", "mitigates", "enables", "changed_from", "contradicts", "alternative_to", "replaces", "decided", "prefers", "avoids"]
ENTITY_KINDS = ["person", "place", "date", "concept", "event", "organization", "preference", "lesson", "project", "technology", "service", "file", "config", "metric"]
INPUT_DOMAINS = ["memory", "knowledge", "guideline", "skill"]


def edge_kind(kind: Column) -> Column:
    """The canonical kind; what is unknown relates_to, as its direction is unknown too."""
    known = {k: k for k in CANONICAL} | SYNONYMS
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(kind))), F.lit("relates_to"))


def entity_kind(kind: Column) -> Column:
    k = F.lower(F.trim(kind))
    return F.when(k.isin(*ENTITY_KINDS), k).otherwise("concept")


def input_domain(domain: Column) -> Column:
    d = F.lower(F.trim(domain))
    return F.when(d.isin(*INPUT_DOMAINS), d).otherwise("memory")
