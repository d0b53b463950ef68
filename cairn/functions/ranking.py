"""Scopes, confidences and the priors of completion ranking as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SOURCE_PRIOR = {"local": 12000, "overlay": 9000, "indexed": 5000, "builtin": 2000, "word": 0, "fallback": -1000}
SOURCE_PRIORITY = {"local": 5, "overlay": 4, "indexed": 3, "builtin": 2, "word": 1, "fallback": 0}
SCOPE_PRIOR = {"current": 6000, "reachable": 4800, "external": 4200, "unknown": 3200, "global": 2400}
CONFIDENCE_PRIOR = {"exact": 2000, "reachable": 1500, "heuristic": 1000, "ambiguous": 500, "fallback": 0}
CONFIDENCE_RANK = {"exact": 4, "reachable": 3, "heuristic": 2, "ambiguous": 1, "fallback": 0}
ROLE_PRIORITY = {"declaration": 4, "tentative": 3, "definition": 2, "unknown": 1}
VISIBILITY = {"current": "current_visible", "reachable": "reachable", "external": "external_first_layer", "unknown": "uncertain", "global": "workspace_fallback"}
STRONG, MEDIUM, DEMOTION, REUSE = 1600, 900, -450, -5000
INTENTS = {
    "type_name": {"type": STRONG + MEDIUM, "enum_constant": STRONG + MEDIUM, "keyword": MEDIUM, "variable": DEMOTION, "function": DEMOTION, "macro": DEMOTION},
    "expression_value": {"variable": STRONG, "function": STRONG, "macro": STRONG, "enum_constant": STRONG, "type": DEMOTION, "keyword": DEMOTION},
    "call_target": {"function": STRONG, "macro": STRONG, "variable": DEMOTION},
    "macro_preprocessor": {"macro": STRONG, "keyword": MEDIUM, "type": DEMOTION, "variable": DEMOTION},
}
DIVISOR = {"high": 1, "medium": 2, "low": 4}
HISTORY_STEP, HISTORY_MOST, PROXIMITY_MOST, PROJECT_MOST, LOW_TRUST_CAP, NEAR_MOST = 120, 700, 750, 350, 8000, 200


def lookup(key: Column, values: dict, default=None) -> Column:
    """The value of a small fixed map."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default) if default is not None else out


def scope_tier(external: Column, direct: Column, has_context: Column, is_current: Column, has_reach: Column, in_files: Column, in_heuristic: Column, is_open: Column) -> Column:
    """Tier of a candidate; the direct inclusion of an external file goes before everything else."""
    return (
        F.when(external & direct, "external")
        .when(~has_context, "global")
        .when(is_current, "current")
        .when(~has_reach, "global")
        .when(in_files, "reachable")
        .when(in_heuristic, "unknown")
        .when(is_open, "unknown")
        .otherwise("global")
    )


def coloring_allowed(tier: Column, in_heuristic: Column) -> Column:
    """Whether a file's names may colour tokens: strong tiers, or unknown by a heuristic include."""
    return tier.isin("current", "reachable", "external") | ((tier == "unknown") & in_heuristic)


def confidence_for(tier: Column, exact_name: Column, open_reason: Column) -> Column:
    """Confidence that follows from a tier."""
    return (
        F.when((tier == "current") & exact_name, "exact")
        .when(tier.isin("current", "reachable"), "reachable")
        .when(tier == "external", "heuristic")
        .when((tier == "unknown") & (open_reason == "ambiguous_include"), "ambiguous")
        .otherwise("fallback")
    )


def reason_for(tier: Column) -> Column:
    """Reason that follows from a tier."""
    return F.when(tier == "current", "current_file").when(tier == "reachable", "reachable_include").when(tier == "external", "external_first_layer").otherwise("global_fallback")


def scope_label(tier: Column, confidence: Column) -> Column:
    """Short label of a candidate's scope; none in the current file and for exact ones."""
    named = {"reachable": "reachable", "heuristic": "external", "ambiguous": "ambiguous", "fallback": "global"}
    return F.when(tier != "current", lookup(confidence, named))


def definition_base(role: Column, kind: Column, path: Column, guard: Column) -> Column:
    """Quality of a declaration as the goal of a jump to the definition."""
    base = lookup(role, {"definition": 1000, "tentative": 750, "declaration": 500}, 0)
    source = kind.isin("function", "method") & is_source_path(path)
    return base + F.when(source, 100).otherwise(0) - F.when(F.coalesce(F.trim(guard) != "", F.lit(False)), 1).otherwise(0)


def is_source_path(path: Column) -> Column:
    """C and C++ sources by extension."""
    return path.rlike(r"(?i)[^/]\.(c|cc|cpp|cxx)$")


def is_header_path(path: Column) -> Column:
    """C and C++ headers by extension."""
    return path.rlike(r"(?i)[^/]\.(h|hh|hpp|hxx|inl)$")


def accepts_arity(n: Column, least: Column, most: Column, variadic: Column) -> Column:
    """True, false or null (unknown)."""
    return F.when(least.isNull(), F.lit(None).cast("boolean")).when(n < least, False).when(most.isNotNull(), n <= most).when(variadic, True)


def truncated_half(value: Column, divisor: Column) -> Column:
    """Integer division that cuts towards zero."""
    return (F.signum(value) * F.floor(F.abs(value) / divisor)).cast("int")


def intent_adjustment(intent: Column, confidence: Column, kind: Column, source: Column, tier: Column) -> Column:
    """What the syntactic place adds to a candidate or takes from it."""
    out = None
    for name, by_kind in INTENTS.items():
        value = lookup(kind, by_kind, 0)
        out = F.when(intent == name, value) if out is None else out.when(intent == name, value)
    declared = F.when(source.isin("local", "overlay", "word", "fallback"), MEDIUM).when((source == "builtin") | ((source == "indexed") & (tier == "global")), REUSE).otherwise(0)
    out = out.when(intent == "declaration_name", declared).otherwise(0)
    return truncated_half(out, lookup(confidence, DIVISOR, 4))


def history_boost(accepts: Column) -> Column:
    """Boost of what was accepted before."""
    return F.least(F.coalesce(accepts, F.lit(0)) * HISTORY_STEP, F.lit(HISTORY_MOST)).cast("int")


def proximity(distance: Column, count: Column) -> Column:
    """Nearness to the cursor in bytes and frequency in the file."""
    near = F.when(distance <= 32, 120).when(distance <= 128, 90).when(distance <= 512, 60).when(distance <= 2048, 30).otherwise(10)
    return F.least(near + F.least(count - 1, F.lit(4)) * 20, F.lit(NEAR_MOST)).cast("int")


def clamp(value: Column, most: int) -> Column:
    """Value between nought and ``most``."""
    return F.least(F.greatest(value, F.lit(0)), F.lit(most))


def final_rank(source: Column, tier: Column, confidence: Column, match: Column, near: Column, project: Column, intent: Column, history: Column) -> Column:
    """Sum of all priors and boosts."""
    return lookup(source, SOURCE_PRIOR) + lookup(tier, SCOPE_PRIOR) + lookup(confidence, CONFIDENCE_PRIOR) + match + clamp(near, PROXIMITY_MOST) + clamp(project, PROJECT_MOST) + intent + history


def low_trust(tier: Column, confidence: Column, has_strong: Column, has_word: Column) -> Column:
    """Candidates whose final rank is capped: global ones that are mere words or fallbacks."""
    return (tier == "global") & ~has_strong & (has_word | (confidence == "fallback"))


def role_allows_color(kind: Column, role: Column) -> Column:
    """Whether the syntactic role of an occurrence is in keeping with the kind found by name."""
    return F.when(role == "declaration", False).when(kind == "type", role.isin("type_use", "definition", "read")).when(kind.isin("macro", "enum_member"), True).otherwise(role != "type_use")


def intent_accepts(intent: Column, kind: Column) -> Column:
    """Which kinds of declaration an intent looks for."""
    return F.when(intent == "neutral", True).when(intent == "call", kind.isin("function", "method")).when(intent == "type", kind.isin("type", "alias")).otherwise(kind.isin("object", "enum_constant", "macro", "function", "method"))


def disposition(n_authoritative: Column, n_focused: Column, focused_ok: Column, complete: Column) -> Column:
    """How far a candidate set can be trusted. focused_ok: the one focused group is authoritative and of full fidelity."""
    return F.when(n_authoritative == 0, "fallback").when(n_focused > 1, "ambiguous").when((n_focused == 0) | ~focused_ok, "fallback").when(complete, "exact").otherwise("preferred")


def pairing_label(evidence: Column, degree: Column) -> Column:
    """Presentation of pairing evidence."""
    return F.when(evidence == "ambiguous", F.concat(F.lit("ambiguous:"), degree.cast("string"))).otherwise(evidence)
