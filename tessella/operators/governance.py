"""Governance: usage normalisation, safety findings, metadata redaction and event shaping, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: The detector's version, limits, rules and their order.
DETECTOR, MAX_CHARS, BLOCK_CHARS = "local.rules.v1", 12_000, 24_000
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u200b\u200c\u200d\ufeff]"
SECRETS = {
    "openai_api_key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "generic_api_key_assignment": r"(?i)\b(?:api[_-]?key|token|secret|password)\s*[:=]\s*['\"]?[^'\"\s]{12,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
}
INJECTIONS = {
    "ignore_previous_instructions": r"(?i)\bignore (?:all )?(?:previous|prior|above) instructions\b",
    "reveal_system_prompt": r"(?i)\b(?:reveal|show|print|dump|repeat).{0,40}\b(?:system prompt|developer message|hidden instructions)\b",
    "bypass_rules": r"(?i)\b(?:bypass|override|disable).{0,30}\b(?:rules|guardrails|safety|policy)\b",
}
#: Categories and summaries of findings.
SUMMARIES = {
    "input_length": "Input length {} chars exceeds {}.",
    "invisible_or_control_text": "Input contains {} control or invisible characters.",
    "secret_or_credential": "Input contains a possible credential or secret pattern.",
    "prompt_injection": "Input contains a prompt-injection style instruction.",
}
#: Keys under which providers report usage, in order of preference, and the objects they nest them in.
USAGE_KEYS = {
    "prompt_tokens": ["prompt_tokens", "input_tokens", "promptTokens", "inputTokens", "promptTokenCount", "inputTokenCount", "prompt_token_count", "input_token_count", "input", "prompt"],
    "completion_tokens": ["completion_tokens", "output_tokens", "completionTokens", "outputTokens", "candidatesTokenCount", "outputTokenCount", "completion_token_count", "output_token_count", "output", "completion"],
    "total_tokens": ["total_tokens", "totalTokens", "totalTokenCount", "total_token_count", "total"],
}
NESTED = ["usage", "token_usage", "tokens"]
#: Stems that make a metadata key sensitive, widths of usage columns, and the context ids that events keep.
SENSITIVE = ["prompt", "user_prompt", "system_prompt", "source_text", "source_content", "retrieved_text", "snippet", "answer", "output", "content", "api_key", "secret"]
USAGE_WIDTHS = {"call_type": 80, "provider": 80, "model": 160, "status": 40, "error_class": 120}
CONTEXT_KEYS = ["user_id", "notebook_id", "conversation_id", "message_id", "source_id", "eval_run_id", "eval_set_id"]


def findings(text: Column, event_type: str, surface: str) -> Column:
    """array of up to eight findings of a text in a fixed order; a null text has none."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    controls = F.regexp_count(t, F.lit(CONTROL))

    def summed(category: str, *values: Column) -> Column:
        return F.format_string(SUMMARIES[category].replace("{}", "%s"), *(v.cast("string") for v in values))

    def finding(when: Column, category: str, severity: Column, decision: Column, rule: str, summary: Column, metadata: Column) -> Column:
        return F.when(when, F.struct(F.lit(event_type).alias("event_type"), F.lit(surface).alias("surface"), F.lit(category).alias("category"), severity.alias("severity"), decision.alias("decision"), F.lit(rule).alias("rule_id"), X.content_hash(t).alias("content_hash"), summary.alias("redacted_summary"), metadata.alias("metadata"), F.lit(DETECTOR).alias("detector_version")))

    huge = n > BLOCK_CHARS
    out = [
        finding(n > MAX_CHARS, "input_length", F.when(huge, "high").otherwise("medium"), F.when(huge, "block_candidate").otherwise("warn"), "input_length.max_chars", summed("input_length", n, F.lit(MAX_CHARS)), F.create_map(F.lit("input_chars"), n.cast("string"), F.lit("max_chars"), F.lit(str(MAX_CHARS)))),
        finding(controls > 0, "invisible_or_control_text", F.lit("medium"), F.lit("warn"), "input_text.control_or_invisible_chars", summed("invisible_or_control_text", controls), F.create_map(F.lit("match_count"), controls.cast("string"))),
    ]
    for rules, kind, category, severity, summary in (
        (SECRETS, "secret", "secret_or_credential", "high", SUMMARIES["secret_or_credential"]),
        (INJECTIONS, "prompt_injection", "prompt_injection", "medium", SUMMARIES["prompt_injection"]),
    ):
        out += [finding(t.rlike(p), category, F.lit(severity), F.lit("warn"), f"{kind}.{r}", F.lit(summary), F.create_map(F.lit("pattern"), F.lit(r))) for r, p in rules.items()]
    return F.filter(F.array(*out), lambda f: f.isNotNull())


def scan(rows: DataFrame, key: str, text: str, event_type: str, surface: str) -> DataFrame:
    """One row per finding: the key and the finding's fields."""
    return rows.select(key, F.explode(findings(F.col(text), event_type, surface)).alias("f")).select(key, "f.*")


def usage_objects(usage: Column) -> Column:
    """array of structs: the known keys of a JSON usage object and of the objects nested in it, each parsed once.

    Of a repeated key the last value counts.
    """
    keys = ", ".join(f"`{k}` variant" for k in dict.fromkeys(k for names in USAGE_KEYS.values() for k in names))
    own = F.from_json(usage, f"struct<{keys}>")
    nested = F.from_json(usage, f"struct<{', '.join(f'{n} string' for n in NESTED)}>")
    return X.let(nested, lambda o: F.array(own, *(F.from_json(o[n], f"struct<{keys}>") for n in NESTED)))


def usage_int(objects: Column, field: str) -> Column:
    """The first usable count of a field: under the object's own keys, then under those of nested objects."""
    every = F.flatten(F.transform(objects, lambda o: F.array(*(X.json_int(o[k]) for k in USAGE_KEYS[field]))))
    return F.get(F.filter(every, lambda n: n.isNotNull()), F.lit(0))


def normalise_usage(usage: Column, input_chars: Column, output_chars: Column) -> Column:
    """struct of tokens, characters and is_estimated: estimated only if the provider gave nothing usable."""
    chars = [F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long") for c in (input_chars, output_chars)]
    found = X.let(usage_objects(usage), lambda objects: F.struct(*(usage_int(objects, f).alias(f) for f in USAGE_KEYS)))

    def result(got: Column) -> Column:
        prompt = F.coalesce(got.prompt_tokens, X.estimate_tokens(chars[0]))
        completion = F.coalesce(got.completion_tokens, X.estimate_tokens(chars[1]))
        none = F.coalesce(got.prompt_tokens, got.completion_tokens, got.total_tokens).isNull()
        return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), F.coalesce(got.total_tokens, prompt + completion).alias("total_tokens"), chars[0].alias("input_chars"), chars[1].alias("output_chars"), none.cast("int").alias("is_estimated"))

    return X.let(found, result)


def is_sensitive(key: Column) -> Column:
    compact = F.regexp_replace(F.lower(key), "[^a-z0-9]+", "")
    return F.exists(F.array(*(F.lit(s.replace("_", "")) for s in SENSITIVE)), lambda s: F.contains(compact, s))


def clean_metadata(m: Column) -> Column:
    """A map without sensitive keys and nulls, keys cut to 80 and values to 300 characters; of keys then alike the last stays."""
    kept = F.map_entries(F.map_filter(m, lambda k, v: ~is_sensitive(k) & v.isNotNull()))
    return X.last_wins(F.transform(kept, lambda e: F.struct(F.substring(e.key, 1, 80).alias("key"), F.substring(e.value, 1, 300).alias("value"))))


def clean_context(m: Column) -> Column:
    """struct of the seven context ids as non-negative integers or null, from a map of strings."""
    return F.struct(*(X.optional_int(F.try_element_at(m, F.lit(k))).alias(k) for k in CONTEXT_KEYS))


def usage_event(rows: DataFrame) -> DataFrame:
    """Usage rows cut to their widths."""
    widths = USAGE_WIDTHS
    return rows.withColumns({c: F.substring(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown" if c in ("call_type", "status") else "")), 1, n) for c, n in widths.items() if c in rows.columns})


def audit_view(events: DataFrame, action: str = "", actor: str = "", target_type: str = "", sensitivity: str = "", limit: int = 100) -> DataFrame:
    """Newest audit events under optional filters: substrings of action and actor, exact type and sensitivity."""
    for column, wanted in (("action", action), ("actor_username", actor)):
        if wanted:
            events = events.where(F.contains(F.lower(column), F.lit(wanted.lower())))
    for column, wanted in (("target_type", target_type), ("sensitivity", sensitivity)):
        if wanted:
            events = events.where(F.col(column) == wanted)
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(min(300, max(1, limit)))
