"""Text rules: secret masking, injected-prompt tests, surfaces and project context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "«REDACTED»"

# The secret patterns, applied in this order.
SECRET_PATTERNS = {
    "sk_key": r"sk-[a-zA-Z0-9-]{20,}",
    "pem_key": r"(?s)-----BEGIN [A-Z ]*KEY-----.*?-----END [A-Z ]*KEY-----",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "google_access_token": r"ya29\.[0-9A-Za-z_\-]+",
    "google_refresh_token": r"1//[0-9A-Za-z_\-]+",
    "bearer": r"(?iu)bearer[\t\n\f\r ]+[A-Za-z0-9._\-]+",
    "assignment": r"(?iu)(api[_\-]?key|secret|token|password)[\t\n\f\r ]*=[\t\n\f\r ]*[^\t\n\f\r ]+",
}

# Markers that make a block-log user line injected wherever they stand.
BLOCK_MARKERS = [
    "<task-notification>",
    "<command-name>",
    "<command-message>",
    "<command-args>",
    "<local-command-stdout>",
    "<system-reminder>",
    "Caveat: The messages below",
]

# Phrases that make it injected only at the start of the trimmed text.
BLOCK_PREFIXES = [
    "This session is being continued from a previous conversation",
    "Base directory for this skill:",
    "## Context Usage",
    "[Request interrupted by user",
]

# The same for rollout logs, start of the trimmed text only.
ROLLOUT_PREFIXES = [
    "<environment_context>",
    "<permissions instructions>",
    "<turn_aborted>",
    "<user_instructions>",
    "<apps_instructions>",
    "<skills_instructions>",
    "<collaboration_mode>",
    "<plugins_instructions>",
    "<user_shell_command>",
    "# AGENTS.md instructions",
]

# Surfaces passed through; everything else is 'unknown'.
SURFACES = ["cli", "sdk-cli"]

# Unicode white space, wider than what Java's \s or Spark's trim remove.
_SPACE = r"[\t-\r \x{85}\x{A0}\p{Z}]"


# Text every match of a pattern contains. Looking for it is far cheaper than running the pattern.
_MUST_CONTAIN = {
    "sk_key": "sk-",
    "pem_key": "-----BEGIN ",
    "github_token": "gh",
    "aws_access_key": "AKIA",
    "google_access_token": "ya29.",
    "google_refresh_token": "1//",
    "bearer": "bearer",
    "assignment": "=",
}


def _may_contain(text: Column, name: str) -> Column:
    return (F.lower(text) if name == "bearer" else text).contains(_MUST_CONTAIN[name])


def scrub(text: Column) -> Column:
    """Mask every secret, pattern after pattern; each sees what the previous ones left."""

    def masked(name: str, pattern: str):
        return lambda t: F.when(_may_contain(t, name), F.regexp_replace(t, pattern, MASK)).otherwise(t)

    # Each step binds the text once; nesting the conditions directly would copy it at every level.
    bound = F.array(text)
    for name, pattern in SECRET_PATTERNS.items():
        bound = F.transform(bound, masked(name, pattern))
    return F.get(bound, F.lit(0))


def secret_hits(text: Column) -> dict[str, Column]:
    """For each pattern, whether the untouched text contains it."""
    return {name: _may_contain(text, name) & text.rlike(pattern) for name, pattern in SECRET_PATTERNS.items()}


def _starts_with_any(text: Column, prefixes: list[str]) -> Column:
    # One anchored pattern: the text is neither copied nor trimmed.
    quoted = "|".join(r"\Q" + p + r"\E" for p in prefixes)
    return text.rlike(rf"\A{_SPACE}*(?:{quoted})")


def has_block_marker(text: Column) -> Column:
    hit = F.lit(False)
    for marker in BLOCK_MARKERS:
        hit = hit | text.contains(marker)
    return hit


def is_block_synthetic(text: Column) -> Column:
    """Block log: the text was injected by the tool, not typed by a person."""
    return has_block_marker(text) | _starts_with_any(text, BLOCK_PREFIXES)


def is_rollout_synthetic(text: Column) -> Column:
    """Rollout log: injected text, judged by its start only."""
    return _starts_with_any(text, ROLLOUT_PREFIXES)


def normalize_surface(entrypoint: Column) -> Column:
    return F.when(entrypoint.isin(SURFACES), entrypoint).otherwise(F.lit("unknown"))


def project_context(cwd: Column, branch: Column) -> Column:
    """Working directory plus `` @branch``; NULL when both are empty."""
    suffix = F.when(branch != "", F.concat(F.lit(" @"), branch)).otherwise(F.lit(""))
    return empty_to_null(F.concat(F.coalesce(cwd, F.lit("")), suffix))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
