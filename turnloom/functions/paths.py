"""Directory names: cleaning, slugs, token keys, queue folders and owners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key of the default directory's token, and the slug used when nothing is left.
DEFAULT_TOKEN_KEY = "device-token"
FALLBACK_SLUG = "claude"
DEFAULT_DIR_NAME = ".claude"


def clean_dir(path: Column) -> Column:
    """Lexically shortest form: no empty or ``.`` parts, ``..`` resolved, no trailing slash."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        depth = F.size(kept)
        removable = (depth > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("..")) != "..")
        popped = F.slice(kept, F.lit(1), F.greatest(depth - 1, F.lit(0)))
        up = F.when(removable, popped).when(rooted, kept).otherwise(F.array_append(kept, part))
        return F.when(part == "..", up).otherwise(F.array_append(kept, part))

    body = F.array_join(F.aggregate(parts, empty, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), body)).when(body == "", F.lit(".")).otherwise(body)


def resolve_dir(value: Column, home: Column, default_dir: Column) -> Column:
    """Empty means the default directory, absolute stays, anything else lies under home."""
    return (
        F.when(F.coalesce(value, F.lit("")) == "", clean_dir(default_dir))
        .when(value.startswith("/"), clean_dir(value))
        .otherwise(clean_dir(F.concat_ws("/", home, value)))
    )


def slug(config_dir: Column) -> Column:
    """Lower-case id of the last path part; other characters become single dashes."""
    base = F.regexp_extract(clean_dir(config_dir), r"([^/]*)$", 1)
    lowered = F.lower(F.regexp_replace(base, r"^\.+", ""))
    dashed = F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit(FALLBACK_SLUG))


def is_default_dir(config_dir: Column, default_dir: Column) -> Column:
    return clean_dir(config_dir) == clean_dir(default_dir)


def token_key(config_dir: Column, default_dir: Column) -> Column:
    return F.when(is_default_dir(config_dir, default_dir), F.lit(DEFAULT_TOKEN_KEY)).otherwise(
        F.concat(F.lit(DEFAULT_TOKEN_KEY + "-"), slug(config_dir))
    )


def queue_slug(config_dir: Column, key: Column) -> Column:
    """Spool folder of an owner; the default owner keeps the flat ``default`` folder."""
    return F.when(key == DEFAULT_TOKEN_KEY, F.lit("default")).otherwise(slug(config_dir))


def is_home_default(config_dir: Column) -> Column:
    """The directory has the default name, so it is the default one of the home it lies in."""
    return F.regexp_extract(config_dir, r"([^/]*)$", 1) == DEFAULT_DIR_NAME


def queue_id(config_dir: Column, key: Column) -> Column:
    """Queue of an owner: a readable name, made unique by the whole directory. Homes that share folder names share no
    queue."""
    return F.concat(queue_slug(config_dir, key), F.lit("~"), F.substring(F.sha2(clean_dir(config_dir), 256), 1, 12))


def owner_dir(path: Column) -> Column:
    """Config directory of a block-log file, NULL when the path has another shape."""
    plain = F.regexp_replace(path, "^file:/+", "/")
    return F.nullif(F.regexp_extract(plain, r"^(.*)/projects/[^/]+/[^/]+\.jsonl$", 1), F.lit(""))


def home_default_dir(path: Column) -> Column:
    """Default config directory of the home a rollout file lies in, NULL for another shape."""
    plain = F.regexp_replace(path, "^file:/+", "/")
    home = F.nullif(F.regexp_extract(plain, r"^(.*)/\.codex/sessions/[^/]+/[^/]+/[^/]+/rollout-[^/]*\.jsonl$", 1), F.lit(""))
    return F.concat(home, F.lit("/" + DEFAULT_DIR_NAME))
