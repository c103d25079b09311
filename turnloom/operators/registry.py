"""The registry of enrolled directories, and who owns an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import paths as ph


def with_default(registry: DataFrame, default_dir: Column) -> DataFrame:
    """Put the default entry first unless an entry for that directory exists."""
    spark = registry.sparkSession
    default = spark.range(1).select(
        ph.clean_dir(default_dir).alias("config_dir"), F.lit(ph.DEFAULT_TOKEN_KEY).alias("token_key")
    )
    known = registry.select(ph.clean_dir(F.col("config_dir")).alias("config_dir"))
    return default.join(known, "config_dir", "left_anti").unionByName(registry.select("config_dir", "token_key"))


def upsert(registry: DataFrame, requested: DataFrame, default_dir: Column) -> DataFrame:
    """Result of enrolling every ``requested.config_dir``: the new entries plus the untouched old ones.

    ``status`` is ``kept``, ``added``, ``updated``, or ``collision`` for a request whose token key
    belongs to another directory; collisions leave the registry as it is.
    """
    old = registry.select(ph.clean_dir(F.col("config_dir")).alias("config_dir"), F.col("token_key").alias("old_key"))
    new = (
        requested.select(ph.clean_dir(F.col("config_dir")).alias("config_dir"))
        .distinct()
        .withColumn("new_key", ph.token_key(F.col("config_dir"), default_dir))
    )
    # The directory that holds a key: an old entry if there is one, else the smallest new one.
    claims = old.select(F.col("old_key").alias("new_key"), "config_dir", F.lit(0).alias("age")).unionByName(
        new.select("new_key", "config_dir", F.lit(1).alias("age"))
    )
    holder = claims.groupBy("new_key").agg(
        F.min_by("config_dir", F.struct("age", "config_dir")).alias("holder"),
        F.max(F.when(F.col("age") == 0, F.col("config_dir"))).alias("last_old"),
    )
    judged = new.join(holder, "new_key").withColumn(
        "clash",
        (F.col("holder") != F.col("config_dir"))
        | (F.col("last_old").isNotNull() & (F.col("last_old") != F.col("config_dir"))),
    )
    return old.join(judged, "config_dir", "full").select(
        "config_dir",
        F.when(F.col("new_key").isNull() | F.col("clash"), F.coalesce("old_key", "new_key"))
        .otherwise(F.col("new_key"))
        .alias("token_key"),
        F.when(F.col("new_key").isNull(), "kept")
        .when(F.col("clash"), "collision")
        .when(F.col("old_key").isNull(), "added")
        .otherwise("updated")
        .alias("status"),
    )


def collisions(dirs: DataFrame, default_dir: Column) -> DataFrame:
    """Token keys claimed by more than one directory."""
    keyed = dirs.select(ph.clean_dir(F.col("config_dir")).alias("config_dir")).distinct()
    return (
        keyed.groupBy(ph.token_key(F.col("config_dir"), default_dir).alias("token_key"))
        .agg(F.count(F.lit(1)).alias("n_dirs"))
        .filter("n_dirs > 1")
    )


def remove(registry: DataFrame, unwanted: DataFrame, default_dir: Column) -> DataFrame:
    """Registry after forgetting ``unwanted.config_dir``; the default directory always stays."""
    gone = (
        unwanted.select(ph.clean_dir(F.col("config_dir")).alias("_dir"))
        .filter(F.col("_dir") != ph.clean_dir(default_dir))
        .distinct()
    )
    return registry.join(gone, ph.clean_dir(F.col("config_dir")) == F.col("_dir"), "left_anti")


def removal_report(registry: DataFrame, unwanted: DataFrame, default_dir: Column) -> DataFrame:
    """What a removal would answer: ``refused`` (default), ``removed`` or ``not found``."""
    asked = unwanted.select(ph.clean_dir(F.col("config_dir")).alias("config_dir")).distinct()
    known = registry.select(ph.clean_dir(F.col("config_dir")).alias("config_dir"), "token_key")
    return asked.join(known, "config_dir", "left").select(
        "config_dir",
        "token_key",
        F.when(F.col("config_dir") == ph.clean_dir(default_dir), "refused")
        .when(F.col("token_key").isNotNull(), "removed")
        .otherwise("not found")
        .alias("outcome"),
    )


def enrollment_status(registry: DataFrame, tokens: DataFrame) -> DataFrame:
    """Every entry with ``enrolled`` or ``no token``."""
    have = tokens.filter(F.coalesce("token", F.lit("")) != "").select("token_key").distinct()
    return registry.join(have.withColumn("_has", F.lit(True)), "token_key", "left").select(
        "config_dir",
        "token_key",
        F.when(F.col("_has"), "enrolled").otherwise("no token").alias("status"),
    )


def attribute_events(events: DataFrame, registry: DataFrame, owner: Column) -> DataFrame:
    """Inner equi-join to the enrolled directory; rows of directories never enrolled drop out.

    No broadcast hint: adaptive execution broadcasts a small registry by its measured size and splits
    a hot owner otherwise.
    """
    keyed = registry.select(
        ph.clean_dir(F.col("config_dir")).alias("config_dir"),
        "token_key",
        ph.queue_slug(F.col("config_dir"), F.col("token_key")).alias("queue_slug"),
    )
    return events.withColumn("config_dir", owner).join(keyed, "config_dir")


def unique_entries(registry: DataFrame) -> DataFrame:
    """One row per cleaned directory, with the smallest of its keys; ``conflict`` if it was given several."""
    cleaned = registry.select(ph.clean_dir(F.col("config_dir")).alias("config_dir"), "token_key")
    return cleaned.groupBy("config_dir").agg(
        F.min("token_key").alias("token_key"), (F.min("token_key") != F.max("token_key")).alias("conflict")
    )


def held_tokens(tokens: DataFrame) -> DataFrame:
    """Distinct (token_key, holder) of the tokens that are there. ``holder`` is the cleaned directory of a table that
    names one, else NULL, for a table that belongs to one home."""
    holder = ph.clean_dir(F.col("config_dir")) if "config_dir" in tokens.columns else F.lit(None).cast("string")
    return tokens.filter("coalesce(token, '') <> ''").select("token_key", holder.alias("holder")).distinct()


def attribute_files(files: DataFrame, entries: DataFrame, owner: Column, needs_token: DataFrame | None = None) -> DataFrame:
    """Files with the directory, key and queue of their owner; files of nobody drop out, rows with an error stay.

    The default directory of a home needs no entry. ``needs_token`` (see ``held_tokens``) keeps only owners with a token.
    """
    joined = files.withColumn("config_dir", owner).join(entries.select("config_dir", "token_key"), "config_dir", "left")
    default = F.when(ph.is_home_default(F.col("config_dir")), ph.DEFAULT_TOKEN_KEY)
    owned = joined.withColumn("token_key", F.coalesce("token_key", default))
    if needs_token is not None:
        held = needs_token.select(F.col("token_key").alias("_key"), F.col("holder").alias("_holder"))
        same = (F.col("token_key") == F.col("_key")) & (F.col("_holder").isNull() | (F.col("_holder") == F.col("config_dir")))
        owned = owned.filter("error IS NULL").join(held, same, "left_semi").unionByName(owned.filter("error IS NOT NULL"))
    return owned.filter("token_key IS NOT NULL OR error IS NOT NULL").withColumn(
        "queue_slug", ph.queue_id(F.col("config_dir"), F.col("token_key"))
    )


def attribute_to_one(events: DataFrame, owner: DataFrame) -> DataFrame:
    """All events with the one entry that owns them; without an entry, none. The owner is a fact of the whole run, so it is
    looked up once and no join is planned."""
    found = owner.select(ph.clean_dir(F.col("config_dir")).alias("config_dir"), "token_key").distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError("more than one owner")
    config_dir, key = (F.lit(v).cast("string") for v in (found[0] if found else (None, None)))
    owned = events if found else events.filter("false")
    return owned.withColumns({"config_dir": config_dir, "token_key": key, "queue_slug": ph.queue_slug(config_dir, key)})


def primary_only(registry: DataFrame, tokens: DataFrame, default_dir: Column) -> DataFrame:
    """The one entry that owns machine-wide logs: the default one, and only while it has a token."""
    have = tokens.filter(F.coalesce("token", F.lit("")) != "").select("token_key").distinct()
    return registry.filter(ph.is_default_dir(F.col("config_dir"), default_dir)).join(have, "token_key", "left_semi")
