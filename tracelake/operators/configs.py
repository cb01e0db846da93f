"""Configuration profiles and runs: fingerprints, duplicates, clean-up plans, protected updates, edit histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_blank


# Fields that say nothing about what a configuration does, and secrets.
NOT_BUSINESS = {"config_id", "created_at", "updated_at", "edit_note", "archived_duplicate", "config_snapshot", "run_id", "question_set_id", "question_set_name"}
SECRETS = {"api_key", "secret_key", "lf_public_key", "lf_secret_key", "openai_api_key", "api_keys", "cookie", "session_token", "password", "token"}


def business_fields(fields: list[str]) -> list[str]:
    return sorted(f for f in fields if f not in NOT_BUSINESS | SECRETS)


def _json_text(c: Column) -> Column:
    """A text as a JSON string in ASCII, characters beyond it as \\uXXXX (two of them beyond the basic plane)."""
    plain = F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    units = lambda x: F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "(.{4})", r"\\u$1")
    wide = F.array_join(F.transform(F.filter(F.split(plain, ""), lambda x: x != ""), lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), units(x)).otherwise(x)), "")
    return F.concat(F.lit('"'), F.when(plain.rlike(r"[^\x00-\x7f]"), wide).otherwise(plain), F.lit('"'))


def fingerprint(fields: list[str]) -> Column:
    """First 16 digits of the SHA-256 of the business fields that hold something, as sorted JSON of texts: equal contents, equal fingerprints."""
    value = lambda f: non_blank(F.col(f).cast("string"))
    parts = [F.when(value(f).isNotNull(), F.concat(F.lit(f'"{f}": '), _json_text(value(f)))) for f in business_fields(fields)]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 16)


def summary(fields: list[str]) -> Column:
    """The fields without secrets as one line."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f + ": "), F.coalesce(non_blank(F.col(f).cast("string")), F.lit("-"))) for f in fields if f not in SECRETS])


def duplicate_groups(configs: DataFrame, key: str, fields: list[str], created: str) -> DataFrame:
    """(fingerprint, n, canonical): groups of two or more, the earliest is canonical (ties by id)."""
    g = configs.groupBy(fingerprint(fields).alias("fingerprint")).agg(F.count("*").alias("n"), F.min(F.struct(created, key)).alias("m"))
    return g.where("n > 1").select("fingerprint", "n", F.col(f"m.{key}").alias("canonical"))


def cleanup_plan(configs: DataFrame, runs: DataFrame, key: str, fields: list[str], created: str) -> DataFrame:
    """What to do with every duplicate: keep the canonical one, archive what runs refer to, delete the rest."""
    groups = duplicate_groups(configs, key, fields, created)
    used = runs.groupBy(key).agg(F.count("*").alias("n_runs"))
    d = configs.withColumn("fingerprint", fingerprint(fields)).join(groups, "fingerprint").join(used, key, "left")
    action = F.when(F.col(key) == F.col("canonical"), "keep").when(F.col("n_runs").isNotNull(), "archive").otherwise("delete")
    return d.select(key, "canonical", action.alias("action"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"))


def rebind(runs: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Runs with their configuration replaced by the canonical one."""
    return runs.join(plan.select(key, "canonical"), key, "left").withColumn(key, F.coalesce("canonical", key)).drop("canonical")


def merge(base: DataFrame, updates: DataFrame, key: str, protected: list[str]) -> DataFrame:
    """Upsert: filled fields of an update replace the base's, except protected ones; unknown keys are added."""
    cols = [c for c in base.columns if c != key]
    u = updates.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in cols if c in updates.columns])
    j = base.withColumn("_old", F.lit(True)).join(u, key, "full")

    def value(c: str) -> Column:
        if c not in updates.columns:
            return F.col(c)
        if c in protected:
            return F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_{c}"))
        return F.coalesce(f"_{c}", c)

    return j.select(key, *[value(c).alias(c) for c in cols])


def with_history(base: DataFrame, edits: DataFrame, key: str, field: str, history: str = "history") -> DataFrame:
    """Edits in order: the last value stays, every earlier one is kept in the history with its time and note.

    The history of one row grows with its edits only.
    """
    e = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("edited_at", "value", "note"))).alias("_edits"))
    j = base.join(e, key, "left").withColumn("_was", F.concat(F.array(F.col(field).cast("string")), F.transform("_edits", lambda x: x["value"])))
    log = F.zip_with("_was", "_edits", lambda b, x: F.when(x.isNotNull(), F.struct(b.alias("before"), x["edited_at"].alias("edited_at"), x["note"].alias("edit_note"))))
    none = F.array().cast("array<struct<before:string,edited_at:timestamp_ntz,edit_note:string>>")
    return j.select(*[c for c in base.columns if c != field], F.coalesce(F.element_at("_edits", -1)["value"], F.col(field)).alias(field), F.coalesce(F.array_compact(log), none).alias(history))
