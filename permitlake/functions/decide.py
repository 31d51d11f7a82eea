"""Permission decisions as column expressions over ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitlake.schemas import Purpose


def active(when: Column) -> Column:
    """Half-open windows: valid_from <= when < valid_until, and before any revocation."""
    until, revoked = F.col("valid_until"), F.col("revoked_at")
    return (F.col("valid_from") <= when) & (until.isNull() | (when < until)) & (revoked.isNull() | (when < revoked))


def covers(purpose: Column | str, scope: str | None = None) -> Column:
    """The purpose is granted; a scope asked for is in the row's scope, or that is empty (all)."""
    granted = F.array_contains("purposes", purpose)
    if scope is None:
        return granted
    return granted & ((F.size("scope") == 0) | F.array_contains("scope", scope))


def latest(ledger: DataFrame) -> DataFrame:
    """The rows at each subject's highest version; all lower ones are dead.

    An aggregate that combines before its shuffle, and a join: no window gathers
    and sorts the rows of a subject with very many.
    """
    return ledger.join(versions(ledger), ["subject", "version"], "left_semi")


def versions(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("subject").agg(F.max("version").alias("version"))


def subject_versions(subjects: DataFrame, ledger: DataFrame) -> DataFrame:
    """The version of each of the given subjects, 0 for those without a row."""
    return subjects.select("subject").join(versions(ledger), "subject", "left").withColumn("version", F.coalesce("version", F.lit(0)))


def consented(ledger: DataFrame, purpose: Purpose, when: Column, scope: str | None = None) -> DataFrame:
    """The subjects whose latest rows permit the purpose; one aggregate, whatever their number.

    Comparing each row with its subject's highest version happens in the
    aggregation: the greatest of 2 * version + permitted is odd if any row of the
    highest version permits. So rows combine by hash, before the shuffle.
    """
    permitted = F.coalesce(covers(purpose.value, scope) & active(when), F.lit(False))
    best = F.max(F.col("version").cast("long") * 2 + permitted.cast("long")).alias("best")
    return ledger.groupBy("subject").agg(best).where(F.pmod("best", F.lit(2)) == 1).select("subject")


def partition(subjects: DataFrame, allowed: DataFrame) -> DataFrame:
    """Every subject with allowed true or false; denied by default."""
    return subjects.select("subject").distinct().join(allowed.select("subject", F.lit(True).alias("allowed")), "subject", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def hidden(subjects: DataFrame, allowed: DataFrame) -> DataFrame:
    return subjects.select("subject").distinct().join(allowed, "subject", "left_anti")


def _of_latest(ledger: DataFrame, **flags: Column) -> DataFrame:
    """Per subject, its highest version and whether any row of that has each flag.

    Rows combine per subject and version before the shuffle, so that a subject
    with very many rows burdens no task.
    """
    any_row = {name: F.bool_or(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in flags.items()}
    per = ledger.groupBy("subject", "version").agg(*any_row.values())
    # version and flags as one number, so that this aggregate too is one by hash
    bits = sum((F.col(name).cast("long") * (1 << i) for i, name in enumerate(any_row)), F.col("version").cast("long") * (1 << len(any_row)))
    best = per.groupBy("subject").agg(F.max(bits).alias("best"))
    flag = lambda i, name: (F.shiftright("best", i).bitwiseAND(F.lit(1).cast("long")) == 1).alias(name)
    return best.select("subject", F.shiftright("best", len(any_row)).cast("int").alias("version"), *(flag(i, name) for i, name in enumerate(any_row)))


def decisions(ledger: DataFrame, subjects: DataFrame, when: Column) -> DataFrame:
    """A decision per subject and purpose, with the version that decided (0: no row)."""
    per = _of_latest(ledger, **{p.value: covers(p.value) & active(when) for p in Purpose})
    every = subjects.select("subject").distinct().join(per, "subject", "left").withColumn("version", F.coalesce("version", F.lit(0)))
    rows = F.array(*(F.struct(F.lit(p.value).alias("purpose"), F.coalesce(p.value, F.lit(False)).alias("allowed")) for p in Purpose))
    return every.select("subject", "version", F.inline(rows)).select("subject", "purpose", "version", "allowed")


def permitted(ledger: DataFrame, when: Column) -> DataFrame:
    """Rows (purpose, subject): for every purpose the subjects that permit it, by one aggregate for all purposes."""
    per = _of_latest(ledger, **{p.value: covers(p.value) & active(when) for p in Purpose})
    given = F.filter(F.array(*(F.when(F.col(p.value), F.lit(p.value)) for p in Purpose)), lambda p: p.isNotNull())
    return per.select(F.explode(given).alias("purpose"), "subject")


def states(ledger: DataFrame, subjects: DataFrame, when: Column) -> DataFrame:
    """Each subject's state: active, revoked, expired, future or never, the first that applies."""
    found = _of_latest(ledger, active=active(when), revoked=F.col("revoked_at") <= when, expired=F.col("valid_until") <= when)
    state = F.when(F.col("active"), "active").when(F.col("revoked"), "revoked").when(F.col("expired"), "expired").when(F.col("active").isNotNull(), "future").otherwise("never")
    return subjects.select("subject").distinct().join(found, "subject", "left").select("subject", state.alias("state"))


def faults(ledger: DataFrame) -> DataFrame:
    """Why a row is no valid permission; null where it is one."""
    vocabulary = F.array(*(F.lit(p.value) for p in Purpose))
    reason = (
        F.when(F.col("subject").isNull(), "no subject")
        .when(F.coalesce(F.size("purposes"), F.lit(0)) <= 0, "no purpose")
        .when(F.size(F.array_except("purposes", vocabulary)) > 0, "unknown purpose")
        .when(F.col("valid_from").isNull(), "no beginning")
        .when(F.col("valid_until") <= F.col("valid_from"), "inverted window")
    )
    return ledger.withColumn("fault", reason)
