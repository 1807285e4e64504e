"""Teacher rules: which apply to whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalktally.functions import expr


def _active(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("is_active"))


def matching_one(rules: DataFrame, user_id) -> DataFrame:
    """Active rules that apply to one given user."""
    own = F.col("student_id") == F.lit(user_id)
    return _active(rules).where(own | F.col("student_id").isNull())


def matching(users: DataFrame, rules: DataFrame) -> DataFrame:
    """Active rules with the users they apply to.

    A targeted rule gives one row for its user. A rule for everyone stays one
    row with NULL ``user_id``, as in the rules table, and stands for all users:
    writing it out once per user would multiply users by rules.
    """
    active = _active(rules).select(F.col("id").alias("rule_id"), "student_id")
    targeted = active.join(
        users.select(F.col("id").alias("student_id")), "student_id"
    ).select(F.col("student_id").alias("user_id"), "rule_id")
    everyone = active.where(F.col("student_id").isNull()).select(
        F.col("student_id").alias("user_id"), "rule_id"
    )
    return targeted.unionByName(everyone)


def match_counts(users: DataFrame, rules: DataFrame) -> DataFrame:
    """Per user the number of rules that apply: targeted, for everyone, both."""
    active = _active(rules)
    targeted = (
        active.where(F.col("student_id").isNotNull())
        .groupBy(F.col("student_id").alias("id"))
        .agg(F.count("*").alias("targeted"))
    )
    everyone = active.where(F.col("student_id").isNull()).agg(F.count("*").alias("n"))
    return (
        users.select("id")
        .join(targeted, "id", "left")
        .select(
            F.col("id").alias("user_id"),
            F.coalesce("targeted", F.lit(0)).alias("targeted"),
            everyone.scalar().alias("everyone"),
        )
        .withColumn("matching", F.col("targeted") + F.col("everyone"))
    )


def first_targeted(rules: DataFrame) -> DataFrame:
    """Per student the targeted active rule with the lowest id."""
    return (
        _active(rules)
        .where(F.col("student_id").isNotNull())
        .groupBy(F.col("student_id").alias("user_id"))
        .agg(F.min(F.struct("id", "rules_json")).alias("rule"))
        .select("user_id", F.col("rule.id").alias("rule_id"), "rule.rules_json")
    )


def first_for_everyone(rules: DataFrame) -> DataFrame:
    """The active rule for everyone with the lowest id; one row, NULL if none."""
    return (
        _active(rules)
        .where(F.col("student_id").isNull())
        .agg(F.min(F.struct("id", "rules_json")).alias("rule"))
        .select(F.col("rule.id").alias("rule_id"), "rule.rules_json")
    )


def effective(users: DataFrame, rules: DataFrame) -> DataFrame:
    """The one rule applied to each user: targeted before everyone's, then the
    lowest id; NULL if none. Two equality lookups instead of an OR join, which
    would compare every user with every rule."""
    targeted = first_targeted(rules).select(F.col("user_id").alias("id"), "rule_id")
    everyone = first_for_everyone(rules).select("rule_id").scalar()
    return (
        users.select("id")
        .join(targeted, "id", "left")
        .select(F.col("id").alias("user_id"), F.coalesce("rule_id", everyone).alias("rule_id"))
    )


def by_teacher(rules: DataFrame) -> DataFrame:
    """All rules with their author, scope and state."""
    return rules.select(
        "teacher_id",
        "id",
        "student_id",
        "rules_json",
        "is_active",
        expr.scope_label("student_id").alias("scope"),
        expr.state_label("is_active").alias("state"),
    )


def of_teacher(rules: DataFrame, teacher_id) -> DataFrame:
    """The rules one teacher wrote, active or not."""
    return by_teacher(rules.where(F.col("teacher_id") == F.lit(teacher_id)))
