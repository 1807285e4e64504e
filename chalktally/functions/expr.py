"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
UNTITLED = "Untitled Session"
DEFAULT_TOKENS = 10
BAND_DANGER = 90
BAND_WARN = 70
BASE_PROMPT = "You are a helpful AI assistant."
RULE_HEADING = "\n\nTeacher Instructions:\n"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quota_pct(used: Column | str, quota: Column | str) -> Column:
    """Share of the quota in percent, at most 100; 0 where there is no quota."""
    used, quota = col(used).cast("double"), col(quota)
    share = F.least(used / F.nullif(quota, F.lit(0)).cast("double") * 100.0, F.lit(100.0))
    return F.when(quota > 0, share).otherwise(F.lit(0.0))


def quota_band(pct: Column | str) -> Column:
    pct = col(pct)
    return F.when(pct > BAND_DANGER, "danger").when(pct > BAND_WARN, "warn").otherwise("ok")


def quota_label(pct: Column | str) -> Column:
    """Percentage without decimals, halves upwards."""
    return F.concat(F.round(col(pct), 0).cast("int").cast("string"), F.lit("%"))


def title(c: Column | str) -> Column:
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(UNTITLED))


def chat_role(sender: Column | str) -> Column:
    return F.when(col(sender) == "user", "user").otherwise("assistant")


def sender_rank(sender: Column | str) -> Column:
    """Question before answer where both rows carry the same instant."""
    return F.when(col(sender) == "user", 0).otherwise(1)


def tokens_or_default(c: Column | str) -> Column:
    """A count that is missing or zero counts as ten."""
    return F.coalesce(F.nullif(col(c), F.lit(0)), F.lit(DEFAULT_TOKENS))


def total_tokens(prompt: Column | str, completion: Column | str) -> Column:
    return tokens_or_default(prompt) + tokens_or_default(completion)


def day(instant: Column | str) -> Column:
    """UTC day of an instant."""
    return F.to_date(col(instant))


# The labels of rules.
def scope_label(student_id: Column | str) -> Column:
    return F.when(col(student_id).isNull(), "All Students").otherwise("Targeted")


def state_label(is_active: Column | str) -> Column:
    return F.when(col(is_active), "Active").otherwise("Inactive")


def rule_text(raw: Column | str) -> Column:
    """Rule JSON as the prompt carries it: printed without blanks and with sorted
    keys; what is not JSON comes as a quoted string. A broken or huge value
    affects its own row only."""
    parsed = F.coalesce(F.try_parse_json(col(raw)), col(raw).cast("variant"))
    return F.when(col(raw).isNotNull(), F.to_json(parsed))


def system_prompt(text: Column | str) -> Column:
    """Base prompt, plus the rule text if there is one."""
    return F.concat(
        F.lit(BASE_PROMPT), F.coalesce(F.concat(F.lit(RULE_HEADING), col(text)), F.lit(""))
    )
