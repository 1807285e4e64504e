"""Replays of the quota whose outcome depends on earlier outcomes.

A refused request uses nothing. Where usage is written when a reply ends, perhaps on
a later day, or where the quota is edited within the day, what counts as used is
no plain sum over all earlier requests. Both replays take a few sums over all rows.
Replies that end on another day are then judged in a loop over a small table, whose
length follows from how outcomes hang together, not from the number of rows; edits
within the day in one pass over the stretches between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalktally import session
from chalktally.functions import expr
from chalktally.operators import skew

_LANDS, _STARTS = 0, 1
_ORDER = ["at", "kind", "id"]


def _events(rows: DataFrame, kind: int, at: str, tokens: Column) -> DataFrame:
    return rows.select(
        "user_id",
        expr.day(at).alias("date"),
        F.col(at).alias("at"),
        F.lit(kind).alias("kind"),
        F.col("request_id").alias("id"),
        tokens.cast("long").alias("tokens"),
    )


def _landed_before(starts: DataFrame, landings: DataFrame, name: str) -> DataFrame:
    """Per start (id, user_id, date) what landed that day up to then; at the same
    instant a landing comes first."""
    events = _events(starts, _STARTS, "started_at", F.lit(None)).unionByName(
        _events(landings, _LANDS, "ended_at", F.col("total_tokens"))
    )
    summed = skew.earlier(events, ["user_id", "date"], _ORDER, F.col("tokens"), name)
    return summed.where(F.col("kind") == _STARTS).select(F.col("id").alias("request_id"), name)


def _reached(used: Column, quota: str) -> Column:
    return F.coalesce(used >= F.col(quota), F.lit(False))


def landing_replay(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``refused`` to requests (request_id, user_id, started_at, ended_at,
    total_tokens) whose usage is written when the reply ends, on the day it ends:
    what had landed on the day of the start up to the start reached the quota.
    Nothing landed yet lets a request pass, whatever the quota.

    Within a day a plain sum is enough: until the quota is reached every request of
    the day was admitted, and later ones can't take it back. A reply that ends on
    another day counts there only if it was admitted, so those requests alone are
    judged again and again until no verdict changes. Each turn settles a further
    day of a chain of nights, so there are no more turns than such days.
    """
    quotas = users.select(
        F.col("id").alias("user_id"), F.col("daily_token_quota").alias("_quota")
    )
    slim = requests.select("request_id", "user_id", "started_at", "ended_at", "total_tokens")
    over = expr.day("started_at") != expr.day("ended_at")
    same_day = _landed_before(slim, slim.where(~over), "_same")
    across = session.stored(
        slim.where(over).join(same_day, "request_id").join(quotas, "user_id", "left"), "across"
    )
    admitted = across.withColumn("refused", F.lit(False))
    while True:
        carried = _landed_before(across, admitted.where(~F.col("refused")), "_carried")
        judged = session.stored(
            across.join(carried, "request_id").withColumn(
                "refused", _reached(skew.plus("_same", "_carried"), "_quota")
            ).drop("_carried"),
            "judged",
        )
        old = admitted.select("request_id", F.col("refused").alias("_old"))
        changed = judged.join(old, "request_id").where(F.col("refused") != F.col("_old"))
        admitted = judged
        if changed.isEmpty():
            break
    landings = slim.where(~over).unionByName(
        admitted.where(~F.col("refused")).select(*slim.columns)
    )
    used = _landed_before(slim, landings, "_used")
    return (
        requests.join(used, "request_id")
        .join(quotas, "user_id", "left")
        .withColumn("refused", _reached(F.col("_used"), "_quota"))
        .select(*requests.columns, "refused")
    )


def quota_in_force(requests: DataFrame, users: DataFrame, history: DataFrame) -> DataFrame:
    """Add ``version``, how many edits of the user's quota came up to the request,
    and ``quota``, that of the last of them, before any edit the one in ``users``.

    ``history`` has change_id, user_id, changed_at and daily_token_quota; of edits at
    the same instant the largest change_id is the last, and a request at that
    instant comes after them. Requests and edits are numbered together, in grains,
    so it makes no difference how many one user has.
    """
    asked = requests.select(
        "user_id", F.col("created_at").alias("at"), F.lit(1).alias("kind"),
        F.col("request_id").alias("id"), F.lit(None).cast("int").alias("set_to"),
    )
    edits = history.select(
        "user_id", F.col("changed_at").alias("at"), F.lit(0).alias("kind"),
        F.col("change_id").alias("id"), F.col("daily_token_quota").alias("set_to"),
    )
    one = F.when(F.col("kind") == 0, F.lit(1))
    numbered = skew.earlier(asked.unionByName(edits), ["user_id"], _ORDER, one, "_n")
    numbered = numbered.withColumn("version", F.coalesce("_n", F.lit(0)) + F.coalesce(one, F.lit(0)))
    values = numbered.where(F.col("kind") == 0).select("user_id", "version", "set_to")
    first = users.select(F.col("id").alias("user_id"), F.col("daily_token_quota").alias("_first"))
    found = (
        numbered.where(F.col("kind") == 1)
        .select("user_id", F.col("id").alias("request_id"), "version")
        .join(values, ["user_id", "version"], "left")
        .join(first, "user_id", "left")
        .select(
            "request_id",
            "version",
            F.when(F.col("version") == 0, F.col("_first")).otherwise(F.col("set_to")).alias("quota"),
        )
    )
    return requests.join(found, "request_id")


def history_replay(requests: DataFrame, users: DataFrame, history: DataFrame) -> DataFrame:
    """Add ``refused`` to requests (request_id, user_id, created_at, total_tokens): what
    the admitted ones before used that day reached the quota in force. A day's
    first request passes.

    Between two edits the quota stands still, so sums within such a stretch, over
    all rows at once, tell where it is reached for any usage at its beginning. What
    a stretch begins with depends on what the one before admitted: one pass over
    the stretches of each user and day in their order settles that, however many
    there are. Totals are not negative, so what its own stretch alone has brought
    to the quota is refused whatever came before, and takes no part in the pass; in
    a task are the others of one user and day, of which nothing is kept but a sum.
    """
    keys = ["user_id", "date"]
    rows = quota_in_force(requests, users, history).withColumn("date", expr.day("created_at"))
    rows = rows.where(F.col("user_id").isNotNull() & F.col("date").isNotNull())
    stretch = [*keys, "version"]
    inside = skew.earlier(
        rows, stretch, ["created_at", "request_id"], F.col("total_tokens"), "_inside"
    )
    slim = inside.select(
        *stretch, "request_id", F.col("total_tokens").cast("long").alias("tokens"), "quota", "_inside"
    )
    stored = session.stored(slim, "stretches")
    found = stored.join(_begins(stored, keys), stretch, "left").select(
        "request_id", _reached(skew.plus("_used", "_inside"), "quota").alias("refused")
    )
    return requests.join(found, "request_id").select(*requests.columns, "refused")


def _begins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, version, _used): what was used when a stretch began, of those before
    which something was."""
    shape = T.StructType(
        [*(rows.schema[k] for k in [*keys, "version"]), T.StructField("_used", T.LongType())]
    )
    names = shape.names

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The user and day, the stretch, what was used before it and since.
        day = version = used = more = None
        for batch in batches:
            begun = []
            *of, versions, tokens, quotas, insides = (c.to_pylist() for c in batch.columns)
            for key, n, some, quota, inside in zip(
                zip(*of, strict=True), versions, tokens, quotas, insides, strict=True
            ):
                if key != day or n != version:
                    used = _plus(used, more) if key == day else None
                    day, version, more = key, n, None
                    if used is not None:
                        begun.append((*key, n, used))
                sofar = _plus(used, inside)
                if sofar is None or quota is None or sofar < quota:
                    more = _plus(more, some)
            columns = list(zip(*begun, strict=True)) or [()] * len(names)
            kinds = [batch.schema.field(k).type for k in names[:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, [*kinds, pa.int64()], strict=True)], names
            )

    open_ = rows.where(~_reached(F.col("_inside"), "quota"))
    return (
        open_.select(*keys, "version", "tokens", "quota", "_inside")
        .repartition(*keys)
        .sortWithinPartitions(*keys, "version")
        .mapInArrow(walk, shape)
    )


def _plus(a: int | None, b: int | None) -> int | None:
    """``skew.plus`` of two values."""
    return b if a is None else a if b is None else a + b
