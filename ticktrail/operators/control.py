"""Session control: the state machine of logons and subscriptions as running values over the log.

A row's state is that after all control rows at or before it. Poison is absorbing: a control row that
can't be decoded freezes epochs from there on, while counters go on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import flag, union
from .lineage import cut
from .ordered import BUCKET, prefix, tasks

SUCCESS, FAILURE, DISCONNECTED, DECODE_ERROR, SUBSCRIPTION = "LOGON_SUCCESS", "LOGON_FAILURE", "DISCONNECTED", "DECODE_ERROR", "SUBSCRIPTION"


def control_states(ctl: DataFrame, keys: Sequence[str], order: str, kind: str, address: str, mask: str | None = None) -> DataFrame:
    """keys, order and __state, a struct, for each control row. ctl is read several times: hand in a cut table.

    A logon replaces the subscription mask, a subscription answer adds to it while logged in, and the
    subscription epoch moves only when the mask changed."""
    k = F.col(kind)
    d = prefix(ctl, keys, order, {"__bad": ("max", F.when(k == DECODE_ERROR, 1).otherwise(0)), "__run": ("sum", F.when(k.isin(SUCCESS, FAILURE), 1).otherwise(0).cast("long"))})
    live = F.col("__bad") == 0
    ok = live & (k == SUCCESS)
    d = prefix(d, keys, order, {"__before": ("last", F.when(ok, F.col(address)))}, inclusive=False)
    login = F.when(k == DECODE_ERROR, 0).when(~live, None).when(k == SUCCESS, 1).when(k.isin(FAILURE, DISCONNECTED), 0)
    window = F.when(~live, None).when(k == SUCCESS, 0).when(k == DISCONNECTED, 1)
    switch = F.when(ok, (F.col("__before").isNotNull() & (F.col("__before") != F.col(address))).cast("int"))
    d = prefix(d, keys, order, {"__epoch": ("sum", F.when(ok, 1).otherwise(0).cast("long")), "__login": ("last", login), "__window": ("last", window), "__switch": ("last", switch)})
    fields = [
        (F.col("__bad") == 1).alias("poisoned"), F.col("__epoch").alias("connection_epoch"), (F.coalesce("__login", F.lit(0)) == 1).alias("logged_in"),
        (F.coalesce("__window", F.lit(0)) == 1).alias("disconnected"), (F.coalesce("__switch", F.lit(0)) == 1).alias("switched"), F.col("__run").alias("logon_run"),
    ]
    if mask:
        d = cut(d, "control")
        adds = ok | (live & (k == SUBSCRIPTION) & (F.coalesce("__login", F.lit(0)) == 1))
        d = prefix(d, [*keys, "__epoch"], order, {"__sum": ("bit_or", F.when(adds, F.col(mask)))}).withColumn("__now", F.when(adds, F.col("__sum")))
        d = prefix(d, keys, order, {"__was": ("last", F.col("__now"))}, inclusive=False)
        moved = F.col("__now").isNotNull() & ~F.col("__now").eqNullSafe(F.col("__was"))
        d = prefix(d.withColumn("__moved", moved.cast("long")), keys, order, {"__sepoch": ("sum", F.col("__moved")), "__mask": ("last", F.col("__now"))})
        fields += [F.col("__sepoch").alias("subscription_epoch"), F.col("__mask").alias("effective_mask"), (moved & F.col("__was").isNotNull()).alias("changed")]
    return d.select(*keys, order, F.struct(*fields, F.col(order).alias("at")).alias("__state"))


def carry(df: DataFrame, states: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """df plus __now, the __state at or before each row: one running last value over the union."""
    kind = states.schema["__state"].dataType
    both = df.withColumn("__state", F.lit(None).cast(kind)).withColumn("__at", F.col(order) * 2 + 1)
    both = both.unionByName(states.withColumn("__at", F.col(order) * 2).drop(order), allowMissingColumns=True)
    return prefix(both, keys, "__at", {"__now": ("last", F.col("__state"))}).where(F.col("__at") % 2 == 1).drop("__state", "__at")


def session(df: DataFrame, keys: Sequence[str] = ("stream",), order: str = "seq", kind: str = "ctype", address: str = "address", mask: Column | None = None) -> DataFrame:
    """df plus poisoned, connection_epoch, logged_in, disconnected, switched, logon_run and quality; with a
    mask (of the keys that a control row answers for) also subscription_epoch, effective_mask and
    subscription_changed. The state machine runs over the few control rows alone."""
    extra = [] if mask is None else [mask.cast("long").alias("__m")]
    ctl = cut(df.where(F.col(kind).isNotNull()).select(*keys, order, kind, address, *extra), "control")
    d = carry(df, cut(control_states(ctl, keys, order, kind, address, "__m" if extra else None), "states"), keys, order)
    zero = F.lit(0).cast("long")
    first = {"poisoned": F.lit(False), "connection_epoch": zero, "logged_in": F.lit(False), "disconnected": F.lit(False), "switched": F.lit(False), "logon_run": zero}
    d = d.withColumns({n: F.coalesce(F.col(f"__now.{n}"), v) for n, v in first.items()})
    if extra:
        own = (F.col("__now.at") == F.col(order)) & F.col("__now.changed")
        d = d.withColumns({"subscription_epoch": F.coalesce("__now.subscription_epoch", zero), "effective_mask": F.col("__now.effective_mask"), "subscription_changed": F.coalesce(own, F.lit(False))})
    unknown = ~F.col("logged_in")
    quality = union(flag("SESSION_UNKNOWN", unknown), flag("SOURCE_DISCONNECTED", unknown & F.col("disconnected")), flag("CONNECTION_SWITCHED", F.col("switched")))
    return d.drop("__now").withColumn("quality", quality)


def first_seen(df: DataFrame, bit: Column, market: Column, keys: Sequence[str] = ("stream",), order: str = "seq") -> DataFrame:
    """df (with session columns) plus seen_mask: required keys seen since the last logon answer, while logged in."""
    value = F.when(market & F.col("logged_in") & ~F.col("poisoned"), bit).otherwise(F.lit(0).cast("long"))
    return prefix(df, [*keys, "logon_run"], order, {"seen_mask": ("bit_or", value)})


#: Refusals in the order in which they are checked; the first that applies is the reason.
READINESS_REASONS = (
    "INVALID_CONFIG", "WRITER_INSTANCE_MISMATCH", "NAMESPACE_MISMATCH", "RAW_FRONTIER_INVALID", "DECODER_CURSOR_INVALID", "WRITER_FATAL",
    "CAPTURE_PIPELINE_UNHEALTHY", "WRITER_HEARTBEAT_MISSING", "WRITER_HEARTBEAT_CLOCK_REGRESSION", "WRITER_HEARTBEAT_TIMED_OUT",
    "DECODER_HEARTBEAT_MISSING", "DECODER_HEARTBEAT_CLOCK_REGRESSION", "DECODER_HEARTBEAT_TIMED_OUT", "DECODER_UNHEALTHY",
    "LIVE_GENERATION_INVALID", "CURRENT_GENERATION_LOGON_MISSING", "CONTROL_POISONED", "CONTROL_EVIDENCE_INCOMPLETE",
    "MARKET_EVIDENCE_INCOMPLETE", "CALENDAR_PROOF_INVALID", "DURABILITY_LAG_EXCEEDED", "DECODER_LAG_EXCEEDED", "DECODER_NOT_CAUGHT_UP",
)


def readiness(tests: dict[str, Column]) -> Column:
    """The first reason, in READINESS_REASONS' order, whose test holds; READY if none does."""
    out = None
    for reason in READINESS_REASONS:
        if reason in tests:
            out = F.when(tests[reason], reason) if out is None else out.when(tests[reason], reason)
    return out.otherwise("READY") if out is not None else F.lit("READY")


def key_masks(keys: DataFrame, group: Sequence[str], key: str, masks: dict[str, Column]) -> DataFrame:
    """Per group a mask for each condition: bit i stands for the i-th of the group's sorted keys, of which there are 63 at most;
    more are an error, not a wrong bit."""
    names = [f"__{n}" for n in masks]
    one = keys.select(*group, key, *[c.cast("boolean").alias(n) for n, c in zip(names, masks.values())]).groupBy(*group, key).agg(*[F.bool_or(n).alias(n) for n in names])
    i = F.row_number().over(Window.partitionBy(*group).orderBy(key)) - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.when(F.col("__i") < 63, F.col("__i")).otherwise(F.raise_error(F.lit("more than 63 keys in a group"))))
    d = one.withColumn("__i", i).withColumn("__bit", bit)
    return d.groupBy(*group).agg(*[F.bit_or(F.when(F.col(n), F.col("__bit")).otherwise(F.lit(0).cast("long"))).alias(m) for n, m in zip(names, masks)])


def resubscribe_verdict(logged_in: Column, trading: Column, hash_ok: Column) -> Column:
    return F.when(~logged_in, "NOT_LOGGED_IN").when(trading, "INSIDE_TRADING").when(~hash_ok, "AUDIT_HASH_MISMATCH").otherwise("ALLOWED")


#: Scopes are counted in so many hash classes; a scope of a class of at most SCOPE_ROWS rows is finished in one task.
CLASSES, SCOPE_ROWS = 65_536, 500_000


def sequence_guard(df: DataFrame, scope: Sequence[str], order: Sequence[str], seq: str, payload: Column, width: int = BUCKET) -> DataFrame:
    """df plus verdict and poisoned. A sequence is compared with the scope's largest accepted one; a repeat
    with the first payload seen under it. After a conflict or a step back the scope is poisoned: later rows
    are classified but not applied. The first column of ``order`` is an integer, the others break ties.

    Rows move once, to the task of their scope. Only a scope of very many rows is many tasks: its running values go by
    buckets of ``width``. df is read twice, for the scopes' counts by hash first; both ways give the same rows."""
    spark, at, ties = df.sparkSession, order[0], list(order[1:])
    of = F.pmod(F.xxhash64(*scope), F.lit(CLASSES))
    counts = df.groupBy(of.alias("__c")).agg(F.count("*").alias("n"))
    rows, heavy = counts.agg(F.sum("n"), F.collect_list(F.when(F.col("n") > SCOPE_ROWS, F.col("__c")))).first()  # at most CLASSES numbers
    same, up = Window.partitionBy(*scope, seq).orderBy(*order), Window.partitionBy(*scope).orderBy(*order)

    def judged(d):
        s, top = F.col(seq), F.col("__top")
        verdict = (
            F.when(top.isNull(), "FIRST_OBSERVED").when((F.col("__n") > 1) & (F.col("__p") == F.col("__first")), "EXACT_DUPLICATE").when(F.col("__n") > 1, "CONFLICT_DUPLICATE")
            .when(s == top + 1, "CONTIGUOUS").when(s > top + 1, "FORWARD_GAP").otherwise("BACKWARD")
        )
        d = d.withColumn("verdict", verdict).withColumn("missing", F.when(F.col("verdict") == "FORWARD_GAP", s - top - 1).otherwise(0).cast("long"))
        return d.drop("__p", "__top", "__first", "__n")

    def compared(d):
        return d.withColumn("__first", F.first("__p").over(same)).withColumn("__n", F.row_number().over(same))

    bad = F.when(F.col("verdict").isin("CONFLICT_DUPLICATE", "BACKWARD"), 1).otherwise(0)

    def light(d):
        d = compared(d.repartition(tasks(spark, rows or 0), *scope).withColumn("__p", payload))
        d = judged(d.withColumn("__top", F.max(seq).over(up.rowsBetween(Window.unboundedPreceding, -1))))
        return d.withColumn("poisoned", F.max(bad).over(up.rowsBetween(Window.unboundedPreceding, 0)) == 1)

    if not heavy:
        return light(df)
    heavy = F.broadcast(spark.createDataFrame([(c,) for c in heavy], "__c long"))
    d = df.join(heavy, of == heavy["__c"], "left_semi").withColumn("__p", payload)
    d = judged(compared(prefix(d, scope, at, {"__top": ("max", F.col(seq))}, inclusive=False, width=width, ties=ties)))
    # Read from a table: the poison's running value reads its input twice, and verdicts are dear.
    d = prefix(cut(d, "guard"), scope, at, {"__bad": ("max", bad)}, width=width, ties=ties)
    d = d.withColumn("poisoned", F.col("__bad") == 1).drop("__bad")
    return light(df.join(heavy, of == heavy["__c"], "left_anti")).unionByName(d)
