"""Snapshots: classifying, merging and comparing incoming rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns' texts; NULL differs from any text."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns)), 256)


def classify(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of either side: NEW, UPDATED, UNCHANGED or RETAINED (not in the incoming rows)."""
    facts = [c for c in incoming.columns if c not in keys]
    old = current.select(*keys, row_hash(facts).alias("_old"))
    new = incoming.select(*keys, row_hash(facts).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "NEW").when(F.col("_new").isNull(), "RETAINED").when(F.col("_old") == F.col("_new"), "UNCHANGED").otherwise("UPDATED")
    return old.join(new, keys, "full_outer").select(*keys, kind.alias("change"))


def merge(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace those of their key; rows of other keys stay."""
    return current.join(incoming.select(keys), keys, "left_anti").unionByName(incoming)


def missing_only(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows of keys that are not known yet."""
    return incoming.join(current.select(keys), keys, "left_anti")


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with `is_duplicate`: all but the first of each key."""
    return rows.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(keys).orderBy(*order)) > 1)


def resolve_facts(rows: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """One row per key: AVAILABLE, DUPLICATE (equal rows) or CONFLICTING, whose facts are NULL."""
    whole = F.struct(*(F.col(c) for c in facts))
    out = rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.size(F.collect_set(F.to_json(whole, {"ignoreNullFields": "false"}))).alias("n_values"), *(F.max(c).alias(c) for c in facts))
    kind = F.when(F.col("n_rows") == 1, "AVAILABLE").when(F.col("n_values") == 1, "DUPLICATE").otherwise("CONFLICTING")
    return out.select(key, "n_rows", kind.alias("evidence"), *(F.when(F.col("n_values") == 1, F.col(c)).alias(c) for c in facts))


def bundles(rows: DataFrame, key: str, columns: list[str], shape: list[str] | None = None) -> DataFrame:
    """Each key's rows as a multiset and its hash, and the hash of their shape columns alone."""
    digest = lambda own: F.sha2(F.array_join(F.sort_array(F.collect_list(row_hash(own))), ","), 256)
    return rows.groupBy(key).agg(F.count("*").alias("n_rows"), digest(columns).alias("bundle"), digest(shape or columns[:1]).alias("shape"))


def classify_bundles(current: DataFrame, incoming: DataFrame, key: str, columns: list[str], shape: list[str] | None = None) -> DataFrame:
    """NEW, EXACT_DUPLICATE, CONFLICT (rows of the same shape, other facts) or UNSAFE (another shape).

    The shape is the multiset of the columns that identify a row (``shape``, by default the first).
    """
    old = bundles(current, key, columns, shape).select(key, F.col("shape").alias("_shape"), F.col("bundle").alias("_bundle"))
    rows = bundles(incoming, key, columns, shape).join(old, key, "left")
    kind = F.when(F.col("_bundle").isNull(), "NEW").when(F.col("_bundle") == F.col("bundle"), "EXACT_DUPLICATE").when(F.col("_shape") == F.col("shape"), "CONFLICT").otherwise("UNSAFE")
    return rows.select(key, "n_rows", kind.alias("verdict"))


def without_absent_zeros(rows: DataFrame, headers: DataFrame, dynamic: Column, name: str = "name", amount: str = "amount", batch: str = "batch_id") -> DataFrame:
    """Component rows but for zeros of dynamic components whose name the other side's header set provably lacks.

    headers: one row per batch of the other side with its names; a batch without one proves nothing.
    """
    known = headers.select(batch, F.col("names").alias("_names"))
    rows = rows.join(known, batch, "left")
    proven = dynamic & F.col("_names").isNotNull() & ~F.array_contains("_names", F.col(name)) & (F.col(amount) == 0)
    return rows.where(~F.coalesce(proven, F.lit(False))).drop("_names")


def classify_events(incoming: DataFrame, committed: DataFrame, fingerprint: str, identity: list[str], order: list[str]) -> DataFrame:
    """Events with an outcome: SKIPPED (known, or seen before in the batch), CONFLICT (its identity has another fact) or NEW."""
    again = F.row_number().over(Window.partitionBy(fingerprint).orderBy(*order)) > 1
    known = committed.select(fingerprint).distinct().withColumn("_known", F.lit(True))
    same = committed.select(*identity).distinct().withColumn("_same", F.lit(True))
    rows = incoming.withColumn("_again", again).join(known, fingerprint, "left").join(same, identity, "left")
    kind = F.when(F.col("_again") | F.col("_known").isNotNull(), "SKIPPED").when(F.col("_same").isNotNull(), "CONFLICT").otherwise("NEW")
    return rows.withColumn("outcome", kind).drop("_again", "_known", "_same")


def preflight(verdicts: DataFrame, events: DataFrame) -> DataFrame:
    """One row: the batch's status by its worst verdict, and how many of each.

    CONFLICT before INCOMPLETE_UNSAFE, ALREADY_IMPORTED when nothing is new, MIXED when some is known.
    """
    count = lambda v: F.count_if(F.col("verdict") == v)
    orders = verdicts.agg(count("NEW").alias("n_new"), count("EXACT_DUPLICATE").alias("n_duplicate"), count("CONFLICT").alias("n_conflict"), count("UNSAFE").alias("n_unsafe"))
    seen = lambda v: F.count_if(F.col("outcome") == v)
    both = orders.join(F.broadcast(events.agg(seen("NEW").alias("n_events_new"), seen("SKIPPED").alias("n_events_skipped"), seen("CONFLICT").alias("n_events_conflict"))))  # one row each
    status = (
        F.when((F.col("n_conflict") > 0) | (F.col("n_events_conflict") > 0), "CONFLICT")
        .when(F.col("n_unsafe") > 0, "INCOMPLETE_UNSAFE")
        .when((F.col("n_new") == 0) & (F.col("n_events_new") == 0), "ALREADY_IMPORTED")
        .when((F.col("n_duplicate") > 0) | (F.col("n_events_skipped") > 0), "MIXED")
        .otherwise("NEW")
    )
    return both.withColumn("status", status)


def write_plan(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """The rows of new keys: what a commit writes."""
    return rows.join(verdicts.where("verdict = 'NEW'"), key, "left_semi")


def exception_queue(issues: DataFrame, key: str) -> DataFrame:
    """One row per key: its first reason, how many more, whether any blocks, and its actions."""
    out = issues.groupBy(key).agg(F.min_by("reason", "position").alias("reason"), F.count("*").alias("n_issues"), F.bool_or("blocking").alias("blocking"), F.array_join(F.array_sort(F.collect_set("action")), ", ").alias("actions"))
    more = F.when(F.col("n_issues") > 1, F.concat(F.col("reason"), F.lit(" +"), (F.col("n_issues") - 1).cast("string"), F.lit(" more"))).otherwise(F.col("reason"))
    return out.withColumn("reason", more)


def work_queue(issues: DataFrame) -> DataFrame:
    """Validation issues as work items: key, scope, title, summary, n_issues, blocking, source, actions, hint, position.

    issues: position (their order), layer, reason, blocking, order_id, source, of_statement, actions (array of label, destructive,
    allowed). All duplicates are one item; then each order is one, each row of a statement, each layer and source, and whatever has
    none of these by itself. The first issue's reason, without the order in front, stands for all; actions that are allowed
    keep the order in which they are first met. Counts are added up before the shuffle, so one item may hold most issues.
    """
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    order, source = filled("order_id"), filled("source")
    place = F.col("position").cast("string")
    duplicate, statement = F.col("layer") == "duplicate", F.coalesce("of_statement", F.lit(False))
    key = (
        F.when(duplicate, "category:duplicate")
        .when(order.isNotNull(), F.concat(F.lit("order:"), order))
        .when(statement, F.concat(F.lit("statement:"), place))
        .when(source.isNotNull(), F.concat(F.lit("source:"), "layer", F.lit(":"), source))
        .otherwise(F.concat(F.lit("other:"), place))
    )
    scope = F.when(duplicate, "Source").when(order.isNotNull(), "Order").when(statement, "Statement").when(source.isNotNull(), "Source").otherwise("Other")
    own = issues.select(key.alias("key"), scope.alias("scope"), order.alias("order_id"), source.alias("source"), "position", "layer", "reason", "blocking", "actions")
    items = own.groupBy("key").agg(
        F.min_by(F.struct("scope", "order_id", "source", "reason"), "position").alias("first"),
        F.count("*").alias("n_issues"),
        F.bool_or("blocking").alias("blocking"),
        F.bool_or(F.col("layer") == "manual_review").alias("manual"),
        F.min("source").alias("low"),
        F.max("source").alias("high"),
        F.min("position").alias("position"),
    )
    allowed = own.select("key", "position", F.posexplode("actions").alias("nth", "action")).where("action.allowed")
    each = allowed.groupBy("key", "action.label").agg(F.min(F.struct("position", "nth")).alias("met"), F.min_by("action.destructive", F.struct("position", "nth")).alias("destructive"))
    actions = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("met", "label", "destructive"))).alias("actions"))
    out = items.join(actions, "key", "left")
    labels = F.coalesce(F.transform("actions", lambda a: a["label"]), F.expr("cast(array() as array<string>)"))
    destructive = F.get(F.filter("actions", lambda a: a["destructive"]), F.lit(0))["label"]
    of_all = F.col("key") == "category:duplicate"
    reason = F.when(F.startswith("first.reason", F.concat("first.order_id", F.lit(":"))), F.ltrim(F.substr("first.reason", F.length("first.order_id") + 2))).otherwise(F.col("first.reason"))
    more = F.when(F.col("n_issues") > 1, F.concat(F.lit(" +"), (F.col("n_issues") - 1).cast("string"), F.lit(" more"))).otherwise("")
    return out.select(
        "key",
        "first.scope",
        F.when(of_all, "Duplicate sources").otherwise(F.coalesce("first.order_id", "first.source", F.lit("Current batch"))).alias("title"),
        F.concat(reason, more).alias("summary"),
        "n_issues",
        "blocking",
        F.when(~of_all, F.col("first.source")).when(F.col("low") == F.col("high"), F.col("low")).alias("source"),
        labels.alias("actions"),
        F.when(F.col("manual"), "Review form below").otherwise(F.coalesce(destructive, F.lit("View details"))).alias("hint"),
        "position",
    )


def lost_issues(issues: DataFrame, queue: DataFrame) -> DataFrame:
    """Empty unless the queue's items hold another number of issues than there are."""
    counts = issues.agg(F.count("*").alias("n_issues")).join(F.broadcast(queue.agg(F.coalesce(F.sum("n_issues"), F.lit(0)).alias("n_held"))))  # one row each
    return counts.where("n_issues <> n_held")
