"""Bookkeeping: conversations, folders, prompts, scopes, jobs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN_ROLES = ("tool", "system")


def history(messages: DataFrame, conversation: str, order: str, exclude: tuple[str, ...] = HIDDEN_ROLES) -> DataFrame:
    """Messages of each conversation in order, without some roles, with their position."""
    kept = messages.where(~F.col("role").isin(*exclude))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(conversation).orderBy(order)).cast("long"))


def visible(collections: DataFrame, user: Column) -> DataFrame:
    return collections.where((F.col("shared") == True) | (F.col("owner") == user))  # noqa: E712


def not_expired(rows: DataFrame, now: Column, column: str = "expiration_ts") -> DataFrame:
    return rows.where(F.col(column).isNull() | (F.col(column) > now))


def effective_scope(user_scope: DataFrame, conversation_scope: DataFrame, key: str, order: str) -> DataFrame:
    """Union of both scopes: an id in both counts as the user's; user first, each in its own order."""
    ranked = user_scope.select(key, F.lit("user").alias("scope"), F.lit(0).alias("__p"), F.col(order).alias("__o")).unionByName(conversation_scope.select(key, F.lit("conversation").alias("scope"), F.lit(1).alias("__p"), F.col(order).alias("__o")))
    first = Window.partitionBy(key).orderBy("__p", "__o")
    return ranked.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").select(key, "scope", F.struct("__p", "__o").alias("place"))


def system_prompt(assigned: DataFrame, defaults: DataFrame, bundled: str, now: Column) -> DataFrame:
    """One prompt: the assigned one, else the newest default, else the bundled one."""
    live = lambda df, p: not_expired(df, now).select("text", F.lit(p).alias("__p"), F.coalesce("modified_ts", "create_ts").alias("__t"))
    last = assigned.sparkSession.range(1).select(F.lit(bundled).alias("text"), F.lit(2).alias("__p"), F.lit(None).cast("timestamp").alias("__t"))
    return live(assigned, 0).unionByName(live(defaults, 1)).unionByName(last).orderBy("__p", F.desc_nulls_last("__t")).limit(1).select("text")


def job_runs(jobs: DataFrame) -> DataFrame:
    """Duration in whole seconds and a status from counts."""
    status = F.when(F.col("succeeded") > 0, "succeeded").when(F.col("failed") > 0, "failed").when(F.col("active") > 0, "running").otherwise("pending")
    return jobs.withColumn("status", status).withColumn("seconds", F.floor(F.unix_timestamp("finish_ts") - F.unix_timestamp("start_ts")).cast("long"))


def reconcile_jobs(jobs: DataFrame, workers: DataFrame, now: Column, grace: int = 60) -> DataFrame:
    """Active jobs whose worker is gone, beyond a grace period, have failed."""
    joined = jobs.join(workers.select("job_id", F.col("verdict")), "job_id", "left")
    late = F.unix_timestamp(now) - F.unix_timestamp("create_ts") > grace
    lost = F.col("status").isin("queued", "running") & ((F.col("verdict") == "failed") | (F.col("verdict").isNull() & late))
    return joined.withColumn("status", F.when(lost, "failed").otherwise(F.col("status"))).drop("verdict")


def pending_collections(collections: DataFrame, checkpoints: DataFrame, key: str) -> DataFrame:
    """What an incremental run still has to do: everything that isn't done; failures are tried again."""
    return collections.join(checkpoints.where("status = 'done'").select(key), key, "left_anti")


def dedupe_calls(calls: DataFrame, turn: list[str], name: str, arguments: str, order: str) -> DataFrame:
    """First call of each (name, arguments) in a turn."""
    first = Window.partitionBy(*turn, name, arguments).orderBy(order)
    return calls.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def fold_fragments(fragments: DataFrame, group: list[str], order: str, text: str) -> DataFrame:
    """Streamed fragments of each group, joined in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return fragments.groupBy(*group).agg(F.array_join(parts, "").alias("text"), F.count("*").alias("n_fragments"))


def name_is_free(folders: DataFrame, user, parent, name: str, exclude=None) -> bool:
    same = (F.col("user_id") == user) & F.col("parent_id").eqNullSafe(F.lit(parent)) & (F.lower("name") == name.lower())
    if exclude is not None:
        same = same & (F.col("id") != exclude)
    return folders.where(same).isEmpty()


def context_percent(tokens: Column, window: int) -> Column:
    return F.bround(tokens / window * 100, 1)


def substring_filter(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows that hold the query in one of the columns, case aside; a blank query keeps all."""
    wanted = query.strip().lower()
    found = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(wanted)) for c in columns]
    return rows.where(functools.reduce(lambda a, b: a | b, found)) if wanted else rows


def by_title(rows: DataFrame, title: str, key: str, default: str = "Untitled chat") -> DataFrame:
    """Rows in order of title, case aside; rows without one go by the default."""
    return rows.withColumn("shown", F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit(default))).orderBy(F.lower("shown"), key)


def job_history(jobs: DataFrame, started: str, key: str) -> DataFrame:
    """Newest first; jobs that have no start yet come last, as if they had started before all others."""
    return jobs.orderBy(F.desc_nulls_last(started), key)


def rehydrated(messages: DataFrame, refs: DataFrame, chunks: DataFrame, given: DataFrame) -> DataFrame:
    """Messages (conv, id, position, role, text) with the passages that were retrieved for them, in order.

    refs: id, at, chunk; chunks: chunk, passage. `given` (conv, n) says how many messages a caller
    holds; a conversation with another number isn't aligned and stays as it is."""
    told = refs.join(chunks, "chunk").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "passage"))), lambda x: x["passage"]), "\n\n").alias("context"))
    sizes = messages.groupBy("conv").agg(F.count("*").alias("__n")).join(given, "conv").where("__n = n").select("conv", F.lit(True).alias("aligned"))
    rows = messages.join(told, "id", "left").join(sizes, "conv", "left")
    use = F.col("aligned") & (F.col("role") == "user") & F.col("context").isNotNull()
    return rows.withColumn("text", F.when(use, F.concat("context", F.lit("\n\n"), "text")).otherwise(F.col("text"))).drop("context", "aligned")


def cleaned_query(text: Column) -> Column:
    """A query on one line without any LIMIT."""
    flat = F.regexp_replace(F.replace(text, F.lit("\\n"), F.lit(" ")), r"[\n\r\t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r"(?i)\bLIMIT\s+(\d+|\$\w+)\b", " "), r"\s{2,}", " "))


def clamped(limit: Column | int, most: int = 200) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(limit) if isinstance(limit, int) else limit, F.lit(most)))
