"""Ingest: identity, keyed upserts, reconciliation, retirement, overlays, snapshots, ledgers, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in order: what a batch may bring for a key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def identify(batch: DataFrame, stored: DataFrame, row: str, stored_id: str, rules: list[list[str]]) -> DataFrame:
    """`batch` with `matched_id` and `rule`: the stored row that the first rule of equal columns finds, null if none does.

    Each rule is one equality join on stored rows reduced to a row for each key; rows without a value of the rule don't match by it.
    """
    out = batch.select(row, *sorted({c for r in rules for c in r}))
    for i, columns in enumerate(rules):
        known = stored.dropna(subset=columns).groupBy(*columns).agg(F.min(stored_id).alias(f"m{i}"))
        out = out.join(known, columns, "left")
    matched = F.coalesce(*(f"m{i}" for i in range(len(rules))))
    rule = F.coalesce(*(F.when(F.col(f"m{i}").isNotNull(), F.lit(i)) for i in range(len(rules))))
    return batch.join(out.select(row, matched.alias("matched_id"), rule.alias("rule")), row, "left")


def upsert(stored: DataFrame, batch: DataFrame, key: str, overwrite: list[str], keep_if_null: list[str] = ()) -> DataFrame:
    """All rows after the merge, with `action`: inserted, changed, unchanged (met, nothing new) or kept (not in the batch).

    `overwrite` columns take the new value, null included; `keep_if_null` ones keep the old where the new is null.
    """
    o, n = stored.withColumn("__old", F.lit(True)).alias("o"), batch.withColumn("__new", F.lit(True)).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    has_old, has_new = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    value = {c: F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in overwrite}
    value |= {c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) for c in keep_if_null}
    same = F.lit(True)
    for c, v in value.items():
        same = same & v.eqNullSafe(F.col(f"o.{c}"))
    action = F.when(~has_old, "inserted").when(~has_new, "kept").when(same, "unchanged").otherwise("changed")
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *(v.alias(c) for c, v in value.items()), action.alias("action"))


def reconcile(stored: DataFrame, batch: DataFrame, key: str, policy: str) -> DataFrame:
    """(key, action) under add_only (what is there stays), smart_merge (what editors touched stays) or replace (machine rows make way).

    `stored` has the booleans added, edited and deleted.
    """
    touched = F.coalesce(F.col("added"), F.lit(False)) | F.coalesce(F.col("edited"), F.lit(False))
    both = stored.select(key, "added", "edited", F.lit(True).alias("__old")).join(batch.select(key, F.lit(True).alias("__new")), key, "full_outer")
    old, new = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    if policy == "add_only":
        action = F.when(~old, "insert").otherwise("keep")
    elif policy == "smart_merge":
        action = F.when(~old, "insert").when(touched, "keep").when(new, "update").otherwise("retire")
    elif policy == "replace":
        action = F.when(~old, "insert").when(touched, "keep").when(new, "replace").otherwise("delete")
    else:
        raise ValueError(policy)
    return both.select(key, action.alias("action"))


def retire(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """`stored` with machine rows that the batch no longer brings marked deleted."""
    seen = batch.select(key).distinct().withColumn("__seen", F.lit(True))
    gone = F.col("__seen").isNull() & ~F.coalesce("added", F.lit(False)) & ~F.coalesce("edited", F.lit(False))
    return stored.join(seen, key, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)) | gone).drop("__seen")


def orphans(entities: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    """Entities that no active mention is left of."""
    return entities.join(mentions.filter("active").select(key), key, "left_anti")


def overlay(base: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Machine rows under an editor's: `edits` has op (edit, add, remove) and new values, of which null means as it was."""
    removed = edits.filter("op = 'remove'").select(key)
    patch = edits.filter("op = 'edit'").select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    rest = base.join(removed, key, "left_anti").join(patch, key, "left")
    rest = rest.select(key, *(F.coalesce(f"__{c}", c).alias(c) for c in columns))
    return rest.unionByName(edits.filter("op = 'add'").select(key, *columns))


def persist_values(stored: DataFrame, batch: DataFrame, keys: list[str], policy: str) -> DataFrame:
    """`keys`, value, confidence and `action` after a batch of single values (metadata or embeddings): one row for each key.

    add_only keeps what is there; smart_merge takes the new value unless an editor touched the row (`stored`: edited);
    replace takes it always. A batch that brings a key twice counts by its surest value, then the smallest.
    """
    if policy not in ("add_only", "smart_merge", "replace"):
        raise ValueError(policy)
    best = latest(batch, keys, [F.desc_nulls_last("confidence"), F.col("value")])
    o = stored.select(*keys, *(F.col(c).alias(f"__{c}") for c in ("value", "confidence", "edited")), F.lit(True).alias("__old"))
    both = o.join(best.select(*keys, "value", "confidence", F.lit(True).alias("__new")), keys, "full_outer")
    old, new = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    fixed = {"add_only": old, "smart_merge": old & F.coalesce("__edited", F.lit(False)), "replace": F.lit(False)}[policy]
    stays = ~new | fixed
    same = F.col("value").eqNullSafe(F.col("__value")) & F.col("confidence").eqNullSafe(F.col("__confidence"))
    action = F.when(~old, "inserted").when(~new, "kept").when(fixed, "skipped").when(same, "unchanged").otherwise("changed")
    taken = lambda c: F.when(old & stays, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*keys, taken("value"), taken("confidence"), action.alias("action"))


def persist_sets(stored: DataFrame, batch: DataFrame, keys: list[str], index: str, policy: str) -> DataFrame:
    """All rows after a batch of whole sets (custom records by article and type, images of an article): a set that the batch brings
    replaces the stored one, unless add_only finds one there. Sets that it doesn't bring stay. Of rows with one index the first by
    their other columns counts."""
    if policy not in ("add_only", "replace"):
        raise ValueError(policy)
    rest = sorted(c for c in batch.columns if c not in (*keys, index))
    new = latest(batch, [*keys, index], [F.col(c) for c in rest])
    if policy == "add_only":
        return stored.unionByName(new.join(stored.select(*keys), keys, "left_anti"))
    return stored.join(batch.select(*keys), keys, "left_anti").unionByName(new)


def hash_diff(stored: DataFrame, built: DataFrame, key: str) -> DataFrame:
    """(key, action): create, update, unchanged, reactivate or deactivate, by the hash of what is indexed.

    `stored` has hash and active, `built` has hash.
    """
    both = stored.select(key, F.col("hash").alias("old"), "active").join(built.select(key, F.col("hash").alias("new")), key, "full_outer")
    action = (
        F.when(F.col("old").isNull(), "create")
        .when(F.col("new").isNull(), F.when(F.col("active"), "deactivate").otherwise("unchanged"))
        .when(~F.col("active"), "reactivate")
        .when(F.col("old") == F.col("new"), "unchanged")
        .otherwise("update")
    )
    return both.select(key, action.alias("action"))


def rewire(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges after canonicals were merged (`merged`: type, id, into): ends replaced, loops and doubles dropped."""
    for side in ("from", "to"):
        m = merged.select(F.col("type").alias(f"{side}_type"), F.col("id").alias(f"{side}_id"), F.col("into").alias("__into"))
        edges = edges.join(m, [f"{side}_type", f"{side}_id"], "left").withColumn(f"{side}_id", F.coalesce("__into", f"{side}_id")).drop("__into")
    return edges.filter(~((F.col("from_type") == F.col("to_type")) & (F.col("from_id") == F.col("to_id")))).distinct()


def append_new(links: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Links that the snapshot doesn't hold yet."""
    return links.select(*keys).distinct().join(kept.select(*keys), keys, "left_anti")


def ledger(arrivals: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """`arrivals` (source, item, fingerprint) with `action`: new, changed, retry (failed or lease over), busy or done."""
    e = entries.select("source", "item", F.col("fingerprint").alias("__f"), "status", "lease_until")
    j = arrivals.join(e, ["source", "item"], "left")
    action = (
        F.when(F.col("status").isNull(), "new")
        .when((F.col("status") == "running") & (F.col("lease_until") > now), "busy")
        .when(F.col("__f") != F.col("fingerprint"), "changed")
        .when(F.col("status") == "succeeded", "done")
        .otherwise("retry")
    )
    return j.withColumn("action", action).drop("__f")


def chunks(df: DataFrame, text: str, *, target: int = 4000, overlap: int = 250) -> DataFrame:
    """`df` exploded to chunks of about `target` tokens of four characters: each owns its range, and its context reaches `overlap` tokens beyond.

    Ranges are characters: [own_start, own_end) partition the text, [start, end) is what the chunk shows. A text below the target is one chunk.
    """
    size, reach = target * 4, overlap * 4
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    out = df.select("*", F.posexplode(starts).alias("chunk", "own_start"))
    own_end = F.least(F.col("own_start") + size, n)
    begin = F.greatest(F.col("own_start") - reach, F.lit(0))
    end = F.least(own_end + reach, n)
    return out.withColumns({"own_end": own_end, "start": begin, "end": end, "chunk_text": F.substring(F.col(text), begin + 1, end - begin)})


def spans(df: DataFrame, text: str, needle: str) -> DataFrame:
    """`df` with each place of `needle` (a column) in `text`, without case, between characters that are no letters or digits: start and end."""
    low, pattern = F.lower(text), F.lower(needle)
    pieces = F.split(low, F.concat(F.lit(r"\Q"), pattern, F.lit(r"\E")), -1)
    lengths = F.transform(pieces, lambda p: F.length(p))
    begins = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda s, x: s + x) + (i - 1) * F.length(pattern))
    out = df.filter(F.contains(low, pattern) & (F.length(pattern) > 0)).select("*", F.explode(begins).alias("start"))
    out = out.withColumn("end", F.col("start") + F.length(needle))
    side = lambda at: F.when(at < 1, F.lit(" ")).otherwise(F.substring(low, at, F.lit(1)))
    return out.filter(~side(F.col("start")).rlike("[a-z0-9]") & ~side(F.col("end") + 1).rlike("[a-z0-9]"))


def from_evidence(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, occurrences) of (article, entity, nature, text, start, end) rows: one mention for an article and entity, whose nature
    is that of its first span; its different spans in order."""
    spans_ = evidence.groupBy("article", "entity", "start", "end").agg(F.min("text").alias("text"), F.min("nature").alias("nature"))
    first = F.min(F.struct("start", "end", "nature"))
    mentions = spans_.groupBy("article", "entity").agg(first["nature"].alias("nature"), F.count("*").alias("occurrences"))
    place = F.row_number().over(Window.partitionBy("article", "entity").orderBy("start", "end"))
    return mentions, spans_.select("article", "entity", place.alias("place"), "start", "end", "text")


def cached(queries: DataFrame, labels: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """`queries` (query, name, fingerprint) with `found` and `tier`: label, if exactly one canonical bears the name or has it as alias
    (`labels`: norm, canonical); else cache, if its entry (fingerprint, result, expires_at) is still good; else miss."""
    alone = labels.groupBy("norm").agg(F.min("canonical").alias("__c"), F.count_distinct("canonical").alias("__n")).filter("__n = 1").drop("__n")
    fresh = cache.filter(F.col("expires_at") > now).groupBy("fingerprint").agg(F.max_by("result", "expires_at").alias("__r"))
    j = queries.join(alone, F.col("name") == F.col("norm"), "left").join(fresh, "fingerprint", "left")
    tier = F.when(F.col("__c").isNotNull(), "label").when(F.col("__r").isNotNull(), "cache").otherwise("miss")
    return j.select("query", F.coalesce(F.col("__c").cast("string"), F.col("__r").cast("string")).alias("found"), tier.alias("tier"))
