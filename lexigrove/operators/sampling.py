"""Deterministic samples, quotas, splits and leakage checks."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Split shares and benchmark quotas.
SPLITS = {"train": 0.70, "val": 0.15, "test": 0.15}
QUOTAS = (25, 35, 25, 20, 15, 10, 10, 10)


def stable_key(seed: int, salt: str, key: Column) -> Column:
    """Pseudo-random order that depends on seed, salt and key only."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), key.cast("string")), 256)


def stable_sample(rows: DataFrame, n: int, seed: int, salt: str, key: str) -> DataFrame:
    """The ``n`` rows that come first in the stable order (a top-n, so only n rows leave each task)."""
    return rows.withColumn("stable_key", stable_key(seed, salt, F.col(key))).orderBy("stable_key", key).limit(n)


def quota_sample(rows: DataFrame, by: str, n: int, seed: int, salt: str, key: str) -> DataFrame:
    window = Window.partitionBy(by).orderBy(stable_key(seed, salt, F.col(key)), key)
    return rows.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n)


def coverage_sample(rows: DataFrame, by: str, n: int, seed: int, salt: str, key: str) -> DataFrame:
    """One row for each ``by`` first, then the rest, in stable order, ``n`` in all."""
    order = stable_key(seed, salt, F.col(key))
    first = F.row_number().over(Window.partitionBy(by).orderBy(order, key)) == 1
    return rows.withColumn("covers", first).withColumn("stable_key", order).orderBy(F.col("covers").desc(), "stable_key", key).limit(n)


def pools(rows: DataFrame, filters: list[tuple[str, Column, int]], seed: int, key: str = "chunk_id") -> DataFrame:
    """Quota pools drawn one after the other; what one pool took, later pools take only if they run short.

    Before pool i at most the quotas of the pools before it are taken, so the first q1 + ... + qi rows of its own order
    hold all it can draw.  One scan gives each pool those rows (a top-n for each); the draw itself works on this
    candidate list, whose size the quotas fix.  A key that several rows have counts once, and so does null.
    """
    reach, total = {}, 0
    for name, _, quota in filters:
        total += quota
        reach[name] = total
    offers = F.array_compact(F.array(*[F.when(condition, F.struct(F.lit(n).alias("no"), F.lit(name).alias("pool"), F.lit(reach[name]).alias("reach"), F.lit(quota).alias("quota"), stable_key(seed, name, F.col(key)).alias("stable_key"))) for n, (name, condition, quota) in enumerate(filters)]))
    offered = rows.select("*", F.explode(offers).alias("_offer")).select(*rows.columns, "_offer.*").dropDuplicates(["no", key])
    place = F.row_number().over(Window.partitionBy("no").orderBy("stable_key", key))
    candidates = offered.withColumn("place", place).where(F.col("place") <= F.col("reach"))

    def draw(own: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        drawn = []
        for (_, quota), pool in own.sort_values(["no", "place"]).groupby(["no", "quota"], sort=True):
            reused = pool["name"].isin(taken)
            chosen = pd.concat([pool[~reused].assign(reused=False), pool[reused].assign(reused=True)]).head(quota)
            taken.update(chosen["name"])
            drawn.append(chosen[["no", "place", "reused"]])
        return pd.concat(drawn) if drawn else pd.DataFrame({"no": [], "place": [], "reused": []})

    # rows are told apart by their place, keys by their spelling, so that a null key is one like any other
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null")).alias("name")
    choice = candidates.select(name, "no", "quota", "place", F.lit(0).alias("all")).groupBy("all").applyInPandas(lambda own: draw(own), "no int, place int, reused boolean")
    return candidates.join(choice, ["no", "place"]).select(*rows.columns, "stable_key", "reused", "pool")


def hash_split(key: Column, seed: int = 0, shares: dict[str, float] = SPLITS) -> Column:
    """Split by hash of a group key: rows of one group never part, and nothing is collected."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out, edge = None, 0.0
    for name, share in shares.items():
        edge += share
        out = F.when(place < edge, name) if out is None else out.when(place < edge, name)
    return out.otherwise(list(shares)[-1])


def leakage(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count("*").alias("n_rows")).where(F.size("splits") > 1)


#: Parts of a stratum whose running totals are computed apart.
PARTS = 64


def stratified_split(samples: DataFrame, seed: int, shares: dict[str, float] = SPLITS) -> DataFrame:
    """(sample_id, split): multilabel stratification over groups of equal digest, without one task that sees all.

    ``samples``: sample_id, digest, labels.  A sample without a digest is a group of its own.  A group belongs to the
    stratum of its rarest label, so rare labels are shared out on their own terms before common ones.  Inside a stratum
    groups stand in stable random order, larger ones first; each goes to the split on whose share of the stratum's rows
    its middle falls.  Every split thus gets its share of every stratum to within one group, and of every label about as
    well (``balance`` tells how well).  Running totals have two levels (totals of parts, then inside a part), so a label
    of most rows is no single task.
    """
    own = F.coalesce(F.concat(F.lit("="), F.col("digest").cast("string")), F.concat(F.lit("null:"), F.col("sample_id").cast("string")))
    samples = samples.withColumn("_group", own)
    groups = samples.groupBy("_group").agg(F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("labels", F.array().cast("array<string>"))))).alias("kinds"))
    counts = samples.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("held"))
    rarest = groups.select("_group", F.explode("kinds").alias("label")).join(counts, "label").groupBy("_group").agg(F.min(F.struct("held", "label"))["label"].alias("stratum"))
    order = stable_key(seed, "split", F.expr("CASE WHEN _group LIKE '=%' THEN substr(_group, 2) ELSE _group END"))
    placed = groups.join(rarest, "_group", "left").select("_group", "n", F.coalesce("stratum", F.lit("")).alias("stratum"), order.alias("place"))
    # larger groups first: parts ascend with the falling logarithm of the size, then with the order
    size = F.lit(63) - F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    placed = placed.withColumn("part", size * PARTS + F.pmod(F.conv(F.substring("place", 1, 4), 16, 10).cast("int"), F.lit(1 << 16)) * PARTS / (1 << 16)).withColumn("part", F.floor("part"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("stratum", "part").agg(F.sum("n").alias("rows"))
    of_stratum = Window.partitionBy("stratum")
    totals = totals.select("stratum", "part", F.sum("rows").over(of_stratum).alias("all"), F.coalesce(F.sum("rows").over(before(of_stratum.orderBy("part"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(before(Window.partitionBy("stratum", "part").orderBy("place", "_group"))), F.lit(0))
    middle = (F.col("base") + inside + F.col("n") / 2) / F.col("all")
    split, edge = None, 0.0
    for name, share in shares.items():
        edge += share
        split = F.when(middle < edge, name) if split is None else split.when(middle < edge, name)
    found = placed.join(totals, ["stratum", "part"]).withColumn("split", split.otherwise(list(shares)[-1]))
    return samples.join(found.select("_group", "split"), "_group").select("sample_id", "split")


#: Kinds of groups (rows of each label, and size) that one task weighs against one another.
KINDS = 100_000


def balanced_split(samples: DataFrame, seed: int, shares: dict[str, float] = SPLITS) -> DataFrame:
    """(sample_id, split): every label has its share of every split to within its largest group, as far as that can be had.

    Groups of equal digest (a sample without one is a group of its own) are counted by kind, that is rows of each label and size.
    Of a kind's m groups each split gets the whole part of m times its share; the one or two that are left over are
    given out kind by kind, the rarest first, where their labels lack most, and moved while that brings labels nearer
    to their shares.  What is weighed are kinds, not rows: one row a kind, KINDS of them a task, so a label of most rows
    costs no more than a rare one.  Groups of a kind stand in stable random order, ranked in two levels.
    """
    names, part = list(shares), np.array(list(shares.values()))
    own = F.coalesce(F.concat(F.lit("="), F.col("digest").cast("string")), F.concat(F.lit("null:"), F.col("sample_id").cast("string")))
    samples = samples.withColumn("_group", own)
    # copies may have other labels than their original, so a kind says how many rows of each label a group has
    held = samples.select("_group", F.explode(F.array_distinct("labels")).alias("label")).groupBy("_group", "label").agg(F.count("*").alias("rows"))
    held = held.groupBy("_group").agg(F.to_json(F.array_sort(F.collect_list(F.struct("label", "rows")))).alias("kind"))
    groups = samples.groupBy("_group").agg(F.count("*").alias("n")).join(held, "_group", "left").select("_group", "n", F.coalesce("kind", F.lit("[]")).alias("kind"))
    kinds = groups.groupBy("kind", "n").agg(F.count("*").alias("m"))
    tasks = max(1, -(-kinds.count() // KINDS))

    def weigh(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["kind", "n"]).reset_index(drop=True)
        said = [[(x["label"], x["rows"]) for x in json.loads(k)] for k in own["kind"]]
        labels = {label: i for i, label in enumerate(sorted({label for rows in said for label, _ in rows}))}
        n, m = own["n"].to_numpy(np.int64), own["m"].to_numpy(np.int64)
        # of each kind the labels and their rows; all rows come last, as a label of their own
        at = [np.array([*(labels[label] for label, _ in rows), len(labels)]) for rows in said]
        weight = [np.array([*(r for _, r in rows), n[k]], float) for k, rows in enumerate(said)]
        given = np.floor(m[:, None] * part[None, :] + 1e-9).astype(np.int64)
        total, lack = np.zeros(len(labels) + 1), np.zeros((len(labels) + 1, len(part)))
        for k in range(len(own)):
            total[at[k]] += m[k] * weight[k]
            lack[at[k]] += (m[k] * part - given[k])[None, :] * weight[k][:, None]
        scale = 1 / np.maximum(total, 1)
        rest = [(k, at[k], weight[k][:, None]) for k in range(len(own)) for _ in range(m[k] - given[k].sum())]
        rest.sort(key=lambda r: (total[r[1]].min(), -n[r[0]], r[0]))
        place = []
        for _, own_at, w in rest:
            to = int(np.argmax((w * lack[own_at] * scale[own_at, None]).sum(axis=0)))
            lack[own_at, to] -= w[:, 0]
            place.append(to)
        for _ in range(20):  # moves that lower the squared lacks; each pass ends at the last leftover
            moved = False
            for i, (_, own_at, w) in enumerate(rest):
                now, by = place[i], scale[own_at, None]
                gain = (by * (2 * w * (lack[own_at] - lack[own_at][:, [now]]) - 2 * w * w)).sum(axis=0)
                gain[now] = 0
                to = int(np.argmax(gain))
                if gain[to] > 1e-9:
                    lack[own_at, now] += w[:, 0]
                    lack[own_at, to] -= w[:, 0]
                    place[i], moved = to, True
            if not moved:
                break
        most = np.full(len(labels) + 1, np.inf)  # the bound of a label is its largest group; all rows have none
        for k in range(len(own)):
            most[at[k][:-1]] = np.where(np.isinf(most[at[k][:-1]]), weight[k][:-1], np.maximum(most[at[k][:-1]], weight[k][:-1]))
        _repair(rest, place, lack, scale, most)
        for (k, _, _), to in zip(rest, place):
            given[k, to] += 1
        return pd.DataFrame({"kind": own["kind"], "n": n, "given": [g.tolist() for g in given]})

    dealt = kinds.withColumn("task", F.pmod(F.xxhash64("kind", "n"), F.lit(tasks)))
    plan = dealt.groupBy("task").applyInPandas(lambda own: weigh(own), "kind string, n long, given array<long>")
    order = stable_key(seed, "split", F.expr("CASE WHEN _group LIKE '=%' THEN substr(_group, 2) ELSE _group END"))
    placed = groups.withColumn("place", order).withColumn("part", F.floor(F.conv(F.substring("place", 1, 4), 16, 10).cast("int") * PARTS / (1 << 16)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("kind", "n", "part").agg(F.count("*").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(before(Window.partitionBy("kind", "n").orderBy("part"))), F.lit(0))).drop("m")
    nth = F.row_number().over(Window.partitionBy("kind", "n", "part").orderBy("place", "_group"))
    ranked = placed.withColumn("nth", nth).join(base, ["kind", "n", "part"]).join(plan, ["kind", "n"])
    rank, split, edge = F.col("base") + F.col("nth"), None, F.lit(0)
    for i, name in enumerate(names):
        edge = edge + F.get("given", F.lit(i))
        split = F.when(rank <= edge, name) if split is None else split.when(rank <= edge, name)
    found = ranked.select("_group", split.alias("split"))
    return samples.join(found, "_group").select("sample_id", "split")


def _repair(rest: list[tuple[int, np.ndarray, np.ndarray]], place: list[int], lack: np.ndarray, scale: np.ndarray, most: np.ndarray, near: int = 150) -> None:
    """Moves, and exchanges in pairs, that bring labels back inside their bounds; the worst label first, until none helps.

    A step looks at the leftovers that have the label where it has too many rows, and for exchanges at ``near`` others
    in the split where it has too few, those with most labels in common first.
    """

    def cost(at: np.ndarray) -> float:
        beyond = np.maximum(np.abs(lack[at]) - most[at, None], 0)
        return float((beyond**2).sum()) + 1e-6 * float((lack[at] ** 2 * scale[at, None]).sum())

    def shift(i: int, to: int) -> None:
        _, at, w = rest[i]
        lack[at, place[i]] += w[:, 0]
        lack[at, to] -= w[:, 0]
        place[i] = to

    for _ in range(4 * len(most)):
        beyond = np.abs(lack) - most[:, None]
        label = int(np.argmax(beyond.max(axis=1)))
        if beyond[label].max() <= 1e-9:
            return
        low, high = int(np.argmin(lack[label])), int(np.argmax(lack[label]))  # too many rows here, too few there
        best, choice = -1e-12, None
        own = [i for i in range(len(rest)) if place[i] == low and label in rest[i][1]][:near]
        for to in {high, *range(lack.shape[1])} - {low}:
            others = [j for j in range(len(rest)) if place[j] == to and label not in rest[j][1]]
            for i in own:
                partners = sorted(others, key=lambda j: -len(np.intersect1d(rest[i][1], rest[j][1])))[:near] if to == high else []
                for j in [None, *partners]:
                    at = rest[i][1] if j is None else np.union1d(rest[i][1], rest[j][1])
                    now = cost(at)
                    shift(i, to)
                    if j is not None:
                        shift(j, low)
                    gain = cost(at) - now
                    shift(i, low)
                    if j is not None:
                        shift(j, to)
                    if gain < best:
                        best, choice = gain, (i, j, to)
        if choice is None:
            return
        i, j, to = choice
        shift(i, to)
        if j is not None:
            shift(j, low)


def balance(samples: DataFrame, splits: DataFrame, shares: dict[str, float] = SPLITS) -> DataFrame:
    """(label, split, held, rows, off): rows of each label in each split, and how many more or fewer than its share."""
    share = F.create_map(*[x for name, part in shares.items() for x in (F.lit(name), F.lit(part))])
    rows = samples.join(splits, "sample_id").select(F.explode(F.array_distinct("labels")).alias("label"), "split")
    found = rows.groupBy("label").pivot("split", list(shares)).count()
    held = F.array(*[F.struct(F.lit(name).alias("split"), F.coalesce(F.col(name), F.lit(0)).alias("rows")) for name in shares])
    flat = found.select("label", sum((F.coalesce(F.col(n), F.lit(0)) for n in shares), F.lit(0)).alias("held"), F.explode(held).alias("s")).select("label", "s.split", "held", "s.rows")
    return flat.withColumn("off", F.round(F.col("rows") - F.col("held") * share[F.col("split")], 6))


def rare_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """Labels with fewer rows than half of the median label."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg((F.percentile("n", F.lit(0.5)) * 0.5).alias("floor")))).where("n < floor").select(label, "n", "floor")


def quota_report(records: DataFrame, quotas: DataFrame, kind: str = "question_type") -> DataFrame:
    """Kinds whose count is not the quota, on either side."""
    got = records.groupBy(kind).agg(F.count("*").alias("n"))
    return got.join(quotas, kind, "fullouter").fillna(0, ["n", "quota"]).where("n <> quota")
