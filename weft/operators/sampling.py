"""Reproducible sampling, stratification and splitting: random order is the MD5 of a seed and the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weft.sources.scratch import settle


def uid(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def sample(entities: DataFrame, n: int, taken: DataFrame | None = None, key: str = "s", seed: int = 42) -> DataFrame:
    """The first n entities in random order that are in no earlier sample: a top-k, not a sort of all."""
    left = entities if taken is None else entities.join(taken.select(key), key, "left_anti")
    return left.withColumn("uid", uid(F.col(key), seed)).orderBy("uid", key).limit(n)


def quota(facts: DataFrame, n: int, key: str = "s", prop: str = "p", seed: int = 42, total: int | None = None) -> DataFrame:
    """Sufficient exposure, free of order: up to n entities for each property (random order); their union. Deviates from a sequential greedy, which
    can't run in parallel: a property is never under its quota if it has the entities, the sum may be larger. With a total, only as many entities stay: those that stand
    first for one of their properties, so that all properties lose alike."""
    place = F.row_number().over(W.Window.partitionBy(prop).orderBy(uid(F.col(key), seed), key))
    chosen = facts.select(key, prop).distinct().withColumn("n", place).where(F.col("n") <= n).groupBy(key).agg(F.count("*").alias("n_quotas"), F.min("n").alias("__first"))
    if total is not None:
        chosen = chosen.orderBy("__first", uid(F.col(key), seed), key).limit(total)
    return chosen.drop("__first")


def exposure(facts: DataFrame, quota: int = 1000, total: int = 4800, repeats: int = 100, key: str = "s", prop: str = "p", seed: int = 42) -> DataFrame:
    """Sufficient exposure as a greedy does it: (key, round, prop) of the entities chosen. Properties come rarest first, a round for each. A round goes through the entities of its property in random
    order until it has met `repeats` that an earlier round has met too; the new ones among those are chosen while the property has no more than `quota` chosen entities (of any
    round) and fewer than `total` are chosen in all. Those met but not chosen are not new in later rounds either.

    A round is a few joins and top-k steps, as only the number of choices of each property passes from one to the next: numbers for the properties of a
    shape, on the driver, and the entities met, as a table. No task gets the entities of a property as a whole."""
    pairs = facts.select(F.col(key).alias("s"), F.col(prop).alias("p")).where("s IS NOT NULL AND p IS NOT NULL").distinct()
    pairs = settle(pairs.withColumn("u", uid(F.col("s"), seed)))
    order = sorted(pairs.groupBy("p").count().collect(), key=lambda r: (r["count"], r.p))  # the properties of a shape
    chosen, met, have = [], None, dict.fromkeys((r.p for r in order), 0)
    for i, p in enumerate(r.p for r in order):
        own = pairs.where(F.col("p") == p).select("s", "u")
        new = own
        if met is not None:
            last = own.join(met, "s", "left_semi").orderBy("u", "s").limit(repeats).agg(F.count("*").alias("n"), F.max(F.struct("u", "s")).alias("last")).first()
            new = own.join(met, "s", "left_anti")
            if last.n == repeats:
                new = new.where((F.col("u") < last["last"].u) | ((F.col("u") == last["last"].u) & (F.col("s") < last["last"].s)))
        k = max(0, min(quota + 1 - have[p], total - sum(n for _, n in chosen)))
        new = settle(new)
        picked = settle(new.orderBy("u", "s").limit(k).select("s", F.lit(i).alias("round"), F.lit(p).alias("p")))
        for r in pairs.join(picked.select("s"), "s").groupBy("p").count().collect():
            have[r.p] += r["count"]
        chosen.append((picked, picked.count()))
        met = new.select("s") if met is None else met.unionByName(new.select("s"))
    out = chosen[0][0] if chosen else facts.sparkSession.createDataFrame([], "s string, round int, p string")
    for picked, _ in chosen[1:]:
        out = out.unionByName(picked)
    return out.select(F.col("s").alias(key), "round", F.col("p").alias(prop))


def strata(facts: DataFrame, key: str = "s", prop: str = "p") -> DataFrame:
    """Per entity its stratum: the rarest of its under-represented properties (those below the mean count), else NONE."""
    counts = facts.groupBy(prop).agg(F.count_distinct(key).alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    rare = counts.join(F.broadcast(mean)).where("n < mean").select(prop, "n")  # a row for each property of a shape
    hit = facts.join(F.broadcast(rare), prop).groupBy(key).agg(F.min(F.struct("n", prop)).alias("m"))
    return facts.select(key).distinct().join(hit, key, "left").select(key, F.coalesce(f"m.{prop}", F.lit("NONE")).alias("stratum"))


def ranked(rows: DataFrame, order: Column, *more: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds n, the place in the order (an MD5 in hexadecimal, then further columns) within each group of `by`, and all, the rows of the group. Groups are cut into
    65,536 buckets by the first digits, whose counts are added up; so no task sorts a whole group."""
    keys = [*by, "__b"]
    hashed = rows.withColumn("__o", order).withColumn("__b", F.substring("__o", 1, 4))
    counts = hashed.groupBy(*keys).agg(F.count("*").alias("__c"))
    group = W.Window.partitionBy(*by) if by else W.Window.partitionBy()
    base = counts.select(*keys, (F.sum("__c").over(group.orderBy("__b")) - F.col("__c")).alias("__a"), F.sum("__c").over(group).alias("all"))
    base = base if by else F.broadcast(base)  # a row for each bucket
    place = F.row_number().over(W.Window.partitionBy(*keys).orderBy("__o", *more)) - 1
    return hashed.withColumn("__r", place).join(base, keys).withColumn("n", F.col("__a") + F.col("__r")).drop("__o", "__b", "__a", "__r")


def stratified_split(rows: DataFrame, stratum: str, share: int = 6, key: str = "s", seed: int = 0) -> DataFrame:
    """test for one in `share` of each stratum (rounded down), train for the rest."""
    placed = ranked(rows, uid(F.col(key), seed), key, by=(stratum,))
    return placed.withColumn("split", F.when(F.col("n") < F.floor(F.col("all") / share), "test").otherwise("train")).drop("n", "all")


def stratified_kfold(rows: DataFrame, stratum: str, k: int, key: str = "s", seed: int = 42) -> DataFrame:
    """Folds that share out each stratum evenly: its rows go round the folds in a random order, beginning where a hash of the stratum says."""
    placed = ranked(rows, uid(F.col(key), seed), key, by=(stratum,))
    begin = F.conv(F.substring(uid(F.col(stratum), seed), 1, 6), 16, 10).cast("long")
    return placed.withColumn("fold", F.pmod(F.col("n") + begin, F.lit(k)).cast("int")).drop("n", "all")


def kfold(rows: DataFrame, k: int, key: str = "s", seed: int = 42) -> DataFrame:
    """Contiguous folds of a random order, sizes at most one apart."""
    placed = ranked(rows, uid(F.col(key), seed), key)
    return placed.withColumn("fold", F.floor(F.col("n") * k / F.col("all")).cast("int")).drop("n", "all")


def slices(rows: DataFrame, cuts: dict[str, tuple[int, int]], key: str = "s", seed: int = 42) -> DataFrame:
    """Splits by place in a random order: name -> [begin, end)."""
    placed = ranked(rows, uid(F.col(key), seed), key)
    split = F.lit(None).cast("string")
    for name, (a, b) in cuts.items():
        split = F.when((F.col("n") >= a) & (F.col("n") < b), name).otherwise(split)
    return placed.withColumn("split", split).where("split IS NOT NULL").drop("n", "all")


def pages(rows: DataFrame, size: int, key: str = "s", seed: int = 42) -> DataFrame:
    """The page of each row, `size` rows on each, in a random order: all LIMIT/OFFSET pages at once."""
    return ranked(rows, uid(F.col(key), seed), key).withColumn("page", F.floor(F.col("n") / size).cast("int")).drop("n", "all")


def augment(sample: DataFrame, synthetic: DataFrame, key: str = "s") -> DataFrame:
    """The sample's entities and the synthetic ones (template, filler), which are named after the template with a short suffix; no repeats."""
    suffix = F.substring(F.md5(F.concat_ws("|", "template", "filler").cast("binary")), 1, 8)
    made = synthetic.select(F.concat_ws("_", "template", suffix).alias(key), F.lit("synthetic").alias("origin"))
    return sample.select(key, F.lit("sample").alias("origin")).unionByName(made).distinct()


def capped_reuse(pairs: DataFrame, cap: int, left: str = "template", right: str = "filler", order: str = "uid") -> DataFrame:
    """Distinct pairs in which either side has been used fewer than cap times before: the first cap of each left and of each right one, which Spark
    cuts to cap rows a key before it shuffles them. It makes no difference whether pairs that are left out count as uses: the first cap pairs of a side are all kept, so a side is used up from
    its next one on either way. A loop that goes through the pairs one by one gives the same."""
    first = lambda c: pairs.withColumn("__n", F.row_number().over(W.Window.partitionBy(c).orderBy(order, left, right))).where(F.col("__n") <= cap).drop("__n")
    return first(left).unionByName(first(right)).distinct()


def class_weights(rows: DataFrame, cls: str) -> DataFrame:
    """ln(all / count) of each class."""
    by = rows.groupBy(cls).agg(F.count("*").alias("nb"))
    total = by.agg(F.sum("nb").alias("__all"))
    return by.join(F.broadcast(total)).select(cls, "nb", F.round(F.ln(F.col("__all") / F.col("nb")), 6).alias("weight"))


def same_level(signatures: DataFrame, key: str = "s", sig: str = "signature", seed: int = 42) -> DataFrame:
    """Template and filler with the same signature: each entity with the next one in random order, and both orders. Linear in the
    entities: a chain within each signature, not all pairs."""
    placed = ranked(signatures, uid(F.col(key), seed), key, by=(sig,))
    after = placed.select(sig, (F.col("n") - 1).alias("n"), F.col(key).alias("b"))
    chain = placed.select(sig, "n", F.col(key).alias("a")).join(after, [sig, "n"]).drop("n")
    both = F.array(F.struct(F.col("a").alias("template"), F.col("b").alias("filler")), F.struct(F.col("b").alias("template"), F.col("a").alias("filler")))
    return chain.select(sig, F.inline(both))


def low_level(signatures: DataFrame, key: str = "s", sig: str = "sig", seed: int = 42) -> DataFrame:
    """Template whose signature is a strict, non-empty subset of the filler's: for each pair of signatures the first entity of both in
    random order. Signatures of a shape are few; entities are reduced to one for each before the pairing."""
    first = signatures.groupBy(sig).agg(F.min_by(key, F.concat(uid(F.col(key), seed), F.col(key))).alias("e"))
    a, b = first.select(F.col(sig).alias("sa"), F.col("e").alias("template")), first.select(F.col(sig).alias("sb"), F.col("e").alias("filler"))
    member = b.withColumn("m", F.explode("sb"))
    need = a.where(F.size("sa") > 0).withColumn("m", F.explode("sa"))
    hit = need.join(member, "m").groupBy("template", "filler", F.size("sa").alias("na"), F.size("sb").alias("nb")).agg(F.count("*").alias("n"))
    return hit.where("n = na AND na < nb").select("template", "filler")


def with_property(facts: DataFrame, prop: str, taken: DataFrame, key: str = "s") -> DataFrame:
    """The entities of a sample and all that have the property."""
    return taken.select(key).union(facts.where(F.col("p") == prop).select(key)).distinct()


def usable(rows: DataFrame, props: list[str], least: int = 10) -> DataFrame:
    """Rows with a property of the shape whose text, and markdown if there is a column md, is longer than `least` characters."""
    long = F.length("text") > least
    if "md" in rows.columns:
        long = long & (F.length("md") > least)
    return rows.where(long & F.col("p").isin(props))


def next_name(names: list[str], stem: str = "sample") -> str:
    """The first free name, <stem>_<number>."""
    numbers = [int(n.rsplit("_", 1)[1]) for n in names if n.startswith(f"{stem}_") and n.rsplit("_", 1)[1].isdigit()]
    return f"{stem}_{max(numbers, default=-1) + 1}"


def free_name(graphs: DataFrame, stem: str = "sample", name: str = "g") -> DataFrame:
    """next_name() over a table of graph names of any length: one row."""
    number = F.regexp_extract(F.col(name), f"^{stem}_([0-9]+)$", 1)
    return graphs.agg((F.coalesce(F.max(F.when(number != "", number.cast("long"))), F.lit(-1)) + 1).alias("__n")).select(F.concat(F.lit(f"{stem}_"), "__n").alias(name))
