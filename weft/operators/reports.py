"""Reports over scored runs: parse quality, derived rates, means over folds, novelty of predicted objects, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators.graph import common_ancestors, similarities
from weft.sources.scratch import settle


def parse_quality(rows: DataFrame) -> DataFrame:
    """One row of shares from (gold, predicted) arrays of (subj, prop, val): part_parsed of all rows (both sides non-empty), and of the parsed
    ones part_subj_ok (same first subject), part_type_ok (same types) and part_valid_rdf (same set of properties); part_valid_s too, if a column valid tells what the shape
    says of the prediction; and the mean edit distance of lines that are not parsed (null if all are), if there are columns gold_line and pred_line. 0 where nothing is parsed."""
    values = lambda c, p: F.array_sort(F.transform(F.filter(c, lambda t: t["prop"] == p), lambda t: t["val"]))
    props = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda t: t["prop"])))
    parsed = F.coalesce((F.size("gold") > 0) & (F.size("predicted") > 0), F.lit(False))
    ok = {"part_subj_ok": F.get("gold", F.lit(0))["subj"] == F.get("predicted", F.lit(0))["subj"], "part_type_ok": values("gold", "type") == values("predicted", "type"), "part_valid_rdf": props("gold") == props("predicted")}
    if "valid" in rows.columns:
        ok["part_valid_s"] = F.col("valid")
    n = F.count_if(parsed)
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)
    more = [F.round(F.avg(F.when(~parsed, F.levenshtein("pred_line", "gold_line"))), 4).alias("edit_distance")] if "pred_line" in rows.columns else []
    return rows.agg(share(n, F.count("*")).alias("part_parsed"), *[share(F.count_if(parsed & c), n).alias(k) for k, c in ok.items()], *more)


def means(rows: DataFrame, metrics: list[str], entity: str = "ex", cls: str = "cls") -> DataFrame:
    """Per class the mean of its entities' means, and over all classes (cls null) the mean of those, rounded to two places."""
    own = rows.groupBy(cls, entity).agg(*[F.avg(m).alias(m) for m in metrics])
    by = own.groupBy(cls).agg(F.count("*").alias("n_entities"), *[F.avg(m).alias(m) for m in metrics])
    total = by.agg(F.lit(None).cast("string").alias(cls), F.sum("n_entities").alias("n_entities"), *[F.avg(m).alias(m) for m in metrics])
    return by.unionByName(total).select(cls, "n_entities", *[F.round(m, 2).alias(m) for m in metrics])


def claim_scores(scored: DataFrame, score: str = "score", by: str = "type") -> DataFrame:
    """Claims and the mean of what a scorer says of them, for each kind of error."""
    return scored.groupBy(by).agg(F.count("*").alias("nb"), F.round(F.avg(score), 6).alias(score))


def write_csv(report: DataFrame, path: str) -> None:
    """A report as CSV files with a header."""
    report.write.option("header", True).csv(path)


def write_json(report: DataFrame, path: str) -> None:
    """A report or an index as JSON files, one object a line."""
    report.write.json(path)


def derived_rates(totals: DataFrame) -> DataFrame:
    """From micro recall and precision in percent (r_micro, p_micro) and the error counts n_fn, n_fp: the true positives that they imply (the larger
    of both estimates; a score of 100 or no error implies none) and the shares of errors among all predicted and all gold values."""
    implied = lambda score, n: F.when((score != 100) & (n != 0), score * n / (100 - score)).otherwise(F.lit(0.0))
    tp = F.greatest(implied(F.col("r_micro"), F.col("n_fn")), implied(F.col("p_micro"), F.col("n_fp")))
    rate = lambda n: F.round(F.coalesce(F.try_divide(n.cast("double"), n + tp), F.lit(0.0)), 6)
    return totals.select("n_fn", "n_fp", F.round(tp, 4).alias("tp"), rate(F.col("n_fp")).alias("new_fp_rate"), rate(F.col("n_fn")).alias("new_fn_rate"))


def fold_means(results: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """The mean of each metric over a model's folds; one row of results for each fold."""
    return results.groupBy(model).agg(F.count("*").alias("n_folds"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def object_novelty(errors: DataFrame, types: DataFrame, ranges: DataFrame, up: DataFrame, root: str) -> DataFrame:
    """How far wrongly predicted objects make sense. errors: (type, pred, val_pred, val_gold), types: (uri, cls), ranges: (pred, shape_cls), up: the class
    closure. Per kind (new, diff): distinct objects, the share that exists, the mean depth similarity of the best of an object's classes to the
    shape's, of the best of the gold object's classes to that class, and the mean Wu-Palmer similarity of the gold object to the shape.
    Similarities are computed once for each pair of classes that occurs."""
    wrong = errors.where((F.col("type") != "FN") & F.col("val_pred").contains(":")).select("pred", "val_pred", "val_gold").distinct()
    bare = lambda c: F.replace(c, F.lit(":"), F.lit(""))
    rows = wrong.join(F.broadcast(ranges), "pred", "left")

    def typed(df: DataFrame, value: str, other: str, name: str, by: str) -> DataFrame:
        """Adds the greatest similarity of column other to a class of the value, and that class; null for an unknown value."""
        own = df.select(value, other).distinct().join(types, bare(F.col(value)) == types["uri"]).select(value, F.col(other).alias("c1"), F.col("cls").alias("c2"))
        sims = settle(similarities(common_ancestors(own.select("c1", "c2").distinct(), up), up, root))
        best = own.join(sims, ["c1", "c2"], "left").groupBy(value, F.col("c1").alias(other)).agg(F.max(F.coalesce(by, F.lit(0.0))).alias(name), F.max_by("c2", F.struct(F.coalesce(by, F.lit(0.0)), "c2")).alias(f"{name}_cls"))
        return settle(df.join(best, [value, other], "left"))  # the next step reads it several times

    rows = typed(rows, "val_pred", "shape_cls", "pred_shape", "depth_sim")
    rows = typed(rows, "val_gold", "pred_shape_cls", "pred_gold", "depth_sim").drop("pred_gold_cls")
    rows = typed(rows, "val_gold", "shape_cls", "gold_shape", "wu_palmer")
    kind = F.when(F.col("val_gold").isNull(), "new").otherwise("diff")
    found = F.col("pred_shape").isNotNull()
    mean = lambda c: F.round(F.avg(F.when(found, F.col(c))), 6).alias(c)
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("nb"), F.round(F.count_if(found) / F.count("*"), 6).alias("uri_ok"), mean("pred_shape"), mean("pred_gold"), mean("gold_shape"))


def claim(subject: Column, prop: Column, value: Column) -> Column:
    """A fact as a sentence for a scorer: names decoded, dates of date properties written out."""
    plain = lambda c: F.replace(F.replace(text.decode_uri(c), F.lit("_"), F.lit(" ")), F.lit(":"), F.lit(""))
    dated = F.when(F.lower(prop).contains("date"), text.long_date(F.try_to_date(value, "yyyy-MM-dd")))
    return F.concat_ws(" ", plain(subject), plain(prop), F.coalesce(dated, plain(value)))
