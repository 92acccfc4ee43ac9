"""Validation of extracted graphs, and scores of predicted against gold triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.codecs import char_bleus
from weft.functions.text import normal_value, strip_entity, year_of
from weft.operators.grounding import in_text, wikicheck
from weft.plans.shape import Property, Shape, abbreviate, local_name
from weft.sources.scratch import settle

#: Lexical forms of the datatypes that shapes use; other types accept any text.
LEXICAL = {"date": "^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}$", "gYear": "^-?[0-9]{4,}$", "double": "^[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?$", "nonNegativeInteger": "^[+]?[0-9]+$", "positiveInteger": "^[+]?0*[1-9][0-9]*$"}


def _classed(facts: DataFrame, wanted: set[tuple[str, str]], types: DataFrame, subject: str) -> DataFrame:
    """facts with cls, the class that wanted (property, class) asks of their object, and classed, true where types (s, cls) give it that class. Facts of other properties look up nothing: they go
    by their subject, as their values (a few types or states) would bring them all to a few tasks."""
    asked = facts.sparkSession.createDataFrame(sorted(wanted), "p string, cls string")
    have = types.where(F.col("cls").isin(sorted({c for _, c in wanted}))).select(F.col("s").alias("__o"), "cls").distinct().withColumn("classed", F.lit(True))
    keyed = facts.join(F.broadcast(asked), "p", "left").withColumn("__o", F.when(F.col("cls").isNull(), F.col(subject)).otherwise(F.col("o")))
    return keyed.join(have, ["__o", "cls"], "left").drop("__o")


def validate(facts: DataFrame, shape: Shape, class_check: str = "skip", types: DataFrame | None = None) -> DataFrame:
    """Per subject of (s, p, o, k): violations and conforms. One aggregation by subject. Counts, datatypes, node kinds and sh:or (a group holds if
    all properties of one branch do). class_check: skip, strict (an object property needs an IRI), or types (its object must have the class asked for among types
    (s, cls), which include those of superclasses if these are to count)."""
    facts = facts.select("s", "p", "o", "k").dropDuplicates(["s", "p", "o"])
    if class_check == "types":
        facts = _classed(facts, {(p.name, (p.range or "").rsplit("/", 1)[-1].rsplit("#", 1)[-1]) for p in shape.properties if p.kind == "object"}, types, "s")
    here = lambda p: F.col("p") == p.name
    aggs, holds = [], {}
    for i, p in enumerate(shape.properties):
        lexical = LEXICAL.get((p.range or "").rsplit("#", 1)[-1])
        wrong = F.lit(False)
        if lexical and p.kind == "datatype":
            wrong = wrong | ~F.col("o").rlike(lexical)
        if (p.node_kind or "").endswith("Literal"):
            wrong = wrong | (F.col("k") != "literal")
        if p.kind == "object" and class_check in ("strict", "types"):
            wrong = wrong | (F.col("k") != "iri")
        if p.kind == "object" and class_check == "types":
            wrong = wrong | F.col("classed").isNull()
        aggs += [F.count_if(here(p)).alias(f"n{i}"), F.count_if(here(p) & wrong).alias(f"w{i}")]
        ok = (F.col(f"n{i}") >= p.min_count) & (F.col(f"w{i}") == 0)
        if p.max_count is not None:
            ok = ok & (F.col(f"n{i}") <= p.max_count)
        holds.setdefault((p.or_group, p.or_branch), []).append((p.name, ok))
    by = facts.groupBy("s").agg(*aggs)
    broken: list[Column] = [F.when(~ok, name) for name, ok in holds.get((0, 0), [])]
    for group in sorted({g for g, _ in holds if g}):
        branches = [b for (g, _), b in holds.items() if g == group]
        any_ = F.lit(False)
        for b in branches:
            every = F.lit(True)
            for _, ok in b:
                every = every & ok
            any_ = any_ | every
        broken.append(F.when(~any_, f"or{group}"))
    names = F.array_join(F.array_sort(F.array_compact(F.array(*broken))), ",")
    return by.select("s", names.alias("violations"), (names == "").alias("conforms"))


def report(facts: DataFrame, shape: Shape, types: DataFrame) -> DataFrame:
    """A row for each violation of a shape: focus, path, value, constraint. facts: (s, p, o, k), types: (s, cls), with the inferred ones if these are to count.
    Focus nodes are the subjects with the target class, those without any fact included. Constraints: minCount and maxCount (value null, path the property), datatype, nodeKind
    and class for each offending value, and or (path or1, or2, ... in the order of the shape) where no branch of a sh:or holds; values in branches are not told one by one.
    One pass over the facts for values and one grouping by focus node for counts; the shape, tens of properties, becomes columns."""
    focus = types.where(F.col("cls") == local_name(shape.target)).select(F.col("s").alias("focus")).distinct()
    named = facts.where(F.col("p").isin(sorted({p.name for p in shape.properties}))).select(F.col("s").alias("focus"), "p", "o", "k")
    own = named.join(focus, "focus", "left_semi").dropDuplicates(["focus", "p", "o"])
    own = settle(_classed(own, {(p.name, local_name(p.range)) for p in shape.properties if p.kind == "object"}, types, "focus"))  # read for values and for counts

    def wrong(p: Property) -> dict[str, Column]:
        """By constraint, whether a value of the property offends it."""
        out = {}
        lexical = LEXICAL.get((p.range or "").rsplit("#", 1)[-1]) if p.kind == "datatype" else None
        if p.kind == "datatype" and p.range:
            out["datatype"] = (F.col("k") != "literal") | (~F.col("o").rlike(lexical) if lexical else F.lit(False))
        if p.node_kind:
            out["nodeKind"] = (F.col("k") == "literal") != F.lit(p.node_kind.endswith("Literal"))
        if p.kind == "object":
            out["class"] = (F.col("k") != "iri") | F.col("classed").isNull()
        return out

    here = lambda p: F.col("p") == p.name
    told = [F.when(here(p) & bad, F.struct(F.lit(p.name).alias("path"), F.lit(c).alias("constraint"))) for p in shape.properties if not p.or_group for c, bad in wrong(p).items()]
    values = own.select("focus", F.col("o").alias("value"), F.inline(F.array_distinct(F.array_compact(F.array(*told))))) if told else None

    aggs, branches, counts = [], {}, []
    for i, p in enumerate(shape.properties):
        bad = F.lit(False)
        for w in wrong(p).values():
            bad = bad | w
        aggs += [F.count_if(here(p)).alias(f"n{i}"), F.count_if(here(p) & bad).alias(f"w{i}")]
        n = F.coalesce(f"n{i}", F.lit(0))
        over = n > p.max_count if p.max_count is not None else F.lit(False)
        if p.or_group:
            branches.setdefault(p.or_group, {}).setdefault(p.or_branch, []).append((n >= p.min_count) & ~over & (F.coalesce(f"w{i}", F.lit(0)) == 0))
        else:
            counts += [F.when(broken, F.struct(F.lit(p.name).alias("path"), F.lit(c).alias("constraint"))) for c, broken in (("minCount", n < p.min_count), ("maxCount", over))]
    for group, by in sorted(branches.items()):
        held = F.lit(False)
        for every in by.values():
            ok = F.lit(True)
            for one in every:
                ok = ok & one
            held = held | ok
        counts.append(F.when(~held, F.struct(F.lit(f"or{group}").alias("path"), F.lit("or").alias("constraint"))))
    by = focus.join(own.groupBy("focus").agg(*aggs), "focus", "left")
    counted = by.select("focus", F.lit(None).cast("string").alias("value"), F.inline(F.array_distinct(F.array_compact(F.array(*counts)))))
    return (counted if values is None else values.unionByName(counted)).select("focus", "path", "value", "constraint")


def set_scores(found: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 in percent of two arrays as sets; 0 on empty."""
    hit = F.size(F.array_intersect(found, gold)).cast("double")
    p = F.coalesce(F.try_divide(100 * hit, F.size(F.array_distinct(found))), F.lit(0.0))
    r = F.coalesce(F.try_divide(100 * hit, F.size(F.array_distinct(gold))), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def extraction_stats(found: Column, shape_props: list[str]) -> list[Column]:
    """Matched, extra and missing properties, coverage and precision in percent."""
    shape = F.array(*[F.lit(p) for p in sorted(shape_props)])
    matched = F.array_sort(F.array_intersect(found, shape))
    n = F.size(F.array_distinct(found))
    return [F.array_join(matched, ",").alias("matched"), F.array_join(F.array_sort(F.array_except(found, shape)), ",").alias("extra"), F.array_join(F.array_sort(F.array_except(shape, found)), ",").alias("missing"), F.round(100 * F.size(matched) / len(shape_props), 2).alias("coverage"), F.round(F.coalesce(F.try_divide(100.0 * F.size(matched), n), F.lit(0.0)), 2).alias("precision")]


def extraction_by_kind(found: Column, shape: Shape) -> list[Column]:
    """Of the shape's literal and of its object properties: how many there are, and the share in percent that was extracted."""
    out = []
    for kind in ("datatype", "object"):
        names = sorted({p.name for p in shape.properties if p.kind == kind})
        hit = F.size(F.array_intersect(found, F.array(*[F.lit(n) for n in names]).cast("array<string>")))
        out += [F.lit(len(names)).alias(f"n_{kind}"), F.round(100 * hit / max(len(names), 1), 2).alias(f"coverage_{kind}")]
    return out


def relation_of(prop: Column, relations: list[str]) -> Column:
    """The relation whose name stands in a property's name, if that is one only; else null."""
    hits = F.filter(F.array(*[F.lit(r) for r in relations]), lambda r: F.contains(prop, r))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def parsed_on_both(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    return gold.select("ex").distinct().join(predicted.select("ex").distinct(), "ex", "left_semi")


def relation_cases(gold: DataFrame, predicted: DataFrame, relations: list[str], bleu_for: list[str] | None = None, strip: bool = True) -> DataFrame:
    """Per relation: tp, fp, fn, tn, nb_gt, nb_pred, and bleu if bleu_for names the relations that it is wanted for. gold and predicted: (ex, p, v). Examples parsed on both
    sides only. A property counts for the relation whose name is in its own, if just one is; nb_gt and nb_pred count equal names. Where both have values,
    the shared count as tp and the other predicted ones as fp; missed gold values add no fn. Gold alone is one fn, prediction alone one fp, none on
    both sides one tn. One shuffle by (example, relation); the relation list is a shape's and stays small."""
    both = parsed_on_both(gold, predicted)
    value = F.trim("v") if strip else F.col("v")
    side = lambda df, n: df.select("ex", relation_of(F.col("p"), relations).alias("r"), F.when(F.lit(n == 1), value).otherwise(F.col("v")).alias("v"), F.lit(n).alias("side"))
    rows = side(gold, 0).unionByName(side(predicted, 1)).where("r IS NOT NULL").join(both, "ex", "left_semi")
    sets = rows.groupBy("ex", F.col("r").alias("p")).agg(F.collect_set(F.when(F.col("side") == 0, F.col("v"))).alias("gold_set"), F.collect_set(F.when(F.col("side") == 1, F.col("v"))).alias("pred_set"))
    counts = side_counts(gold, predicted, both, relations)
    g, p = F.size("gold_set") > 0, F.size("pred_set") > 0
    hit = F.size(F.array_intersect("pred_set", "gold_set"))
    scores = [F.sum(F.when(g & p, hit).otherwise(0)).alias("tp"), F.sum(F.when(g & p, F.size("pred_set") - hit).when(p, 1).otherwise(0)).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count("*").alias("__seen")]
    if bleu_for:
        each = char_bleus(F.col("pred_set"), F.col("gold_set"))
        total = F.when(g & p & F.col("p").isin(bleu_for), F.aggregate(each, F.lit(0.0), lambda a, x: a + x))
        scores.append(F.round(F.try_divide(F.sum(total), F.sum(F.when(total.isNotNull(), F.size("pred_set")))), 4).alias("bleu"))
    by = sets.groupBy("p").agg(*scores)
    names = gold.sparkSession.createDataFrame([(r,) for r in relations], "p string")
    total = both.agg(F.count("*").alias("__all"))
    joined = F.broadcast(names).join(by, "p", "left").join(counts, "p", "left").join(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select("p", *[zero(c).alias(c) for c in ("tp", "fp", "fn")], (F.col("__all") - zero("__seen")).alias("tn"), zero("nb_gt").alias("nb_gt"), zero("nb_pred").alias("nb_pred"), *(["bleu"] if bleu_for else []))


def side_counts(gold: DataFrame, predicted: DataFrame, both: DataFrame, relations: list[str]) -> DataFrame:
    """Per relation p: the gold and the predicted facts of just that name, nb_gt and nb_pred."""
    rows = gold.select("ex", "p", F.lit(0).alias("side")).unionByName(predicted.select("ex", "p", F.lit(1).alias("side"))).where(F.col("p").isin(relations))
    return rows.join(both, "ex", "left_semi").groupBy("p").agg(F.count_if(F.col("side") == 0).alias("nb_gt"), F.count_if(F.col("side") == 1).alias("nb_pred"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p = F.coalesce(F.try_divide(100.0 * tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(100.0 * tp, tp + fn), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [F.round(p, 4).alias("p_score"), F.round(r, 4).alias("r_score"), F.round(f, 4).alias("f1")]


def overall(cases: DataFrame, rates_with_tn: bool = True) -> DataFrame:
    """Micro scores from the sums, macro F1 as the mean over relations with gold values; accuracy and error rates as fractions, the rates of all cases or, without
    tn, of those that are no true negative. The mean of bleu over relations that have one, if the cases have it."""
    tp, fp, fn, tn = (F.sum(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, r = F.try_divide(100 * tp, tp + fp), F.try_divide(100 * tp, tp + fn)
    f = lambda a, b, c: F.coalesce(F.try_divide(200.0 * a, 2 * a + b + c), F.lit(0.0))
    macro = F.avg(F.when(F.col("nb_gt") > 0, f(F.col("tp"), F.col("fp"), F.col("fn"))))
    every = tp + fp + fn + tn
    errors = every if rates_with_tn else tp + fp + fn
    more = [F.round(F.avg("bleu"), 4).alias("bleu")] if "bleu" in cases.columns else []
    return cases.agg(F.round(F.coalesce(p, F.lit(0.0)), 4).alias("p_micro"), F.round(F.coalesce(r, F.lit(0.0)), 4).alias("r_micro"), F.round(f(tp, fp, fn), 4).alias("f1_micro"), F.round(macro, 4).alias("f1_macro"), F.round(F.try_divide(tp + tn, every), 6).alias("accuracy"), F.round(F.try_divide(fp, errors), 6).alias("fp_rate"), F.round(F.try_divide(fn, errors), 6).alias("fn_rate"), *more)


def to_inspect(gold: DataFrame, predicted: DataFrame, texts: DataFrame | None = None, kinds: DataFrame | None = None, first_only: bool = False) -> DataFrame:
    """Error rows: FP_different for each predicted value that isn't among the gold ones (with the first gold value), FN for a relation that only gold has, FP_new for
    one that only the prediction has. gold and predicted: (ex, p, v, pos), pos giving the order of values; examples parsed on both sides only. first_only: of the
    predicted values that differ, the first predicted one is told. With texts (ex, text) and kinds (p, range), abs and found are added, FP_different is told only where there is
    a text, and a FP_new without one is a plain FP."""
    both = parsed_on_both(gold, predicted)
    side = lambda df, n: df.join(both, "ex", "left_semi").groupBy("ex", "p").agg(F.collect_set("v").alias(f"{n}_set"), F.min_by("v", F.struct("pos", "v")).alias(f"{n}_first"))
    rows = side(gold, "g").join(side(predicted, "q"), ["ex", "p"], "full")
    row = lambda kind, pred, own: F.struct(F.lit(kind).alias("type"), pred.alias("val_pred"), own.alias("val_gold"))
    wrong = F.filter("q_set", lambda v: ~F.array_contains("g_set", F.trim(v)))
    wrong = F.transform(wrong, lambda v: F.col("q_first")) if first_only else wrong
    none = F.lit(None).cast("string")
    each = F.when(F.col("q_set").isNull(), F.array(row("FN", none, F.col("g_first")))).when(F.col("g_set").isNull(), F.array(row("FP_new", F.col("q_first"), none))).otherwise(F.transform(wrong, lambda v: row("FP_different", v, F.col("g_first"))))
    errors = rows.select("ex", F.col("p").alias("pred"), F.inline(each)).select("type", "ex", "pred", "val_pred", "val_gold")
    if texts is None:
        return errors
    read = errors.join(texts.select("ex", F.col("text").alias("abs")), "ex", "left").join(F.broadcast(kinds.select(F.col("p").alias("pred"), "range")), "pred", "left")
    kind = F.when((F.col("type") == "FP_new") & F.col("abs").isNull(), F.lit("FP")).otherwise(F.col("type"))
    found = F.coalesce(in_text(F.coalesce("val_pred", "val_gold"), F.coalesce("range", F.lit("")), F.col("pred"), F.col("abs")), F.lit(False))
    told = read.where((F.col("type") != "FP_different") | F.col("abs").isNotNull())
    return told.select(kind.alias("type"), "ex", "pred", F.when(kind != "FP", F.col("val_pred")).alias("val_pred"), "val_gold", "abs", found.alias("found"))


def not_parsed(rows: DataFrame) -> DataFrame:
    """Of rows (gold_line, pred_line, predicted): what no triple was read from, with the edit distance to gold."""
    return rows.where(F.coalesce(F.size("predicted"), F.lit(0)) <= 0).select(F.col("pred_line").alias("p_sent"), F.col("gold_line").alias("g_sent"), F.levenshtein("pred_line", "gold_line").alias("dist"))


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.where("size(gold) > 0 AND size(predicted) > 0")


def wrong_subject(rows: DataFrame) -> DataFrame:
    """Of rows (gold, predicted) that are parsed: subjects that differ."""
    first = lambda c: F.get(c, F.lit(0))["subj"]
    return _parsed(rows).select(first("gold").alias("subj_gt"), first("predicted").alias("subj_pred")).where("subj_gt <> subj_pred OR subj_gt = ''")


def not_valid(rows: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """Of rows (gold, predicted) that are parsed: property sets that differ, as text; with a validation (s, violations), what the shape has against the prediction."""
    props = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda t: t["prop"])))
    pairs = _parsed(rows).select(F.get("predicted", F.lit(0))["subj"].alias("ent_uri"), props("predicted").alias("p"), props("gold").alias("g")).where("p <> g")
    told = pairs.select("ent_uri", F.array_join("p", ",").alias("p_pred"), F.array_join("g", ",").alias("g_pred"))
    return told if validation is None else told.join(validation.select(F.col("s").alias("ent_uri"), F.col("violations").alias("report")), "ent_uri", "left")


def datatype_relations(shape: Shape) -> list[str]:
    """The relations of a scorer that looks at literals only."""
    return [p.name for p in shape.properties if p.kind == "datatype"]


def triples_to_facts(triples: DataFrame, shape: Shape, literals_only: bool = False) -> DataFrame:
    """(s, p, o, k, dt) from (subj, prop, val): properties that the shape doesn't know are left out, types kept. Values of object properties become IRIs without brackets, namespace and
    colon, other values literals with the datatype of the shape; with literals_only every value is a literal of its property's range, as one reader of the scores has it."""
    known = {p.name: (p.kind, abbreviate(p.range) if p.range else None) for p in shape.properties} | {"type": ("type", None)}
    kinds = triples.sparkSession.createDataFrame([(n, *v) for n, v in known.items()], "prop string, kind string, range string")
    rows = triples.join(F.broadcast(kinds), "prop")
    is_iri = (F.col("kind") == "type") | ((F.col("kind") == "object") & F.lit(not literals_only))
    name = F.regexp_replace(strip_entity(F.col("val")), "^:", "")
    return rows.select(F.col("subj").alias("s"), F.when(F.col("kind") == "type", F.lit("rdf:type")).otherwise(F.col("prop")).alias("p"), F.when(is_iri, name).otherwise(F.col("val")).alias("o"), F.when(is_iri, "iri").otherwise("literal").alias("k"), F.when(~is_iri, F.col("range")).alias("dt"))


def initial_graph(quads: DataFrame, shape: Shape) -> DataFrame:
    """(ex, p, v) of the shape's properties as the knowledge base has them: objects as :Name, duplicates kept."""
    names = [p.name for p in shape.properties]
    value = F.when(F.col("k") == "iri", F.concat(F.lit(":"), F.col("o"))).otherwise(F.col("o"))
    return quads.where(F.col("p").isin(names)).select(F.col("s").alias("ex"), "p", value.alias("v"))


def correct_graph(initial: DataFrame, texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """The facts of an initial graph that the entity's text (ex, text, perhaps md) expresses. Years are cut to four digits; empty values and NaN go."""
    trimmed = initial.withColumn("v", F.when(F.col("p").endswith("Year"), year_of(F.col("v"))).otherwise(F.col("v"))).where("v <> '' AND v <> 'NaN'")
    facts = trimmed.select(F.col("ex").alias("s"), "p", F.col("v").alias("o"))
    found = wikicheck(facts, texts.withColumnRenamed("ex", "s"), kinds).where("found")
    return found.select(F.col("s").alias("ex"), "p", F.col("o").alias("v"))


def compare_graphs(initial: DataFrame, correct: DataFrame, extracted: DataFrame, shape_props: list[str]) -> DataFrame:
    """Per entity of any of three graphs (ex, p, v), types left out: precision, recall and F1 in percent of the extracted graph against the initial (init) and the correct
    one, by property and by property and normalised value; expressiveness, the correct properties' share of the initial ones; coverage, the extracted
    properties' share of the shape's. One shuffle by entity."""
    pair = F.concat_ws("=", "p", normal_value(F.col("v")))
    sides = {"i": initial, "c": correct, "x": extracted}
    rows = None
    for n, df in sides.items():
        one = df.where("p NOT IN ('type', 'rdf:type')").select("ex", "p", pair.alias("pv"), F.lit(n).alias("side"))
        rows = one if rows is None else rows.unionByName(one)
    by = rows.groupBy("ex").agg(*[F.collect_set(F.when(F.col("side") == n, F.col(c))).alias(f"{n}_{c}") for n in sides for c in ("p", "pv")])
    out = []
    for name, n in (("init", "i"), ("correct", "c")):
        for what, c in (("prop", "p"), ("value", "pv")):
            scores = set_scores(F.col(f"x_{c}"), F.col(f"{n}_{c}"))
            out += [F.round(x, 2).alias(f"{name}_{what}_{k}") for x, k in zip(scores, ("p", "r", "f1"), strict=True)]
    share = lambda a, b: F.round(F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0)), 2)
    shape = F.array(*[F.lit(p) for p in shape_props])
    return by.select("ex", *out, share(F.size("c_p"), F.size("i_p")).alias("expressiveness"), share(F.size(F.array_intersect("x_p", shape)), F.lit(len(set(shape_props)))).alias("coverage"))


def critic_stats(scored: DataFrame, critics: list[str], entity: str = "s", prop: str = "p") -> DataFrame:
    """Per property: its entities, and of each critic's score the least, the mean (rounded) and the greatest."""
    aggs = [a for c in critics for a in (F.min(c).alias(f"{c}_min"), F.round(F.avg(c), 6).alias(f"{c}_avg"), F.max(c).alias(f"{c}_max"))]
    return scored.groupBy(F.col(prop).alias("p")).agg(F.count_distinct(entity).alias("nb"), *aggs)


def merge_annotations(sample: DataFrame, notes: DataFrame) -> DataFrame:
    """Corrected sample: facts confirmed as missing (FP, verif and found TRUE) are added, facts judged wrong (FN, verif FALSE) go; only entities of the sample."""
    own = sample.select("s").distinct()
    add = notes.where(F.col("type").contains("FP") & (F.col("verif") == "TRUE") & (F.col("found") == "TRUE")).select("s", "p", F.col("val_pred").alias("o")).join(own, "s", "left_semi")
    gone = notes.where(F.col("type").contains("FN") & (F.col("verif") == "FALSE")).select("s", "p", F.col("val_gold").alias("o"))
    return sample.join(gone, ["s", "p", "o"], "left_anti").select("s", "p", "o").unionByName(add).distinct()


def value_confusion(errors: DataFrame) -> DataFrame:
    """Values reported for an entity under two error types or more."""
    return errors.groupBy("ex", "val").agg(F.count_distinct("type").alias("n_types")).where("n_types > 1")


def pattern_extension(rows: DataFrame) -> DataFrame:
    """Per gold and predicted property set (arrays g, q): equal, extended (gold strictly within) or other."""
    sg, sq = F.array_sort(F.array_distinct("g")), F.array_sort(F.array_distinct("q"))
    kind = F.when(sg == sq, "equal").when((F.size(F.array_except(sg, sq)) == 0) & (F.size(sg) < F.size(sq)), "extended").otherwise("other")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("nb"), F.count_distinct(F.array_join(sg, ",")).alias("n_gold_patterns"))
