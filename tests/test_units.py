import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weft.functions import codecs, text
from weft.operators import graph, grounding, mapping, plugins, reports, sampling, scoring, signatures
from weft.plans.config import Run
from weft.plans.shape import Shape, read_rules
from weft.queries import ORDER_SHAPE
from weft.sources import quads
from weft.streaming import incremental


def values(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(column).collect()]


def test_shape_reader():
    assert ORDER_SHAPE.target.endswith("Order")
    assert [p.name for p in ORDER_SHAPE.properties] == ["status", "customer", "orderDate", "priority"]
    assert [p.kind for p in ORDER_SHAPE.properties] == ["datatype", "object", "datatype", "datatype"]
    assert [(p.or_group, p.or_branch) for p in ORDER_SHAPE.properties] == [(0, 0), (0, 0), (1, 1), (1, 2)]
    assert (ORDER_SHAPE.properties[0].min_count, ORDER_SHAPE.properties[0].max_count) == (1, 1)


def test_shape_without_types():
    s = Shape.read("@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <http://e/> . e:S a sh:NodeShape ; sh:targetClass e:C ; sh:property [ sh:path e:a ] .")
    assert s.properties[0].kind == "datatype" and s.typed == ()


def test_rules():
    assert [r.body for r in read_rules("<rdf:RDF xmlns:rdf='r'><rule><body>SELECT 1</body></rule><rule><body/></rule></rdf:RDF>")] == ["SELECT 1", ""]


def test_parse_of_uneven_lines(spark):
    parse = codecs.parse(F.col("x"))
    got = values(spark, parse, ':Stacey_Fox a:Artist;:birthDate "1965-06-21".', ":A a :P; :birthPlace :H; :deathPlace:H, :N. ", "nonsense", None)
    assert [tuple(t) for t in got[0]] == [("Stacey_Fox", "type", "Artist"), ("Stacey_Fox", "birthDate", "1965-06-21")]
    assert [tuple(t)[1:] for t in got[1]] == [("type", "P"), ("birthPlace", ":H"), ("deathPlace", ":H"), ("deathPlace", ":N")]
    assert got[2] == []


def test_grammar(spark):
    ok = codecs.accepted(F.col("x"))
    assert values(spark, ok, ':A a :P; :b "c"; :d :E, :F .', ":A a:P.", ':A a :P; :b "c" d; .', None) == [True, True, False, False]


def test_triplet_tokens_and_tags(spark):
    got = values(spark, codecs.from_triplet_tokens(F.col("x")), "<s><triplet> A <subj> B <obj> r <subj> C <obj> q <triplet> D <subj> E <obj> r")
    assert [tuple(t) for t in got[0]] == [("A", "r", "B"), ("A", "q", "C"), ("D", "r", "E")]
    back = values(spark, codecs.from_tags(F.col("x")), "<subj>a<rel>b<obj>c<et><subj>d<rel>e<obj>f<et>")
    assert [tuple(t) for t in back[0]] == [("a", "b", "c"), ("d", "e", "f")]


def test_uris(spark):
    assert values(spark, text.encode_uri(F.col("x")), "a b.c'd/e~f*", "x%20y") == ["a%20b%2Ec%27d/e~f%2A", "x%20y"]
    assert values(spark, text.decode_uri(F.col("x")), "a%20b+c", "100%", "plain") == ["a b+c", "100%", "plain"]


def test_dates(spark):
    got = values(spark, text.dates_in(F.col("x")), "born 29 August 1994, died 2001-02-03; or May 5, 1999; not 31 February 2000 or 1994-99-99", "none", None)
    assert got[0] == ["1994-08-29", "1999-05-05", "2001-02-03"] and got[1] == []
    for written in ("Aug 29, 1994", "29.08.1994", "29th August 1994", "29 august 1994", "AUG. 29TH 1994", "29/8/1994", "08/29/1994", "29-08-1994", "1994.8.29", "29 Aug 1994.", "(29. August, 1994)", "29th of aug., 1994"):
        assert values(spark, text.dates_in(F.col("x")), f"It was {written} then") == [["1994-08-29"]], written
    for none in ("August 1994", "29 August", "05/06/1994", "129 August 1994", "29 August 19945", "29 Augustus 1994", "1994-08-291", "29.13.1994", "30 Feb 1994", "29.08/1994", "x29 May 1994", "29 May 94"):
        assert values(spark, text.dates_in(F.col("x")), none) == [[]], none
    assert values(spark, text.dates_in(F.col("x")), "5/5/1999 and Sept 3, 2001, Sep 4 2001, september 5th 2001") == [["1999-05-05", "2001-09-03", "2001-09-04", "2001-09-05"]]


def test_shorten(spark):
    assert values(spark, text.shorten(F.col("x"), 12), "One two. Three. Four.", "A very long sentence. B.") == ["One two.", "A very long sentence."]


def test_object_in_markdown(spark):
    found = grounding.in_markdown(F.lit(":Moldavian_SSR"), F.col("x"))
    assert values(spark, found, "the [Moldavian](:Moldavian_SSR)", "Moldavian_SSR", None) == [True, False, False]


def test_tagging_takes_the_longest_first(spark):
    pairs = F.array(F.struct(F.lit("York").alias("val"), F.lit("a").alias("prop")), F.struct(F.lit("New York").alias("val"), F.lit("b").alias("prop")))
    assert values(spark, grounding.tag(F.col("x"), pairs), "New York, York") == ["$b$, $a$"]


def test_three_graph_golden(spark):
    row = spark.range(1).select(F.array(F.lit("x")).alias("found"), F.array(F.lit("x"), F.lit("y")).alias("gold"))
    p, r, f = scoring.set_scores(F.col("found"), F.col("gold"))
    assert [round(v, 2) for v in row.select(p, r, f).first()] == [100, 50, 66.67]


def test_identity_of_cases(spark):
    gold = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x")], "ex int, p string, v string")
    pred = spark.createDataFrame([(1, "a", "x"), (1, "a", "z"), (2, "b", "q")], "ex int, p string, v string")
    got = {r.p: (r.tp, r.fp, r.fn, r.tn) for r in scoring.relation_cases(gold, pred, ["a", "b", "c"]).collect()}
    assert got == {"a": (1, 1, 1, 0), "b": (0, 1, 1, 0), "c": (0, 0, 0, 2)}


def test_signatures_add_up(spark):
    facts = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "a")], "s string, p string")
    sigs = signatures.entity_signatures(facts, spark.createDataFrame([("1",), ("2",), ("3",)], "s string"))
    full = signatures.power_set(sigs, ["a", "b"])
    assert sorted((r.mask, r.nb) for r in full.collect()) == [(0, 1), (1, 1), (2, 0), (3, 1)]
    assert signatures.power_set(sigs, ["a", "b"], include_full=False).count() == 3


def test_samples_are_disjoint(spark):
    e = spark.range(100).select(F.col("id").cast("string").alias("s"))
    a = sampling.sample(e, 30)
    b = sampling.sample(e, 30, a)
    assert a.join(b, "s").count() == 0 and sorted(a.toPandas().s) == sorted(sampling.sample(e, 30).toPandas().s)


def test_folds_are_even(spark):
    e = spark.range(103).select(F.col("id").cast("string").alias("s"))
    sizes = [r["count"] for r in sampling.kfold(e, 10).groupBy("fold").count().collect()]
    assert sum(sizes) == 103 and max(sizes) - min(sizes) <= 1


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    q = spark.createDataFrame([("g1", "s", "p", "o", "iri"), ("g1", "s", "p", "o", "iri"), ("g2", "s", "p", "o", "iri")], "g string, s string, p string, o string, k string")
    quads.write_store(q, path)
    assert spark.read.parquet(path).count() == 2
    assert quads.insert_missing(q, path) == 0
    quads.drop_graph(spark, path, "g1")
    assert [r.g for r in spark.read.parquet(path).collect()] == ["g2"]
    assert quads.delete_where(q, F.col("g") == "g1").count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<s> <p> <o> .\n<s> <q> "v \\"w\\""@en .\nbroken\n')
    assert [(r.p, r.k, r.lang) for r in quads.read_ntriples(spark, str(tmp_path / "a.nt"), "g").collect()] == [("p", "iri", None), ("q", "literal", "en")]
    (tmp_path / "d.json").write_text('[{"triples": "t", "abstract": "a", "entity": "e"}]')
    assert quads.read_dataset(spark, str(tmp_path / "d.json")).first()[2:] == ("e", None, 0)
    (tmp_path / "t.json").write_text('{"columns": ["a", "b"], "data": [["1", "2"], ["1", "2"]]}')
    assert [r.row for r in quads.read_artifact(spark, str(tmp_path / "t.json")).collect()] == [{"a": "1", "b": "2"}]


def test_incremental_step_is_idempotent(spark, tmp_path):
    source, path = spark.range(10), str(tmp_path / "out")
    work = lambda df: df.withColumn("y", F.col("id") * 2)
    assert incremental.step(source.where("id < 4"), path, work, ["id"]) == 4
    assert incremental.step(source, path, work, ["id"]) == 6
    assert incremental.step(source, path, work, ["id"]) == 0


def test_stream(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = incremental.stream(spark, source, str(tmp_path / "out"), lambda df: df, ["id"], str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_char_bleu(spark):
    df = spark.createDataFrame([("abcd", ["abcd"]), ("abcd", ["wxyz"]), ("ab cd ef", ["abcdef"]), ("abcde", ["abcdx", "zbcde"]), ("abc", ["abc"]), ("abcd", ["abcdefgh"]), ("", ["a"]), (None, ["a"])], "a string, b array<string>")
    got = [r[0] for r in df.select(codecs.char_bleu(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, 1.0, 1.0, 0.0, pytest.approx(0.36788, abs=1e-4), 0.0, 0.0]  # exp(1 - 8 / 4)
    long = spark.range(1).select(F.repeat(F.lit("abcdefg hij"), 40_000).alias("a")).select(codecs.char_bleu(F.col("a"), F.array(F.concat("a", F.lit("x"))))).first()[0]
    assert long == pytest.approx(1.0, abs=1e-4)  # 400,000 characters: linear in the text
    both = df.select(codecs.char_bleus(F.array("a", F.lit("wxyz"), F.lit(None).cast("string")), F.col("b"))).collect()
    assert both[0][0] == [1.0, 0.0, 0.0] and both[1][0] == [0.0, 1.0, 0.0]


def test_parse_quality_of_nothing(spark):
    kind = "array<struct<subj:string,prop:string,val:string>>"
    rows = spark.createDataFrame([], f"gold {kind}, predicted {kind}")
    assert tuple(reports.parse_quality(rows).first()) == (0, 0, 0, 0)
    one = spark.createDataFrame([([("s", "type", "T")], None), ([("s", "type", "T")], [("s", "type", "U")])], f"gold {kind}, predicted {kind}")
    assert tuple(reports.parse_quality(one).first()) == (0.5, 1, 0, 1)


def test_derived_rates_without_errors(spark):
    totals = spark.createDataFrame([(100.0, 100.0, 0, 0), (50.0, 80.0, 10, 5)], "r_micro double, p_micro double, n_fn long, n_fp long")
    got = [(r.tp, r.new_fp_rate, r.new_fn_rate) for r in reports.derived_rates(totals).collect()]
    assert got == [(0, 0, 0), (20, 0.2, round(1 / 3, 6))]


def test_mapping_keeps_to_its_relations(spark):
    rows = [(1, "A B", "place of birth", "Lyon"), (1, "Lyon", "country", "France"), (2, "Lyon", "country", "Gaul"), (1, "A B", "date of death", "soon"), (1, "A B", "spouse", "C")]
    got = mapping.map_relations(spark.createDataFrame(rows, "ex long, subj string, rel string, obj string"))
    assert {tuple(r) for r in got.collect()} == {(1, "A_B", "birthPlace", "Lyon"), (1, "A_B", "birthPlace", "France")}


def test_short_forms(spark):
    df = spark.createDataFrame([('S a Person;label "A. B";birthYear "1994".', "{'b', 'a', 'b'}", ["x", "rdf-schema#label 1", "rdf-syntax-ns#type T", "rdf-schema#label 2"])], "line string, members string, lines array<string>")
    got = df.select(codecs.parse_ultra(F.col("line")), codecs.from_set_text(F.col("members")), codecs.type_and_label_first(F.col("lines"))).first()
    assert [tuple(t) for t in got[0]] == [("S", "type", "Person"), ("S", "label", "A. B"), ("S", "birthYear", "1994")]
    assert got[1] == ["a", "b"] and got[2] == ["rdf-syntax-ns#type T", "rdf-schema#label 1", "x", "rdf-schema#label 2"]


def test_scores_and_extractors(spark):
    facts = spark.createDataFrame([("a", "p", "Red Fox"), ("a", "p", "..."), ("b", "p", "red"), ("c", "p", None)], "s string, p string, o string")
    texts = spark.createDataFrame([("a", "a red hen, 1 of 2"), ("c", None)], "s string, text string")
    assert sorted((r.s, r.score) for r in plugins.score(facts, texts).collect()) == [("a", 0.0), ("a", 0.5), ("b", 0.0), ("c", 0.0)]
    assert {r.score for r in plugins.score(facts, texts, least=0.5).collect()} == {0.0}
    assert {r.score for r in plugins.score(facts, texts, lambda e, p, v, t: F.lit(1)).collect()} == {1.0}
    assert sorted(tuple(r) for r in plugins.extract_by_rules(texts, {"n": "(\\d)", "hue": "(red)"}).collect()) == [("a", "hue", "red"), ("a", "n", "1"), ("a", "n", "2")]
    assert plugins.extract(texts, lambda batches: (b.assign(line=b["text"].str.upper())[["s", "line"]] for b in batches)).where("s = 'a'").first().line == "A RED HEN, 1 OF 2"


def test_other_syntaxes(spark):
    assert values(spark, codecs.encode_locals(F.col("x")), ':A(b) a :C;:n ":D(e)" .', ":É :p :Q,:R.", None) == [':A%28b%29 a :C;:n ":D(e)" .', ":%C3%89 :p :Q,:R.", None]
    assert codecs.syntax_of("DS_turtleS_0datatype_1inLine_1facto_bart") == {"syntax": "turtleS", "datatype": False, "inLine": True, "facto": True}
    assert codecs.syntax_of("tags") == {"syntax": "tags", "datatype": False, "inLine": False, "facto": False}
    got = values(spark, codecs.parse_as(F.col("x"), F.lit("list")), '[["a","b","c"],["d"]]', "no list", None)
    assert [[tuple(t) for t in x] for x in got] == [[("a", "b", "c")], [], []]
    facts = spark.createDataFrame([("x", "n", "1", "literal", "xsd:int"), ("x", "n", "2", "literal", None), ("x", "rdf:type", "T", "iri", None)], "s string, p string, o string, k string, dt string")
    assert codecs.statements(facts, datatypes=True).first().line == ':x a :T . :x :n "1"^^xsd:int . :x :n "2" .'


def test_closure_of_any_graph(spark):
    def up(*edges):
        return {(r.c, r.a): r.d for r in graph.closure(spark.createDataFrame(list(edges), "c string, p string")).collect()}

    def brute(edges):
        out, nodes = {}, {x for e in edges for x in e}
        for n in nodes:
            seen, todo = {n: 0}, [n]
            for x in todo:
                for a, b in edges:
                    if a == x and b not in seen:
                        seen[b] = seen[x] + 1
                        todo.append(b)
            out |= {(n, a): d for a, d in seen.items()}
        return out

    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(80)]
    diamonds = [e for i in range(12) for e in ((f"d{i}", f"l{i}"), (f"d{i}", f"r{i}"), (f"l{i}", f"d{i + 1}"), (f"r{i}", f"d{i + 1}"))]
    cycle = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")]
    for edges in (chain, diamonds, cycle):
        assert up(*edges) == brute(edges)


def test_values_of_any_length_are_found(spark):
    values = ["fox", "quick brown fox", "the quick brown fox jumps over", "own fo", "x", "", "jumps over the lazy dog again and again", "ox jumps", "  "]
    texts = ["the quick brown fox", "a quick brown foxes", "the quick brown fox jumps over the lazy dog", "", None, "nothing", "he jumps over the lazy dog again and again!", "tabs\tand  blanks"]
    v = spark.createDataFrame(list(enumerate(values)), "item long, value string")
    t = spark.createDataFrame(list(enumerate(texts)), "s long, text string")
    got = {tuple(r) for r in grounding.contained(v, t).collect()}
    assert got == {(i, k) for i, x in enumerate(values) for k, y in enumerate(texts) if x and y and x in y}
    assert grounding.contained(v.limit(0), t).count() == 0


def test_errors_are_told_by_value(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "ex long, p string, v string, pos int")
    gold = rows((1, "a", "x", 1), (1, "a", "y", 2), (2, "a", "x", 1), (3, "a", "x", 1), (3, "b", "z", 1), (1, "c", "k", 1))
    pred = rows((1, "a", "y", 1), (1, "a", "q", 2), (1, "d", "n", 2), (1, "d", "m", 1), (3, "b", "z", 1))
    got = sorted(tuple(r) for r in scoring.to_inspect(gold, pred).select("type", "ex", "pred", F.coalesce("val_pred", F.lit("-")), F.coalesce("val_gold", F.lit("-"))).collect())
    assert got == [("FN", 1, "c", "-", "k"), ("FN", 3, "a", "-", "x"), ("FP_different", 1, "a", "q", "x"), ("FP_new", 1, "d", "m", "-")]
    texts = spark.createDataFrame([(1, "a q here")], "ex long, text string")
    kinds = spark.createDataFrame([(p, "xsd:string") for p in "abcd"], "p string, range string")
    told = {(r.type, r.ex, r.pred): r.found for r in scoring.to_inspect(gold, pred, texts, kinds).collect()}
    assert told == {("FN", 1, "c"): False, ("FN", 3, "a"): False, ("FP_different", 1, "a"): True, ("FP_new", 1, "d"): False}


def test_golden_comparison_of_three_graphs(spark):
    rows = lambda name, *r: spark.createDataFrame([("e", *x) for x in r], "ex string, p string, v string")
    initial = rows("i", ("birthDate", "1965-06-21"), ("birthYear", "1965"), ("birthYear", "1965"), ("genre", ":World_music"), ("genre", ":World_Music"), ("label", "Stacey Fox"), ("alias", "S."), ("birthPlace", ":X"))
    correct = rows("c", ("birthDate", "1965-06-21"), ("birthYear", "1965"), ("birthYear", "1965"))
    extracted = rows("x", ("type", "Artist"), ("birthDate", "1965-06-21"))
    got = scoring.compare_graphs(initial, correct, extracted, [f"p{i}" for i in range(17)] + ["birthDate"]).first()
    assert (got.init_prop_p, got.init_prop_r, got.init_prop_f1) == (100, 16.67, 28.57) == (got.init_value_p, got.init_value_r, got.init_value_f1)
    assert (got.correct_prop_p, got.correct_prop_r, got.correct_prop_f1) == (100, 50, 66.67) == (got.correct_value_p, got.correct_value_r, got.correct_value_f1)
    assert (got.expressiveness, got.coverage) == (33.33, 5.56)


def test_relations_by_names_within_names(spark):
    names = ["city", "cityServed", "label"]
    got = values(spark, scoring.relation_of(F.col("x"), names), "city", "cityServed", "dbo:label", "other")
    assert got == ["city", None, "label", None]


def test_run_settings(spark):
    run = Run.of({"dataset": "DS_turtleS_0datatype_1inLine_1facto", "folds": "5", "limit": None})
    assert run.folds == 5 and run.syntax["inLine"] is True and Run.from_json(run.to_json()) == run
    spark.conf.set("weft.limit", "40")
    try:
        assert run.told_by(spark).limit == 40 and run.told_by(spark).folds == 5
    finally:
        spark.conf.unset("weft.limit")
    with pytest.raises(ValueError, match="unknown"):
        Run.of({"fold": 3})


def test_sample_names():
    assert [sampling.next_name(x) for x in ([], ["sample_0", "sample_12", "other_40", "sample_x"])] == ["sample_0", "sample_13"]


def test_hot_groups_are_ranked_whole(spark):
    rows = spark.range(5000).select(F.col("id").alias("s"), F.when(F.col("id") < 4000, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    got = sampling.ranked(rows, sampling.uid(F.col("s")), "s", by=("g",)).toPandas()
    assert all(sorted(x.n) == list(range(len(x))) and (x["all"] == len(x)).all() for _, x in got.groupby("g"))
    folds = sampling.stratified_kfold(rows, "g", 4).groupBy("fold").agg(F.count_if(F.col("g") == "hot").alias("n")).toPandas().n
    assert set(folds) == {1000}
    pairs = spark.range(300).select((F.col("id") % 3).alias("template"), F.col("id").alias("filler"), F.col("id").alias("uid"))
    assert sampling.capped_reuse(pairs, 10).count() == 300


def test_lead_without_noise(spark):
    page = '<article><p>A <span class="IPA">xx</span><a href="./B C">b</a> <a class="new" href="./D">d</a><sup class="reference noprint">[1]</sup>.</p><p>Open'
    assert values(spark, text.html_lead(F.col("x")), page, None) == ["A [b](:B C) d. Open", None]
    assert values(spark, text.html_lead(F.col("x"), encode=True), page) == ["A [b](:B%20C) d. Open"]


def test_repairs_of_each_kind(spark):
    fix = lambda x, repairs: values(spark, text.repair_decoded(F.col("x"), repairs), x)[0]
    assert fix('<s>< rdf : type =" a" / ></s><pad>', text.REPAIRS_MODEL) == '<rdf:type="a" />'
    assert fix('"1994" ^^ xsd : date', text.REPAIRS_TRAINED) == '"1994"^^xsd:date'
    assert fix("it\\'s \\\\\"x\\\\\" . end", text.REPAIRS_SCORED) == 'it\'s "x".end'
    assert fix("<s>: A  a : B .</s>", text.REPAIRS_LINE) == ":A a:B."
    assert fix("<s>:A a:B;:c :d</s>", text.REPAIRS_NAMES) == ":A a :B; :c  :d"
    assert values(spark, text.repair_decoded(F.col("x"), text.REPAIRS_MODEL), None) == [None]


def test_token_budget_is_the_loop(spark, sf_dir):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids) + 2
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(-1, None), (-2, ""), (-3, "..a..b. c" * 200), (-4, "word " * 400), (-5, "Short. Text.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.short for r in df.select("doc_id", text.shorten_to_tokens(F.col("text"), F.lit(7), 128, path).alias("short")).collect()}
    for i, t in rows:
        while t and size(t) + 7 > 128:
            t = ".".join([x for x in t.split(".") if x][:-1])
        assert got[i] == t
    assert got[-4] == "" and got[-5] == "Short. Text."


def test_token_budget_encodes_heads_only():
    """Sizes of beginnings by one encoding of the head equal encodings of them, at every place; long texts are not encoded whole."""
    import random

    path = public_tokenizers.path("byte_bpe_50k.json")
    sizes, r = text._sizes(path), random.Random(5)
    seen, whole = [], sizes.whole
    words = ["word", " ", ". ", ".", "..", "  ", "\n", "it's", "3.14", "naïve", "год", "東京", "x)", "\u00a0", "_", "<|endoftext|>", "e\u0301", "😀.", "'re", "\t\t", "\x1c"]
    for n in range(150):
        t = "".join(r.choice(words if n % 3 else words[:-6]) for _ in range(r.randrange(200)))
        for most in (-1, 0, 3, 20, 500):
            fits, end = sizes.of(t, most)
            for i in [r.randrange(len(t) + 1) for _ in range(15)] + [0, len(t), end]:
                if i == len(t) or text._SURE.match(t, i) or i < end:
                    assert fits(i) == (whole(t[:i]) <= most), (t, i, most)
    cut = text._Sizes(text._tokenizer(path))
    cut.whole = lambda t: seen.append(len(t)) or whole(t)
    fits, end = cut.of("A sentence of words. " * 5000, 254)
    assert not fits(105000) and end < 3000 and not seen
