"""The library's registered queries over the driver's tables, each with the DuckDB SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from xml.sax.saxutils import escape

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import codecs, text
from weft.operators import graph, grounding, inference, mapping, plugins, reports, sampling, scoring, signatures
from weft.plans import sparql
from weft.plans.config import Run
from weft.plans.grammar import COMPACT, LIGHT
from weft.plans.shape import Shape, read_rules
from weft.sources import quads as store
from weft.sources.quads import delete_where, load, star_quads, star_sql
from weft.sources.scratch import folder
from weft.sources.turtle import triples_in
from weft.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


ORDER_SHAPE = Shape.read("""
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix ex: <http://example.org/> .
ex:OrderShape a sh:NodeShape ; sh:targetClass ex:Order ;
  sh:property [ sh:path ex:status ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ; sh:nodeKind sh:Literal ] ,
              [ sh:path ex:customer ; sh:class ex:Customer ; sh:minCount 1 ] ;
  sh:or ( [ sh:property [ sh:path ex:orderDate ; sh:datatype xsd:date ; sh:minCount 1 ] ] [ sh:property [ sh:path ex:priority ; sh:datatype xsd:gYear ; sh:minCount 1 ] ] ) .
""")
ORDERS, PEOPLE = ("orders",), ("customer", "supplier", "nation", "region")
_Q, _QO, _QP = star_sql(), star_sql(ORDERS), star_sql(PEOPLE)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts (order, return flag and line status): the sparse properties of orders."""
    return load(spark, sf_dir, "lineitem").select(F.concat(F.lit("order/"), "l_orderkey").alias("s"), F.concat("l_returnflag", "l_linestatus").alias("p"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.concat(F.lit("order/"), "o_orderkey").alias("s"))


_FLAGS = "facts AS (SELECT 'order/' || l_orderkey AS s, l_returnflag || l_linestatus AS p FROM lineitem)"
_SIGS = _FLAGS + """, sigs AS (SELECT e.s, coalesce(f.sig, '') AS signature, coalesce(f.n, 0) AS n_props FROM (SELECT 'order/' || o_orderkey AS s FROM orders) e
    LEFT JOIN (SELECT s, array_to_string(list_sort(list_distinct(list(p))), ',') AS sig, count(DISTINCT p) AS n FROM facts GROUP BY s) f ON e.s = f.s)"""


# Graph profile and scoping


@query(f"WITH {_QP} SELECT p, o AS cls, count(DISTINCT s) AS nb FROM quads WHERE p = 'rdf:type' GROUP BY ALL")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_quads(spark, sf_dir, PEOPLE).where("p = 'rdf:type'").groupBy("p", F.col("o").alias("cls")).agg(F.count_distinct("s").alias("nb"))


@query(f"WITH {_Q} SELECT g, p, count(*) AS nb, count(DISTINCT s) AS nb_s FROM quads GROUP BY ALL")
def quads_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_quads(spark, sf_dir).groupBy("g", "p").agg(F.count("*").alias("nb"), F.count_distinct("s").alias("nb_s"))


@query(f"WITH {_Q} SELECT DISTINCT g FROM quads WHERE contains(g, 'er')")
def graph_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_quads(spark, sf_dir).select("g").distinct().where(F.col("g").contains("er"))


@query(f"WITH {_QO} SELECT s, o FROM quads WHERE g = 'orders' AND p = 'priority' AND o IN ('1-URGENT', '2-HIGH') ORDER BY s LIMIT 50 OFFSET 100")
def scoped_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.in_graphs(star_quads(spark, sf_dir, ORDERS), "orders").where((F.col("p") == "priority") & F.col("o").isin("1-URGENT", "2-HIGH"))
    return found.select("s", "o").orderBy("s").offset(100).limit(50)


# Signatures


@query(f"WITH {_FLAGS} SELECT p, count(DISTINCT s) AS nb, round(count(DISTINCT s) / (SELECT count(DISTINCT s) FROM facts), 6) AS freq FROM facts GROUP BY p")
def prop_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.property_frequency(_flags(spark, sf_dir))


@query(f"WITH {_SIGS} SELECT signature, count(*) AS nb, any_value(n_props)::INT AS n_props, round(count(*) / (SELECT count(*) FROM sigs), 6) AS freq FROM sigs GROUP BY signature")
def signature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.signature_counts(signatures.entity_signatures(_flags(spark, sf_dir), _orders(spark, sf_dir)))


@query(f"""WITH {_SIGS}, c AS (SELECT signature, count(*) AS nb FROM sigs GROUP BY signature)
    SELECT signature, nb, round(run / a, 6) AS freq_cumul, round(1 - run / a, 6) AS inv_freq_cumul
    FROM (SELECT *, sum(nb) OVER (ORDER BY nb DESC, signature ROWS UNBOUNDED PRECEDING)::DOUBLE AS run, (SELECT count(*) FROM sigs) AS a FROM c)""")
def signature_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.cumulative(signature_counts(spark, sf_dir))


_MASK = "+".join(f"(contains(signature, '{p}'))::INT * {1 << i}" for i, p in enumerate(("AF", "AO", "NF", "NO", "RF", "RO")))


@query(f"WITH {_SIGS}, m AS (SELECT ({_MASK})::INT AS mask, count(*) AS nb FROM sigs GROUP BY 1) SELECT r.range::INT AS mask, bit_count(r.range::INT)::INT AS n_props, coalesce(nb, 0) AS nb FROM range(64) r LEFT JOIN m ON m.mask = r.range")
def signature_power_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.power_set(signatures.entity_signatures(_flags(spark, sf_dir), _orders(spark, sf_dir)), ["AF", "AO", "NF", "NO", "RF", "RO"])


@query(f"WITH {_SIGS} SELECT contains(signature, 'AF')::INT AS AF, contains(signature, 'NO')::INT AS \"NO\", count(*) AS nb FROM sigs GROUP BY ALL")
def signature_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.one_hot(signatures.entity_signatures(_flags(spark, sf_dir), _orders(spark, sf_dir)), ["AF", "NO"])


# Rules, semi and anti joins


@query(f"WITH {_QO} SELECT 'inferences' AS g, s, 'orderYear' AS p, substr(o, 1, 4) AS o, 'literal' AS k FROM quads WHERE p = 'orderDate'")
def infer_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.infer_from_date(star_quads(spark, sf_dir, ORDERS), "orderDate", "orderYear", "inferences")


@query(f"WITH {_QP} SELECT DISTINCT 'inferences' AS g, a.s, 'region' AS p, b.o, 'iri' AS k FROM quads a JOIN quads b ON a.o = b.s WHERE a.p = 'nation' AND b.p = 'region'")
def infer_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.infer_two_hops(star_quads(spark, sf_dir, PEOPLE), "nation", "Nation", "region", "region", "inferences")


@query("SELECT DISTINCT 'customer/' || c_custkey AS s FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def todo_anti_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order in progress."""
    bought = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("customer/"), "o_custkey").alias("s"))
    return graph.missing(graph.of_class(star_quads(spark, sf_dir, ("customer",)), "Customer"), bought, "s")


@query(f"WITH {_QO} SELECT s, p, o FROM quads WHERE p = 'status' AND NOT EXISTS (SELECT 1 FROM orders x WHERE 'order/' || x.o_orderkey = s AND x.o_orderstatus = 'F' AND o = 'F')")
def todo_anti_spo(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = star_quads(spark, sf_dir, ORDERS).where("p = 'status'")
    return graph.missing(q, q.where("o = 'F'"), "s", "p", "o").select("s", "p", "o")


@query("SELECT 'order/' || o_orderkey AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus = 'O'")
def new_vs_old_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.concat(F.lit("order/"), "o_orderkey").alias("s"), F.to_date("o_orderdate").alias("d"), "o_orderstatus")
    old, new = o.where("d < DATE '1997-01-01'"), o.select("s")
    return graph.exists(graph.missing(new, old, "s"), o.where("o_orderstatus = 'O'"), "s")


@query(f"WITH {_QP} SELECT s, max(o) FILTER (p = 'label') AS label, max(o) FILTER (p = 'nation') AS nation FROM quads GROUP BY s HAVING count(*) FILTER (p = 'label') > 0 AND count(*) FILTER (p = 'nation') > 0")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.star(star_quads(spark, sf_dir, PEOPLE), ["label", "nation"])


@query(f"WITH {_QP} SELECT s, string_agg(DISTINCT o, '|' ORDER BY o) FILTER (p = 'label') AS label, string_agg(DISTINCT o, '|' ORDER BY o) FILTER (p = 'region') AS region FROM quads GROUP BY s")
def optional_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.optional(star_quads(spark, sf_dir, PEOPLE), ["label", "region"])


@query(f"WITH {_QP} SELECT DISTINCT a.s, a.p, a.o FROM quads a JOIN quads t ON t.s = a.o AND t.p = 'rdf:type' WHERE a.p = 'nation' AND t.o = 'Nation'")
def optional_range_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([("nation", "Nation"), ("region", "Nation")], "p string, range string")
    return graph.range_checked(star_quads(spark, sf_dir, PEOPLE), ranges)


# Grounding. Texts are composed from the tables.


def _order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    note = F.concat(F.lit("Order placed on "), text.long_date(F.to_date("o_orderdate")), F.lit(" with status "), F.when(F.col("o_orderkey") % 3 == 0, F.lit("unknown")).otherwise(F.lower("o_orderstatus")), F.lit(", priority "), F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lit("none")), F.lit("."))
    return o.select(F.concat(F.lit("order/"), "o_orderkey").alias("s"), note.alias("text"))


_NOTE = "'Order placed on ' || strftime(o_orderdate, '%d %B %Y') || ' with status ' || CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE lower(o_orderstatus) END || ', priority ' || CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE 'none' END || '.'"
_CHECKED = f"""{_QO}, texts AS (SELECT 'order/' || o_orderkey AS s, {_NOTE} AS t, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
    checked AS (SELECT q.s, q.p, q.o, CASE WHEN p = 'orderDate' THEN q.o = d ELSE contains(lower(t), lower(q.o)) END AS found FROM quads q JOIN texts USING (s) WHERE p IN ('orderDate', 'status', 'priority'))"""


@query(f"WITH {_CHECKED} SELECT s, p, o, found FROM checked")
def ground_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([("orderDate", "xsd:date"), ("status", "xsd:string"), ("priority", "xsd:string")], "p string, range string")
    return grounding.wikicheck(star_quads(spark, sf_dir, ORDERS), _order_texts(spark, sf_dir), kinds).select("s", "p", "o", "found")


@query(f"WITH {_CHECKED} SELECT s, count(*) AS n, count(*) FILTER (found) AS n_found, round(100 * count(*) FILTER (found) / count(*), 2) AS rate FROM checked GROUP BY s")
def grounding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.rate(ground_plain(spark, sf_dir))


@query("SELECT 'customer/' || c_custkey AS s, 'nation/' || c_nationkey AS o, c_custkey % 2 = 0 AS found FROM customer")
def ground_object_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("s"), F.concat(F.lit("nation/"), "c_nationkey").alias("o"), (F.col("c_custkey") % 2 == 0).alias("linked"))
    md = F.concat(F.lit("Lives in "), F.when(F.col("linked"), F.concat(F.lit("[the place](:"), "o", F.lit(")"))).otherwise(F.col("o")), F.lit("."))
    return c.select("s", "o", grounding.in_markdown(F.concat(F.lit(":"), "o"), md).alias("found"))


@query("SELECT p_partkey, contains(strip_accents('im land ' || replace(replace(lower(p_name), 'a', 'á'), 'e', 'ë')), lower(p_name)) AS found FROM part")
def ground_accent(spark: SparkSession, sf_dir: str) -> DataFrame:
    accented = F.concat(F.lit("im land "), F.replace(F.replace(F.lower("p_name"), F.lit("a"), F.lit("á")), F.lit("e"), F.lit("ë")))
    return load(spark, sf_dir, "part").select("p_partkey", text.folds_into(accented, F.col("p_name")).alias("found"))


@query("SELECT c_custkey, c_custkey % 5 <> 4 AS found FROM customer")
def ground_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in Cyrillic, Greek and Latin letters of their own, each in a text of ASCII letters or the other way about; one of five is another name."""
    k = F.col("c_custkey")
    pick = lambda *of: F.concat(F.element_at(F.array(*map(F.lit, of)), (k % 5 + 1).cast("int")), F.lit(" "), k)
    said, meant = pick("Moskva", "АФИНЫ", "Łódź", "Athena", "Pinsk"), pick("Москва", "Afiny", "lodz", "Αθήνα", "Минск")
    return load(spark, sf_dir, "customer").select("c_custkey", text.folds_into(F.concat(F.lit("Near "), said, F.lit(".")), meant).alias("found"))


@query("SELECT DISTINCT item_id AS item, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def ground_benchmark_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("value"))
    return grounding.contained(values, load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("SELECT 'order/' || o_orderkey AS s, [strftime(o_orderdate, '%Y-%m-%d')]::VARCHAR AS dates, strftime(o_orderdate, '%Y') AS year FROM orders")
def date_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.dates_in(F.col("text"))
    return _order_texts(spark, sf_dir).select("s", F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("dates"), text.year_of(F.get(found, F.lit(0))).alias("year"))


# Text functions


@query("SELECT c_custkey, replace(replace(replace(url_encode(replace(c_name, '#', ' ') || '''s a.b/c'), '%2F', '/'), '.', '%2E'), '+', '%20') AS enc, replace(c_name, '#', ' ') || '''s a.b/c' AS dec FROM customer")
def uri_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit("'s a.b/c"))
    return load(spark, sf_dir, "customer").select("c_custkey", text.encode_uri(raw).alias("enc")).withColumn("dec", text.decode_uri(F.col("enc")))


@query("SELECT p_partkey, p_name AS label, lower(replace(p_name, '_', ' ')) AS normal, p_type || ' (x)' AS raw FROM part")
def label_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(", Jr. (part)"))
    value = F.concat(F.lit(":"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return load(spark, sf_dir, "part").select("p_partkey", text.simple_label(raw).alias("label"), text.normal_value(value).alias("normal"), F.concat("p_type", F.lit(" (x)")).alias("raw"))


@query("SELECT c_custkey, 'In ' || c_name || ' & beyond' AS plain, c_name AS label, 'N' || c_custkey AS target FROM customer")
def md_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("In  **["), "c_name", F.lit("](:N"), "c_custkey", F.lit(")** ( )&amp; beyond"))
    n = load(spark, sf_dir, "customer").withColumn("md", md)
    return n.select("c_custkey", text.md_to_text(F.col("md")).alias("plain"), F.get(text.md_links(F.col("md"), 1), F.lit(0)).alias("label"), F.get(text.md_links(F.col("md")), F.lit(0)).alias("target"))


@query("""SELECT page_id, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') AS links, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::INT AS n FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = text.html_links(F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(links, " ").alias("links"), F.size(links).alias("n"))


@query(r"""WITH b AS (SELECT page_id, regexp_extract(html, '(?s)<(?:article|section)[^>]*>(.*?)(?:</article>|</section>|$)', 1) AS block FROM pages),
    t AS (SELECT page_id, array_to_string(list_transform(string_split(block, '<p>')[2:], lambda x: split_part(x, '</p>', 1)), ' ') AS t FROM b)
    SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(replace(t, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '[ \n\r\t]+', ' ', 'g'), ' ') AS lead FROM t""")
def html_paragraph_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", text.html_lead(F.col("html")).alias("lead"))


@query("SELECT page_id, md5(html) || ' [see it](:T_' || page_id || ') Last' || page_id || ' & more' AS lead FROM pages")
def html_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with a dropped element that holds another one of its kind, a link with markup in its label, and paragraphs that a list or the end of the page ends."""
    page = F.concat(F.lit('<!-- <p> --><script>"<section>"</script><p>before</p><section><p>'), F.md5("html"), F.lit('<span class="IPA">x <span>y</span> z</span> <a href="./T_'), "page_id",
        F.lit('">see <i>it</i></a><ul><li>one<li>two</ul><p class=k>Last'), "page_id", F.lit(" &amp; more</b></section><p>after</p>"))
    return load(spark, sf_dir, "pages").select("page_id", text.html_lead(page).alias("lead"))


@query("""SELECT conv_id, turn, '<s>' || role || ' : ' || text || '</s>' AS prompt, replace(replace(replace(text, '\\', '\\\\'), '''', '\\'''), '"', '\\"') AS escaped, trim(replace(replace(replace(replace(replace(replace(text, ' ;', ';'), '; ', ';'), ' .', '.'), '" ', '"'), '  ', ' '), chr(0), ''), ' ') AS repaired FROM conversations""".replace("\\\\", "\\"))
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    decoded = F.concat(F.lit("<s>"), "text", F.lit("</s><pad>"))
    return c.select("conv_id", "turn", text.prompt(F.col("role"), F.col("text")).alias("prompt"), text.escape_literal(F.col("text")).alias("escaped"), text.repair_decoded(decoded).alias("repaired"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS found, CASE WHEN day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate) THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS slashed FROM orders")
def dates_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's day in one of eight forms within a text, and with slashes, where the month may be in doubt."""
    d, form = F.col("o_orderdate"), F.col("o_orderkey") % 8
    ending = F.when(F.dayofmonth(d).isin(1, 21, 31), "st").when(F.dayofmonth(d).isin(2, 22), "nd").when(F.dayofmonth(d).isin(3, 23), "rd").otherwise("th")
    day, year = F.date_format(d, "d"), F.date_format(d, "yyyy")
    forms = [F.concat(F.date_format(d, "MMM d"), F.lit(", "), year), F.date_format(d, "dd.MM.yyyy"), F.concat(day, ending, F.lit(" "), F.date_format(d, "MMMM yyyy")), F.lower(F.date_format(d, "d MMMM yyyy")),
        F.upper(F.concat(F.date_format(d, "MMMM d"), ending, F.lit(" "), year)), F.date_format(d, "yyyy/M/d"), F.concat(day, ending, F.lit(" of "), F.date_format(d, "MMM"), F.lit("., "), year), F.date_format(d, "yyyy-MM-dd")]
    written = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        written = F.when(form == i, f).otherwise(written)
    around = F.concat(F.lit("In May 1990, no. 12-1999: ("), written, F.lit("); 31 February 2000, 1234-5678."))
    slashed = F.when(form % 2 == 0, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    told = lambda c: F.array_join(text.dates_in(c), ",")
    return load(spark, sf_dir, "orders").select("o_orderkey", told(around).alias("found"), told(slashed).alias("slashed"))


def _repaired(text_sql: str, repairs: tuple[tuple[str, str], ...]) -> str:
    for a, b in repairs:
        text_sql = f"replace({text_sql}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return text_sql


_DECODED = """('<s>< a href =" x" / > : ' || text || ' "/><b> ^^ xsd : date " : "' || role || '" # . a</s>')"""


@query(f"SELECT conv_id, turn, trim({_repaired(_DECODED, text.REPAIRS_MODEL)}, ' ') AS model, {_repaired(_DECODED, text.REPAIRS_TRAINED)} AS trained, {_repaired(_DECODED, text.REPAIRS_SCORED)} AS scored, {_repaired(_DECODED, text.REPAIRS_LINE)} AS line, trim({_repaired(_DECODED, text.REPAIRS_NAMES)}, ' ') AS names FROM conversations")
def decoded_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns set in markup as a tokenizer spaces it, put right by each list."""
    said = F.concat(F.lit('<s>< a href =" x" / > : '), "text", F.lit(' "/><b> ^^ xsd : date " : "'), "role", F.lit('" # . a</s>'))
    fix = lambda repairs, trim=False: text.repair_decoded(said, repairs, trim)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", fix(text.REPAIRS_MODEL, True).alias("model"), fix(text.REPAIRS_TRAINED).alias("trained"), fix(text.REPAIRS_SCORED).alias("scored"), fix(text.REPAIRS_LINE).alias("line"), fix(text.REPAIRS_NAMES, True).alias("names"))


@query()
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents cut to sentences that fit 256 tokens with their source; SQL has no tokenizer, a test repeats the loop."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", text.shorten_to_tokens(F.col("text"), F.length(F.coalesce("source", F.lit(""))) + 10, 256, public_tokenizers.path("byte_bpe_50k.json")).alias("short"))


# Sampling and splitting


@query("SELECT 'customer/' || c_custkey AS s, md5('42:' || 'customer/' || c_custkey) AS uid FROM customer")
def uid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = graph.of_class(star_quads(spark, sf_dir, ("customer",)), "Customer")
    return c.select("s", sampling.uid(F.col("s")).alias("uid"))


@query("SELECT 'order/' || o_orderkey AS s, md5('42:order/' || o_orderkey) AS uid FROM orders WHERE o_orderstatus <> 'F' ORDER BY 2 LIMIT 200")
def sample_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.concat(F.lit("order/"), "o_orderkey").alias("s"), "o_orderstatus")
    return sampling.sample(o.select("s"), 200, o.where("o_orderstatus = 'F'"))


_STRATA = f"""{_FLAGS}, c AS (SELECT p, count(DISTINCT s) AS n FROM facts GROUP BY p), r AS (SELECT p, n FROM c WHERE n < (SELECT avg(n) FROM c)),
    strata AS (SELECT s, coalesce(min_by(r.p, (r.n, r.p)), 'NONE') AS stratum FROM (SELECT DISTINCT s, p FROM facts) f LEFT JOIN r ON r.p = f.p GROUP BY s)"""


@query(f"WITH {_STRATA} SELECT s, stratum FROM strata")
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.strata(_flags(spark, sf_dir))


@query(f"WITH {_STRATA} SELECT s, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5('0:' || s), s) <= floor(count(*) OVER (PARTITION BY stratum) / 6) THEN 'test' ELSE 'train' END AS split FROM strata")
def strat_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(sampling.strata(_flags(spark, sf_dir)), "stratum")


@query(f"WITH {_FLAGS} SELECT s, count(*) AS n_quotas FROM (SELECT s, p, row_number() OVER (PARTITION BY p ORDER BY md5('42:' || s), s) AS n FROM (SELECT DISTINCT s, p FROM facts)) WHERE n <= 100 GROUP BY s")
def exposure_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota(_flags(spark, sf_dir), 100)


@query(f"WITH {_FLAGS} SELECT s, count(*) AS n_quotas FROM (SELECT s, p, row_number() OVER (PARTITION BY p ORDER BY md5('42:' || s), s) AS n FROM (SELECT DISTINCT s, p FROM facts)) WHERE n <= 100 GROUP BY s ORDER BY min(n), md5('42:' || s), s LIMIT 150")
def exposure_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota(_flags(spark, sf_dir), 100, total=150)


def _exposure(quota: int, total: int, repeats: int, rounds: int) -> str:
    steps = [_FLAGS, "own AS MATERIALIZED (SELECT DISTINCT s, p, md5('42:' || s) AS u FROM facts)", "props AS MATERIALIZED (SELECT p, row_number() OVER (ORDER BY count(*), p) - 1 AS r FROM own GROUP BY p)",
        "seen_0 AS (SELECT s FROM own WHERE false)", "taken_0 AS (SELECT s, 0::BIGINT AS r FROM own WHERE false)"]
    for i in range(rounds):
        steps.append(f"c{i} AS MATERIALIZED (SELECT s, u, s IN (SELECT s FROM seen_{i}) AS old FROM own JOIN props USING (p) WHERE r = {i})")
        steps.append(f"cut{i} AS MATERIALIZED (SELECT u, s FROM c{i} WHERE old ORDER BY u, s LIMIT 1 OFFSET {repeats - 1})")
        steps.append(f"new{i} AS MATERIALIZED (SELECT s, row_number() OVER (ORDER BY u, s) AS n FROM c{i} a WHERE NOT old AND NOT EXISTS (SELECT 1 FROM cut{i} k WHERE a.u > k.u OR a.u = k.u AND a.s > k.s))")
        steps.append(f"seen_{i + 1} AS MATERIALIZED (SELECT s FROM seen_{i} UNION ALL SELECT s FROM new{i})")
        steps.append(f"""taken_{i + 1} AS MATERIALIZED (SELECT * FROM taken_{i} UNION ALL SELECT s, {i} FROM new{i} WHERE n <= least({total} - (SELECT count(*) FROM taken_{i}),
            {quota + 1} - (SELECT count(*) FROM taken_{i} t JOIN own o ON o.s = t.s JOIN props q ON q.p = o.p AND q.r = {i})))""")
    return f"WITH {', '.join(steps)} SELECT s, t.r::INT AS round, p FROM taken_{rounds} t JOIN props USING (r)"


@query(_exposure(120, 300, 15, 8))
def exposure_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round for each property, rarest first, each depending on what the rounds before have chosen."""
    return sampling.exposure(_flags(spark, sf_dir), quota=120, total=300, repeats=15)


_RANK = "(SELECT 'order/' || o_orderkey AS s, row_number() OVER (ORDER BY md5('42:order/' || o_orderkey)) - 1 AS n, count(*) OVER () AS a FROM orders)"


@query(f"SELECT s, floor(n * 10 / a)::INT AS fold FROM {_RANK}")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.kfold(_orders(spark, sf_dir), 10)


@query(f"SELECT s, CASE WHEN n < 1000 THEN 'train' ELSE 'test' END AS split FROM {_RANK} WHERE n < 1200")
def slice_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.slices(_orders(spark, sf_dir), {"train": (0, 1000), "test": (1000, 1200)})


@query("""SELECT template, filler, uid FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY uid, template, filler) AS l, row_number() OVER (PARTITION BY filler ORDER BY uid, template, filler) AS r
    FROM (SELECT l_suppkey AS template, l_partkey AS filler, min(l_orderkey * 10 + l_linenumber)::BIGINT AS uid FROM lineitem GROUP BY ALL)) WHERE l <= 10 OR r <= 10""")
def reuse_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("template"), F.col("l_partkey").alias("filler")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uid"))
    return sampling.capped_reuse(pairs, 10)


@query("SELECT o_orderpriority, count(*) AS nb, round(ln((SELECT count(*) FROM orders) / count(*)), 6) AS weight FROM orders GROUP BY 1")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.class_weights(load(spark, sf_dir, "orders"), "o_orderpriority")


# Codecs

_LINE = "':order/' || o_orderkey || ' a :Order; :customer :customer/' || o_custkey || '; :orderDate \"' || strftime(o_orderdate, '%Y-%m-%d') || '\"; :priority \"' || o_orderpriority || '\"; :status \"' || o_orderstatus || '\" .'"


@query(f"SELECT 'order/' || o_orderkey AS s, {_LINE} AS line FROM orders")
def ttl_light_serialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.serialize(star_quads(spark, sf_dir, ORDERS))


@query(f"""WITH {_QO} SELECT s AS subj, CASE WHEN p = 'rdf:type' THEN 'type' ELSE p END AS prop, CASE WHEN k = 'iri' AND p <> 'rdf:type' THEN ':' || o ELSE o END AS val FROM quads""")
def ttl_light_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = codecs.serialize(star_quads(spark, sf_dir, ORDERS))
    return lines.select(F.inline(codecs.parse(F.col("line"))))


@query("SELECT 'order/' || o_orderkey AS s, '<subj>order/' || o_orderkey || '<rel>type<obj>Order<et>' AS head, 5::INT AS n, true AS same FROM orders")
def tags_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ttl_light_serialize(spark, sf_dir).withColumn("t", codecs.parse(F.col("line"))).withColumn("tags", codecs.to_tags(F.col("t"))).withColumn("back", codecs.from_tags(F.col("tags")))
    return t.select("s", F.concat(F.substring_index("tags", "<et>", 1), F.lit("<et>")).alias("head"), F.size("back").alias("n"), (F.to_json("back") == F.to_json("t")).alias("same"))


@query("SELECT 'order/' || o_orderkey AS s, o_orderkey % 5 <> 0 AS accepted FROM orders")
def grammar_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ttl_light_serialize(spark, sf_dir)
    broken = F.when(F.substring_index("s", "/", -1).cast("long") % 5 == 0, F.replace("line", F.lit('"; :status "'), F.lit('" :status '))).otherwise(F.col("line"))
    return lines.select("s", codecs.accepted(broken).alias("accepted"))


@query("""WITH l AS (SELECT o_orderkey AS k, ':order/' || o_orderkey || ' a :Order; :customer :customer/' || o_custkey || '; :orderDate "' || strftime(o_orderdate, '%Y-%m-%d') || '"; :priority "' || o_orderpriority || '"; :status "' || o_orderstatus || '" .' AS line FROM orders)
    SELECT k AS o_orderkey, k % 4 < 2 AS prefix, k % 4 = 0 AS "full", (CASE k % 4 WHEN 2 THEN strpos(line, '; :status') + 1 WHEN 3 THEN length(line) END - CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END)::INT AS failed FROM l""")
def grammar_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines, halves, lines without one semicolon, and lines with something after the end."""
    lines = ttl_light_serialize(spark, sf_dir).withColumn("k", F.substring_index("s", "/", -1).cast("long"))
    half = F.substring(F.col("line"), F.lit(1), (F.length("line") / 2).cast("int"))
    damaged = F.when(F.col("k") % 4 == 0, F.col("line")).when(F.col("k") % 4 == 1, half).when(F.col("k") % 4 == 2, F.replace("line", F.lit("; :status"), F.lit(" :status"))).otherwise(F.concat("line", F.lit("x")))
    return lines.select(F.col("k").alias("o_orderkey"), LIGHT.run(damaged).alias("r")).select("o_orderkey", "r.prefix", "r.full", "r.failed")


@query("SELECT p_partkey, p_partkey % 3 = 0 AS light, p_partkey % 3 <> 2 AS compact FROM part")
def grammar_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that both grammars hold for sentences or beginnings, that only the compact one does (an escaped comma in a name), and that neither does."""
    k = F.col("p_partkey")
    odd = F.when(k % 3 == 0, "").when(k % 3 == 1, "\\,x").otherwise('"')
    line = F.concat(F.lit(":p"), k.cast("string"), F.lit(" a:Part"), odd, F.lit(';:brand "'), "p_brand", F.lit('".'))
    return load(spark, sf_dir, "part").select("p_partkey", codecs.accepted(line).alias("light"), codecs.accepted(line, COMPACT).alias("compact"))


@query("SELECT 'customer/' || c_custkey AS subj, 'nation' AS prop, 'nation ' || c_nationkey AS val FROM customer UNION ALL SELECT 'customer/' || c_custkey, 'label', c_name FROM customer")
def triplet_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("<s><triplet> customer/"), "c_custkey", F.lit(" <subj> nation "), "c_nationkey", F.lit(" <obj> nation <subj> "), "c_name", F.lit(" <obj> label "))
    return load(spark, sf_dir, "customer").select(F.inline(codecs.from_triplet_tokens(s)))


# Validation and scores


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order facts of which some are missing or of a wrong form."""
    q = star_quads(spark, sf_dir, ORDERS).withColumn("n", F.substring_index("s", "/", -1).cast("long"))
    kept = q.where(~((F.col("p") == "status") & (F.col("n") % 7 == 0)) & ~((F.col("p") == "customer") & (F.col("n") % 11 == 0)))
    return kept.withColumn("o", F.when((F.col("p") == "orderDate") & (F.col("n") % 3 == 0), F.lit("soon")).when((F.col("p") == "priority") & (F.col("n") % 2 == 0), F.lit("1999")).otherwise(F.col("o")))


@query("""SELECT 'order/' || n AS s, concat_ws(',', CASE WHEN n % 11 = 0 THEN 'customer' END, CASE WHEN n % 3 = 0 AND n % 2 <> 0 THEN 'or1' END, CASE WHEN n % 7 = 0 THEN 'status' END) AS violations,
    n % 11 <> 0 AND n % 7 <> 0 AND NOT (n % 3 = 0 AND n % 2 <> 0) AS conforms FROM (SELECT o_orderkey AS n FROM orders)""")
def shacl_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.validate(_damaged(spark, sf_dir), ORDER_SHAPE)


@query("""SELECT 'order/' || n AS s, concat_ws(',', CASE WHEN n % 11 <> 0 THEN 'customer' END, 'orderDate', 'priority', CASE WHEN n % 7 <> 0 THEN 'status' END) AS matched, 'rdf:type' AS extra,
    concat_ws(',', CASE WHEN n % 11 = 0 THEN 'customer' END, CASE WHEN n % 7 = 0 THEN 'status' END) AS missing,
    round(100 * m / 4, 2) AS coverage, round(100 * m / (m + 1), 2) AS precision FROM (SELECT o_orderkey AS n, 4 - (o_orderkey % 11 = 0)::INT - (o_orderkey % 7 = 0)::INT AS m FROM orders)""")
def extract_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _damaged(spark, sf_dir).groupBy("s").agg(F.collect_set("p").alias("found"))
    return found.select("s", *scoring.extraction_stats(F.col("found"), [p.name for p in ORDER_SHAPE.properties]))


@query("""SELECT 'order/' || n AS s, 3::INT AS n_datatype, round(100 * (3 - (n % 7 = 0)::INT) / 3, 2) AS coverage_datatype, 1::INT AS n_object, CASE WHEN n % 11 = 0 THEN 0 ELSE 100 END::DOUBLE AS coverage_object FROM (SELECT o_orderkey AS n FROM orders)""")
def extract_stats_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _damaged(spark, sf_dir).groupBy("s").agg(F.collect_set("p").alias("found"))
    return found.select("s", *scoring.extraction_by_kind(F.col("found"), ORDER_SHAPE))


@query("""SELECT 'order/' || o_orderkey AS s, 'customer' AS p, 'customer/' || o_custkey AS o, 'iri' AS k, NULL AS dt FROM orders UNION ALL SELECT 'order/' || o_orderkey, 'status', o_orderstatus, 'literal', 'xsd:string' FROM orders UNION ALL SELECT 'order/' || o_orderkey, 'rdf:type', 'Order', 'iri', NULL FROM orders""")
def triples_to_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = lambda p, v: F.struct(F.lit(p).alias("prop"), v.alias("val"))
    own = F.array(fact("customer", F.concat(F.lit("<http://dbpedia.org/resource/customer/"), "o_custkey", F.lit(">"))), fact("status", F.col("o_orderstatus")), fact("type", F.lit(":Order")), fact("unheard", F.lit("x")))
    triples = load(spark, sf_dir, "orders").select(F.concat(F.lit("order/"), "o_orderkey").alias("subj"), F.inline(own))
    return scoring.triples_to_facts(triples, ORDER_SHAPE)


RELATIONS = ["AF", "NO", "RF", "orderStatus"]


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ex"), F.concat("l_returnflag", "l_linestatus").alias("p"), F.col("l_suppkey").cast("string").alias("v"), F.col("l_linenumber").alias("pos"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = load(spark, sf_dir, "lineitem").where("l_linenumber % 3 <> 0 AND l_orderkey % 10 <> 0")
    return x.select(F.col("l_orderkey").alias("ex"), F.concat(F.when(F.col("l_orderkey") % 4 == 0, F.lit("A")).otherwise(F.col("l_returnflag")), "l_linestatus").alias("p"), (F.col("l_suppkey") + (F.col("l_partkey") % 5 == 0).cast("int")).cast("string").alias("v"), F.col("l_linenumber").alias("pos"))


_GP = """gold AS (SELECT l_orderkey AS ex, l_returnflag || l_linestatus AS p, l_suppkey::VARCHAR AS v, l_linenumber AS pos FROM lineitem),
    pred AS (SELECT l_orderkey AS ex, CASE WHEN l_orderkey % 4 = 0 THEN 'A' ELSE l_returnflag END || l_linestatus AS p, (l_suppkey + (l_partkey % 5 = 0)::INT)::VARCHAR AS v, l_linenumber AS pos FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_orderkey % 10 <> 0)"""
_CASES = _GP + """, ex AS (SELECT DISTINCT ex FROM gold WHERE ex IN (SELECT ex FROM pred)), rel AS (SELECT unnest(['AF', 'NO', 'RF', 'orderStatus']) AS p),
    g AS (SELECT ex, p, list(DISTINCT v) AS vs, count(*) AS n FROM gold GROUP BY ALL), q AS (SELECT ex, p, list(DISTINCT v) AS vs, count(*) AS n FROM pred GROUP BY ALL),
    a AS (SELECT rel.p, g.vs AS G, q.vs AS Q, coalesce(g.n, 0) AS ng, coalesce(q.n, 0) AS nq, len(list_intersect(coalesce(g.vs, []), coalesce(q.vs, []))) AS hit FROM ex CROSS JOIN rel LEFT JOIN g USING (ex, p) LEFT JOIN q USING (ex, p)),
    cases AS (SELECT p, sum(hit)::BIGINT AS tp, sum(CASE WHEN G IS NOT NULL AND Q IS NOT NULL THEN len(Q) - hit WHEN Q IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS fp,
        count(*) FILTER (G IS NOT NULL AND Q IS NULL) AS fn, count(*) FILTER (G IS NULL AND Q IS NULL) AS tn, sum(ng)::BIGINT AS nb_gt, sum(nq)::BIGINT AS nb_pred FROM a GROUP BY p)"""
_P, _R = "coalesce(100 * tp / nullif(tp + fp, 0), 0)", "coalesce(100 * tp / nullif(tp + fn, 0), 0)"


@query(f"WITH {_CASES} SELECT *, round({_P}, 4) AS p_score, round({_R}, 4) AS r_score, round(coalesce(200 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM cases")
def score_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = scoring.relation_cases(_gold(spark, sf_dir), _predicted(spark, sf_dir), RELATIONS)
    return cases.select("*", *scoring.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@query(f"""WITH {_CASES}, s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, avg(coalesce(200 * tp / nullif(2 * tp + fp + fn, 0), 0)) FILTER (nb_gt > 0) AS m FROM cases)
    SELECT round({_P}, 4) AS p_micro, round({_R}, 4) AS r_micro, round(200 * tp / (2 * tp + fp + fn), 4) AS f1_micro, round(m, 4) AS f1_macro, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(fp / (tp + fp + fn + tn), 6) AS fp_rate, round(fn / (tp + fp + fn + tn), 6) AS fn_rate FROM s""")
def score_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.overall(scoring.relation_cases(_gold(spark, sf_dir), _predicted(spark, sf_dir), RELATIONS))


_ERRS = _GP + """, ok AS (SELECT DISTINCT ex FROM gold WHERE ex IN (SELECT ex FROM pred)), eg AS (SELECT ex, p, list(DISTINCT v) AS vs, arg_min(v, (pos, v)) AS f FROM gold WHERE ex IN (SELECT ex FROM ok) GROUP BY ALL),
    eq AS (SELECT ex, p, arg_min(v, (pos, v)) AS f FROM pred WHERE ex IN (SELECT ex FROM ok) GROUP BY ALL),
    e AS (SELECT 'FP_different' AS type, q.ex, q.p AS pred, q.v AS val_pred, eg.f AS val_gold FROM (SELECT DISTINCT ex, p, v FROM pred) q JOIN eg ON eg.ex = q.ex AND eg.p = q.p WHERE NOT list_contains(eg.vs, q.v)
        UNION ALL SELECT 'FN', eg.ex, eg.p, NULL, eg.f FROM eg LEFT JOIN eq ON eq.ex = eg.ex AND eq.p = eg.p WHERE eq.ex IS NULL
        UNION ALL SELECT 'FP_new', eq.ex, eq.p, eq.f, NULL FROM eq LEFT JOIN eg ON eq.ex = eg.ex AND eq.p = eg.p WHERE eg.ex IS NULL)"""


@query(f"WITH {_ERRS} SELECT * FROM e")
def score_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.to_inspect(_gold(spark, sf_dir), _predicted(spark, sf_dir))


@query(f"""WITH {_ERRS}, t AS (SELECT o_orderkey AS ex, 'supplier ' || o_custkey || ' and ' || o_shippriority AS text FROM (SELECT *, o_orderkey % 7 AS o_shippriority FROM orders) WHERE o_orderkey % 3 <> 0)
    SELECT CASE WHEN type = 'FP_new' AND text IS NULL THEN 'FP' ELSE type END AS type, e.ex, pred, CASE WHEN type = 'FP_new' AND text IS NULL THEN NULL ELSE val_pred END AS val_pred, val_gold, text AS abs, coalesce(contains(text, coalesce(val_pred, val_gold)), false) AS found
    FROM e LEFT JOIN t ON t.ex = e.ex WHERE type <> 'FP_different' OR text IS NOT NULL""")
def score_errors_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0")
    texts = o.select(F.col("o_orderkey").alias("ex"), F.concat(F.lit("supplier "), "o_custkey", F.lit(" and "), F.col("o_orderkey") % 7).alias("text"))
    kinds = spark.createDataFrame([(p, "xsd:string") for p in ("AF", "AO", "NF", "NO", "RF", "RO")], "p string, range string")
    return scoring.to_inspect(_gold(spark, sf_dir), _predicted(spark, sf_dir), texts, kinds)


@query(f"WITH {_ERRS} SELECT count(*) FILTER (contains(type, 'FN')) AS n_fn, count(*) FILTER (contains(type, 'FP')) AS n_fp, round(count(*) FILTER (type = 'FP_new') / count(*) FILTER (contains(type, 'FP')), 6) AS new_rate FROM e")
def fp_fn_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = score_errors(spark, sf_dir)
    fp = F.count_if(F.col("type").contains("FP"))
    return e.agg(F.count_if(F.col("type").contains("FN")).alias("n_fn"), fp.alias("n_fp"), F.round(F.count_if(F.col("type") == "FP_new") / fp, 6).alias("new_rate"))


_LINES = """l AS (SELECT o_orderkey AS k, """ + _LINE + """ AS g, CASE WHEN o_orderkey % 5 = 0 THEN 'no graph ' || o_orderstatus ELSE """ + _LINE + """ END AS p FROM orders)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted lines of orders with their triples; a fifth of the predictions is no graph, some have another subject or lack a property."""
    lines = ttl_light_serialize(spark, sf_dir).withColumn("n", F.substring_index("s", "/", -1).cast("long"))
    own = F.regexp_extract("line", ':status "([^"]*)"', 1)
    other = F.when(F.col("n") % 5 == 0, F.concat(F.lit("no graph "), own)).otherwise(F.col("line"))
    triples = codecs.parse(other)
    named = F.when(F.col("n") % 4 == 0, F.transform(triples, lambda t: F.struct(F.concat(F.lit("x"), t["subj"]).alias("subj"), t["prop"].alias("prop"), t["val"].alias("val")))).otherwise(triples)
    fewer = F.when(F.col("n") % 3 == 0, F.filter(named, lambda t: t["prop"] != "status")).otherwise(named)
    each = F.struct("s", F.col("line").alias("gold_line"), other.alias("pred_line"), codecs.parse(F.col("line")).alias("gold"), fewer.alias("predicted"))
    return lines.select(F.inline(F.array(each)))  # conditions on the triples don't move below a generator, where they would parse again


@query(f"WITH {_LINES} SELECT p AS p_sent, g AS g_sent, levenshtein(p, g)::INT AS dist FROM l WHERE k % 5 = 0")
def not_parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.not_parsed(_lines(spark, sf_dir))


@query("SELECT 'order/' || o_orderkey AS subj_gt, 'xorder/' || o_orderkey AS subj_pred FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0")
def wrong_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.wrong_subject(_lines(spark, sf_dir))


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE '' END || 'order/' || o_orderkey AS ent_uri, 'customer,orderDate,priority,type' AS p_pred, 'customer,orderDate,priority,status,type' AS g_pred FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0")
def not_valid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.not_valid(_lines(spark, sf_dir))


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE '' END || 'order/' || o_orderkey AS ent_uri, 'status' AS report FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0")
def not_valid_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    facts = scoring.triples_to_facts(rows.select(F.inline("predicted")), ORDER_SHAPE)
    return scoring.not_valid(rows, scoring.validate(facts, ORDER_SHAPE)).select("ent_uri", "report")


@query(f"""WITH {_LINES} SELECT round(count(*) FILTER (k % 5 <> 0) / count(*), 6) AS part_parsed, round(count(*) FILTER (k % 5 <> 0 AND k % 4 <> 0) / count(*) FILTER (k % 5 <> 0), 6) AS part_subj_ok, 1.0::DOUBLE AS part_type_ok,
    round(count(*) FILTER (k % 5 <> 0 AND k % 3 <> 0) / count(*) FILTER (k % 5 <> 0), 6) AS part_valid_rdf, round(count(*) FILTER (k % 5 <> 0 AND k % 2 = 0) / count(*) FILTER (k % 5 <> 0), 6) AS part_valid_s,
    round(avg(levenshtein(p, g)) FILTER (k % 5 = 0), 4) AS edit_distance FROM l""")
def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.parse_quality(_lines(spark, sf_dir).withColumn("valid", F.substring_index("s", "/", -1).cast("long") % 2 == 0))


@query(f"""WITH {_GP}, a AS (SELECT ex, list_distinct(list(p)) AS g FROM gold GROUP BY ex), b AS (SELECT ex, list_distinct(list(p)) AS q FROM pred GROUP BY ex),
    c AS (SELECT ex, len(list_intersect(g, q)) AS h, len(q) AS nq, len(g) AS ng FROM a JOIN b USING (ex))
    SELECT ex, round(100 * h / nq, 2) AS prop_p, round(100 * h / ng, 2) AS prop_r, round(CASE WHEN h = 0 THEN 0 ELSE 200 * h / (nq + ng) END, 2) AS prop_f1 FROM c""")
def three_graph_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda df, n: df.groupBy("ex").agg(F.collect_set("p").alias(n))
    both = own(_gold(spark, sf_dir), "g").join(own(_predicted(spark, sf_dir), "q"), "ex")
    p, r, f = scoring.set_scores(F.col("q"), F.col("g"))
    return both.select("ex", F.round(p, 2).alias("prop_p"), F.round(r, 2).alias("prop_r"), F.round(f, 2).alias("prop_f1"))


@query(f"""WITH {_GP}, a AS (SELECT ex, list_sort(list_distinct(list(p))) AS g FROM gold GROUP BY ex), b AS (SELECT ex, list_sort(list_distinct(list(p))) AS q FROM pred GROUP BY ex)
    SELECT CASE WHEN g = q THEN 'equal' WHEN len(list_intersect(g, q)) = len(g) AND len(g) < len(q) THEN 'extended' ELSE 'other' END AS kind, count(*) AS nb, count(DISTINCT g) AS n_gold_patterns FROM a JOIN b USING (ex) GROUP BY 1""")
def pattern_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda df, n: df.groupBy("ex").agg(F.collect_set("p").alias(n))
    return scoring.pattern_extension(own(_gold(spark, sf_dir), "g").join(own(_predicted(spark, sf_dir), "q"), "ex"))


@query(f"WITH {_ERRS} SELECT ex, coalesce(val_pred, val_gold) AS val, count(DISTINCT type) AS n_types FROM e GROUP BY ALL HAVING count(DISTINCT type) > 1")
def value_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.value_confusion(score_errors(spark, sf_dir).select("type", "ex", F.coalesce("val_pred", "val_gold").alias("val")))


@query("""WITH n AS (SELECT 'order/' || o_orderkey AS s, o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr FROM orders)
    SELECT s, 'status' AS p, st AS o FROM n WHERE k % 6 <> 0 UNION ALL SELECT s, 'priority', pr FROM n UNION ALL SELECT s, 'clerk', 'c' || k FROM n WHERE k % 5 = 0""")
def annotation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = star_quads(spark, sf_dir, ORDERS).where("p IN ('status', 'priority')").select("s", "p", "o")
    n = load(spark, sf_dir, "orders").select(F.concat(F.lit("order/"), "o_orderkey").alias("s"), F.col("o_orderkey").alias("k"), "o_orderstatus")
    add = n.where("k % 5 = 0").select("s", F.lit("clerk").alias("p"), F.lit("FP_new").alias("type"), F.lit("TRUE").alias("verif"), F.lit("TRUE").alias("found"), F.concat(F.lit("c"), "k").alias("val_pred"), F.lit(None).cast("string").alias("val_gold"))
    gone = n.where("k % 6 = 0").select("s", F.lit("status").alias("p"), F.lit("FN").alias("type"), F.lit("FALSE").alias("verif"), F.lit("FALSE").alias("found"), F.lit(None).cast("string").alias("val_pred"), F.col("o_orderstatus").alias("val_gold"))
    return scoring.merge_annotations(q, add.unionByName(gone))


@query("SELECT l_returnflag AS p, count(DISTINCT l_orderkey) AS nb, round(avg(l_discount), 6) AS tc_avg, min(l_discount) AS tc_min, max(l_discount) AS tc_max, round(avg(l_tax), 6) AS xnli_avg, min(l_tax) AS xnli_min, max(l_tax) AS xnli_max FROM lineitem GROUP BY 1")
def critic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s"), F.col("l_returnflag").alias("p"), F.col("l_discount").alias("tc"), F.col("l_tax").alias("xnli"))
    return scoring.critic_stats(scored, ["tc", "xnli"])


# Variants of the scorer


@query(f"""WITH {_CASES}, s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cases) SELECT round(fp / (tp + fp + fn), 6) AS fp_rate, round(fn / (tp + fp + fn), 6) AS fn_rate FROM s""")
def score_rates_of_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.overall(scoring.relation_cases(_gold(spark, sf_dir), _predicted(spark, sf_dir), RELATIONS), rates_with_tn=False).select("fp_rate", "fn_rate")


@query(f"""WITH {_ERRS} SELECT type, ex, pred, CASE WHEN type = 'FP_different' THEN (SELECT f FROM eq WHERE eq.ex = e.ex AND eq.p = e.pred) ELSE val_pred END AS val_pred, val_gold FROM e""")
def score_errors_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.to_inspect(_gold(spark, sf_dir), _predicted(spark, sf_dir), first_only=True)


@query("SELECT 'label' AS p, count(*) FILTER (c_custkey % 2 = 0) AS tp, count(*) FILTER (c_custkey % 2 <> 0) AS fp FROM customer")
def score_unstripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as they stand: a space at the end makes another value."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ex"), F.lit("label").alias("p"), F.col("c_name").alias("v"))
    spaced = c.withColumn("v", F.when(F.col("ex") % 2 == 0, F.col("v")).otherwise(F.concat("v", F.lit(" "))))
    return scoring.relation_cases(c, spaced, ["label"], strip=False).select("p", "tp", "fp")


@query(f"""WITH {_ERRS.replace("FROM lineitem),", "FROM lineitem WHERE l_returnflag <> 'N'),", 1)} SELECT type, count(*) AS nb FROM e WHERE pred IN ('AF', 'RF') GROUP BY type""")
def score_literals_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a shape's literal relations."""
    parts = "; sh:property ".join(f"[ sh:path e:{n} ; sh:{'datatype x:string' if n.endswith('F') else 'class e:C'} ]" for n in ("AF", "AO", "RF"))
    shape = Shape.read(f"@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix x: <http://www.w3.org/2001/XMLSchema#> . @prefix e: <http://e/> . e:S a sh:NodeShape ; sh:targetClass e:C ; sh:property {parts} .")
    errors = scoring.to_inspect(_gold(spark, sf_dir).where("p NOT LIKE 'N%'"), _predicted(spark, sf_dir))
    return errors.where(F.col("pred").isin(scoring.datatype_relations(shape))).groupBy("type").agg(F.count("*").alias("nb"))


_NAMED = "(SELECT c_custkey AS ex, 'city' AS p, c_mktsegment AS v FROM customer UNION ALL SELECT c_custkey, 'cityServed', c_name FROM customer UNION ALL SELECT c_custkey, 'dbo:label', c_name FROM customer)"


@query(f"SELECT r AS p, count(DISTINCT ex) FILTER (p = CASE r WHEN 'label' THEN 'dbo:label' ELSE r END AND r <> 'cityServed')::BIGINT AS tp, count(*) FILTER (p = r) AS nb_gt FROM {_NAMED}, (SELECT unnest(['city', 'cityServed', 'label']) AS r) GROUP BY r")
def score_names_within_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    fact = lambda p, v: F.struct(F.lit(p).alias("p"), F.col(v).alias("v"))
    facts = c.select(F.col("c_custkey").alias("ex"), F.inline(F.array(fact("city", "c_mktsegment"), fact("cityServed", "c_name"), fact("dbo:label", "c_name"))))
    return scoring.relation_cases(facts, facts, ["city", "cityServed", "label"]).select("p", "tp", "nb_gt")


_CHARS = "list_filter(string_split({}, ''), lambda c: trim(c) <> '')"
_BLEU = f"""c AS (SELECT p_partkey, p_brand, {_CHARS.format("p_name")} AS a, {_CHARS.format("p_name || ' x'")} AS b FROM part),
    g AS (SELECT p_partkey, p_brand, len(a) AS la, len(b) AS lb, n, list_transform(range(1, len(a) - n + 2), lambda i: array_to_string(a[i:i + n - 1], '')) AS m, list_transform(range(1, len(b) - n + 2), lambda i: array_to_string(b[i:i + n - 1], '')) AS t FROM c, (SELECT unnest([1, 2, 3, 4]) AS n)),
    x AS (SELECT p_partkey, unnest(m) AS w, n, 1 AS own, 0 AS other FROM g UNION ALL SELECT p_partkey, unnest(t), n, 0, 1 FROM g),
    h AS (SELECT p_partkey, n, sum(least(own, other)) AS h, sum(own) AS l FROM (SELECT p_partkey, n, w, sum(own) AS own, sum(other) AS other FROM x GROUP BY ALL) GROUP BY ALL),
    bleus AS (SELECT p_partkey, p_brand, CASE WHEN min(h) = 0 THEN 0 ELSE exp(least(0, 1 - any_value(lb) / any_value(la)) + sum(ln(h / l)) / 4) END AS bleu FROM h JOIN (SELECT DISTINCT p_partkey, p_brand, la, lb FROM g) USING (p_partkey) GROUP BY ALL)"""


@query(f"WITH {_BLEU} SELECT p_brand, round(avg(bleu), 4) AS bleu FROM bleus GROUP BY 1")
def bleu_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_brand", codecs.char_bleu(F.col("p_name"), F.array(F.concat("p_name", F.lit(" x")))).alias("bleu"))
    return p.groupBy("p_brand").agg(F.round(F.avg("bleu"), 4).alias("bleu"))


@query(f"WITH {_BLEU} SELECT 'label' AS p, (SELECT count(*) FROM part) AS fp, (SELECT round(avg(bleu), 4) FROM bleus) AS bleu")
def score_with_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda v: load(spark, sf_dir, "part").select(F.col("p_partkey").alias("ex"), F.lit("label").alias("p"), v.alias("v"))
    return scoring.relation_cases(side(F.concat("p_name", F.lit(" x"))), side(F.col("p_name")), ["label"], bleu_for=["label"]).select("p", "fp", "bleu")


# Three graphs, validation with classes


@query("SELECT 'customer/' || c_custkey AS s, 'nation' AS p, 'nation/' || c_nationkey AS o, c_custkey % 2 = 0 AS found FROM customer UNION ALL SELECT 'customer/' || c_custkey, 'label', c_name, c_custkey % 3 = 0 FROM customer")
def ground_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = star_quads(spark, sf_dir, ("customer",)).where("p IN ('nation', 'label')")
    c = load(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.lit("someone"))
    link = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("[there](:nation/"), "c_nationkey", F.lit(")"))).otherwise(F.lit("there"))
    texts = c.select(F.concat(F.lit("customer/"), "c_custkey").alias("s"), F.concat(name, F.lit(" lives there")).alias("text"), F.concat(name, F.lit(" lives "), link).alias("md"))
    kinds = spark.createDataFrame([("nation", "dbo:Nation"), ("label", "xsd:string")], "p string, range string")
    return grounding.wikicheck(q, texts, kinds)


@query("SELECT s_suppkey, p, CASE p WHEN 'seat' THEN s_suppkey % 2 = 0 WHEN 'note' THEN true ELSE s_suppkey % 3 = 0 END AS found FROM supplier, (SELECT unnest(['seat', 'note', 'founded']) AS p)")
def ground_plain_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").withColumn("s", F.concat(F.lit("s"), "s_suppkey"))
    fact = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"))
    facts = s.select("s", F.inline(F.array(fact("seat", F.lit(":New_Town")), fact("note", F.lit("FAMOUS")), fact("founded", F.lit("1994-08-29")))))
    text = F.concat(F.lit("A famous firm"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(" in new town")).otherwise(F.lit("")), F.when(F.col("s_suppkey") % 3 == 0, F.lit(" of 29 August 1994.")).otherwise(F.lit(".")))
    kinds = spark.createDataFrame([("seat", "dbo:Place"), ("founded", "xsd:date")], "p string, range string")
    found = grounding.in_plain_text(facts, s.select("s", text.alias("text")), kinds)
    return found.select(F.substring("s", 2, 99).cast("long").alias("s_suppkey"), "p", "found")


@query("""SELECT 'order/' || o_orderkey AS s, concat_ws(',', CASE WHEN o_custkey % 2 <> 0 THEN 'customer' END, CASE WHEN o_orderkey % 3 = 0 THEN 'status' END) AS violations, o_custkey % 2 = 0 AND o_orderkey % 3 <> 0 AS conforms FROM orders""")
def shacl_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted triples to facts, facts to a validation that looks at the classes of objects."""
    lines = ttl_light_serialize(spark, sf_dir).where("s IS NOT NULL")
    triples = lines.select(F.inline(codecs.parse(F.col("line")))).where(~((F.col("prop") == "status") & (F.substring_index("subj", "/", -1).cast("long") % 3 == 0)))
    types = load(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.concat(F.lit("customer/"), "o_custkey").alias("s"), F.lit("Customer").alias("cls"))
    return scoring.validate(scoring.triples_to_facts(triples, ORDER_SHAPE), ORDER_SHAPE, "types", types)


@query(f"""WITH {_CHECKED}, i AS (SELECT s, p, lower(replace(CASE WHEN k = 'iri' THEN o ELSE o END, '_', ' ')) AS v FROM quads WHERE p <> 'rdf:type'), c AS (SELECT s, p, lower(replace(o, '_', ' ')) AS v FROM checked WHERE found),
    x AS (SELECT s, p, v FROM i WHERE p <> 'priority' AND (p <> 'status' OR split_part(s, '/', 2)::BIGINT % 2 = 0)), n AS (SELECT s, count(*) AS ni FROM i GROUP BY s), m AS (SELECT s, count(*) AS nc FROM c GROUP BY s), l AS (SELECT s, count(*) AS nx FROM x GROUP BY s),
    h AS (SELECT x.s, count(*) AS hc FROM x JOIN c ON c.s = x.s AND c.p = x.p AND c.v = x.v GROUP BY x.s)
    SELECT s AS ex, 100.0::DOUBLE AS init_prop_p, round(100 * nx / ni, 2) AS init_prop_r, round(200 * nx / (ni + nx), 2) AS init_prop_f1, round(100 * coalesce(hc, 0) / nx, 2) AS correct_value_p, round(coalesce(100 * hc / nc, 0), 2) AS correct_value_r,
        round(100 * coalesce(nc, 0) / ni, 2) AS expressiveness, round(100 * nx / 4, 2) AS coverage FROM n JOIN l USING (s) LEFT JOIN m USING (s) LEFT JOIN h USING (s)""")
def three_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knowledge base's graph, what the text says of it, and an extraction, compared for each entity."""
    kinds = spark.createDataFrame([("orderDate", "xsd:date"), ("status", "xsd:string"), ("priority", "xsd:string")], "p string, range string")
    initial = scoring.initial_graph(star_quads(spark, sf_dir, ORDERS), ORDER_SHAPE)
    correct = scoring.correct_graph(initial, _order_texts(spark, sf_dir).withColumnRenamed("s", "ex"), kinds)
    extracted = initial.where("p <> 'priority'").where((F.col("p") != "status") | (F.substring_index("ex", "/", -1).cast("long") % 2 == 0))
    found = scoring.compare_graphs(initial, correct, extracted, [p.name for p in ORDER_SHAPE.properties])
    return found.select("ex", "init_prop_p", "init_prop_r", "init_prop_f1", "correct_value_p", "correct_value_r", "expressiveness", "coverage")


@query("""WITH e AS (SELECT l_returnflag AS cls, l_orderkey AS ex, avg(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY ALL), c AS (SELECT cls, count(*) AS n_entities, avg(quantity) AS quantity, avg(discount) AS discount FROM e GROUP BY cls)
    SELECT cls, n_entities, round(quantity, 2) AS quantity, round(discount, 2) AS discount FROM c UNION ALL SELECT NULL, sum(n_entities)::BIGINT, round(avg(quantity), 2), round(avg(discount), 2) FROM c""")
def means_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cls"), F.col("l_orderkey").alias("ex"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return reports.means(rows, ["quantity", "discount"])


@query("SELECT o_orderstatus AS type, count(*) AS nb, round(avg(o_orderkey % 11 / 10), 6) AS score FROM orders GROUP BY 1")
def claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("type"), (F.col("o_orderkey") % 11 / 10).alias("score"))
    return reports.claim_scores(o)


# Samples and their statistics


@query(f"WITH t AS (SELECT 'order/' || o_orderkey AS s, o_orderpriority AS o, {_NOTE} AS note FROM orders ORDER BY md5('42:order/' || o_orderkey) LIMIT 300) SELECT s, CASE WHEN contains(note, o) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM t")
def sample_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample whose facts a caller's scorer has judged against their texts."""
    q = star_quads(spark, sf_dir, ORDERS).where("p = 'priority'").select("s", "p", "o")
    drawn = sampling.sample(q.select("s"), 300).select("s")
    whole = lambda s, p, o, t: F.contains(t, o).cast("double")
    return plugins.score(q.join(drawn, "s", "left_semi"), _order_texts(spark, sf_dir), whole).select("s", "score")


@query(f"WITH {_SIGS} SELECT signature, count(*) AS nb, any_value(n_props)::INT AS n_props, round(count(*) / (SELECT count(*) FROM sigs WHERE split_part(s, '/', 2)::BIGINT % 3 = 0), 6) AS freq FROM sigs WHERE split_part(s, '/', 2)::BIGINT % 3 = 0 GROUP BY signature")
def sampled_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = _orders(spark, sf_dir).where(F.substring_index("s", "/", -1).cast("long") % 3 == 0)
    return signatures.sampled_patterns(signatures.entity_signatures(_flags(spark, sf_dir), _orders(spark, sf_dir)), sample)


@query(f"""WITH {_SIGS}, t AS (SELECT 'property' AS kind, p AS name, count(DISTINCT s) - 1 AS nb FROM facts GROUP BY p UNION ALL SELECT 'pattern', signature, count(*) - 1 FROM sigs WHERE n_props > 0 GROUP BY signature)
    SELECT kind, name, nb, row_number() OVER (PARTITION BY kind ORDER BY nb, name)::INT AS place FROM t""")
def stratum_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.tallies(_flags(spark, sf_dir), first_is_zero=True)


@query(f"WITH {_FLAGS} SELECT s, count(DISTINCT p) AS n_props FROM facts GROUP BY s")
def property_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.property_numbers(_flags(spark, sf_dir))


@query(f"WITH {_FLAGS} SELECT DISTINCT s FROM facts WHERE p = 'NF' OR split_part(s, '/', 2)::BIGINT % 100 = 0")
def with_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flags(spark, sf_dir)
    return sampling.with_property(f, "NF", f.where(F.substring_index("s", "/", -1).cast("long") % 100 == 0).select("s"))


@query("SELECT doc_id AS s, source AS p FROM documents WHERE length(text) > 40 AND source IS NOT NULL")
def usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("s"), F.col("source").alias("p"), "text")
    names = [r.p for r in d.select("p").distinct().collect() if r.p is not None]  # the shape's properties
    return sampling.usable(d, names, 40).select("s", "p")


@query(f"WITH {_STRATA}, placed AS (SELECT s, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || s), s) - 1 + ('0x' || substr(md5('42:' || stratum), 1, 6))::BIGINT AS n FROM strata) SELECT s, stratum, (n % 5)::INT AS fold FROM placed")
def strat_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_kfold(sampling.strata(_flags(spark, sf_dir)), "stratum", 5)


# More forms of text and lines


@query("""SELECT n AS o_orderkey, CASE WHEN n % 3 = 0 THEN 4 ELSE 5 END::INT AS n, n % 3 <> 0 AS same FROM (SELECT o_orderkey AS n FROM orders)""")
def statement_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement lines read back; without the object of a statement its value is NULL."""
    q = star_quads(spark, sf_dir, ORDERS)
    lines = codecs.statements(q).join(codecs.serialize(q).withColumnRenamed("line", "light"), "s").withColumn("n", F.substring_index("s", "/", -1).cast("long"))
    cut = F.when(F.col("n") % 3 == 0, F.regexp_replace("line", ':status "[^"]*"', ":status")).otherwise(F.col("line"))
    t = lines.withColumn("t", codecs.parse_statements(cut)).withColumn("want", codecs.parse(F.col("light")))
    known = F.filter("t", lambda x: x["val"] != "NULL")
    return t.select(F.col("n").alias("o_orderkey"), F.size(known).alias("n"), (F.to_json(F.array_sort("t")) == F.to_json(F.array_sort("want"))).alias("same"))


@query("SELECT p_partkey, p_partkey % 4 <> 3 AS accepted FROM part")
def grammar_after_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.concat(F.lit(":p"), "p_partkey", F.lit(' a :Part; :brand "'), "p_brand", F.lit('" .'))
    coded = F.replace(plain, F.lit(";"), F.lit("%3B"))
    line = F.when(F.col("p_partkey") % 4 == 0, plain).when(F.col("p_partkey") % 4 == 1, coded).when(F.col("p_partkey") % 4 == 2, F.replace(coded, F.lit("%"), F.lit("%25"))).otherwise(F.replace(F.replace(coded, F.lit("%"), F.lit("%25")), F.lit("%"), F.lit("%25")))
    return load(spark, sf_dir, "part").select("p_partkey", codecs.accepted_after_decoding(F.concat(line, F.lit("é"))).alias("accepted"))


@query("SELECT 's' || s_suppkey AS subj, 'org' AS subj_type, 'seat' AS prop, 'n' || s_nationkey AS val, 'loc' AS val_type FROM supplier UNION ALL SELECT 's' || s_suppkey, 'org', 'head', 'p', 'per' FROM supplier")
def typed_triplet_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("<triplet> s"), "s_suppkey", F.lit(" <org> "))
    text = F.concat(F.lit("<s>"), head, F.lit("n"), "s_nationkey", F.lit(" <loc> seat "), head, F.lit("p <per> head"))
    return load(spark, sf_dir, "supplier").select(F.inline(codecs.from_typed_tokens(text)))


@query("""SELECT c_custkey, 'c_' || replace(c_name, ' ', '_') AS name, 'a b' AS plain, 'Graph: ' || c_name || ' : ' || c_mktsegment AS prompt, 'caf ' || c_custkey AS ascii,
    'A [place](:New%20Town) here' AS md FROM customer""")
def text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    html = F.lit('<section><p>A <a href="./New Town">place</a><sup class="noprint reference">[1]</sup> <a class="new" href="./X?redlink=1">here</a></p></section>')
    return c.select("c_custkey", text.strip_entity_name(F.concat(F.lit("<http://dbpedia.org/resource/c_"), "c_name", F.lit('">'))).alias("name"), text.strip_prefixes(F.lit("dbo:a dbr:b")).alias("plain"), text.prompt(F.col("c_name"), F.col("c_mktsegment"), "Graph").alias("prompt"), text.ascii_only(F.concat(F.lit("café "), "c_custkey")).alias("ascii"), text.html_lead(html, encode=True).alias("md"))


# Readers and writers: files written from the tables and read again


@query("SELECT 'parts' AS g, 'http://x/p' || p_partkey AS s, 'http://x/brand' AS p, p_brand AS o, 'literal' AS k, NULL AS dt, 'en' AS lang FROM part UNION ALL SELECT 'parts', 'http://x/p' || p_partkey, 'http://x/size', p_size::VARCHAR, 'literal', 'http://x/int', NULL FROM part UNION ALL SELECT 'parts', 'http://x/p' || p_partkey, 'http://x/kind', 'http://x/Part', 'iri', NULL, NULL FROM part")
def ntriples_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.concat(F.lit("<http://x/p"), "p_partkey", F.lit("> "))
    lines = F.array(F.concat(subject, F.lit('<http://x/brand> "'), "p_brand", F.lit('"@en .')), F.concat(subject, F.lit('<http://x/size> "'), "p_size", F.lit('"^^<http://x/int> .')), F.concat(subject, F.lit("<http://x/kind> <http://x/Part> .")), F.lit("# no triple"))
    load(spark, sf_dir, "part").select(F.explode(lines).alias("value")).write.text(path := folder(spark))
    return store.read_ntriples(spark, path, "parts")


@query("""SELECT 'b' || l_orderkey AS s, 'http://x/é' || l_linenumber AS p, CASE WHEN l_linenumber % 2 = 0 THEN 'b' || l_partkey ELSE 'say "' || l_returnflag || '"' || chr(10) || chr(92) || 'é😀' END AS o,
    CASE WHEN l_linenumber % 2 = 0 THEN 'bnode' ELSE 'literal' END AS k, CASE WHEN l_linenumber % 2 = 1 THEN 'http://x/t' END AS dt, 1::BIGINT AS files FROM lineitem""")
def ntriples_blank_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank nodes and escapes. A node's lines are written to one file, which its name tells; files: the most that one has."""
    literal = F.concat(F.lit('"say \\"'), "l_returnflag", F.lit('\\"\\n\\\\\\u00e9\\U0001F600"^^<http://x/t>'))
    line = F.concat(F.lit("_:b"), "l_orderkey", F.lit(" <http://x/\\u00E9"), "l_linenumber", F.lit("> "), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("_:b"), "l_partkey")).otherwise(literal), F.lit(" . # seen"))
    load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").repartition("l_orderkey").select(line.alias("value")).write.text(path := folder(spark))
    bare = lambda c: F.when(F.col(c).startswith("_:"), F.substring_index(c, ".", -1)).otherwise(F.col(c))
    t = store.read_ntriples(spark, path, "items")
    files = t.select("s").distinct().groupBy(bare("s").alias("b")).agg(F.count("*").alias("n")).agg(F.max("n").alias("files"))
    return t.select(bare("s").alias("s"), "p", F.when(F.col("k") == "bnode", bare("o")).otherwise(F.col("o")).alias("o"), "k", "dt").join(F.broadcast(files), F.lit(True))


@query(f"WITH {_QP} SELECT g || '?a=b/c:' AS g, count(*) AS nb FROM quads WHERE g NOT IN ('region', 'nation') GROUP BY g")
def store_graph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs named by IRIs with signs that folders escape, each in several files; two are dropped."""
    q, path = star_quads(spark, sf_dir, PEOPLE).withColumn("g", F.concat("g", F.lit("?a=b/c:"))), folder(spark)
    store.write_store(q, path, file_rows=100)
    for g in ("region", "nation"):
        store.drop_graph(spark, path, f"{g}?a=b/c:")
    return store.read_store(spark, path).groupBy("g").agg(F.count("*").alias("nb"))


@query("""SELECT 'p' || p_partkey AS s, 'type' AS p, 'Part' AS o FROM part UNION ALL SELECT 'p' || p_partkey, 'label', p_name || ' "x"' FROM part UNION ALL SELECT 'p' || p_partkey, 'size', p_size::VARCHAR FROM part
    UNION ALL SELECT 'p' || p_partkey, 'like', 'p' || (p_partkey + n) FROM part, (VALUES (1), (2)) t(n)""")
def turtle_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Turtle document for each part: prefixes, lists of properties and values, a literal with quotes and one with a datatype."""
    k = F.col("p_partkey")
    doc = F.concat(F.lit("@prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n:p"), k, F.lit(' a :Part ; :label "'), "p_name", F.lit(' \\"x\\"" ;\n  :size "'), "p_size", F.lit('"^^xsd:int ; :like :p'), k + 1, F.lit(", :p"), k + 2, F.lit(" . # end"))
    found = load(spark, sf_dir, "part").select(F.inline(triples_in(doc)))
    bare = lambda c: F.regexp_extract(c, "([^/#]*)$", 1)
    return found.select(bare("s").alias("s"), bare("p").alias("p"), F.when(F.col("p").endswith("label"), F.col("o")).otherwise(bare("o")).alias("o"))


@query("SELECT ':c' || c_custkey || ' a :Customer .' AS triples, c_name AS abstract, 'c' || c_custkey AS ent, c_mktsegment AS pattern, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 0 END AS class FROM customer")
def dataset_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays of rows, under the newer and the older name of the entity, some without a class."""
    c = load(spark, sf_dir, "customer")
    name = F.concat(F.lit("c"), "c_custkey")
    row = F.struct(F.concat(F.lit(":c"), "c_custkey", F.lit(" a :Customer .")).alias("triples"), F.col("c_name").alias("abstract"), F.when(F.col("c_custkey") % 3 == 0, name).alias("ent"), F.when(F.col("c_custkey") % 3 != 0, name).alias("entity"), F.col("c_mktsegment").alias("pattern"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("class"))
    files = c.groupBy("c_nationkey").agg(F.to_json(F.collect_list(row)).alias("value")).select("value")
    files.write.option("maxRecordsPerFile", 1).text(path := folder(spark))
    return store.read_dataset(spark, path)


@query("SELECT 's' || s_suppkey AS ent_uri, 'label' AS pred, 'FP_new' AS type, CASE WHEN s_suppkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS verif, s_name AS val_pred FROM supplier")
def annotations_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    rows = s.select(F.concat(F.lit("s"), "s_suppkey").alias("ent_uri"), F.lit("label").alias("pred"), F.lit("FP_new").alias("type"), F.when(F.col("s_suppkey") % 2 == 0, "TRUE").otherwise("FALSE").alias("verif"), F.lit("TRUE").alias("found"), F.col("s_name").alias("val_pred"), F.lit("x").alias("val_gold"))
    reports.write_csv(rows, path := folder(spark))
    return store.read_annotations(spark, path).select("ent_uri", "pred", "type", "verif", "val_pred")


@query("SELECT DISTINCT 'Brand' AS name, p_brand AS brand, p_size::VARCHAR AS size FROM part")
def artifact_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table artifacts (columns and a matrix of data), one a fold; rows that folds share count once."""
    rows = load(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 8).alias("fold")).agg(F.collect_list(F.array("p_brand", F.col("p_size").cast("string"))).alias("data"))
    rows.select(F.to_json(F.struct(F.array(F.lit("brand"), F.lit("size")).alias("columns"), "data")).alias("value")).write.option("maxRecordsPerFile", 1).text(path := folder(spark))
    return store.read_artifact(spark, path).select(F.lit("Brand").alias("name"), F.col("row")["brand"].alias("brand"), F.col("row")["size"].alias("size"))


@query(f"WITH {_QP} SELECT g, count(*) AS nb FROM quads WHERE g <> 'region' GROUP BY g")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk load, guarded insert of what is there in part, and removal of a graph."""
    q, path = star_quads(spark, sf_dir, PEOPLE), folder(spark)
    store.write_store(q.where("g <> 'supplier'"), path)
    store.insert_missing(q, path)
    store.drop_graph(spark, path, "region")
    return store.read_store(spark, path).groupBy("g").agg(F.count("*").alias("nb"))


@query(f"SELECT split, count(*) AS nb, min(s) AS first FROM (SELECT s, CASE WHEN n < 1000 THEN 'train' ELSE 'test' END AS split FROM {_RANK} WHERE n < 1200) GROUP BY split")
def splits_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.write_splits(slice_splits(spark, sf_dir), path := folder(spark))
    return spark.read.schema("s string, split string").json(path).groupBy("split").agg(F.count("*").alias("nb"), F.min("s").alias("first"))


@query(f"{ORACLE['class_weights']}")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as CSV and as JSON, read again and put together."""
    report, csv, json = class_weights(spark, sf_dir), folder(spark), folder(spark)
    reports.write_csv(report.select("o_orderpriority", "nb"), csv)
    reports.write_json(report.select("o_orderpriority", "weight"), json)
    return spark.read.schema("o_orderpriority string, nb long").csv(csv, header=True).join(spark.read.schema("o_orderpriority string, weight double").json(json), "o_orderpriority")


@query("SELECT 'order/' || o_orderkey AS s, lower(o_orderpriority) AS o FROM orders")
def incremental_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do, done in two steps and a third that finds nothing."""
    source = load(spark, sf_dir, "orders").select(F.concat(F.lit("order/"), "o_orderkey").alias("s"), "o_orderpriority")
    work = lambda todo: todo.select("s", F.lower("o_orderpriority").alias("o"))
    path = folder(spark)
    incremental.step(source.where(F.substring_index("s", "/", -1).cast("long") % 2 == 0), path, work, ["s"])
    for _ in range(2):
        incremental.step(source, path, work, ["s"])
    return spark.read.schema("s string, o string").parquet(path)


@query("SELECT count(*)::INT AS nb FROM customer")
def sparql_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = sparql.scalar("SELECT (COUNT(DISTINCT ?s) AS ?n) WHERE { ?s a <Customer> }", star_quads(spark, sf_dir, ("customer",)))
    return spark.createDataFrame([(n,)], "nb int")


# Ontology: nations under regions under the world


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").select(F.col("n_name").alias("c"), F.concat(F.lit("region"), "n_regionkey").alias("p"))
    r = load(spark, sf_dir, "region").select(F.concat(F.lit("region"), "r_regionkey").alias("c"), F.lit("world").alias("p"))
    return n.unionByName(r)


_UP = """tree AS (SELECT n_name AS c, 'region' || n_regionkey AS p FROM nation UNION ALL SELECT 'region' || r_regionkey, 'world' FROM region),
    up(c, a, d) AS (SELECT x, x, 0 FROM (SELECT c AS x FROM tree UNION SELECT p FROM tree) UNION SELECT up.c, t.p, up.d + 1 FROM up JOIN tree t ON t.c = up.a)"""
_LCA = _UP + """, pairs AS (SELECT a.n_name AS c1, b.n_name AS c2 FROM nation a JOIN nation b ON b.n_nationkey BETWEEN a.n_nationkey AND a.n_nationkey + 3),
    l AS (SELECT c1, c2, arg_min(x.a, (x.d + y.d, x.a)) AS lca, arg_min(x.d, (x.d + y.d, x.a)) AS d1, arg_min(y.d, (x.d + y.d, x.a)) AS d2 FROM pairs JOIN up x ON x.c = c1 JOIN up y ON y.c = c2 AND y.a = x.a GROUP BY c1, c2)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    a = n.select(F.explode(F.sequence(F.col("n_nationkey"), F.col("n_nationkey") + 3)).alias("n_nationkey"), F.col("n_name").alias("c1"))
    return a.join(n, "n_nationkey").select("c1", F.col("n_name").alias("c2"))


@query(f"WITH RECURSIVE {_UP} SELECT c, a, min(d)::INT AS d FROM up GROUP BY c, a")
def class_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_tree(spark, sf_dir))


@query(f"WITH RECURSIVE {_LCA} SELECT c1, c2, lca, d1::INT AS d1, d2::INT AS d2 FROM l")
def lowest_common_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.common_ancestors(_pairs(spark, sf_dir), graph.direct(_tree(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_LCA}, z AS (SELECT l.*, u.d AS d0 FROM l JOIN up u ON u.c = lca AND u.a = 'world')
    SELECT c1, c2, lca, round(CASE WHEN c1 = c2 THEN 1 WHEN d0 = 0 THEN 0 ELSE 2.0::DOUBLE * d0 / (d1 + d2 + 2 * d0) END, 6) AS wu_palmer,
    round(CASE WHEN c1 = c2 THEN 1 WHEN d0 = 0 THEN 0 ELSE (1 - pow(0.5, d0)) / (1 - pow(0.5, d1) + 1 - pow(0.5, d2) + 1 - pow(0.5, d0)) END, 6) AS depth_sim FROM z""")
def class_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = graph.direct(_tree(spark, sf_dir))
    return graph.similarities(graph.common_ancestors(_pairs(spark, sf_dir), up), up, "world")


def _two_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class graph in which a part k has the parents k div 2 and k div 3: diamonds everywhere, and pairs with several lowest common ancestors."""
    k = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).where("k > 0")
    return k.select(F.concat(F.lit("part/"), "k").alias("c"), F.explode(F.array(F.expr("k div 2"), F.expr("k div 3"))).alias("up")).select("c", F.concat(F.lit("part/"), "up").alias("p"))


def _part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with the parts that are 1, 4 and 30 further, and with the one at half its number."""
    k = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    other = F.explode(F.array(F.col("k") + 1, F.col("k") + 4, F.col("k") + 30, F.expr("k div 2"))).alias("o")
    return k.select("k", other).select(F.concat(F.lit("part/"), "k").alias("c1"), F.concat(F.lit("part/"), "o").alias("c2"))


_DAG = """e AS (SELECT DISTINCT 'part/' || p_partkey AS c, 'part/' || unnest([p_partkey // 2, p_partkey // 3]) AS p FROM part WHERE p_partkey > 0),
    up AS (SELECT c, c AS a FROM e UNION SELECT p, p FROM e UNION SELECT up.c, e.p FROM up JOIN e ON up.a = e.c),
    pairs AS (SELECT DISTINCT 'part/' || p_partkey AS c1, 'part/' || unnest([p_partkey + 1, p_partkey + 4, p_partkey + 30, p_partkey // 2]) AS c2 FROM part),
    shared AS (SELECT c1, c2, x.a FROM pairs JOIN up x ON x.c = c1 JOIN up y ON y.c = c2 AND y.a = x.a),
    lowest AS (SELECT c1, c2, a AS lca FROM shared s WHERE NOT EXISTS (SELECT 1 FROM shared t JOIN e ON e.c = t.a WHERE t.c1 = s.c1 AND t.c2 = s.c2 AND e.p = s.a)),
    one AS (SELECT c1, c2, min(lca) AS lca FROM pairs LEFT JOIN lowest USING (c1, c2) GROUP BY c1, c2),
    dist AS (SELECT x.c AS b, y.a AS t, count(DISTINCT x.a) - 1 AS n FROM up x JOIN up y ON y.c = x.a GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_DAG} SELECT c1, c2, coalesce(n, CASE WHEN c1 = c2 THEN 0 ELSE -1 END)::INT AS n FROM pairs LEFT JOIN dist ON b = c1 AND t = c2")
def path_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distances(_part_pairs(spark, sf_dir), graph.direct(_two_parents(spark, sf_dir)))


@query(f"WITH RECURSIVE {_DAG} SELECT c1, c2, lca FROM lowest")
def lowest_common_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lowest_common(_part_pairs(spark, sf_dir), graph.direct(_two_parents(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_DAG}, z AS (SELECT one.*, p.n AS d1, q.n AS d2, r.n AS d0 FROM one LEFT JOIN dist p ON p.b = c1 AND p.t = lca LEFT JOIN dist q ON q.b = c2 AND q.t = lca LEFT JOIN dist r ON r.b = lca AND r.t = 'part/0')
    SELECT c1, c2, lca, round(CASE WHEN c1 = c2 THEN 1 WHEN lca IS NULL THEN NULL WHEN d0 = 0 THEN 0 ELSE 2.0::DOUBLE * d0 / (d1 + d2 + 2 * d0) END, 6) AS wu_palmer,
    round(CASE WHEN c1 = c2 THEN 1 WHEN lca IS NULL OR d0 = 0 THEN 0 ELSE (1 - pow(0.5, d0)) / (1 - pow(0.5, d1) + 1 - pow(0.5, d2) + 1 - pow(0.5, d0)) END, 6) AS depth_sim FROM z""")
def similarity_several_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = graph.direct(_two_parents(spark, sf_dir))
    return graph.similarities(graph.common_ancestors(_part_pairs(spark, sf_dir), up), up, "part/0")


@query("SELECT n_name AS c, CASE WHEN n_nationkey % 2 = 0 THEN n_name WHEN n_nationkey % 3 = 0 THEN 'eq' || n_nationkey END AS cls FROM nation")
def equivalent_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").withColumnRenamed("n_name", "c")
    return graph.or_equivalent(n.select("c"), n.where("n_nationkey % 2 = 0").select("c"), n.where("n_nationkey % 3 = 0").select("c", F.concat(F.lit("eq"), "n_nationkey").alias("e")))


@query("""WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL), v AS (SELECT doc_id, text, list_filter(list_distinct([w[2], w[2] || ' ' || w[3], w[4], right(w[2], 3), 'a']), lambda x: coalesce(x, '') <> '') AS v FROM w),
    p AS (SELECT doc_id, text, array_to_string(list_transform(list_reverse_sort(list_transform(v, lambda x: {'n': length(x), 'x': x})), lambda x: regexp_escape(x.x)), '|') AS pattern FROM v)
    SELECT doc_id, regexp_replace(text, pattern, '$\\0$', 'g') AS tagged, regexp_replace(text, pattern, '$MASK$', 'g') AS masked FROM p""".replace("\\\\", "\\"))
def tag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with values that hold one another and the letter a, each tagged by itself and masked."""
    d = load(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("w", F.split("text", " "))
    word = lambda i: F.get("w", F.lit(i))
    found = F.array(word(1), F.concat(word(1), F.lit(" "), word(2)), word(3), F.substring(word(1), -3, 3), F.lit("a"))
    values = F.transform(F.array_distinct(found), lambda x: F.struct(x.alias("val"), x.alias("prop")))
    return d.select("doc_id", grounding.tag(F.col("text"), values).alias("tagged"), grounding.tag(F.col("text"), values, "$MASK$").alias("masked"))


@query("SELECT 'sample_' || (max(p_size) + 1) AS g FROM part")
def free_sample_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first free name beside those of the samples that parts are in, and of graphs with other names."""
    k = F.col("p_size")
    graphs = load(spark, sf_dir, "part").select(F.explode(F.array(F.concat(F.lit("sample_"), k), F.concat(F.lit("other_"), k + 100), F.concat(F.lit("sample_"), k + 200, F.lit("x")))).alias("g"))
    return sampling.free_name(graphs)


@query("""SELECT floor(n * 7 / 500)::INT AS fold, count(*) AS nb, min(s) AS first FROM (SELECT s, row_number() OVER (ORDER BY md5('42:' || s), s) - 1 AS n FROM (SELECT 'order/' || o_orderkey AS s FROM orders)) WHERE n < 500 GROUP BY 1""")
def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run as its settings say: a sample of limit orders, in folds."""
    run = Run.from_json('{"dataset": "DS_turtleS_0datatype_1inLine_1facto", "folds": "7", "limit": 500}')
    chosen = sampling.sample(_orders(spark, sf_dir), run.limit, seed=run.seed).select("s")
    return sampling.kfold(chosen, run.folds, seed=run.seed).groupBy("fold").agg(F.count("*").alias("nb"), F.min("s").alias("first"))


# Inference and reports

#: Classes and properties of the orders below: priorities are kinds of orders, buyers and payers are customers.
ONTOLOGY = [("Urgent", "rdfs:subClassOf", "Prioritised"), ("Prioritised", "rdfs:subClassOf", "Order"), ("Order", "rdfs:subClassOf", "Record"), ("Customer", "rdfs:subClassOf", "Party"),
    ("buyer", "rdfs:subPropertyOf", "customer"), ("payer", "rdfs:subPropertyOf", "buyer"), ("customer", "rdfs:domain", "Order"), ("customer", "rdfs:range", "Customer"), ("status", "rdfs:domain", "Record")]
INFERRED_SHAPE = Shape.read("""
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix ex: <http://example.org/> .
ex:OrderShape a sh:NodeShape ; sh:targetClass ex:Order ;
  sh:property [ sh:path ex:status ; sh:datatype xsd:string ; sh:minCount 1 ; sh:maxCount 1 ] , [ sh:path ex:customer ; sh:class ex:Customer ; sh:minCount 1 ; sh:maxCount 1 ] , [ sh:path ex:orderDate ; sh:datatype xsd:date ; sh:minCount 1 ] ;
  sh:or ( [ sh:property [ sh:path ex:priority ; sh:datatype xsd:string ; sh:minCount 1 ] ] [ sh:property [ sh:path ex:comment ; sh:datatype xsd:string ; sh:minCount 1 ] ] ) .
""")


def _untyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with defects by their number: a seventh are urgent, others have no type; one customer property of three; missing or second status, dates that are none, no priority."""
    k = F.col("o_orderkey")
    who = F.when(k % 3 == 0, "buyer").when(k % 3 == 1, "payer").otherwise("customer")
    fact = lambda p, o, kind, when: F.when(when, F.struct(p.alias("p"), o.alias("o"), F.lit(kind).alias("k")))
    each = F.array(
        fact(F.lit("rdf:type"), F.lit("Urgent"), "iri", k % 7 == 0), fact(who, F.concat(F.lit("customer/"), "o_custkey"), "iri", k % 11 != 0), fact(F.lit("buyer"), F.lit("nobody"), "literal", k % 13 == 0),
        fact(F.lit("status"), F.col("o_orderstatus"), "literal", k % 5 != 0), fact(F.lit("status"), F.lit("again"), "literal", k % 17 == 0),
        fact(F.lit("orderDate"), F.when(k % 19 == 0, "soon").otherwise(F.to_date("o_orderdate").cast("string")), "literal", F.lit(True)), fact(F.lit("priority"), F.col("o_orderpriority"), "literal", k % 23 != 0),
    )
    return load(spark, sf_dir, "orders").select(F.concat(F.lit("order/"), k).alias("s"), F.inline(F.array_compact(each)))


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.rdfs(_untyped(spark, sf_dir), spark.createDataFrame([(*t, "iri") for t in ONTOLOGY], "s string, p string, o string, k string"))


_UNTYPED = """u AS (SELECT o_orderkey AS k, 'order/' || o_orderkey AS s, o_orderkey % 3 AS w, o_orderkey % 7 = 0 AS urgent, o_orderkey % 11 <> 0 AS linked, o_orderkey % 13 = 0 AS nobody,
    o_orderkey % 5 <> 0 AS stated, o_orderkey % 17 = 0 AS again, 'customer/' || o_custkey AS c, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS priority FROM orders)"""


@query(f"""WITH {_UNTYPED}, t AS (SELECT s, unnest(['Urgent', 'Prioritised', 'Order', 'Record']) AS cls FROM u WHERE urgent UNION SELECT s, unnest(['Order', 'Record']) FROM u WHERE linked OR nobody
    UNION SELECT s, 'Record' FROM u WHERE stated OR again UNION SELECT c, unnest(['Customer', 'Party']) FROM u WHERE linked) SELECT s, cls FROM t""")
def rdfs_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.types(_inferred(spark, sf_dir)).where("s LIKE '%/%'")


@query(f"""WITH {_UNTYPED}, f AS (SELECT s, p, o, 'iri' AS k FROM (SELECT s, unnest(CASE w WHEN 0 THEN ['buyer', 'customer'] WHEN 1 THEN ['payer', 'buyer', 'customer'] ELSE ['customer'] END) AS p, c AS o FROM u WHERE linked)
    UNION SELECT s, unnest(['buyer', 'customer']), 'nobody', 'literal' FROM u WHERE nobody)
    SELECT s, p, o, k FROM f""")
def rdfs_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inferred(spark, sf_dir).where(F.col("p").isin("buyer", "payer", "customer") & F.col("s").startswith("order/"))


@query(f"""WITH {_UNTYPED}, f AS (SELECT * FROM u WHERE urgent OR linked OR nobody)
    SELECT s AS focus, 'status' AS path, NULL AS value, 'minCount' AS constraint FROM f WHERE NOT stated AND NOT again
    UNION ALL SELECT s, 'status', NULL, 'maxCount' FROM f WHERE stated AND again
    UNION ALL SELECT s, 'customer', NULL, 'minCount' FROM f WHERE NOT linked AND NOT nobody
    UNION ALL SELECT s, 'customer', NULL, 'maxCount' FROM f WHERE linked AND nobody
    UNION ALL SELECT s, 'customer', 'nobody', 'class' FROM f WHERE nobody
    UNION ALL SELECT s, 'orderDate', 'soon', 'datatype' FROM f WHERE k % 19 = 0
    UNION ALL SELECT s, 'or1', NULL, 'or' FROM f WHERE k % 23 = 0""")
def shacl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _inferred(spark, sf_dir)
    return scoring.report(facts, INFERRED_SHAPE, inference.types(facts))


# Augmentation


@query(f"WITH {_SIGS}, c AS (SELECT signature, s AS a, lead(s) OVER (PARTITION BY signature ORDER BY md5('42:' || s), s) AS b FROM sigs WHERE n_props > 0) SELECT signature, a AS template, b AS filler FROM c WHERE b IS NOT NULL UNION ALL SELECT signature, b, a FROM c WHERE b IS NOT NULL")
def kr_same_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigs = signatures.entity_signatures(_flags(spark, sf_dir)).select("s", F.array_join("sig", ",").alias("signature"))
    return sampling.same_level(sigs)


@query(f"WITH {_FLAGS}, g AS (SELECT s, list_sort(list_distinct(list(p))) AS sig FROM facts GROUP BY s), f AS (SELECT sig, arg_min(s, md5('42:' || s) || s) AS e FROM g GROUP BY sig) SELECT a.e AS template, b.e AS filler FROM f a JOIN f b ON len(list_intersect(a.sig, b.sig)) = len(a.sig) AND len(a.sig) < len(b.sig)")
def kr_low_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.low_level(signatures.entity_signatures(_flags(spark, sf_dir)))


@query("SELECT c_custkey, '$label$ buys in $segment$.' AS template, 'X' || c_custkey || ' buys in Y.' AS filled FROM customer")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    pair = lambda v, p: F.struct(v.alias("val"), F.lit(p).alias("prop"))
    masked = grounding.tag(F.concat("c_name", F.lit(" buys in "), "c_mktsegment", F.lit(".")), F.array(pair(F.col("c_mktsegment"), "segment"), pair(F.col("c_name"), "label")))
    values = F.array(pair(F.concat(F.lit("X"), "c_custkey"), "label"), pair(F.lit("Y"), "segment"))
    return c.select("c_custkey", masked.alias("template")).withColumn("filled", grounding.fill(F.col("template"), values))


# Lookups, clean-up, partitions


@query(f"WITH {_QP} SELECT s, p, o FROM quads WHERE s IN (SELECT 'supplier/' || s_suppkey FROM supplier) AND p IN ('label', 'nation')")
def value_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = load(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier/"), "s_suppkey").alias("s"))
    return graph.lookup(star_quads(spark, sf_dir, PEOPLE), batch, "label", "nation")


@query(f"WITH {_QP} SELECT cls, cls IN (SELECT o FROM quads WHERE p = 'rdf:type') AS known FROM (SELECT unnest(['Customer', 'Nation', 'Airport']) AS cls)")
def ask_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("Customer",), ("Nation",), ("Airport",)], "cls string")
    return graph.known_classes(names, star_quads(spark, sf_dir, PEOPLE))


@query(f"WITH {_QO} SELECT s, p, o FROM quads WHERE k = 'literal'")
def reified_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = star_quads(spark, sf_dir, ORDERS).where("k = 'literal'").withColumn("n", F.concat_ws("#", "s", "p"))
    node = F.array(F.struct(F.col("s"), F.col("p"), F.col("n").alias("o"), F.lit("iri").alias("k")), F.struct(F.col("n").alias("s"), F.lit("rdf:value").alias("p"), F.col("o"), F.lit("literal").alias("k")))
    return graph.reified(q.select(F.inline(node)))


@query("SELECT doc_id, p, o FROM (SELECT doc_id, 'lang' AS p, lang AS o FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents) WHERE o IS NOT NULL AND o NOT IN ('', 'NaN')")
def clean_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("p"), F.col(c).alias("o")) for c in ("lang", "source")])
    facts = load(spark, sf_dir, "documents").select("doc_id", F.inline(pairs))
    return delete_where(facts, F.col("o").isNull() | F.col("o").isin("", "NaN"))


@query(f"WITH {_FLAGS} SELECT p, count(DISTINCT s) AS nb FROM facts GROUP BY p HAVING count(DISTINCT s) >= 100")
def shape_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.prune_properties(_flags(spark, sf_dir), 100)


@query(f"SELECT s, floor(n / 500)::INT AS page FROM {_RANK}")
def uid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.pages(_orders(spark, sf_dir), 500)


@query(f"WITH {_QP} SELECT s, CASE WHEN s IN (SELECT 'customer/' || o_custkey FROM orders) THEN 'new' ELSE 'old' END AS part FROM (SELECT DISTINCT s FROM quads WHERE k = 'iri' AND p <> 'rdf:type')")
def new_or_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = load(spark, sf_dir, "orders").select(F.concat(F.lit("customer/"), "o_custkey").alias("s"))
    return graph.new_or_old(star_quads(spark, sf_dir, PEOPLE), bought)


@query("SELECT 'supplier/' || s_suppkey AS s, 'sample' AS origin FROM supplier UNION SELECT t || '_' || substr(md5(t || '|' || f), 1, 8), 'synthetic' FROM (SELECT 'supplier/' || l_suppkey AS t, 'part/' || l_partkey AS f FROM lineitem)")
def augment_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = load(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier/"), "s_suppkey").alias("s"))
    pairs = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("supplier/"), "l_suppkey").alias("template"), F.concat(F.lit("part/"), "l_partkey").alias("filler"))
    return sampling.augment(sample, pairs.distinct())


# Reports


@query("""SELECT round(count(*) FILTER (k % 5 <> 0) / count(*), 6) AS part_parsed, 1.0::DOUBLE AS part_subj_ok, round(count(*) FILTER (k % 5 <> 0 AND k % 7 <> 0) / count(*) FILTER (k % 5 <> 0), 6) AS part_type_ok,
    round(count(*) FILTER (k % 5 <> 0 AND k % 3 <> 0) / count(*) FILTER (k % 5 <> 0), 6) AS part_valid_rdf FROM (SELECT o_orderkey AS k FROM orders)""")
def parse_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ttl_light_serialize(spark, sf_dir).withColumn("n", F.substring_index("s", "/", -1).cast("long"))
    other = F.when(F.col("n") % 7 == 0, F.replace("line", F.lit("a :Order"), F.lit("a :Thing"))).otherwise(F.col("line"))
    other = F.when(F.col("n") % 3 == 0, F.regexp_replace(other, '; :status "[^"]*"', "")).otherwise(other)
    other = F.when(F.col("n") % 5 == 0, F.lit("no graph")).otherwise(other)
    return reports.parse_quality(lines.select(codecs.parse(F.col("line")).alias("gold"), codecs.parse(other).alias("predicted")))


@query(f"""WITH a AS ({ORACLE["score_micro_macro"]}), b AS ({ORACLE["fp_fn_rates"]}), t AS (SELECT n_fn, n_fp, greatest(r_micro * n_fn / (100 - r_micro), p_micro * n_fp / (100 - p_micro)) AS tp FROM a, b)
    SELECT n_fn, n_fp, round(tp, 4) AS tp, round(n_fp / (n_fp + tp), 6) AS new_fp_rate, round(n_fn / (n_fn + tp), 6) AS new_fn_rate FROM t""")
def derived_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.derived_rates(score_micro_macro(spark, sf_dir).join(F.broadcast(fp_fn_rates(spark, sf_dir))))  # one row each


@query("SELECT model, count(*) AS n_folds, round(avg(discount), 6) AS discount, round(avg(tax), 6) AS tax FROM (SELECT l_returnflag AS model, l_linenumber, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY ALL) GROUP BY model")
def fold_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), "l_linenumber").agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    return reports.fold_means(folds, "model", ["discount", "tax"])


@query(f"""WITH {_GP}, a AS (SELECT ex, list_distinct(list(p || '=' || v)) AS g, count(DISTINCT p) AS np FROM gold GROUP BY ex), b AS (SELECT ex, list_distinct(list(p || '=' || v)) AS q, count(DISTINCT p) AS nq FROM pred GROUP BY ex),
    c AS (SELECT ex, len(list_intersect(g, q)) AS h, len(q) AS n1, len(g) AS n2, nq, np FROM a JOIN b USING (ex))
    SELECT ex, round(100 * h / n1, 2) AS value_p, round(100 * h / n2, 2) AS value_r, round(CASE WHEN h = 0 THEN 0 ELSE 200 * h / (n1 + n2) END, 2) AS value_f1, round(100 * nq / np, 2) AS expressiveness FROM c""")
def three_graph_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda df, n: df.groupBy("ex").agg(F.collect_set(F.concat_ws("=", "p", text.normal_value(F.col("v")))).alias(n), F.count_distinct("p").alias(f"n_{n}"))
    both = own(_gold(spark, sf_dir), "g").join(own(_predicted(spark, sf_dir), "q"), "ex")
    p, r, f = scoring.set_scores(F.col("q"), F.col("g"))
    return both.select("ex", F.round(p, 2).alias("value_p"), F.round(r, 2).alias("value_r"), F.round(f, 2).alias("value_f1"), F.round(100 * F.col("n_q") / F.col("n_g"), 2).alias("expressiveness"))


@query("""WITH e AS (SELECT DISTINCT (c_nationkey + c_custkey) % 30 AS vp, CASE WHEN c_custkey % 3 = 1 THEN c_nationkey END AS vg FROM customer WHERE c_custkey % 3 <> 2),
    x AS (SELECT e.*, a.n_nationkey IS NOT NULL AS found, CASE WHEN a.n_regionkey = 0 THEN 0.5 ELSE 0 END AS ps, CASE WHEN vg IS NULL OR b.n_nationkey IS NULL THEN NULL WHEN a.n_nationkey = b.n_nationkey THEN 1 WHEN a.n_regionkey = b.n_regionkey THEN 1 / 3 ELSE 0 END AS pg,
        CASE WHEN b.n_regionkey = 0 THEN 2 / 3 WHEN b.n_regionkey IS NOT NULL THEN 0 END AS gs FROM e LEFT JOIN nation a ON a.n_nationkey = vp LEFT JOIN nation b ON b.n_nationkey = vg)
    SELECT CASE WHEN vg IS NULL THEN 'new' ELSE 'diff' END AS kind, count(*) AS nb, round(count(*) FILTER (found) / count(*), 6) AS uri_ok, round(avg(ps) FILTER (found), 6) AS pred_shape, round(avg(pg) FILTER (found), 6) AS pred_gold, round(avg(gs) FILTER (found), 6) AS gold_shape FROM x GROUP BY 1""")
def object_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    kind = F.when(F.col("c_custkey") % 3 == 0, "FP_new").when(F.col("c_custkey") % 3 == 1, "FP_different").otherwise("FN")
    errors = c.select(kind.alias("type"), F.lit("nation").alias("pred"), F.concat(F.lit(":n"), (F.col("c_nationkey") + F.col("c_custkey")) % 30).alias("val_pred"), F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(":n"), "c_nationkey")).alias("val_gold"))
    types = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("uri"), F.col("n_name").alias("cls"))
    return reports.object_novelty(errors, types, spark.createDataFrame([("nation", "region0")], "pred string, shape_cls string"), graph.closure(_tree(spark, sf_dir)), "world")


@query("SELECT o_orderkey, 'order ' || o_orderkey || ' orderDate ' || strftime(o_orderdate, '%d %B %Y') AS dated, 'order ' || o_orderkey || ' order status ' || o_orderstatus AS plain FROM orders")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.concat(F.lit(":order_"), "o_orderkey")
    day = reports.claim(subject, F.lit("orderDate"), F.to_date("o_orderdate").cast("string"))
    return load(spark, sf_dir, "orders").select("o_orderkey", day.alias("dated"), reports.claim(subject, F.lit("order_status"), F.concat(F.lit(":"), "o_orderstatus")).alias("plain"))


# Foreign records


@query("""WITH c AS (SELECT c_custkey AS ex, replace(c_name, ' ', '_') AS subj, replace(n_name, ' ', '_') AS n, replace(r_name, ' ', '_') AS r, strftime(DATE '1970-01-01' + (c_custkey % 9000)::INT, '%Y-%m-%d') AS d FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
    SELECT ex, subj, 'birthDate' AS prop, d AS val FROM c UNION ALL SELECT ex, subj, 'birthYear', substr(d, 1, 4) FROM c UNION ALL SELECT ex, subj, 'birthPlace', n FROM c UNION ALL SELECT ex, subj, 'birthPlace', r FROM c""")
def relation_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = load(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    day = text.long_date(F.date_add(F.lit("1970-01-01").cast("date"), (F.col("c_custkey") % 9000).cast("int")))
    triple = lambda s, r, o: F.struct(s.alias("subj"), F.lit(r).alias("rel"), o.alias("obj"))
    each = F.array(triple(F.col("c_name"), "place of birth", F.col("n_name")), triple(F.col("n_name"), "country", F.col("r_name")), triple(F.col("c_name"), "date of birth", day), triple(F.col("c_name"), "spouse", F.col("n_name")))
    return mapping.map_relations(c.select(F.col("c_custkey").alias("ex"), F.inline(each)))


@query("""SELECT 's' || s_suppkey AS s, 'founded' AS p, '1994-08-29' AS o FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL
    SELECT 's' || s_suppkey, 'seat', n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 3 <> 0""")
def attribute_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    day = F.when(F.col("s_suppkey") % 2 == 0, F.lit("on 29 August 1994")).otherwise(F.lit("1994-08-29 or 1995-01-02"))
    place = F.concat(F.when(F.col("s_suppkey") % 3 == 0, F.lit("old ")).otherwise(F.lit("")), "n_name", F.lit(", somewhere"))
    records = s.select(F.concat(F.lit("s"), "s_suppkey").alias("s"), F.create_map(F.lit("founded_on"), day, F.lit("city"), place).alias("attrs"))
    return mapping.import_attributes(records, {"founded_on": "founded"}, {"city": "seat"}, star_quads(spark, sf_dir, ("nation",)), "Nation")


@query("SELECT 'p' || p_partkey AS subj, 'type' AS prop, 'Part' AS val FROM part UNION ALL SELECT 'p' || p_partkey, 'brand', p_brand FROM part UNION ALL SELECT 'p' || p_partkey, 'size', p_size::VARCHAR FROM part")
def ultra_light_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("p"), "p_partkey", F.lit(' a Part;brand "'), "p_brand", F.lit('";size "'), "p_size", F.lit('" .'))
    return load(spark, sf_dir, "part").select(F.inline(codecs.parse_ultra(line)))


@query("SELECT p_partkey, CASE WHEN 'label' < p_name THEN 'label,' || p_name ELSE p_name || ',label' END AS members FROM part")
def set_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.lit("{'"), "p_name", F.lit("', 'label', '"), "p_name", F.lit("'}"))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(codecs.from_set_text(written), ",").alias("members"))


@query("SELECT c_custkey, 'rdf-syntax-ns#type N' || chr(10) || 'rdf-schema#label ' || c_name || chr(10) || 'nation ' || c_nationkey || chr(10) || 'rdf-schema#label also' AS lines FROM customer")
def ntriples_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(F.concat(F.lit("nation "), "c_nationkey"), F.concat(F.lit("rdf-schema#label "), "c_name"), F.lit("rdf-syntax-ns#type N"), F.lit("rdf-schema#label also"))
    return load(spark, sf_dir, "customer").select("c_custkey", F.array_join(codecs.type_and_label_first(lines), "\n").alias("lines"))


# SPARQL text

_STORE = "PREFIX : <> "


@query("SELECT 'order/' || o_orderkey AS s, strftime(o_orderdate, '%Y-%m-%d') AS day, c_name AS who FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= '1995-01-01'")
def sparql_star_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT ?s ?day ?who WHERE { ?s a :Order ; :orderDate ?day ; :priority ?pr ; :customer ?c . ?c :label ?who . FILTER(?pr IN ('1-URGENT', '2-HIGH') && ?day >= '1995-01-01') }"
    return sparql.query(_STORE + text, star_quads(spark, sf_dir, ("orders", "customer")))


@query("SELECT 'nation/' || c_nationkey AS n, count(*) AS nb FROM customer GROUP BY 1 HAVING count(*) > 2 ORDER BY nb DESC, n LIMIT 10")
def sparql_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT ?n (COUNT(DISTINCT ?s) AS ?nb) FROM <customer> WHERE { ?s a :Customer . ?s :nation ?n } GROUP BY ?n HAVING (COUNT(DISTINCT ?s) > 2) ORDER BY DESC(?nb) ASC(?n) LIMIT 10"
    return sparql.query(_STORE + text, star_quads(spark, sf_dir, PEOPLE))


@query("SELECT 'order/' || o_orderkey AS s FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY s LIMIT 50 OFFSET 10")
def sparql_exists_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """SELECT ?s FROM <orders> WHERE { ?s a :Order ; :customer ?c . FILTER EXISTS { GRAPH <customer> { ?c :segment 'BUILDING' } }
        FILTER NOT EXISTS { ?s :status 'F' } MINUS { ?s :priority '5-LOW' } } ORDER BY ASC(?s) LIMIT 50 OFFSET 10"""
    return sparql.query(_STORE + text, star_quads(spark, sf_dir, ("orders", "customer")))


@query("SELECT c_name AS name, n_name AS land, CASE WHEN n_name LIKE 'A%' THEN 'nation/' || n_nationkey END AS a FROM customer JOIN nation ON n_nationkey = c_nationkey")
def sparql_optional_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT ?name ?land ?a WHERE { ?n :label ?name . ?n :nation/:label ?land . OPTIONAL { ?n :nation ?a . ?a :label ?x . FILTER regex(?x, '^A') } }"
    return sparql.query(_STORE + text, star_quads(spark, sf_dir, ("customer", "nation")))


@query("SELECT 'customer/' || c_custkey AS c, unnest(['customer/' || c_custkey, 'nation/' || c_nationkey]) AS a FROM customer")
def sparql_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparql.query("SELECT ?c ?a { ?c a <Customer> . ?c <nation>* ?a }", star_quads(spark, sf_dir, ("customer", "nation")))


@query("""SELECT 'inferences' AS g, 'order/' || o_orderkey AS s, 'orderYear' AS p, year(o_orderdate)::VARCHAR AS o, 'literal' AS k FROM orders
    UNION SELECT 'inferences', 'customer/' || c_custkey, 'region', 'region/' || n_regionkey, 'iri' FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def sparql_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = "CONSTRUCT { GRAPH $INFERENCE_NS$ { ?s <orderYear> ?y } } WHERE { ?s a <Order> ; <orderDate> ?d . BIND(year(?d) AS ?y) FILTER NOT EXISTS { ?s <orderYear> ?b } }"
    region = "CONSTRUCT { GRAPH $INFERENCE_NS$ { ?s <region> ?r } } WHERE { ?s a <Customer> . ?s <nation> ?n . ?n a <Nation> . ?n <region> ?r . FILTER NOT EXISTS { ?s <region> ?r } }"
    return sparql.apply_rules([year, region], star_quads(spark, sf_dir, ("orders", "customer", "nation")), "inferences")


@query("SELECT 'p' || p_partkey AS s, p_name AS name FROM part WHERE p_partkey % 2 = 0")
def sparql_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in two languages, one of them asked for."""
    part = load(spark, sf_dir, "part")
    lang = F.when(F.col("p_partkey") % 2 == 0, "en").otherwise("fr")
    q = part.select(F.lit("part").alias("g"), F.concat(F.lit("p"), "p_partkey").alias("s"), F.lit("label").alias("p"), F.col("p_name").alias("o"), F.lit("literal").alias("k"), lang.alias("lang"))
    return sparql.query("SELECT ?s ?name WHERE { ?s <label> ?name . FILTER(lang(?name) = 'en') }", q)


@query("SELECT 'order/' || o_orderkey AS s, o_orderstatus AS v FROM orders UNION ALL SELECT 'order/' || o_orderkey, o_orderpriority FROM orders")
def sparql_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparql.query("SELECT ?s ?v WHERE { ?s <status>|<priority> ?v }", star_quads(spark, sf_dir, ORDERS))


# Shapes, rule files and names of datasets: metadata on the driver


@query(f"""WITH {_QO} SELECT t.*, count(q.s) AS nb, count(DISTINCT q.o) AS n_values FROM (VALUES ('Order', 'status', 'datatype', 1, 1, 0, 0), ('Order', 'customer', 'object', 1, NULL, 0, 0), ('Order', 'orderDate', 'datatype', 1, NULL, 1, 1), ('Order', 'priority', 'datatype', 1, NULL, 1, 2)) t(target, p, kind, min_count, max_count, or_group, or_branch)
    LEFT JOIN quads q USING (p) GROUP BY ALL""")
def shape_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shape's properties with the facts that have them and their different values."""
    shape = ORDER_SHAPE.table(spark).select("target", "p", "kind", "min_count", "max_count", "or_group", "or_branch")
    used = star_quads(spark, sf_dir, ORDERS).groupBy("p").agg(F.count("*").alias("nb"), F.count_distinct("o").alias("n_values"))
    return F.broadcast(shape).join(used, "p", "left").fillna(0, ["nb", "n_values"])


@query("SELECT 'customer/' || c_custkey AS s, 'nation/' || c_nationkey AS o FROM customer")
def rule_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of an XML file, applied."""
    body = "CONSTRUCT { GRAPH $INFERENCE_NS$ { ?s <within> ?o } } WHERE { ?s a <Customer> . ?s <nation> ?o }"
    rules = read_rules(f"<rules><rule><body>{escape(body)}</body></rule></rules>")
    return sparql.apply_rules([r.body for r in rules], star_quads(spark, sf_dir, ("customer",)), "inferences").select("s", "o")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'turtle' END AS syntax, p_partkey % 2 = 1 AS datatype, p_partkey % 3 = 1 AS in_line, p_partkey % 4 = 0 AS facto FROM part")
def dataset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of datasets, some without a flag or a syntax."""
    k = F.col("p_partkey")
    flag = lambda name, n: F.concat(F.lit("_"), F.when(k % n == 1, "1").otherwise("0"), F.lit(name))
    name = F.concat(F.when(k % 5 == 0, "").otherwise("DS_turtle"), flag("datatype", 2), flag("inLine", 3), F.when(k % 4 == 0, "_1facto").otherwise(""), F.lit("_sample_"), k)
    return load(spark, sf_dir, "part").select("p_partkey", codecs.syntaxes_of(name).alias("x")).select("p_partkey", "x.syntax", "x.datatype", F.col("x.inLine").alias("in_line"), "x.facto")


@query("""SELECT c_custkey, ':c' || c_custkey || '%28x%29 a :Customer;:label "' || c_name || ' (y)";:at :A%2Cb.' AS line, CASE WHEN length(c_name) + 12 <= 40 THEN c_name || '. It is here.' ELSE c_name || '.' END AS short FROM customer""")
def line_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local names encoded in lines, and texts cut to whole sentences."""
    line = F.concat(F.lit(":c"), "c_custkey", F.lit('(x) a :Customer;:label "'), "c_name", F.lit(' (y)";:at :A%2Cb.'))
    told = F.concat("c_name", F.lit(". It is here. "), F.repeat(F.lit("And so on"), 9), F.lit("."))
    return load(spark, sf_dir, "customer").select("c_custkey", codecs.encode_locals(line).alias("line"), text.shorten(told, 40).alias("short"))


# Scorers and extractors

_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''))"


@query(f"SELECT 'p' || p_partkey AS s, 'partType' AS p, p_type AS o, round(len(list_intersect({_WORDS.format('p_type')}, {_WORDS.format('t')})) / len({_WORDS.format('p_type')}), 6) AS score FROM (SELECT *, p_name || ' ' || split_part(p_type, ' ', 1 + p_partkey % 2) AS t FROM part)")
def critic_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").withColumn("s", F.concat(F.lit("p"), "p_partkey"))
    texts = part.select("s", F.concat("p_name", F.lit(" "), F.split_part("p_type", F.lit(" "), (1 + F.col("p_partkey") % 2).cast("int"))).alias("text"))
    scored = plugins.score(part.select("s", F.lit("partType").alias("p"), F.col("p_type").alias("o")), texts)
    return scored.withColumn("score", F.round("score", 6))


@query(f"SELECT s, 'status' AS p, regexp_extract(note, 'status (\\w+)', 1) AS o FROM (SELECT 'order/' || o_orderkey AS s, {_NOTE} AS note FROM orders) UNION ALL SELECT s, 'year', regexp_extract(note, ' (\\d{{4}}) ', 1) FROM (SELECT 'order/' || o_orderkey AS s, {_NOTE} AS note FROM orders)")
def extract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.extract_by_rules(_order_texts(spark, sf_dir), {"status": "status (\\w+)", "year": " (\\d{4}) "})


@query("""SELECT s, s1 || 'a :Customer .' || chr(10) || s1 || ':label "' || c_name || '" .' || chr(10) || s1 || ':nation :nation/' || c_nationkey || ' .' || chr(10) || s1 || ':segment "' || c_mktsegment || '" .' AS line
    FROM (SELECT *, 'customer/' || c_custkey AS s, ':customer/' || c_custkey || ' ' AS s1 FROM customer)""")
def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.statements(star_quads(spark, sf_dir, ("customer",)), gap="\n")


@query("SELECT s, syntax, n::INT AS n, true AS same FROM (SELECT 'order/' || o_orderkey AS s FROM orders), (VALUES ('light', 5), ('tags', 5), ('list', 5), ('other', 0)) v(syntax, n)")
def parse_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ttl_light_serialize(spark, sf_dir).withColumn("t", codecs.parse(F.col("line")))
    written = F.create_map(F.lit("light"), F.col("line"), F.lit("tags"), codecs.to_tags(F.col("t")), F.lit("list"), codecs.to_list(F.col("t")), F.lit("other"), F.col("line"))
    back = t.select("s", "t", F.explode(written).alias("syntax", "text")).withColumn("back", codecs.parse_as(F.col("text"), F.col("syntax")))
    again = codecs.from_factored(codecs.to_factored(F.col("back")))
    return back.select("s", "syntax", F.size("back").alias("n"), (again == F.when(F.size("back") > 0, F.col("t")).otherwise(F.col("back"))).alias("same"))


@query(f"WITH {_CHECKED}, y AS (SELECT s, 'orderYear' AS p FROM quads WHERE p = 'orderDate'), f AS (SELECT s, p FROM checked WHERE found UNION ALL SELECT s, p FROM y) SELECT p, count(DISTINCT s) AS nb, round(count(DISTINCT s) / (SELECT count(DISTINCT s) FROM f), 6) AS freq FROM f GROUP BY p")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape, rules, grounding and property statistics in one plan."""
    kinds = spark.createDataFrame([("orderDate", "xsd:date"), ("status", "xsd:string"), ("priority", "xsd:string"), ("orderYear", "xsd:gYear")], "p string, range string")
    q = star_quads(spark, sf_dir, ORDERS)
    known = q.select("s", "p", "o").unionByName(graph.infer_from_date(q, "orderDate", "orderYear", "inferences").select("s", "p", "o"))
    found = grounding.wikicheck(known, _order_texts(spark, sf_dir), kinds).where("found")
    return signatures.property_frequency(found)
