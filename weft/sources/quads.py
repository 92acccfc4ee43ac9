"""Quads (graph, subject, predicate, object, kind of object) and readers for the files they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.sources.arrays import read_json_array, read_json_matrix

TYPE = "rdf:type"
COLUMNS = ("g", "s", "p", "o", "k")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(table: DataFrame, graph: str, cls: str, subject: Column, literals: dict[str, Column], objects: dict[str, Column] | None = None) -> DataFrame:
    """One quad per row and property that has a value, and the type; one scan of the table."""
    rows = [(F.lit(TYPE), F.lit(cls), "iri"), *((F.lit(p), v.cast("string"), "literal") for p, v in literals.items()), *((F.lit(p), v, "iri") for p, v in (objects or {}).items())]
    each = F.array(*[F.struct(p.alias("p"), o.alias("o"), F.lit(k).alias("k")) for p, o, k in rows])
    return table.select(F.lit(graph).alias("g"), subject.alias("s"), F.inline(each)).where(F.col("o").isNotNull() & (F.col("o") != ""))


def uri(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


#: How each table of the star schema becomes facts: class, key, literals and objects.
STAR = {
    "customer": ("Customer", "c_custkey", {"label": "c_name", "segment": "c_mktsegment"}, {"nation": ("nation", "c_nationkey")}),
    "supplier": ("Supplier", "s_suppkey", {"label": "s_name"}, {"nation": ("nation", "s_nationkey")}),
    "nation": ("Nation", "n_nationkey", {"label": "n_name"}, {"region": ("region", "n_regionkey")}),
    "region": ("Region", "r_regionkey", {"label": "r_name"}, {}),
    "orders": ("Order", "o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority", "orderDate": "o_orderdate"}, {"customer": ("customer", "o_custkey")}),
    "part": ("Part", "p_partkey", {"label": "p_name", "brand": "p_brand", "partType": "p_type"}, {}),
}
_KIND = {"customer": "customer", "supplier": "supplier", "nation": "nation", "region": "region", "orders": "order", "part": "part"}


def star_quads(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = tuple(STAR)) -> DataFrame:
    """The star schema as quads, each table in a graph of its own name."""
    out = None
    for t in tables:
        cls, key, literals, objects = STAR[t]
        values = {p: F.to_date(c).cast("string") if c.endswith("date") else F.col(c) for p, c in literals.items()}
        one = facts(load(spark, sf_dir, t), t, cls, uri(_KIND[t], key), values, {p: uri(kind, c) for p, (kind, c) in objects.items()})
        out = one if out is None else out.unionByName(one)
    return out


def star_sql(tables: tuple[str, ...] = tuple(STAR)) -> str:
    """star_quads() for DuckDB, as the CTE quads."""
    parts = []
    for t in tables:
        cls, key, literals, objects = STAR[t]
        s = f"'{_KIND[t]}/' || {key}"
        parts.append(f"SELECT '{t}' AS g, {s} AS s, '{TYPE}' AS p, '{cls}' AS o, 'iri' AS k FROM {t}")
        parts += [f"SELECT '{t}', {s}, '{p}', {f'strftime({c}, ' + chr(39) + '%Y-%m-%d' + chr(39) + ')' if c.endswith('date') else c}, 'literal' FROM {t}" for p, c in literals.items()]
        parts += [f"SELECT '{t}', {s}, '{p}', '{kind}/' || {c}, 'iri' FROM {t}" for p, (kind, c) in objects.items()]
    return "quads AS (" + " UNION ALL ".join(parts) + ")"


#: Quads of a graph for each of its files, and graphs up to which their sizes are broadcast.
FILE_ROWS, MAX_GRAPHS = 2_000_000, 100_000


def write_store(quads: DataFrame, path: str, mode: str = "append", file_rows: int = FILE_ROWS) -> None:
    """Bulk load: Parquet partitioned by graph, so a graph is a directory and scoping prunes. A graph is cut into buckets by the hash of its quads, as many as its size asks for, so
    no task writes a large graph as a whole, and a small one has one file."""
    quads = quads.dropDuplicates(list(COLUMNS))
    sizes = quads.groupBy("g").agg(F.count("*").alias("__n")).withColumnRenamed("g", "__g")
    sizes = F.broadcast(sizes) if sizes.count() <= MAX_GRAPHS else sizes
    placed = quads.join(sizes, quads["g"].eqNullSafe(F.col("__g"))).withColumn("__b", F.pmod(F.xxhash64("s", "p", "o", "k"), F.ceil(F.col("__n") / file_rows)))
    placed.repartition("g", "__b").drop("__g", "__n", "__b").write.mode(mode).partitionBy("g").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The quads of a store. Graphs stay text, also where all of their names look like numbers or days."""
    found = spark.read.option("mergeSchema", False).parquet(path)
    return spark.read.schema(T.StructType([*(f for f in found.schema if f.name != "g"), T.StructField("g", T.StringType())])).parquet(path)


def insert_missing(quads: DataFrame, path: str) -> int:
    """Guarded insert: appends the quads that the store lacks; returns how many. Quads with nulls count as equal where all of their columns are."""
    have = read_store(quads.sparkSession, path)
    same = [quads[c].eqNullSafe(have[c]) for c in COLUMNS]
    new = quads.join(have, same, "left_anti").dropDuplicates(list(COLUMNS)).persist()
    n = new.count()
    if n:
        write_store(new, path)
    new.unpersist()
    return n


def drop_graph(spark: SparkSession, path: str, graph: str | None) -> None:
    """Removes one graph, whatever its name; the others stay as they are. FileNotFoundError if the store has none of that name."""
    folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("g", graph)
    base = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.org.apache.hadoop.fs.Path(path), folder)
    files = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.delete(base, True):
        raise FileNotFoundError(f"no graph {graph} in {path}")


def delete_where(quads: DataFrame, condition: Column) -> DataFrame:
    return quads.where(~F.coalesce(condition, F.lit(False)))


#: N-Triples: the terms of a line. Quantifiers don't give back what they took, so long literals need no deep recursion.
_IRI, _NODE = r"<([^\x00-\x20<>\"{}|^`]*)>", r"_:([\p{L}\p{N}_:](?:[\p{L}\p{N}_:·.-]*[\p{L}\p{N}_:·-])?)"
_LITERAL = r'"([^"\\\n\r]*+(?:\\.[^"\\\n\r]*+)*+)"(?:@([a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|\^\^' + _IRI + ")?"
_TRIPLE = rf"^[ \t]*(?:{_IRI}|{_NODE})[ \t]*{_IRI}[ \t]*(?:{_IRI}|{_NODE}|{_LITERAL})[ \t]*\.[ \t]*(?:#.*)?$"
#: The same with the first character of the object as group 4, matched to the very end of the line.
_PARTS = _TRIPLE.replace(rf"(?:{_IRI}|{_NODE}|{_LITERAL})", rf"(?=(.))(?:{_IRI}|{_NODE}|{_LITERAL})")[:-1] + r"(?:\r\n|[\n\r\u0085\u2028\u2029])?\z"


def unescaped(c: Column) -> Column:
    """Text with the escapes of N-Triples decoded: \\t \\b \\n \\r \\f \\" \\' \\\\, \\u and \\U. Numbers that are no character become U+FFFD; other escapes stay as they are."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\)"), F.lit(1))
    plain = F.create_map(*[F.lit(x) for pair in (("\\t", "\t"), ("\\b", "\b"), ("\\n", "\n"), ("\\r", "\r"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'"), ("\\\\", "\\")) for x in pair])

    def one(x: Column) -> Column:
        code = F.conv(F.substring(x, 3, 8), 16, 10).cast("long")
        char = F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32")
        is_code = (x.startswith("\\u") | x.startswith("\\U")) & (F.length(x) > 2)
        return F.when(is_code, F.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd").otherwise(char)).otherwise(F.coalesce(F.element_at(plain, x), x))

    return F.when(c.contains("\\"), F.array_join(F.transform(parts, one), "")).otherwise(c)


def _ntriple_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.where(~F.col("value").rlike(r"^[ \t]*(?:#.*)?$")).withColumn("is_triple", F.col("value").rlike(_TRIPLE))


def read_ntriples(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """Line-by-line N-Triples: g, s, p, o, k (iri, bnode or literal), dt, lang. Escapes are decoded. A blank node is named by its file and label, as labels hold within a file. Lines that
    are neither triples nor comments: see ntriples_rejects()."""
    lines = _ntriple_lines(spark, path).where("is_triple")
    # one match a line: all terms as fields, the literal last, as it alone may hold the mark between them
    fields = F.split(F.regexp_replace("value", _PARTS, "\x1f".join(f"${i}" for i in (1, 2, 3, 4, 5, 6, 8, 9, 7))), "\x1f", 9)
    read = lines.select("file", fields.alias("f"))
    iri, label, prop, mark, obj_iri, obj_label, lang, dt, literal = (F.get("f", F.lit(i)) for i in range(9))
    node = lambda c: F.concat(F.lit("_:"), F.substring(F.md5("file"), 1, 16), F.lit("."), c)
    obj = F.when(mark == "<", unescaped(obj_iri)).when(mark == "_", node(obj_label)).otherwise(unescaped(literal))
    kind = F.when(mark == "<", "iri").when(mark == "_", "bnode").otherwise("literal")
    subject = F.when(label != "", node(label)).otherwise(unescaped(iri))
    none = lambda c: F.nullif(c, F.lit(""))
    return read.select(F.lit(graph).alias("g"), subject.alias("s"), unescaped(prop).alias("p"), obj.alias("o"), kind.alias("k"), unescaped(none(dt)).alias("dt"), none(lang).alias("lang"))


def ntriples_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of the lines that read_ntriples() leaves out as they are neither triples nor comments."""
    return _ntriple_lines(spark, path).where("NOT is_triple").select("file", "value")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Dataset rows from JSON arrays: triples, abstract, ent (or the older name entity), class (0 if missing). One array may be of any size: see read_json_array()."""
    raw = read_json_array(spark, path, "triples string, abstract string, ent string, entity string, pattern string, class int")
    return raw.select("triples", "abstract", F.coalesce("ent", "entity").alias("ent"), "pattern", F.coalesce("class", F.lit(0)).alias("class"))


def write_splits(dataset: DataFrame, path: str, split: str = "split") -> None:
    """One JSON folder for each split."""
    dataset.write.partitionBy(split).json(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ent_uri string, pred string, type string, verif string, found string, val_pred string, val_gold string").csv(path, header=True, enforceSchema=False)


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """Rows of table artifacts (columns, data matrix), without repeats across folds, as maps from column to value."""
    return read_json_matrix(spark, path).dropDuplicates().select(F.map_from_arrays("columns", "d").alias("row"))
