"""How often costly steps stand in a plan."""

from pyspark.sql import functions as F

from weft import queries
from weft.operators import scoring
from weft.sources import quads


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_conditions_on_parsed_lines_dont_parse_again(spark, sf_dir):
    rows = queries._lines(spark, sf_dir)
    assert _plan(scoring.not_valid(rows)).count("Filter (") >= 1
    below = _plan(scoring.not_valid(rows)).split("Generate", 1)
    assert len(below) == 2 and "regexp_extract" not in below[0]


def test_a_triple_line_is_matched_once_and_once_more_for_its_terms(spark, tmp_path):
    (tmp_path / "a.nt").write_text('_:a <p> "x\x1fy"@en . # seen\n<> <p> <> .\n<s> <p> _:b.c .\n<s> <p> ""^^<t> .\nno\n', encoding="utf-8")
    t = quads.read_ntriples(spark, str(tmp_path), "g")
    assert _plan(t).count("(?:@([a-zA-Z]+") == 2
    got = {(r.s.split(".")[-1], r.o.split(".", 1)[-1], r.k, r.dt, r.lang) for r in t.select(*[F.col(c) for c in t.columns]).collect()}
    assert got == {("a", "x\x1fy", "literal", None, "en"), ("", "", "iri", None, None), ("s", "b.c", "bnode", None, None), ("s", "", "literal", "t", None)}
