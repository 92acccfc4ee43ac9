import pytest
from conftest import same_rows

from weft.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE:
        same_rows(got, duck.execute(ORACLE[name]).df())
    else:
        assert len(got)
