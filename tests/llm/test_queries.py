import pytest
from catalogue import agrees

from tallyforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, smallest, name):
    agrees(spark, smallest, queries.QUERIES[name], queries.SQL[name])


def test_every_query_runs(spark, smallest):
    for name in sorted(set(queries.QUERIES) - set(queries.SQL)):
        queries.QUERIES[name](spark, smallest).write.format("noop").mode("overwrite").save()
