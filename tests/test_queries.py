"""Every query against its SQL on the smallest tables; those without SQL run and have rows."""

import pytest
from conftest import same

from palimpsest import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    if name in SQL:
        same(df, duck, SQL[name])
    else:
        assert df.count() > 0
