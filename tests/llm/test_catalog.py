"""Every query of the subpackage that has SQL, against another engine."""

import pytest

from defectlens.llm import catalog
from tools.check import compare, connect


@pytest.mark.parametrize("name", list(catalog.CHECKS))
def test_query(spark, data_dir, name):
    assert compare(catalog.QUERIES[name](spark, data_dir), connect(data_dir), catalog.CHECKS[name]) is None
