import cases
import compare
import pytest

from wareseek.llm.queries import ORACLES, RUNS


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in RUNS if n.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    assert compare.difference(spark, RUNS[name], ORACLES[name], cases.SF_DIR) is None
