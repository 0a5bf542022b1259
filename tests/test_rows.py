"""A query that returns nothing proves nothing, however well it agrees with its SQL."""

import math
import os

import pytest

from corpuswarden.duck.check import connect
from corpuswarden.duck.queries import ORACLES
from corpuswarden.sources import templates as tpl

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    if not os.path.exists(f"{SF_DIR}/events.parquet"):
        pytest.skip("no test tables here")
    return connect(SF_DIR)


def test_every_line_comes_to_every_path():
    assert math.gcd(len(tpl.LINES), tpl.FILES_PER_GROUP) == 1
    assert math.gcd(len(tpl.LINES), tpl.STRIDE) == 1
    assert len(tpl.PATHS) == tpl.FILES_PER_GROUP


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_has_rows(con, name):
    assert con.execute(f"select count(*) from ({ORACLES[name]})").fetchone()[0] > 0


@pytest.mark.parametrize("check", ["D1", "D2", "C2", "D4", "D9", "H1", "S1", "P1", "H3"])
def test_whole_audit_has_the_check(con, check):
    audit = ORACLES["findings_all"]
    assert con.execute(f"select count(*) from ({audit}) where check_id = '{check}'").fetchone()[0] > 0
