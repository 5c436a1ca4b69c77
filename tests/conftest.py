from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from underwright.session import build_session

    session = build_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    from compare import connect

    return connect(SF)


@pytest.fixture(scope="session")
def raw(spark):
    """Raw applicants of the smallest scale, written once."""
    from underwright.session import materialise
    from underwright.sources.applicants import applicants

    return materialise(applicants(spark, "/root/testdata/sf0.001"), "raw")


@pytest.fixture(scope="session")
def clean(raw):
    from underwright.operators.cleaning import clean_applicants
    from underwright.session import materialise

    return materialise(clean_applicants(raw), "clean")


@pytest.fixture(scope="session")
def batch(clean):
    """First 50 cleaned applicants that meet the contract."""
    from underwright.operators.scoring import validate

    return validate(clean, strict=False)[0].orderBy("customer_id").limit(50)
