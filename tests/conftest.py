from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from folioscan.session import local_session

    session = local_session(memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SMALLEST


@pytest.fixture(scope="session")
def mails(spark, tmp_path_factory):
    """The hand-written corpus, written to files and read back."""
    from folioscan.sources import read_docs
    from tests.mails import MAILS

    folder = tmp_path_factory.mktemp("mails")
    for name, html in MAILS.items():
        (folder / f"{name}.html").write_text(html, encoding="utf-8")
    (folder / "notes.txt").write_text("not a mail")
    return read_docs(spark, str(folder)).cache()
