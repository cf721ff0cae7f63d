"""The driver's contract, with the corpus operators and without them."""

import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    ids = {re.match(r"[A-Z]\d+", k)[0] for k in entry.queries() if k[0].isupper()}
    assert {"J04", "W08", "D02", "M01", "V10", "S08", "T01"} <= ids


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "is_attributed" in df.columns


def test_library_does_not_need_the_corpus_operators():
    code = "import sys; sys.modules['causeway.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, files in os.walk(f"{ROOT}/causeway"):
        for f in files:
            if f.endswith(".py") and "/llm" not in folder:
                assert "llm" not in open(f"{folder}/{f}").read()
