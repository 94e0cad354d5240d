import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: nulls in every column, empty and very long texts, repeated rows, ties, clashing extra columns
MESSY = [
    (1, "Alpha beta gamma delta.", "en", "src1"), (2, "Alpha  beta\tgamma delta.", "en", "src1"),
    (3, None, "en", "src2"), (4, "", None, None), (5, "   \n\t", "de", "src0"),
    (6, LONG, "en", "src0"), (6, LONG, "en", "src0"), (None, "Alpha beta gamma delta.", "fr", ""),
    (None, None, None, None), (7, "x", "es", "src9"), (8, "ÄÖÜ ß é 中文 😀", "de", "src3"),
    (9, "Released under the MIT License. token = \"abcdef123456\"", "en", "src4")]
EXTRA = "score double, n_tokens string, spans int, _text string, fp string, label int, digest int"


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(*r, 0.5, "n", 3, "t", "f", 1, 2) for r in MESSY]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, " + EXTRA).coalesce(2)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
