import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (id, text) pairs or from (id, text, lang, source) rows."""

    def make(rows, extra=False):
        rows = [(r[0], r[1], *(r[2:4] or ("en", "src")), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(rows, DOCUMENTS)
        if extra:  # columns whose names operators also use inside
            df = df.selectExpr("*", "'x' as node", "1 as keep", "'y' as row_no", "'z' as run")
        return df

    return make
