"""Line and exact duplicates: against their SQL, and odd inputs against plain Python."""

import hashlib
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest

from touchstone.llm.digest_tree import exact_groups
from touchstone.llm.line_dedup import drop_lines, keep_bitmaps, kept_mask, op5
from touchstone.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    from tools.check import canonical

    con = duckdb.connect()
    for t in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {t.stem} as select * from '{t}'")
    assert canonical(QUERIES[name](spark, SMALL).toPandas()) == canonical(con.execute(ORACLES[name]).df())


SPACES = " \t\n\x0b\x0c\r"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute_lines(rows):
    found = {}
    for d in {(i, t or "") for i, t in rows}:
        for k in {lower(x.strip(SPACES)) for x in d[1].split("\n")} - {""}:
            found[k] = found.get(k, 0) + 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if found.get(lower(x.strip(SPACES)), 0) < 10]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows():
    rows = [(i, f"own {i}\n  Shared LINE\t\nÄ shared\n\n" + ("nine times\n" if i < 9 else "") + ("ten times\n" if i < 10 else "") + "again\nagain") for i in range(40)]
    return rows + [(50, None), (51, ""), (52, "\n\n"), (53, "shared line\n" * 5000 + "end"), (None, "shared line\nx"), (None, "shared line\ny"),
                   (54, "Shared line"), (55, "ä shared"), (3, rows[3][1]), (54, "other\nagain")]


@pytest.mark.parametrize("batch", [10_000, 6])
def test_lines(spark, documents, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = line_rows()
        df = documents(rows, extra=True)
        assert sorted([tuple(r) for r in op5(df).collect()], key=str) == brute_lines(rows)
        maps = keep_bitmaps(df).collect()
        assert all((~kept_mask(r.keep, r.n_lines)).sum() == r.n_dropped for r in maps)
        kept = drop_lines(df)
        assert kept.columns == df.columns
        text = {r.doc_id: r.text for r in kept.collect()}
        assert text[50] is None and text[51] == "" and text[53] == "end" and text[54] == "other" or text[54] == ""
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lines_of_an_empty_table(documents):
    df = documents([(1, "a")]).limit(0)
    assert op5(df).collect() == [] and drop_lines(df).collect() == []


def brute_groups(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault("".join(c for c in t or "" if c not in SPACES), []).append((-len(t or ""), i is None, i or 0, n))
    out = []
    for squeezed, members in groups.items():
        best = min(members)
        for m in members:
            i = rows[m[3]][0]
            out.append((i, rows[best[3]][0], len(members), m[:3] == best[:3], hashlib.sha256(squeezed.encode()).hexdigest()))
    return out


def test_groups(documents):
    rows = [(i, "same  text" if i % 2 else "same text") for i in range(3000)]
    rows += [(5000, None), (5001, ""), (5002, " \t"), (5003, "é " * 100_000), (5004, "é" * 100_000), (None, "no id"), (None, "noid"), (7, "seven"), (8, "se ven")]
    df = documents(rows, extra=True)
    got = sorted([tuple(r) for r in exact_groups(df).collect()], key=str)
    assert got == sorted(brute_groups(rows), key=str)
    assert exact_groups(df.limit(0)).collect() == []


def test_one_of_identical_rows_is_kept(documents):
    got = exact_groups(documents([(1, "a b")] * 5 + [(2, "ab")])).collect()
    assert [sum(r.kept for r in got), {r.keep_id for r in got}, {r.group_size for r in got}] == [1, {1}, {6}]


def test_masks():
    assert kept_mask(__import__("zlib").compress(np.packbits(np.array([1, 0, 1], bool), bitorder="little").tobytes()), 3).tolist() == [True, False, True]
