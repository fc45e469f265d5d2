"""Personal data: base spans against a plain scan in Python, the labelers' reliabilities, odd inputs."""

import hashlib
import re

from touchstone.llm.queries import QUERIES
from touchstone.llm.span_votes import op10, personal_spans, reliabilities

SMALL = "/root/testdata/sf0.001"
BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def good(kind, value):
    number = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(number) <= 19 and luhn(number)
    return kind != "phone" or 9 <= len(number) <= 15


def brute(text):
    spans = [(m.start(), k, m.end()) for k, (kind, pattern) in enumerate(BASE) for m in re.finditer(pattern, text or "") if good(kind, m[0])]
    counts = [sum(s[1] == k for s in spans) for k in range(4)]
    joined = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(spans))
    return [*counts, hashlib.sha256(joined.encode()).hexdigest()], joined


def compare(rows, df):
    got = sorted(([r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256], r.spans) for r in df.collect())
    want = sorted(([i, *brute(t)[0]], brute(t)[1]) for i, t in rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    for (_, spans), (_, base) in zip(got, want, strict=True):
        assert set(filter(None, base.split(","))) <= set(spans.split(","))


def test_query_on_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    compare(rows, QUERIES["op10_span_votes"](spark, SMALL))


def test_tricky_texts(documents):
    rows = list(enumerate([
        None, "", "no data at all", "a@b.c.d_e@f.g x@y", "..%@-.- me@host.example.org.", "1.2.3.4.5.6.7.8 300.1.1.1 0255.000.1.2",
        "é😀 +49 (30) 1234-567 ü 4111 1111 1111 1111 4111-1111-1111-1112", "+1 5 +12345678 +123456789 +1234567890123456",
        "@" * 500 + "a@" * 500, "9" * 5000, "b" * 20000 + "@", "x@" + "y." * 20000 + "z", "1." * 5000, "12 " * 3000,
        " ".join(f"u{i}@h{i}.net" for i in range(700)), "password=32bb02aa3b580bf8ab ssn 123-45-6789", "1 2 3 4 5 6 7 8 9 0 1 2 3-4",
    ]))
    rows += [(3, rows[3][1])]
    df = documents(rows, extra=True)
    compare(rows, op10(df))
    assert op10(df.limit(0)).collect() == []


def test_method_adds_spans(documents):
    text = "login with password=32bb02aa3b580bf8ab today, mail ann.lee@example.com or call +1 (619) 555-1368 now"
    rows = [(i, f"{text} {i}") for i in range(40)]
    spans = personal_spans(documents(rows)).first().spans
    kinds = [(s.kind, s.base) for s in spans]
    assert (4, False) in kinds and (0, True) in kinds and (3, True) in kinds


def test_reliabilities_find_the_better_labeler(spark):
    # Three labelers agree with a hidden truth in 95 % of cases, two are coins.
    import random

    rng = random.Random(5)
    rows = {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        v = "".join("2" if truth == (rng.random() < q) else "0" for q in (0.95, 0.95, 0.95, 0.5, 0.5))
        rows[v] = rows.get(v, 0) + 1
    share, chance = reliabilities(spark.createDataFrame(list(rows.items()), "votes string, n bigint"))
    assert abs(share - 0.4) < 0.05
    assert all(chance[i][1][2] > 0.9 for i in range(3)) and all(abs(chance[i][1][2] - 0.5) < 0.08 for i in (3, 4))
