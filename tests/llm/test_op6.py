"""Packing: exact round trip of token ids, no padding but at the end, the curve's neighbours."""

import random
import zlib

import numpy as np

from touchstone.llm.curve_packing import Encoder, default_tokenizer, hilbert, pack
from touchstone.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def check(rows, df):
    encode = Encoder(default_tokenizer())
    pieces = df.collect()
    got = {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    want = {}
    for i, text in rows:
        want.setdefault(i, []).append(np.array([*encode.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    assert set(got) == set(want)
    for i, texts in want.items():
        assert sum(n for _, n, _, _ in got[i]) == sum(len(t) for t in texts)
        if len(texts) == 1:
            place = 0
            for start, n, crc, total in sorted(got[i]):
                assert (start, total) == (place, len(texts[0])) and crc == zlib.crc32(texts[0][start:start + n].tobytes())
                place += n
    used = {}
    for p in pieces:
        assert p.length > 0
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, places in used.items():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end == 2048 or i == max(used)
    assert sorted(used) == list(range(len(used)))


def test_query_on_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, QUERIES["op6_curve_packing"](spark, SMALL))


def test_edges(documents):
    rows = [(1, None), (2, ""), (3, "x " * 20_000), (4, "  leading  and\n\n runs "), (5, "<|endoftext|> is text"), (6, "é😀ü don't"), (None, "no id"), (8, "twice"), (8, "twice"),
            (9, "\x1c odd \x85 spaces here")] + [(100 + i, "the same text again") for i in range(500)]
    df = documents(rows, extra=True)
    check(rows, pack(df))
    assert pack(df.limit(0)).collect() == []


def test_pieces_match_whole_encoding():
    encode = Encoder(default_tokenizer())
    rng = random.Random(8)
    texts = ["", " ", "a  b", " a", "don't  stop", "x\ny z", "x \ny", "é 😀 ü12,34's", "a b c", "foo's bar'll 's 'd", "\n", "tab\tin word", "a\x1cb c", "12 345 6a",
             "a\u00a0b", "x \u2003y", "end. Next,then.\nNew ,x .y", "a.b,c", "é, ü.", "", "wide\u3000space", "<|endoftext|> text"]
    texts += ["".join(rng.choices("ab Z.,'\n1é 😀\t-", k=rng.randint(1, 40))) for _ in range(400)]
    raw = [t.encode() for t in texts]
    got = encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    assert got == [x + b"\x01\x00" for x in encode.plain(raw)]


def test_the_curve_visits_neighbours():
    for dims, depth in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << depth)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hilbert(grid, depth)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_neighbours_share_sequences(documents):
    en, de = "the and of stone river walk house " * 30, "und der nicht stein fluss gehen haus " * 30
    rows = [(i, (en if i % 2 else de) + f" {i}") for i in range(120)]
    kinds = {}
    for p in pack(documents(rows)).collect():
        kinds.setdefault(p.sequence_id, set()).add(p.doc_id % 2)
    assert sum(len(k) == 1 for k in kinds.values()) >= len(kinds) - 2
