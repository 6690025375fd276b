"""Ids that are strings, negative, repeated or missing in bulk."""

import random

import pytest

from kelpforge.llm import exact_dedup, secret_scan, warc


def plain_winners(rows):
    """Of equal texts without blanks the longest, then the smallest id, nulls last; how many are equal."""
    groups = {}
    for i, t in rows:
        groups.setdefault("".join((t or "").split(" ")), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    return {k: (min(g, key=lambda r: r[:2] + ((r[2],) if not r[1] else (0,)))[3], len(g)) for k, g in groups.items()}


@pytest.mark.parametrize("kind,name", [("string", str), ("bigint", lambda k: k), ("bigint", lambda k: -k), ("int", lambda k: k - 50)])
def test_exact_dedup_takes_ids_of_any_type(spark, kind, name):
    rng = random.Random(1)
    rows = [(name(k), rng.choice(["a b c", "ab c", "a  bc", "x", "", None, " "])) for k in range(100)] + [(None, "a b c"), (None, "only here")]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    want = plain_winners(rows)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r["text_sha256"], set()).add((r["keep_id"], r["group_size"]))
    assert sorted(map(str, (x for v in by_text.values() for x in v))) == sorted(map(str, want.values()))
    assert sum(r["kept"] for r in got) == len(want)
    kept = exact_dedup.drop_exact_duplicates(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(i) for i, _ in want.values())


def test_secrets_of_many_rows_without_an_id_or_with_one(spark):
    rows = [(None, f"AKIA{'A' * 16} {k}") if k % 2 else (7, f"password=abcdefgh{k}") for k in range(400)]
    got = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 400 and sorted({(str(r["doc_id"]), len(r["spans"]), r["spans"][0]["kind"]) for r in got}) == [("7", 1, "assign"), ("None", 1, "access")]
    assert len({r["spans"][0]["stop"] for r in got if r["doc_id"] == 7}) == 3


def test_chunks_of_a_payload_are_cut_by_number(spark):
    html = "".join(chr(97 + k % 26) for k in range(1000)) + "\xe9"
    pages = spark.createDataFrame([(1, "x://a", html), (2, "x://b", ""), (3, "x://c", html)], "page_id long, url string, html string")
    parts = {}
    for r in warc.cut(pages, 64, 100).orderBy("chunk_no").collect():
        parts.setdefault(r["page_id"], []).append(r)
    assert b"".join(bytes(r["data"]) for r in parts[1]) == html.encode() and [r["chunk_no"] for r in parts[1]] == list(range(16))
    assert [r["last"] for r in parts[1]] == [False] * 15 + [True]
    assert len(parts[2]) == 1 and parts[2][0]["last"] and [(r["refers_to"], r["data"], r["last"]) for r in parts[3]] == [(1, None, True)]
