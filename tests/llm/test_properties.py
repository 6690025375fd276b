"""Properties that hold for all inputs, by generated cases."""

import io
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpforge.llm import packing, secret_scan, simhash, toxicity, warc
from kelpforge.llm._grams import hashed_grams

LETTERS = st.text("abcdé1!$ .", max_size=30)


@given(st.lists(st.tuples(st.integers(0, 250), st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 5))), max_size=60), st.integers(1, 100))
def test_every_word_is_packed_once_and_conflicts_never_meet(docs, capacity):
    rows = [((True, k, 0), k, n, s, c) for k, (n, s, c) in enumerate(docs)]
    bins: dict = {}
    words: dict = {}
    for doc, _, start, n, number, offset in packing.pack_rows(rows, capacity):
        words.setdefault(doc, []).append((start, n))
        if number is not None:
            bins.setdefault(number, []).append((offset, n, doc))
    for k, (n, _, _) in enumerate(docs):
        at = 0
        for start, size in sorted(words[k]):
            assert start == at
            at += size
        assert at == n
    for parts in bins.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
        for field in (1, 2):
            held = [docs[d][field] for _, _, d in parts if docs[d][field] is not None]
            assert len(held) == len(set(held))


@settings(max_examples=40)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60, unique=True), st.integers(1, 12), st.data())
def test_shards_meet_every_close_pair_once(values, leaves, data):
    near = [v ^ (1 << data.draw(st.integers(0, 63))) for v in values[:20]]
    all_ = np.unique(np.array(values + near, np.uint64))
    leaf, index, home = simhash.VantageTree(all_[:: max(1, len(all_) // 20)], leaves).route(all_, 2)
    at = np.empty(len(all_), int)
    at[index[home]] = leaf[home]
    assert home.sum() == len(all_)
    met = {(a, b) for a in range(len(all_)) for b in range(a) if int(all_[a] ^ all_[b]).bit_count() <= 2}
    visits = set(zip(leaf.tolist(), index.tolist(), strict=True))
    for a, b in met:
        first, other = (a, b) if at[a] <= at[b] else (b, a)
        assert (at[first], other) in visits


@given(st.text("pasworde_kyAIKA0123456789=: \"'tokensecret", max_size=120))
def test_trigram_queries_hold_for_every_match(text):
    low = text.lower()
    for rule in secret_scan.BASE_RULES + secret_scan.ADDED_RULES:
        if re.search(rule.pattern, text):
            assert any(all(g in low for g in clause) for clause in secret_scan.trigram_query(rule.pattern))


@given(st.lists(st.text(max_size=9), max_size=12))
def test_grams_of_many_words_are_those_of_each(words):
    buckets, of = hashed_grams(words, (2, 3), 1 << 10)
    for k, w in enumerate(words):
        alone, _ = hashed_grams([w], (2, 3), 1 << 10)
        assert sorted(buckets[of == k].tolist()) == sorted(alone.tolist())
        assert len(alone) == max(0, len(w) + 1) + max(0, len(w))


@given(LETTERS)
def test_restoration_always_ends_in_words(text):
    codes, n = np.unique(toxicity.trigram_codes("a bad idiot"), return_counts=True)
    words = toxicity.Restorer(toxicity.CharModel(codes, n)).words(text)
    assert all(w and w.isalpha() and w == w.lower() for w in words)
    assert {w for w in text.lower().split() if w.isalpha() and not re.search(r"(.)\1\1", w)} <= words


@given(st.lists(st.binary(max_size=300), max_size=6), st.integers(1, 64))
def test_archives_give_back_their_payloads(payloads, chunk):
    out = io.BytesIO()
    for k, p in enumerate(payloads):
        out.write(warc._header(k, f"id-{k}", "http://x/", len(p), "0", None) + p + b"\r\n\r\n")
    out.seek(0)
    got: dict = {}
    for record, no, _, _, data, _ in warc.parse_stream(out, chunk):
        assert len(data) <= chunk and no == len(got.setdefault(record, []))
        got[record].append(data)
    assert [b"".join(got[f"id-{k}"]) for k in range(len(payloads))] == payloads


@given(st.text(max_size=200))
def test_fingerprints_ignore_case_and_white_space(text):
    plain = text.encode("utf-8", "replace").decode()
    spaced = "\t" + "  ".join(re.split(r"[\x20\x09-\x0D]+", plain)) + "\n"
    assert simhash.fingerprint(plain) == simhash.fingerprint(spaced)
    assert simhash.fingerprint("ABC def") == simhash.fingerprint("abc DEF") != simhash.fingerprint("abc dég")
