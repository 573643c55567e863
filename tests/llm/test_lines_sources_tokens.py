"""Line dedup, source divergence and tokenizer alignment against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from citeloom.llm import alignment, divergence, line_dedup

BLANK = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) beside columns whose names operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], "doc_id long, text string, lang string, source string, pos int, id string, kind string, value int")


# Line dedup


def plain_lines(rows, min_docs, keep_first, min_chars=1):
    """Kept lines by (id, text); a document is a row of its own id and text."""
    documents = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    holders = defaultdict(set)
    for d in documents:
        for line in (d[1] or "").split("\n"):
            holders[line.strip(BLANK).translate(LOWER)].add(d)
    seen, out = set(), {}
    for d in documents:
        kept = []
        for line in (d[1] or "").split("\n"):
            key = line.strip(BLANK).translate(LOWER)
            often = len(key) >= min_chars and len(holders[key]) >= min_docs
            if not often or keep_first and key not in seen:
                kept.append(line)
            seen.add(key)
        out[d] = "\n".join(kept)
    return out


def line_rows():
    rng = np.random.default_rng(5)
    pool = ["Hot line", " hot LINE\t", "a", "", "É", "é", *(f"line {i}" for i in range(30))]
    rows = []
    for i in range(90):
        picks = [pool[int(k)] for k in rng.integers(2, len(pool), rng.integers(0, 9))]
        rows.append((i, "\n".join([pool[i % 2], *picks]) if i % 7 else "\n".join(picks)))
    return [*rows, (200, None), (201, ""), (202, "\n\n"), (203, "line 1\n" * 500), (None, "line 2\nmine"), (7, rows[7][1]), (7, rows[7][1])]


@pytest.mark.parametrize(("min_docs", "keep_first"), [(10, False), (1, True), (2, True), (85, False), (3, False)])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_lines_match_brute_force(spark, min_docs, keep_first, batch):
    rows = line_rows()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        docs = documents(spark, [(*r, None, None) for r in rows]).repartition(5)
        found = line_dedup.deduplicate_lines(docs, min_docs=min_docs, keep_first=keep_first).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = plain_lines(rows, min_docs, keep_first)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in found) == sorted((r[0] is not None, r[0] or 0, expected[r]) for r in rows)
    lines = {(r["doc_id"], r["n_lines"]) for r in found}
    assert {(200, 1), (201, 1), (202, 3), (203, 501)} <= lines


def test_a_line_of_all_documents_lies_in_many_partitions(spark):
    docs = documents(spark, [(i, f"same\nown {i}", None, None) for i in range(4000)])
    marked = line_dedup.dropped_lines(docs, min_docs=10)
    assert marked.count() == 4000 and marked.where("pos = 0").select("id").distinct().count() == 4000
    short = line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=5).agg({"n_dropped": "sum"}).first()[0]
    assert short == 0


def test_bitmaps_are_small_and_give_the_text_back(spark):
    docs = documents(spark, [(i, "\n".join(f"{i} {k}" for k in range(20_000)) + "\nshared", None, None) for i in range(12)])
    rows = line_dedup.keep_bitmaps(docs).collect()
    assert all(len(r["keep"]) < 100 and (r["n_lines"], r["n_dropped"]) == (20_001, 1) for r in rows)
    assert line_dedup.kept_text("a\nb\n", line_dedup.zlib.compress(np.packbits([1, 0, 1]).tobytes())) == "a\n"


def test_no_rows_of_lines(spark):
    assert line_dedup.deduplicate_lines(documents(spark, [(1, "a", None, None)]).limit(0)).collect() == []


# Source divergence


def plain_audit(rows, min_docs, top):
    words = [([w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")], lang or "", s or "") for _, t, lang, s in rows]
    out = []
    for lang in {w[1] for w in words}:
        df = Counter(t for found, at, _ in words if at == lang for t in set(found))
        kept = sorted((t for t in df if df[t] >= min_docs), key=str.encode)
        count = defaultdict(Counter)
        for found, at, source in words:
            if at == lang:
                count[source].update(t for t in found if df[t] >= min_docs)
        whole = sum(count.values(), Counter())

        def share(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}  # noqa: B023

        p = {s: share(c) for s, c in count.items()}
        q = share(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in p:
            peers = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in p if o != s))
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(peers)]
            found = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("block", "seat", "cells"), [(1 << 16, 4, 1 << 21), (40, 1, 50)])
def test_audit_matches_brute_force(spark, monkeypatch, block, seat, cells):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SEAT", seat)
    monkeypatch.setattr(divergence, "CELLS", cells)
    rng = np.random.default_rng(3)
    vocabulary = [*(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)), "Über", "ÜBER", "日本", "don't", "A1b"]
    rows = [(i, " ".join(vocabulary[int(k)] for k in (rng.random(30) ** 2 * len(vocabulary)).astype(int)), ("en", "de", None)[i % 3], f"s{int(rng.integers(0, 7))}") for i in range(120)]
    rows += [(200, None, "en", "empty"), (201, "", "xx", None), (202, "1 2 3", "xx", "b"), (203, "wa wa", None, None), (3, rows[3][1], *rows[3][2:])]
    found = divergence.audit(documents(spark, rows).repartition(3), min_docs=4, top=5).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in found) == plain_audit(rows, 4, 5)


def test_every_two_seats_meet_once():
    for n in range(1, 9):
        met = [(i, (r - i) % n) for r in range(n) for i in range(n) if (r - i) % n >= i]
        assert sorted(met) == [(i, j) for i in range(n) for j in range(i, n)]


@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=20), st.integers(1, 10**6))
@settings(max_examples=60, deadline=None)
def test_shares_are_exact(counts, v):
    n = sum(counts)
    assert divergence.shares(np.array(counts), n, v).tolist() == [1 + 10**9 * (c + 2) // (n + 2 * v) for c in counts]


def test_vectors_come_back():
    places, counts = np.array([0, 3, 70_000]), np.array([5, 1, 10**12])
    assert [x.tolist() for x in divergence.unpacked(divergence.packed(places, counts))] == [places.tolist(), counts.tolist()]


def test_no_rows_to_audit(spark):
    assert divergence.audit(documents(spark, [(1, "a", "en", "s")]).limit(0)).collect() == []
    one = divergence.audit(documents(spark, [(1, "a", "en", "s")])).collect()
    assert one == []


# Tokenizer alignment

_JSON = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
_JSON.encode_special_tokens = True
_PIECES, _SIDE_B = alignment._side_b(None)


def byte_level():
    """Characters of the byte-level vocabulary and their bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTES = byte_level()


def plain_links(text):
    """Ids, links (a, b) and groups by offsets of tokens."""
    if not text:
        return [], [], [], ""
    whole = b" " + text.encode()
    a = _JSON.encode(" " + text, add_special_tokens=False).ids
    b = _PIECES.encode(text)
    bytes_a = [bytes(_BYTES[c] for c in _JSON.id_to_token(i)) for i in a]
    bytes_b = [_SIDE_B.token[i] for i in b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], [], [], ""
    spans = []
    for tokens in (bytes_a, bytes_b):
        ends = np.cumsum([len(t) for t in tokens]).tolist()
        spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
    links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, last = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(x) for x, (s, e) in zip(ids, side, strict=True) if last <= s < cut) for ids, side in ((a, spans[0]), (b, spans[1]))))
        last = cut
    return a, b, links, ";".join(groups)


TEXTS = ["Hello world", "the  quick\n\nbrown fox", "naïve café 日本語 🙂🙂", "<s> </s> <|endoftext|> <unk>", "a▁b", "", None, " x", "\x00y", "tab\tend ", " lead", "ＡＢＣ ﬁ", "the the the the", "Donaudampfschifffahrtsgesellschaft " * 40]


def expected_alignment(rows):
    found = [(i, *plain_links(t)) for i, t in rows]
    count = Counter(link for r in found for link in r[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for i, a, b, links, groups in found:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out


@pytest.mark.parametrize("listed", [1 << 21, 9, 0])
def test_alignment_matches_brute_force(spark, listed):
    rows = [*enumerate(TEXTS), (50, TEXTS[0]), (50, TEXTS[0]), (None, TEXTS[1])]
    docs = documents(spark, [(*r, None, None) for r in rows]).repartition(3)
    found = alignment.alignment(docs, listed=listed).collect()
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in found), key=repr) == sorted(expected_alignment(rows), key=repr)
    assert alignment.alignment(docs.limit(0), listed=listed).collect() == []


def test_token_bytes_of_both_sides():
    side = alignment._side_a(None)
    assert all(side.token[i] == bytes(_BYTES[c] for c in _JSON.id_to_token(i)) for i in range(50256))
    assert _SIDE_B.token[_PIECES.piece_to_id("<0x0A>")] == b"\n" and _SIDE_B.token[_PIECES.piece_to_id("▁the")] == b" the"


@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_groups_of_any_texts(texts):
    a, b = alignment.encoded(texts)
    made = alignment.align(alignment._side_a(None).length[a.ids], _SIDE_B.length[b.ids])
    plain = [plain_links(t) for t in texts]
    assert alignment.group_digests(a, b, made) == [hashlib.sha256(p[3].encode()).hexdigest() if p[3] else "" for p in plain]
    assert list(zip(a.ids[made.link_a].tolist(), b.ids[made.link_b].tolist(), strict=True)) == [x for p in plain for x in p[2]]
