"""The registered text queries against brute force, on every column that their contract names, over a whole small table."""

import collections
import hashlib
import itertools
import re
import zlib

import pytest

from tallyleaf.llm import catalog, packing

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def result(spark, name):
    rows = catalog.QUERIES[name](spark, DATA).collect()
    return {r.doc_id: r for r in rows}, len(rows)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def luhn(digits):
    total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
}
SECRETS = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6), "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


@pytest.mark.parametrize("name, kinds", [("op1_personal_data", PERSONAL), ("op6_secrets", SECRETS)])
def test_base_spans(spark, docs, name, kinds):
    got, n = result(spark, name)
    assert n == len(docs) == len(got)
    order = list(kinds)
    for d, text in docs.items():
        found = sorted((m.start(), order.index(kind), kind, m.end()) for kind, (pattern, ok) in kinds.items() for m in re.finditer(pattern, text) if ok(m))
        base = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)
        assert got[d].base_sha256 == sha(base), d
        assert [got[d][f"n_{k}"] for k in order] == [sum(f[2] == k for f in found) for k in order]
        spans = got[d].spans.split(",") if got[d].spans else []
        assert set(base.split(",")) - {""} <= set(spans)
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts) and all(int(s.split(":")[2]) <= len(text) for s in spans)


def test_op2(spark, docs):
    got, n = result(spark, "op2_ngram_join")
    assert n == len(docs)
    sets = {}
    for d, text in docs.items():
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        sets[d] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(docs, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 90 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == {d: (len(sets[d]), find(d)) for d in docs}


def test_op3(spark, docs):
    got, n = result(spark, "op3_suffix_dedup")
    assert n == len(docs)
    texts = {d: t.encode() for d, t in docs.items()}
    seen = collections.Counter(hash(t[k : k + 400]) for t in texts.values() for k in range(len(t) - 399))
    for d, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(t, gone) if not g)
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)), d


def test_op4(spark, docs):
    got, n = result(spark, "op4_window_dedup")
    assert n == len(docs)
    words = {d: WORD.findall(t) for d, t in docs.items()}
    first = {}
    for d in sorted(words):
        w = words[d]
        for k in range(len(w) - 49):
            first.setdefault(hash(tuple(w[k : k + 50])), d)
    for d, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[hash(tuple(w[k : k + 50]))] < d:
                gone[k : k + 50] = [True] * 50
        r = got[d]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))), d


def test_op5(spark, docs):
    from tokenizers import Tokenizer

    rows = catalog.QUERIES["op5_packing"](spark, DATA).collect()
    tokens = Tokenizer.from_file(packing.default_tokenizer())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by.keys() == docs.keys()
    total = 0
    for d, pieces in by.items():
        ids = [*tokens.encode(docs[d], add_special_tokens=False).ids, 2]
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // 1024))) and all(r.length == 1024 for r in pieces[1:])
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
        total += at
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= 1.02 * -(-total // 1024) + 1


def test_op7(spark, docs):
    got, n = result(spark, "op7_media")
    assert n == len(docs)
    for d, t in docs.items():
        body = t.encode()
        whole = body + b"\xff" * (max(1, -(-len(body) // 576)) * 576 - len(body))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(whole), sha(whole), zlib.crc32(whole[-32:])), d
        assert r.media_bytes > len(whole)
    same = collections.defaultdict(set)
    for d, t in docs.items():
        same[t].add((got[d].media_sha256, got[d].feature))
    assert all(len(x) == 1 for x in same.values())


def test_op9(spark, docs):
    """Every document that holds a benchmark item word for word is found."""
    items = {r.item_id: WORD.findall(r.text or "") for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    padded = {d: " " + " ".join(WORD.findall(t)) + " " for d, t in docs.items()}
    want = {d for d, t in padded.items() if any(len(w) >= 6 and " " + " ".join(w) + " " in t for w in items.values())}
    rows = catalog.QUERIES["op9_decontaminate"](spark, DATA).collect()
    assert want <= {r.doc_id for r in rows}


def test_op10(spark, docs):
    got, n = result(spark, "op10_toxicity")
    assert n == len(docs)
    for d in docs:
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    same = collections.defaultdict(set)
    for d, t in docs.items():
        same[t].add(got[d].score)
    assert all(len(x) == 1 for x in same.values())


def test_op13(spark, docs):
    got, n = result(spark, "op13_quality_rules")
    assert n == len(docs)
    for d, t in docs.items():
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)), d
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r.base_failed and r.kept)
