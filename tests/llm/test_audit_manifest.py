"""The filter audit and the Merkle manifest against brute force, and the cases that their docstrings define."""

import hashlib
import itertools
import re
import zlib

import pytest

from tallyleaf.llm import filter_audit, merkle_manifest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def odd_rows():
    """Repeated rows and ids, nulls in each column, empty and very long texts, ties."""
    long = " ".join(f"w{k % 700}" for k in range(40_000))
    rows = [(k, f"text {k} with a few words", ["en", "de", None, "é", ""][k % 5 if k % 3 else 0], f"s{k % 3}", k) for k in range(40)]
    rows += [(50, "LOUD TEXT $", "en", "s1", 9), (51, "LOUD TEXT $", "en", None, 9), (52, "LOUD TEXT $", None, "", None), (50, "LOUD TEXT $", "en", "s1", 9), (50, "LOUD TEXT $", "en", "s2", 9)]
    rows += [(60, None, None, None, None), (61, "", "fr", "s1", 0), (62, None, "fr", "s1", 2**63 - 1), (None, "LOUD TEXT $", "en", "s1", 1), (None, "", "en", "s1", None), (None, "", "en", "s1", None)]
    rows += [(70, long, "en", "s1", len(long)), (71, long, "en", "s2", len(long)), (72, "Ab " * 300, "en", "s2", 3), (-5, "text 1 with a few words", "en", "s9", 1), (73, " \n\t\x0b ", "en", "s2", 5)]
    return rows


def audit_brute(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, *_ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    parts = {}
    for d, text, _, source, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        parts.setdefault(source or "", []).append((d, {f for f in fails if fails[f]}))
    out = set()
    for part, docs in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        found = []
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [(d, fails) for d, fails in docs if f in fails and not fails & before]
                removed_by[f] += len(gone)
                kept = sum(not fails & (before | {f}) for _, fails in docs)
                redundant = sum(f in fails and bool(fails & before) for _, fails in docs)
                found.append([part, "".join(order), step, kept, len(gone), redundant, sum(fails == {f} for _, fails in docs), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)])
        out |= {(*r, removed_by[r[1][r[2] - 1]]) for r in found}
    return out


def test_audit_brute(spark):
    rows, labels = odd_rows(), [(k, k % 2, int(k % 3 == 0)) for k in range(20)] + [(50, 1, None), (50, 0, 1), (51, 1, 1), (None, 1, 1), (70, None, None), (71, 1, 0)]
    docs = spark.createDataFrame([(*r, "x", 1, b"d") for r in rows], ROWS + ", part string, mask int, digest binary").repartition(3)
    marks = spark.createDataFrame([(*r, "x") for r in labels], LABELS + ", part string")
    got = filter_audit.audit(docs, marks).collect()
    assert len(got) == 600 * len({r[3] or "" for r in rows})
    assert set(map(tuple, got)) == audit_brute(rows, labels)
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert got[0].__fields__ == names


def test_audit_empty(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(spark.createDataFrame([], ROWS), none).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None, None, None)], ROWS), none).collect()
    assert len(one) == 600 and {r.removed for r in one if r.filter_order[r.step - 1] == "A"} == {1} and {r.part for r in one} == {""}


def test_audit_recursion_has_all_prefixes(spark):
    steps = filter_audit.prefix_steps(spark, spark.createDataFrame([(m,) for m in range(32)], "mask int"))
    assert steps.count() == 325 * 32 and steps.select("prefix").distinct().count() == 325


def H(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def tree(leaves):
    """All levels of the tree over a list of hex digests."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[k : k + 2]) for k in range(0, len(last), 2)])
    return levels


def way(levels, k):
    """The others of each run on the way up, with their side."""
    out = []
    for level in levels[:-1]:
        other = k ^ 1
        out.append((None, None) if other >= len(level) else (level[other], other < k))
        k //= 2
    return out


def manifest_brute(rows):
    def leaf(d, text, lang, source, n):
        return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, source, lang, n, text)))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = tree([x[2] for x in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    root = top[-1][0]
    out = []
    for at, g in enumerate(order):
        for k, (_, _, node, r) in enumerate(groups[g]):
            steps = way(trees[g], k) + way(top, at)
            d, text, lang, source, n = r
            now = leaf(d, text, lang, source, n + 1) if d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0 else node
            for other, left in steps:
                now = H(now) if other is None else H(other, now) if left else H(now, other)
            out.append((d, node, trees[g][-1][0], root, H(*(o for o, _ in steps if o)), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 3, 10])
def test_manifest_brute(spark, levels):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ROWS + ", grp string, rank int, node int").repartition(3)
    got = merkle_manifest.manifest(docs, levels).collect()
    assert sorted(map(tuple, got), key=str) == manifest_brute(rows)
    assert {r.verified for r in got} == {True, False}


def test_manifest_many_groups(spark):
    rows = [(k, "t", f"l{k % 37}", "s", k) for k in range(90)]
    assert sorted(map(tuple, merkle_manifest.manifest(spark.createDataFrame(rows, ROWS), 2).collect()), key=str) == manifest_brute(rows)


def test_manifest_small(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], ROWS)).count() == 0
    one = merkle_manifest.manifest(spark.createDataFrame([(1, "x", None, None, 1)], ROWS)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == H() and one.verified


@pytest.mark.parametrize("levels", [2, 3])
def test_positions(levels):
    """Each node's closed-form place in the log holds that node, for any number of leaves."""
    for n in range(1, (1 << levels) + 1):
        nodes = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
        for block in {0, 1} if n < 1 << levels else {0}:
            log = merkle_manifest.append_log(nodes, block, levels)
            places, level = [], nodes
            for h in range(merkle_manifest.height(n, block, levels) + 1):
                for k, node in enumerate(level):
                    at = merkle_manifest.position(h, k, n)
                    assert log[32 * at : 32 * at + 32] == node
                    places.append(at)
                level = [merkle_manifest.digest(*level[k : k + 2]) for k in range(0, len(level), 2)]
            assert sorted(places) == list(range(len(log) // 32))
