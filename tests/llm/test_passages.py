"""Substring dedup at its shipped parameters: against a brute-force version, on planted passages and near copies, and its edges."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.llm import passages
from quiverlake.llm import textvec as tv

WIDTH, SPREAD, LEAST = 28, 20, 40


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 5) for i, t in rows], "doc_id long, text string, content int, key string, start int")


def words(text):
    return [(m.start(), m.end(), m[0].encode().lower()) for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text or "")]


def word_hash(w):
    return int(tv.hashes(np.frombuffer(w + b" ", np.uint8), np.array([0]), np.array([len(w)]))[0])


def spans(text):
    """First words, and the words after the last, of natural and of sliding paragraphs."""
    w = words(text)
    natural, lines, at, blank = set(), [], 0, True
    for line in (text or "").split("\n"):
        n = len(words(line))
        if n:
            if blank:
                lines.append([])
            lines[-1].append((at, at + n))
        blank = not n
        at += n
    for block in lines:
        natural |= {x for x in block if x[1] - x[0] >= LEAST}
        if block[-1][1] - block[0][0] >= LEAST:
            natural.add((block[0][0], block[-1][1]))
    if len(w) >= 5:
        natural.add((0, len(w)))
    h = np.array([word_hash(x[2]) for x in w], np.uint64)
    v, picked, kept, first = tv.shingles(h, 3).tolist(), [], [], None
    for p in range(len(v)):
        if any(v[p] == min(v[max(0, s) : s + SPREAD]) for s in range(p - SPREAD + 1, p + 1)):
            if not picked or v[picked[-1]] != v[p] or p - picked[-1] >= SPREAD:
                first = p
                kept.append(p)
            elif (p - first) // SPREAD != (picked[-1] - first) // SPREAD:
                kept.append(p)
            picked.append(p)
    return w, natural, [(p, p + WIDTH) for p in kept if p + WIDTH <= len(w)]


def brute(rows, similarity=0.8):
    found = {}  # by content: the shingles of a natural paragraph, or None, and where it is
    for i, t in dict.fromkeys(rows):
        if i is None:
            continue
        w, natural, sliding = spans(t)
        for a, b in [*natural, *sliding]:
            own = tuple(x[2] for x in w[a:b])
            sets = frozenset(own[k : k + 5] for k in range(len(own) - 4)) if (a, b) in natural else None
            was = found.setdefault(own, [None, set()])
            was[0] = was[0] or sets
            was[1].add((i, w[a][0], w[b - 1][1]))
    nodes = list(found.values())
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for x, (s, _) in enumerate(nodes):
        for g in s or ():
            holders[g].append(x)
    for x, (s, _) in enumerate(nodes):
        for y in {y for g in s or () for y in holders[g] if y < x}:
            t = nodes[y][0]
            if len(s & t) >= similarity * len(s | t):
                parent[root(x)] = root(y)
    groups = defaultdict(set)
    for x, (_, places) in enumerate(nodes):
        groups[root(x)] |= places
    gone = defaultdict(set)
    for g in groups.values():
        keep = min(p[0] for p in g)
        for i, s, e in g:
            if i != keep:
                gone[i].add((s, e, keep))
    out = []
    for i, own in gone.items():
        merged = []
        for s, e, k in sorted(own):
            if merged and merged[-1][1] >= s:
                r = merged[-1]
                merged[-1] = (r[0], max(r[1], e), min(r[2], k), r[3] + 1)
            else:
                merged.append((s, e, k, 1))
        out += [(i, *r) for r in merged]
    return sorted(out)


def test_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()][:120]
    rng = random.Random(4)
    base = [t for _, t in rows if len(t.split()) > 200][:8]
    for n, t in enumerate(base):  # copies with a few words changed, and a passage set into another text
        w = t.split(" ")
        for _ in range(4):
            w[rng.randrange(len(w))] = "changed"
        rows.append((2000 + n, " ".join(w)))
        rows.append((2100 + n, f"own words {n} before it " + " ".join(base[n - 1].split()[30:90]) + " and after"))
    rows += [(3000, None), (3001, ""), (3002, "short text"), (3003, base[0]), (3003, base[0]), (None, base[0]), (3004, "Ä🙂 " + base[1].upper()), (3005, "loop " * 300), (3006, "loop " * 290 + "end"), (3007, "ab cd " * 60), (3008, "x " + "ab cd " * 70)]
    rows += [(3009, "five words are a paragraph"), (3010, "Five words ARE a paragraph\n"), (3011, " \n\t\n"), (3012, "a b c d e\n\nf g h i j\n\n" * 9), (3013, "a b c d e\n \nf g h i j\n\n" * 9)]
    expected = brute(rows)
    assert len(expected) > 20
    for chunk in (256, 3):
        got = sorted(tuple(r) for r in passages.repeated_passages(table(spark, rows), chunk=chunk).collect())
        assert got == expected
    assert passages.repeated_passages(table(spark, [])).count() == 0


def text(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def test_planted(spark):
    """Every passage of 50 words or more inside longer lines is found, with fewer than ``SPREAD`` words left at either end; other documents stay."""
    rng = random.Random(7)
    docs, planted = {i: text(rng, rng.randint(100, 400)) for i in range(400)}, {}
    for p in range(60):
        passage = text(rng, 50 + p % 3 * 30)
        for i in range(p * 4, p * 4 + 2):
            at = rng.randrange(len(docs[i]))
            docs[i][at:at] = passage
            planted[i] = (p, len(" ".join(docs[i][:at])) + (at > 0), len(" ".join(docs[i][: at + len(passage)])))
    found = passages.repeated_passages(table(spark, [(i, " ".join(w)) for i, w in docs.items()]))
    got = {r["doc_id"]: r for r in found.collect()}
    assert set(got) == {p * 4 + 1 for p in range(60)}
    for i, r in got.items():
        _, start, end = planted[i]
        whole = " ".join(docs[i])
        assert r["kept_doc_id"] == i - 1 and start <= r["start"] < r["end"] <= end
        assert len(whole[start : r["start"]].split()) < SPREAD and len(whole[r["end"] : end].split()) < SPREAD


def test_near_copies(spark):
    """Paragraphs of 50 to 150 words with an inner word changed, kept at 0.8 by definition: recall of the shipped bands."""
    rng, rows, n = random.Random(3), [], 600
    for k in range(n):
        line = text(rng, rng.randint(50, 150))
        rows.append((2 * k, " ".join(text(rng, 45)) + "\n" + " ".join(line)))
        line[rng.randrange(5, len(line) - 5)] = "changed"
        rows.append((2 * k + 1, "\n".join([" ".join(text(rng, 45)), " ".join(line)])))
    got = {r["doc_id"]: r for r in passages.repeated_passages(table(spark, rows)).collect()}
    whole = sum(2 * k + 1 in got and rows[2 * k + 1][1][got[2 * k + 1]["start"] : got[2 * k + 1]["end"]] == rows[2 * k + 1][1].split("\n")[1] for k in range(n))
    print("recall", whole / n)
    assert whole >= 0.95 * n and not any(i % 2 == 0 for i in got)


@pytest.mark.parametrize("chunk", [256, 16])
def test_large_group(spark, chunk):
    """Near copies of one paragraph, far more than a chunk holds, and a second group that shares bands with it."""
    rng = random.Random(9)
    base = text(rng, 120)
    rows = []
    for i in range(500):
        w = list(base)
        w[rng.randrange(120)] = f"c{i}"
        rows.append((i, " ".join(w)))
    got = passages.repeated_passages(table(spark, rows), chunk=chunk).collect()
    assert {r["doc_id"] for r in got} == set(range(1, 500)) and {r["kept_doc_id"] for r in got} == {0}


def test_long_text(spark):
    rng = random.Random(13)
    long, passage = text(rng, 60_000), text(rng, 60)
    rows = [(1, " ".join(long[:30_000] + passage + long[30_000:])), (2, " ".join([*text(rng, 9), *passage, *text(rng, 9)])), (3, " ".join(long))]
    got = {r["doc_id"]: r for r in passages.repeated_passages(table(spark, rows)).collect()}
    assert set(got) == {2, 3} and got[2]["kept_doc_id"] == got[3]["kept_doc_id"] == 1


def test_cut(spark):
    docs = table(spark, [(1, "abcdef"), (1, "abcdef"), (2, None), (3, "xyz"), (None, "abc")])
    gone = spark.createDataFrame([(1, 1, 3, 0, 1), (1, 4, 5, 0, 1), (2, 0, 4, 0, 1)], "doc_id long, start long, end long, kept_doc_id long, n_paragraphs long")
    out = passages.cut(docs, gone)
    assert out.columns == docs.columns and sorted((r["doc_id"] or -1, r["text"]) for r in out.collect() if r["text"]) == [(-1, "abc"), (1, "adf"), (1, "adf"), (3, "xyz")]
    assert passages.cut(docs.limit(0), gone).count() == 0 and passages.cut(docs, gone.where(F.lit(False))).count() == 5
