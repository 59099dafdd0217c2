"""Operators on documents against brute-force versions, with nulls, empty and repeated rows, and clashing names."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quiverlake.llm import bpe, decontaminate, line_dedup, quality, simhash
from quiverlake.llm.components import connected_components
from quiverlake.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, 7, "k") for i, t in rows], SCHEMA)


def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


EDGES = [(5, None), (6, ""), (7, " \t"), (8, "Same line of text\nsame LINE of text \nshort\n"), (3, "same line of text"), (8, "Same line of text\nsame LINE of text \nshort\n"), (None, "same line of text\nown line of it"), (9, "a\n\n\nb" * 3000), (10, "ÄÖ same line\x0b"), (11, "ÄÖ same line")]


def brute_lines(rows):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
        return k if len(k) >= 10 else None

    order = lambda i: 2**63 - 1 if i is None else i
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line):
                first[key(line)] = min(first.get(key(line), 2**63), order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or first[key(x)] == order(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 7])
def test_lines(spark, sf, batches):
    rows = documents(spark, sf) + [(1000 + i if i else i, t) for i, t in EDGES]
    out = line_dedup.dedup_lines(table(spark, rows), batches=batches, fanout=2)
    assert out.columns == [*table(spark, []).columns, "n_lines", "n_dropped"]
    assert sorted([tuple(r) for r in out.select("doc_id", "text", "n_lines", "n_dropped").collect()], key=repr) == brute_lines(rows)
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0
    assert {r[0] for r in out.select("pos").collect()} == {7}


def test_runs_are_sorted_once(spark):
    """A batch that meets a run sorts itself alone."""
    store = line_dedup.LineRuns(spark)
    frame = spark.range(1000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"), F.col("id").alias("owner"))
    try:
        store.add(frame)
        with line_dedup._in_order(spark):
            batch = frame.groupBy("h1", "h2").agg(F.min("owner").alias("owner"))
            plan = batch.join(spark.table(store.runs()[0]).hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1, plan
        assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"
    finally:
        store.close()


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_simhash(spark, sf):
    rows = documents(spark, sf) + [(1000 + i, t) for i, t in {5: None, 6: "", 7: "one", 8: "one two", 9: "ONE\ttwo", 10: " ".join(f"w{k % 977}x{k % 31}" for k in range(150_000))}.items()]
    got = {r[0]: (r[1], r[2]) for r in simhash.simhash_components(table(spark, rows)).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    groups = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i, _ in rows}
    again = simhash.simhash_components(table(spark, [*rows[:20], rows[3], (None, rows[3][1])])).collect()
    assert len(again) == 22 and [r[2] for r in again if r[0] is None] == [None]
    assert simhash.simhash_components(table(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [8, 2048])
def test_dense_fingerprints(spark, chunk):
    rng = np.random.default_rng(5)
    prints = set()
    for _ in range(12):  # chains and balls of near fingerprints
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(60):
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints = dict(enumerate(sorted(prints)))
    classes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in prints.items()], "fp long, rep long")
    got = {r[0]: r[1] for r in connected_components(simhash.fingerprint_links(classes, chunk=chunk)).collect()}
    want = brute_components(prints)
    assert {i: got.get(i, i) for i in want} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 100), (7, 7), (60, 100)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 100: 50, 60: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, sf):
    rows = documents(spark, sf)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    words = rows[0][1].split()
    items += [(900, None), (901, " ,. "), (902, " ".join(words[5:8])), (903, " ".join(words[10:60])), (903, "x y z"), (904, " ".join(rows[1][1].split()[:16]))]
    rows += [(1000, None), (1001, ""), (1002, " ".join(words[10:34]) + " and then " + " ".join(words[34:60])), (None, "X, y. z!"), (1003, ("w " * 5000) + items[0][1].upper())]
    import re

    toks = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = []
    for i, t in items:
        w = toks(t)
        own = grams(w, min(5, len(w))) if w else set()
        for d, text in rows:
            if own and (n := len(own & grams(toks(text), min(5, len(w))))) >= 0.8 * len(own):
                want.append((d, i, len(own), n, n / len(own)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.contaminated(table(spark, rows), bench).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 5
    blocks = [tuple(r) for r in decontaminate.contaminated(table(spark, rows), bench, block=10).collect()]
    assert sorted(blocks, key=repr) == sorted(want, key=repr)
    assert decontaminate.contaminated(table(spark, []), bench).count() == 0
    assert decontaminate.contaminated(table(spark, rows), bench.limit(0)).count() == 0


def test_bpe(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation(), t.no_padding()
    rows = documents(spark, sf) + [(1000, None), (1001, ""), (1002, "a<|endoftext|>b  <|endoftext|> c"), (1003, "aaaaaaaaaaaaaaaaaaaa" * 50 + "　 x\t\n  y"), (1004, "naïve 日本語 🙂🙂 'll don't ²½ \x00\x7f"), (1004, "x"), (None, "x" * 9999)]
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    path = tokenizer_path()
    got = [(r[0], r[1], bytes(r[2]), r[3]) for r in bpe.decode(bpe.encode(table(spark, rows), path), path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    both = bpe.round_trip(table(spark, rows), path).collect()
    assert sorted([(r[0], r[1], bytes(r[2]), r[3]) for r in both], key=repr) == sorted(want, key=repr) and all(r["intact"] for r in both)
    assert bpe.encode(table(spark, []), path).count() == bpe.round_trip(table(spark, []), path).count() == 0


def test_bpe_small_automaton():
    """All words over two letters, against merging by rank, with merges of equal parts and of overlapping parts."""
    import itertools
    import json

    for merges in (["a a", "aa a", "b a"], ["a b", "b b", "ab ab", "bb a", "a a"], ["a a", "aa aa", "b aa", "a b"]):
        vocab = {"a": 0, "b": 1}
        for m in merges:
            vocab[m.replace(" ", "")] = len(vocab)
        own = bpe.Automaton(json.dumps({"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "pre_tokenizer": {"type": "ByteLevel"}, "normalizer": None, "added_tokens": []}))
        for n in range(1, 11):
            for word in map("".join, itertools.product("ab", repeat=n)):
                parts = list(word)
                for m in merges:
                    x, y = m.split()
                    i, out = 0, []
                    while i < len(parts):
                        if parts[i : i + 2] == [x, y]:
                            out.append(x + y)
                            i += 2
                        else:
                            out.append(parts[i])
                            i += 1
                    parts = out
                assert own.word(word.encode()) == [vocab[p] for p in parts], (merges, word)
    spec = {"model": {"type": "BPE", "vocab": {"a": 0}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel"}, "normalizer": None, "added_tokens": [{"id": 1, "content": "<x>", "lstrip": True}]}
    with pytest.raises(ValueError, match="added tokens"):
        bpe.Automaton(json.dumps(spec))
    assert not own.arc(vocab["a"], vocab["a"]) and own.arc(vocab["aa"], vocab["a"])  # the first gadget takes a from the state after a; the state after aa is the copy made before


def test_quality(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit, held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0), labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    out = quality.classify(docs.withColumn("keep", F.lit(1)), fit)
    assert out.count() == docs.count()
    r = out.join(held, "doc_id").select(((F.col("quality_score") >= 0.5) == (F.col("quality") == 1)).cast("int").alias("q"), "quality", "keep").collect()
    assert np.mean([x[0] for x in r]) > 0.9
    empty = quality.classify(table(spark, [(1, None), (None, "x"), (2, "")]), labels.limit(0)).collect()
    assert [x["keep"] for x in empty] == [True] * 3
    assert quality.classify(table(spark, []), labels).count() == 0
    assert quality.classify(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), labels).count() == 1


def test_quality_brute_force(spark, sf):
    """Scores against a model applied row by row, and the pseudo-labels of a round against a choice from all rows at once."""
    import pyarrow as pa

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9001, "", "en", "s", 0), (9002, rows[0][1], "xx", "new", -4), (None, rows[1][1], "en", "s", 3), (9003, "word " * 60_000, "de", "s", 300_000), (rows[0][0], rows[0][1] + " more", "en", "s", 1)]
    frame = spark.createDataFrame([(*r, True, 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, keep boolean, pick double")
    model, views, _ = quality._fit(frame, labels, min_count=2)
    assert model.targets["quality"].constant is None

    def score(r):
        got = quality._matrices(pa.record_batch(quality._views(*([x] for x in r[1:]), model.index), ["d0", "h0", "d1", "h1"]), len(model.index))
        return tuple(float(x[0]) for x in model.scores(got))

    want = sorted((r[0] or -1, *map(lambda x: round(x, 6), score(r))) for r in rows)
    out = quality.classify(frame, labels, min_count=2).collect()
    assert sorted((r["doc_id"] or -1, round(r["quality_score"], 6), round(r["toxic_score"], 6)) for r in out) == want
    assert all(r["keep"] == (r["quality_score"] >= 0.5 and r["toxic_score"] < 0.5) for r in out)
    good = quality.good_documents(frame, labels, min_count=2)
    assert good.columns == frame.columns and sorted((r["doc_id"] or -1, r["text"] or "", r["pick"]) for r in good.collect()) == sorted((r[0] or -1, r[1] or "", 1.5) for r in rows if (s := score(r))[0] >= 0.5 > s[1])
    targets = list(model.targets.values())
    for quota, taken in ((5, {}), (1000, {2: {0}})):
        found = quality.sure_rows(views.repartition(7), targets, len(model.index), 0.9, quota, taken).collect()
        table_ = views.toArrow().combine_chunks()
        x, pick = quality._matrices(table_, len(model.index)), table_.column("pick").to_pylist()
        want = set()
        for t, own in enumerate(targets):
            for v in (0, 1) if own.constant is None else ():
                odds = own.models[v].odds(x[v])
                for label in (0, 1):
                    sure = sorted(p for p, o in zip(pick, odds if label else -odds, strict=True) if o >= np.log(9))[:quota]
                    want |= {(4 * t + 2 * v + label, p) for p in sure}
        assert {(r["number"], r["pick"]) for r in found} == want and len(found) <= 8 * quota


def test_toxic_words(spark):
    """Held-out documents with telling words, and with telling beginnings of words, are found; clean ones stay."""
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    rows = []
    for i in range(2000):
        w = [word() for _ in range(60)]
        toxic = i % 8 == 0
        for at in range(0, 60, 10) if toxic else ():
            w[at] = rng.choice(["nasty", "vile"]) if i % 16 else "zorgl" + word()
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t, "en", "s", 9) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 3 and 1, x) for i, _, x in rows if i % 5], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxic_score"] >= 0.5 for r in quality.classify(docs, labels).collect()}
    held = [(got[i], bool(x)) for i, _, x in rows if i % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.98 * len(held) and sum(a and b for a, b in held) >= 0.95 * sum(b for _, b in held)


def brute_contaminated(rows, items):
    """Places of the rows that hold 0.8 of an item's distinct shingles."""
    import re

    def grams(text, n=None):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        n = n or min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set(), n

    out = set()
    for t in items:
        own, n = grams(t)
        out |= {k for k, (_, text) in enumerate(rows) if own and len(own & grams(text, n)[0]) >= 0.8 * len(own)}
    return out


def edges(spark, sf):
    """The documents with nulls, empty, repeated and very long rows, and extra columns with clashing names."""
    rows = [(*r, 1, "x", 2) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    text, item = rows[0][1], spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows += [(9000, None, None, None, None, 1, "x", 2), (9001, "", "en", "s", 0, 1, "x", 2), (9002, text, "en", "s", 5, 1, "x", 2), (9002, text, "en", "s", 5, 1, "x", 2), (9003, text + " " + item, "en", "s", 5, 1, "x", 2), (9003, "own " + text, "en", "s", 5, 1, "x", 2), (None, rows[1][1], "en", "s", 5, 1, "x", 2), (9004, (text + "\n") * 400, "en", "s", 5, 1, "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep int, fp string, component_id int")


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = edges(spark, sf)
    rows = [tuple(r)[:2] for r in docs.select("doc_id", "text").collect()]
    items = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    order = lambda own: sorted(((i, t or "") for i, t in own), key=repr)
    groups = brute_components({i: brute_print(t) for i, t in rows if i is not None and i != 9003} | {9003: brute_print(rows[-4][1])})
    dirty = brute_contaminated(rows, items)
    want = {
        "line dedup": order((i, t) for i, t, *_ in brute_lines(rows)),
        "benchmark decontamination": order(r for k, r in enumerate(rows) if k not in dirty),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.names == docs.columns
        got = order((r["doc_id"], r["text"]) for r in out.collect())
        assert name not in want or got == want[name], name
        if name == "SimHash near-dedup":
            plain = {i for i, g in groups.items() if i != g and i != 9003 and g != 9003}
            assert not plain & {i for i, _ in got} and (None, rows[1][1]) in got and [i for i, _ in got].count(9000) == 1 and 9001 not in {i for i, _ in got}
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    out = corpus_pipeline.bpe_stage(spark, docs, sf)
    assert out.count() == len(rows) and out.where("intact").count() == len(rows) and corpus_pipeline.bpe_stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline(spark, sf):
    """run() against brute-force versions of all stages but the classifier, whose decisions test_quality_brute_force covers, and the tokenizers library."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    got = {r["doc_id"]: (r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"], r["intact"]) for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keep = {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("keep").collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if r["doc_id"] in keep]
    rows = [(i, t) for i, t, *_ in brute_lines(rows)]
    groups = brute_components({i: brute_print(t) for i, t in rows})
    rows = [(i, t) for i, t in rows if groups[i] == i]
    dirty = brute_contaminated(rows, [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()])
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation(), t.no_padding()
    want = {}
    for k, (i, text) in enumerate(rows):
        if k not in dirty:
            ids = t.encode(text, add_special_tokens=False).ids
            want[i] = (len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), True)
    assert got == want and len(got) > 50
