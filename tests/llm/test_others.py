"""Chat, secrets, language model and nearest neighbours against brute-force versions and held-out checks."""

import itertools
import math
import random
import re
import string
import sysconfig
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quiverlake.llm import ann, chat, lm, queries, secrets

HARD = "</s>[INST] ok [/INST]"


def digest(text):
    return sha256(text.encode()).hexdigest()


def test_chat(spark, sf, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(900, 1, "assistant", "\\</s>\\\\<s>[/INST][INST"), (900, 0, None, None), (900, 1, "assistant", "b\n"), (900, None, "user", "first"), (901, 0, "user", "only\\"), (None, 0, "assistant", "x🙂"), (902, 3, "assi</s>[/INST]", "[/INST]"), (903, 0, "assistant", None), (904, 0, "", "")]
    frame = spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id long, turn long, role string, text string, example string, n int")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in queries.op2_chat(spark, str(tmp_path)).collect()}
    groups = defaultdict(list)
    for c, t, role, text in [*rows, (-7, 0, "user", HARD), (-7, 1, "assistant", HARD)]:
        groups[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x[2] for x in turns if x[1] == "assistant")
        assert got[c][:4] == (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), digest(loss)), c
    examples = chat.expand(frame).where("conv_id = -7 or conv_id = 0").orderBy("example").collect()
    assert all(0 <= e["loss_start"] <= e["loss_end"] <= len(e["text"]) for e in examples)
    assert all("[INST" not in e["text"][e["loss_start"] : e["loss_end"]] for e in examples)
    assert chat.read_back(chat.expand(frame.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.Template(end="a\\")


def test_long_conversation(spark):
    """Hundreds of turns, one of them very long, with ties and repeated rows."""
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i} [INST] \\") for i in range(300)] + [(1, 300, "assistant", "x</s>" * 40_000), (1, 300, "assistant", "tie"), (1, 300, "assistant", "tie"), (2, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.expand(frame)).collect()}
    turns = sorted((t, r, x) for c, t, r, x in rows if c == 1)
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r, x) for _, r, x in turns]
    assert out[1]["loss"] == "".join(x for _, r, x in turns if r == "assistant") and out[2]["loss"] == "" and len(out[2]["turns"]) == 1


def brute_secrets(text):
    spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
    spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [sum(s[1] == k for s in spans) for k in range(3)], ",".join(s[2] for s in sorted(spans))


def markov_score(table, token):
    return sum(round(table[ord(a) * 128 + ord(b)], 5) for a, b in itertools.pairwise(token))


def test_secrets_held_out(spark, sf):
    """Identifiers of Python's library and random strings of another generator and other lengths, none of which trained."""
    names = set()
    for f in sorted(Path(sysconfig.get_path("stdlib")).glob("*.py")):
        names |= {x for x in re.findall(r"\b[A-Za-z_][A-Za-z0-9_]{15,}\b", f.read_text(errors="ignore")) if not re.search("[0-9a-f]{12}", x)}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table, rng = secrets.ratios(secrets.labelled_sample(docs, 4000, 6000)), random.Random(8)
    flagged = sum(markov_score(table, x) >= 10.0 for x in names) / len(names)
    print("identifiers flagged", flagged, "of", len(names))
    assert flagged < 0.01
    for alphabet in ("0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits):
        for size in (20, 24, 40):
            found = sum(markov_score(table, "".join(rng.choice(alphabet) for _ in range(size))) >= 10.0 for _ in range(500)) / 500
            assert found >= 0.98, (alphabet, size, found)


def test_secrets(spark, sf, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    token = "q7Zx0PfL2vRt9WkYb3NcHd8E"
    rows += [(9000, None), (9001, ""), (9002, "🙂 é TOKEN = 'abc.def=' secret:token:abcdef ſecret=1234567 api_key=\"short\""), (9003, "AKIAAKIA" + "A1" * 9 + " " + "a" * 23 + " " + "0f" * 12), (9004, " ".join(["password: abcdef0"] * 3000)), (9004, "x"), (None, token), (9005, f"get_default_configuration_value and {token}!")]
    frame = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, markov string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(r) for r in queries.op3_secrets(spark, str(tmp_path)).collect()], key=repr)
    want = []
    for i, t in rows:
        counts, listed = brute_secrets(t or "")
        want.append((i, *counts, digest(listed)))
    assert [g[:5] for g in got] == sorted(want, key=repr)
    said = {g[0]: g[5] for g in got}
    assert said[None] == f"markov:0:{len(token)}" and said[9005] == "markov:36:60"
    for g in got:  # base spans stay
        base = set(brute_secrets(dict(rows)[g[0]] or "")[1].split(",")) - {""}
        assert g[0] == 9004 or base <= set(g[5].split(","))
    table = secrets.ratios(secrets.labelled_sample(frame, 4000, 6000))
    for i, t in rows:  # the method's spans against scores taken one by one
        markov = [f"markov:{m.start()}:{m.end()}" for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", t or "") if markov_score(table, m[0]) >= 10.0]
        assert i == 9004 or [x for x in said[i].split(",") if x.startswith("markov")] == markov
    plain = [g for g in got if g[0] is not None and g[0] < 9000 and not any(g[1:4])]
    assert sum("markov" in g[5] for g in plain) <= 0.03 * len(plain)
    assert secrets.scan(frame.limit(0)).count() == 0


def brute_model(rows, order):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count, context, fan = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = ["<", *words(t)]
            for k in range(1, len(w)):
                for n in range(1, order + 1):
                    if k - n + 1 >= 0:
                        gram = tuple(w[k - n + 1 : k + 1])
                        count[gram] += 1
                        context[gram[:-1]] += 1
    for gram in count:
        fan[gram[:-1]] += 1
    n, v = context[()], fan[()]
    d = {}
    for k in range(2, order + 1):
        once, twice = (sum(c == m for g, c in count.items() if len(g) == k) for m in (1, 2))
        d[k] = min(0.95, max(0.05, once / (once + 2 * twice))) if once and twice else 0.5

    def p(gram):
        if len(gram) == 1:
            return (count[gram] + 1) / (n + v + 1)
        h = gram[:-1]
        if not context[h]:
            return p(gram[1:])
        return (max(count[gram] - d[len(gram)], 0) + d[len(gram)] * fan[h] * p(gram[1:])) / context[h]

    for i, t in rows:
        w = words(t)
        x = ["<", *w]
        score = sum(math.log10(p(tuple(x[max(0, k - order + 1) : k + 1]))) for k in range(1, len(x)))
        yield i, held(i), len(w), sum(count[y,] > 0 for y in w), n, sum(math.log10(p((y,))) for y in w), score


@pytest.mark.parametrize(("order", "block"), [(3, 4 << 20), (2, 60_000), (3, 60_000), (4, 200_000)])
def test_language_model(spark, sf, order, block):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9000, None), (9001, ""), (9002, "\x0b A a\x00 Á á "), (9002, "again"), (None, "the of"), (9003, "w " * 20000), (9004, "w " * 600 + "new words here"), (9005, rows[0][1]), (9005, rows[0][1])]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int")
    got = sorted([tuple(r) for r in lm.score_documents(frame, order=order, block=block, part=block // 2).collect()], key=repr)
    want = sorted(brute_model(rows, order), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)
    assert lm.score_documents(frame.limit(0), order=order).count() == 0


def test_language_model_reads_texts_once(monkeypatch):
    """A block holds its tokens, so that no later stage splits and hashes its texts again; and an arc is searched for only where a state has several."""
    texts = ["A b a\x0bc", "", "b  a B", "a b a b new"]
    batch = pa.record_batch([pa.array([1, None, 3, 4], pa.int64()), pa.array(texts), pa.array([False, False, False, True])], ["doc_id", "text", "held_out"])
    monkeypatch.setattr(lm, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Own", (), {"partitionId": lambda self: 0})())}))
    (blob,) = (x for b in lm._packed(1 << 20)(iter([batch])) for x in b.column("texts").to_pylist())

    def again(*_):
        raise AssertionError("a text is read again")

    monkeypatch.setattr(lm.tv, "words", again)
    monkeypatch.setattr(lm.tv, "hashes", again)
    order = 3
    block = lm.Block(blob, order)
    assert block.sizes.tolist() == [5, 1, 4, 6] and block.ids.to_pylist() == [1, None, 3, 4]
    words = [w for t in texts for w in [*t.lower().split(), None]]
    assert len({*zip(words, block.keys[block.word].tolist(), strict=True)}) == len({*words}) == len(block.keys) - 1
    for n in range(2, order + 1):
        asked = block.requests(n, 1)
        block.fill(n, {p: lm._totals([m])[0][0] for p, m, _ in asked}, 1)
    looked = []
    find = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x: (looked.append(len(v)) if a is automaton.keys else None, find(a, v, *x))[1])
    automaton = lm.Automaton(block, 10, 4, [0.5] * (order - 1))
    assert np.isfinite(automaton.traverse()).all()
    assert sum(looked) < len(words) / 2


@pytest.mark.parametrize("limit", [1 << 20, 1 << 62])
def test_distinct(limit):
    """Codes sorted together with their positions, and codes too wide for that."""
    code = np.random.default_rng(3).integers(0, 50, 400) * (limit // 50)
    where = np.delete(np.arange(410), np.arange(0, 410, 41))
    distinct, place, first = lm._distinct(code, limit, where, 410)
    assert (distinct == np.unique(code)).all() and (distinct[place[where]] == code).all() and (place[::41] == -1).all()
    assert (first == where[np.unique(code, return_index=True)[1]]).all()
    assert [x.tolist() for x in lm._distinct(code[:0], limit, where[:0], 2)] == [[], [-1, -1], []]


def test_nearest(spark, sf):
    sf = sf.replace("0.001", "0.1")
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    bad = [(5000, None), (5050, [0.0] * 64), (5001, [None] + [1.0] * 63), (5100, [math.nan] + [1.0] * 63), (5002, [math.inf] + [1.0] * 63), (None, [1.0] * 64), (5003, []), (5150, [1.0, 0.0]), (0, rows[0][1]), (5200, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(frame, shard=700, block=10).collect()
    x = {i: np.array(v, float) for i, v in [*rows, (5200, rows[0][1])]}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    m /= np.linalg.norm(m, axis=1)[:, None]
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == {i for i in x if i % 50 == 0}
    right = 0
    for q, near in found.items():
        s = m @ m[np.searchsorted(ids, q)]
        best = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:5]
        right += len({v for v, _ in near} & set(best))
        assert len(near) == 5 and near == sorted(near, key=lambda t: (-t[1], t[0]))
        np.testing.assert_allclose([t[1] for t in near], [s[np.searchsorted(ids, v)] for v, _ in near], rtol=1e-9)
    assert right >= 0.95 * 5 * len(found)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.nearest(few).orderBy("rank").collect()] == [2, 1]
    assert ann.nearest(few.limit(0)).count() == 0


def test_nearest_extremes(spark):
    """Components whose squares overflow or vanish."""
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1.0, 0.0]), (3, [-1e200, 1e-200]), (50, [0.0, 5e-324])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0, 1] == (1, pytest.approx(1)) and got[0, 4] == (3, pytest.approx(-math.sqrt(0.5))) and got[50, 1][0] in (0, 1) and len(got) == 8
    assert all(math.isfinite(s) for _, s in got.values())


def test_nearest_copies(spark):
    """Copies of one vector tie wherever they lie, so the smallest ids come first."""
    rng = np.random.default_rng(11)
    copy, rows = rng.standard_normal(37), []
    for i in range(1, 900):
        rows.append((i, (copy if i % 3 else copy + rng.standard_normal(37)).tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(frame, shard=300).collect()
    copies = [i for i in range(1, 900) if i % 3]
    for q in range(50, 900, 50):
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        if q % 3:
            assert [v for _, v in own] == [i for i in copies if i != q][:5]
    assert len({r["score"] for r in got if r["query_id"] == 50}) == 1
