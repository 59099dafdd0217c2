"""Quality classifier by co-training.

Two views see a document: its text (presence of telling words and beginnings of words, character and repetition ratios) and its metadata (language, source,
recorded length). Each is a logistic regression. Over a few rounds each view labels the unlabelled documents, all of them, and hands some of those it is sure of to the
*other* view's training set. Both are then calibrated on labelled documents held out of training, and combined by a calibrated sum of
their log-odds, shifted to where fewest of those rows are wrong. There is one such pair for ``quality`` and one for ``toxic``.

What is bounded: labelled training rows (``n_labelled``, by a hash of doc_id), and the pseudo-labelled rows that a view takes in a round (``quota`` for each
class: of all documents that the other view is sure of, those of smallest hash). The views of every document are written once, whole texts in one pass; rounds and scores
read that table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import materialize, remove

_WORD = re.compile(r"\w+")
_UPPER, _LOWER, _DIGIT, _SPACE = (bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58), (9, 14)))
_SPACE += b" "
_SYMBOL = bytes(b for b in range(33, 127) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123))
TARGETS = ("quality", "toxic")
_HASHED = 256
_BEGIN = range(3, 9)


def text_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _ratios(text: str, words: list[str], distinct: set[str]) -> list[float]:
    raw = text.encode()
    size = max(1, len(raw))
    lines = text.split("\n")
    count = [(len(raw) - len(raw.translate(None, c))) / size for c in (_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL)]
    return [*count, count[0] / (count[0] + count[1] + 0.01), len(distinct) / max(1, len(words)), np.log1p(len(words)), len(set(lines)) / len(lines), raw.count(b"|") / size, raw.count(b"!") / size, len(words) / size]


def flags(distinct: set[str], wanted: set[str] | None = None) -> set[str]:
    """The words, and the beginnings of 3 to 8 letters of longer ones: ``abc*`` if one word has it, ``abc**`` if two, ``abc***`` if three or more. With ``wanted``, of these beginnings alone."""
    times: dict[str, int] = {}
    heads = None if wanted is None else {b[: _BEGIN[0]] for b in wanted}
    for w in distinct if heads is None else [w for w in distinct if w[: _BEGIN[0]] in heads]:
        for k in _BEGIN[: max(0, len(w) - _BEGIN[0])]:
            if wanted is None or w[:k] in wanted:
                times[w[:k]] = times.get(w[:k], 0) + 1
    return distinct | {b + "***"[:m] for b, n in times.items() for m in range(1, min(n, 3) + 1)}


def content_view(text: str, index: dict[str, int], wanted: set[str]) -> tuple[list[float], list[int]]:
    words = text_words(text)
    distinct = set(words)
    return _ratios(text, words, distinct), [index[w] for w in flags(distinct, wanted) & index.keys()]


def metadata_view(lang, source, n_chars) -> tuple[list[float], list[int]]:
    from zlib import crc32

    known = n_chars is not None and n_chars >= 0
    return [np.log1p(float(n_chars)) if known else 0.0, float(known)], [crc32(f"{k}={v}".encode()) % _HASHED for k, v in (("lang", lang), ("source", source))]


_DENSE = (12, 2)


def _matrix(dense: pa.Array, hot: pa.Array, n_dense: int, n_sparse: int) -> np.ndarray:
    """Rows of ``n_dense`` numbers and of numbered flags."""
    x = np.zeros((len(dense), n_dense + n_sparse), np.float32)
    x[:, :n_dense] = dense.flatten().to_numpy().reshape(len(dense), n_dense)
    sizes = np.diff(hot.offsets.to_numpy())
    x[np.repeat(np.arange(len(hot)), sizes), n_dense + hot.flatten().to_numpy()] = 1
    return x


def _matrices(b: pa.RecordBatch | pa.Table, n_words: int) -> list[np.ndarray]:
    """Both views of a batch of the views table."""
    out = []
    for k, n in enumerate((max(1, n_words), _HASHED)):
        dense, hot = (b.column(f"{c}{k}") for c in "dh")
        dense, hot = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (dense, hot))
        out.append(_matrix(dense, hot, _DENSE[k], n))
    return out


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps, on standardized columns, with Platt calibration."""

    mean: np.ndarray = None
    scale: np.ndarray = None
    w: np.ndarray = None
    platt: tuple[float, float] = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 20.0, steps: int = 12) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1), np.float32)]).astype(np.float64)
        w, keep = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        keep[-1] = 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            s = np.maximum(p * (1 - p), 1e-5)
            step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
            w += step
            if np.abs(step).max() < 1e-4:
                break
        self.w = w
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds."""
        return np.clip(self.platt[0] * self.raw(x) + self.platt[1], -15, 15)


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (0 at least) and intercept; targets are smoothed, so that few rows cannot give certainty. Newton steps are halved until they help."""
    good, bad, scale = y.sum(), len(y) - y.sum(), s.std() + 1e-9
    t, s = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2)), s / scale

    def loss(c: np.ndarray) -> float:
        z = c[0] * s + c[1]
        return float((np.logaddexp(0, z) - t * z).sum() + 5e-4 * c[0] ** 2)

    c, now = np.zeros(2), None
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(c[0] * s + c[1], -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((t - p) * s).sum() - 1e-3 * c[0], (t - p).sum()])
        step = np.linalg.solve(np.array([[(v * s * s).sum() + 1e-3, (v * s).sum()], [(v * s).sum(), v.sum() + 1e-6]]), g)
        now = loss(c)
        while loss(c + step) > now and np.abs(step).max() > 1e-6:
            step = step / 2
        c = c + step
        if np.abs(step).max() < 1e-6:
            break
    return (float(c[0] / scale), float(c[1])) if c[0] > 0 else (0.0, float(np.log((good + 1) / (bad + 1))))


class CoTraining:
    """The two views of one target while they learn, and their calibrated combination; ``constant`` where the labels hold no two classes.

    Of the labelled rows, three quarters train, an eighth calibrates and weighs the views, and an eighth is for ``report`` alone.
    """

    def __init__(self, views: list[np.ndarray], y: np.ndarray, otherwise: float):
        part = np.arange(len(y)) % 8
        own, self.calibrate, self.test = part % 4 != 3, part == 3, part == 7
        self.views, self.y = views, y
        self.x, self.t = [[v[own]] for v in views], [[y[own]], [y[own]]]
        self.models, self.weights, self.exchanged, self.report = [Logistic(), Logistic()], (0.5, 0.5, 0.0), [], {}
        few = min(y[own].sum(), (1 - y[own]).sum()) < 5 or min(y[self.calibrate].sum(), (1 - y[self.calibrate]).sum()) < 2
        self.constant = (float(y.mean()) if len(y) else otherwise) if few else None

    def fit(self) -> None:
        if self.constant is None:
            for m, x, t, v in zip(self.models, self.x, self.t, self.views, strict=True):
                m.fit(np.concatenate(x), np.concatenate(t))
                m.platt = _platt(m.raw(v[self.calibrate]), self.y[self.calibrate])

    def take(self, view: int, label: int, rows: np.ndarray) -> None:
        self.x[view].append(rows)
        self.t[view].append(np.full(len(rows), float(label)))

    def _errors(self) -> dict[str, float]:
        wrong = lambda p: float(((p >= 0.5) != (self.y[self.test] == 1)).mean()) if self.test.any() else 0.0
        odds = [m.odds(v[self.test]) for m, v in zip(self.models, self.views, strict=True)]
        return {"content": wrong(1 / (1 + np.exp(-odds[0]))), "metadata": wrong(1 / (1 + np.exp(-odds[1]))), "both": wrong(self.probability([v[self.test] for v in self.views]))}

    def combine(self, name: str) -> None:
        """Weigh the views; note the errors on labelled rows that nothing was fitted on as ``report[name]``."""
        if self.constant is None:
            y = self.y[self.calibrate]
            a, b = (m.odds(v[self.calibrate]) for m, v in zip(self.models, self.views, strict=True))
            best = max(((1, 0), (1, 0.25), (1, 0.5), (1, 1), (0.5, 1), (0, 1)), key=lambda w: -np.logaddexp(0, -(2 * y - 1) * (w[0] * a + w[1] * b)).sum())
            slope, shift = _platt(best[0] * a + best[1] * b, y)
            z = slope * (best[0] * a + best[1] * b) + shift
            steps = np.arange(-12, 13) / 4
            wrong = np.array([((z >= c) != (y == 1)).sum() for c in steps])
            self.weights = slope * best[0], slope * best[1], shift - float(steps[wrong == wrong.min()].mean())  # one half lies where fewest rows are wrong
            self.report[name] = self._errors()

    def probability(self, views: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(views[0]), self.constant)
        a, b = (v.odds(x) for v, x in zip(self.models, views, strict=True))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] * a + self.weights[1] * b + self.weights[2], -30, 30)))

    def done(self) -> CoTraining:
        """Without the training rows, to be sent to the executors."""
        self.views = self.x = self.t = self.y = self.calibrate = self.test = None
        return self


@dataclass
class Model:
    index: dict[str, int]
    targets: dict[str, CoTraining]

    def scores(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return tuple(self.targets[n].probability(views) for n in TARGETS)


def kept(scores: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (scores[0] >= 0.5) & (scores[1] < 0.5)


_FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
_VIEWS = "doc_id long, pick long, d0 array<float>, h0 array<int>, d1 array<float>, h1 array<int>"


def _fields(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    return docs.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (x.split(" ") for x in _FIELDS.split(", "))])


def _views(texts, langs, sources, sizes, index: dict[str, int]) -> list[pa.Array]:
    """Columns d0, h0, d1 and h1."""
    wanted = {w.rstrip("*") for w in index if w.endswith("*")}
    rows = [content_view(t or "", index, wanted) for t in texts], [metadata_view(*r) for r in zip(langs, sources, sizes, strict=True)]
    return [pa.array([r[k] for r in own], pa.list_(t)) for own in rows for k, t in ((0, pa.float32()), (1, pa.int32()))]


def views_table(fields: DataFrame, index: dict[str, int]) -> DataFrame:
    """``_VIEWS`` for each row of ``fields``; ``pick`` is a hash of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tv.slices(b, "text", 1 << 22):
                columns = _views(*(part.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars")), index)
                yield pa.record_batch([part.column("doc_id"), part.column("pick"), *columns], ["doc_id", "pick", "d0", "h0", "d1", "h1"])
        tv.release()

    return fields.select("*", F.xxhash64(F.lit("pick"), "doc_id", "text").alias("pick")).mapInArrow(run, _VIEWS)


_SURE = "number int, pick long, d0 array<float>, h0 array<int>, d1 array<float>, h1 array<int>"


def sure_rows(pool: DataFrame, targets: list[CoTraining], n_words: int, sure: float, quota: int, taken: dict[int, set[int]]) -> DataFrame:
    """Of the whole ``pool``, by (target, view, label) numbered ``4 t + 2 v + l``: the ``quota`` rows of smallest ``pick`` that the view gives the label with a probability of ``sure`` or more, but for those ``taken``."""
    bound = float(np.log(sure / (1 - sure)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pa.Table] = {}
        for b in batches:
            views, pick = _matrices(b, n_words), b.column("pick").to_numpy()
            for t, own in enumerate(targets):
                for v in (0, 1) if own.constant is None else ():
                    odds = own.models[v].odds(views[v])
                    for label in (0, 1):
                        k = 4 * t + 2 * v + label
                        at = np.flatnonzero((odds if label else -odds) >= bound)
                        at = at[~np.isin(pick[at], list(taken.get(k, ())))]
                        at = at[np.argsort(pick[at], kind="stable")[:quota]]
                        if len(at):
                            rows = pa.Table.from_batches([b]).select(["pick", "d0", "h0", "d1", "h1"]).take(pa.array(at))
                            rows = pa.concat_tables([best[k], rows]) if k in best else rows
                            best[k] = rows.take(pa.array(np.argsort(rows.column("pick").to_numpy(), kind="stable")[:quota])).combine_chunks()
        for k, rows in best.items():
            yield from rows.add_column(0, "number", pa.array([k] * rows.num_rows, pa.int32())).to_batches()
        tv.release()

    found = pool.mapInArrow(run, _SURE)
    for groups in ([F.col("number"), F.pmod("pick", F.lit(64))], [F.col("number")]):  # a bounded number of rows of each partition meets in two steps
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy("pick"))).where(F.col("rank") <= quota).drop("rank")
    return found


def _fit(docs: DataFrame, labels: DataFrame, n_labelled: int = 12_000, n_words: int = 240, min_count: int = 4, rounds: int = 3, sure: float = 0.97, quota: int = 300) -> tuple[Model, DataFrame, str]:
    """The model, the views of all rows, and the folder where they are."""
    spark, docs = docs.sparkSession, _fields(docs)
    given = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.col(t).cast("int")).alias(t) for t in TARGETS])
    chosen = F.broadcast(given.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(n_labelled))  # n_labelled rows at most
    sample = docs.join(chosen, "doc_id").groupBy("doc_id", *TARGETS).agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))  # and as many documents
    sample, sample_path = materialize(sample.select("doc_id", *TARGETS, "row.*"), "sample")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tv.slices(b, "text", 1 << 22):
                seen: dict[str, list[int]] = {}
                for text, q, t in zip(*(part.column(c).to_pylist() for c in ("text", *TARGETS)), strict=True):
                    for w in flags(set(text_words(text or ""))):
                        c = seen.setdefault(w, [0, 0, 0])
                        c[0] += 1
                        c[1] += q == 0
                        c[2] += t == 1
                yield pa.record_batch([pa.array(list(seen), pa.string()), *(pa.array([c[i] for c in seen.values()], pa.int64()) for i in range(3))], ["word", "n", "bad", "toxic"])

    total = sample.agg(F.count(F.lit(1)), F.sum((F.col("quality") == 0).cast("int")), F.sum((F.col("toxic") == 1).cast("int"))).first()
    n, totals = max(1, total[0]), [total[1] or 0, total[2] or 0]
    counts = sample.select("text", *TARGETS).mapInArrow(words_of, "word string, n long, bad long, toxic long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "toxic")]).where(F.col("n") >= min_count)
    index: dict[str, int] = {}
    for name, own in zip(("bad", "toxic"), totals, strict=True):
        rate = own / n
        gap = (F.col(name) - F.col("n") * F.lit(rate)) / F.sqrt(F.col("n") * F.lit(max(rate * (1 - rate), 1e-9)))
        for r in counts.orderBy(F.abs(gap).desc(), "word").limit(n_words // 2).select("word").collect():
            index.setdefault(r[0], len(index))

    views, views_path = materialize(views_table(docs, index), "views")
    rows = views_table(sample.select(*[x.split(" ")[0] for x in _FIELDS.split(", ")]), index).join(sample.select("doc_id", *TARGETS), "doc_id").toArrow().sort_by("doc_id")  # n_labelled rows at most, as features
    x, targets = _matrices(rows, len(index)), []
    for name, otherwise in zip(TARGETS, (1.0, 0.0), strict=True):
        y = rows.column(name).to_pylist()
        has = np.array([v is not None for v in y], bool)
        targets.append(CoTraining([v[has] for v in x], np.array([float(v) for v in y if v is not None]), otherwise))
    pool, taken = views.join(given.select("doc_id"), "doc_id", "left_anti"), {}
    for own in targets:
        own.fit()
        own.combine("labels alone")
    if any(own.constant is None for own in targets) and rounds:
        pool, pool_path = materialize(pool, "pool")
        for _ in range(rounds):
            found = sure_rows(pool, [_bare(t) for t in targets], len(index), sure, quota, taken).toArrow()  # 8 quota rows at most
            numbers = found.column("number").to_numpy() if found.num_rows else np.zeros(0, int)
            for t, own in enumerate(targets):
                own.exchanged.append(0)
                for v in (0, 1):
                    for label in (0, 1):
                        k = 4 * t + 2 * v + label
                        got = found.filter(pa.array(numbers == k)).sort_by("pick")
                        if got.num_rows:
                            own.take(1 - v, label, _matrices(got, len(index))[1 - v])
                            taken.setdefault(k, set()).update(got.column("pick").to_pylist())
                            own.exchanged[-1] += got.num_rows
                own.fit()
            if not found.num_rows:
                break
        remove(spark, pool_path)
    for own in targets:
        own.combine("co-trained")
    remove(spark, sample_path)
    return Model(index, {name: own.done() for name, own in zip(TARGETS, targets, strict=True)}), views, views_path


def _bare(own: CoTraining) -> CoTraining:
    """A copy that holds the models alone."""
    out = CoTraining.__new__(CoTraining)
    out.constant, out.models = own.constant, own.models
    return out


def train(docs: DataFrame, labels: DataFrame, **settings) -> Model:
    """Fit on at most ``n_labelled`` labelled documents and on pseudo-labels from all others."""
    model, _, path = _fit(docs, labels, **settings)
    remove(docs.sparkSession, path)
    return model


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Train and score: ``(doc_id, quality_score, toxic_score, keep)`` for each row of ``docs``.

    ``keep`` is a quality of 0.5 or more and a toxicity under 0.5. Without labels of two classes a target has a constant score:
    the labels' mean, or 1 for quality and 0 for toxicity if there are none, so documents stay. Labels repeated for a doc_id: the larger counts;
    labels without a document or doc_id are ignored, and of rows that share a labelled doc_id the smallest trains. Each row is scored by its own text: null texts count
    as empty, null metadata as a value of its own, missing metadata columns as null; other columns are not read. An empty table gives an empty table.
    """
    model, views, path = _fit(docs, labels, **settings)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred words and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, t = sent.value.scores(_matrices(b, len(sent.value.index)))
            yield pa.record_batch([b.column("doc_id"), pa.array(q), pa.array(t), pa.array(kept((q, t)))], ["doc_id", "quality_score", "toxic_score", "keep"])

    out, _ = materialize(views.mapInArrow(run, "doc_id long, quality_score double, toxic_score double, keep boolean"), "quality")
    remove(docs.sparkSession, path)
    return out


def good_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that ``classify`` would keep, with all their columns: each row is judged where it lies, without a join."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **settings))
    names = docs.columns
    own = [n for n in ("text", "lang", "source", "n_chars") if n in names]
    judged = docs.select("*", F.struct(*[F.col(n).cast("long" if n == "n_chars" else "string").alias(n) for n in own]).alias("__judged"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for part in tv.slices(b, "text", 1 << 22):
                row = dict(zip(own, part.column("__judged").flatten(), strict=True))
                columns = _views(*(row[n].to_pylist() if n in row else [None] * part.num_rows for n in ("text", "lang", "source", "n_chars")), model.index)
                views = _matrices(pa.record_batch(columns, ["d0", "h0", "d1", "h1"]), len(model.index))
                yield part.select(names).filter(pa.array(kept(model.scores(views))))
        tv.release()

    return judged.mapInArrow(run, docs.schema)
