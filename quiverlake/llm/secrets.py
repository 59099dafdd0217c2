"""Secret scans in DataFrame functions only: fixed rules, and two character Markov models compared by log-likelihood ratio.

One model is trained on random strings, the other on ordinary identifiers; both samples are labelled by how they are made. Random strings come from
digests of numbers. Identifiers are put together from a fixed list of words in many styles; to them come words of a bounded sample of the documents, outside all rule
matches, that are letters of one case alone. A token of ``min_chars`` or more goes if the sum over its character pairs of log P(random) - log P(ordinary)
reaches ``threshold``.

Each text is scanned where it lies: no shuffle, no join. A cheap test tells first whether a text can hold a match of a rule. Positions come from the lengths of the pieces between
matches, summed in blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: The rules, in the order in which their kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Words of identifiers.
WORDS = (
    "get set is has add remove create delete update find load save read write open close start stop run init build make parse format render fetch send receive handle process validate check test "
    "user name value default request response handler connection pool argument buffer size content type background color available lower upper string builder application image profile configuration manager "
    "invalid input output calculate total price document element left right outer join national timeout seconds load balancer index key file path directory list map array node tree graph table column row "
    "field record message error exception warning event listener callback thread process lock queue stack cache memory storage database query result filter sort group order count number integer float double "
    "boolean date time zone year month day client server service host port address network socket protocol http url header body cookie session token password account customer product invoice payment order "
    "option parameter setting property attribute method function class object instance module package version release status state mode level depth width height length offset position start end first last next "
    "previous current new old max min average sum code byte char encode decode compress extract convert transform register unregister enable disable visible hidden active public private static abstract"
)

_BLOCK = 512
_CHARS = 128


def _starts(lengths: Column) -> Column:
    """``array<struct<gap, size>>`` -> ``array<struct<start, end>>``: running sums, in blocks so that long arrays stay near linear."""

    def walk(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["gap"]
            e = s + x["size"]
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end")))).alias("out"))

        return F.aggregate(block, zero, step, lambda a: a["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["size"]))
    begin = F.transform(blocks, lambda _, i: F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, begin, walk))


def matches(text: Column, pattern: str, can: Column, group: int = 0) -> Column:
    """All leftmost non-overlapping matches, or a group of them; only texts that ``can`` have any are searched."""
    return F.when(can, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def spans(text: Column, pattern: str, found: Column, keep: Column | None = None) -> Column:
    """Where the matches ``found`` lie, as ``array<struct<start, end>>`` in code points; with ``keep`` (an array of booleans, one a match), those it names."""
    lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.char_length(p).cast("long").alias("gap"), F.char_length(m).cast("long").alias("size")))
    all_of = _starts(lengths) if keep is None else F.filter(_starts(lengths), lambda _, i: F.get(keep, i))
    return F.when(F.size(found) > 0, all_of).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _pairs(tokens: DataFrame) -> DataFrame:
    """``(label, token)`` -> ``(label, a, b, n)``: how often character ``b`` follows ``a``."""
    codes = F.transform(F.split("token", ""), lambda c: F.ascii(c))
    pair = F.explode(F.zip_with(F.slice("codes", F.lit(1), F.size("codes") - 1), F.slice("codes", F.lit(2), F.size("codes") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    return tokens.where("length(token) > 1").select("label", codes.alias("codes")).select("label", pair.alias("p")).groupBy("label", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def identifiers(spark: SparkSession, n: int) -> DataFrame:
    """``(token)``: ``n`` identifiers of two to five words in ten styles, numbers among them."""
    words = F.array(*[F.lit(w) for w in WORDS.split(" ")])
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.lit("word"), "id", k), F.size(words)) + 1).cast("int"))
    own = F.transform(F.sequence(F.lit(1), (F.pmod(F.xxhash64(F.lit("size"), "id"), F.lit(4)) + 2).cast("int")), pick)
    titled = F.transform("own", F.initcap)
    number = F.when(F.pmod(F.xxhash64(F.lit("end"), "id"), F.lit(4)) == 0, F.pmod(F.xxhash64(F.lit("number"), "id"), F.lit(100)).cast("string")).otherwise("")
    camel = F.concat(F.element_at("own", 1), F.array_join(F.slice(titled, F.lit(2), F.size("own")), ""))
    styles = [
        F.array_join("own", "_"),
        F.upper(F.array_join("own", "_")),
        camel,
        F.array_join(titled, ""),
        F.array_join("own", "-"),
        F.array_join("own", "/"),
        F.array_join("own", ""),
        F.concat(F.lit("_"), F.array_join("own", "_")),
        F.array_join(titled, "_"),
        F.concat(F.upper(F.element_at("own", 1)), F.array_join(F.slice(titled, F.lit(2), F.size("own")), "")),
    ]
    rows = spark.range(n).select("id", own.alias("own"))
    return rows.select(F.concat(F.element_at(F.array(*styles), (F.col("id") % len(styles) + 1).cast("int")), number).alias("token"))


def labelled_sample(docs: DataFrame, n_docs: int, n_random: int) -> DataFrame:
    """``(label, token)``: 1 for random strings in five alphabets, 0 for as many identifiers and for the plain words of six letters or more in about ``n_docs`` documents."""
    spark: SparkSession = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("quiverlake"), F.col("id").cast("string")), 256)
    letters = F.translate(F.base64(F.unhex(digest)), "=", "")
    bare = F.translate(letters, "+/", "")
    kinds = F.element_at(F.array(F.substr(digest, F.lit(1), F.lit(40)), letters, F.translate(letters, "+/", "-_"), F.upper(bare), F.lower(bare)), (F.col("id") % 5 + 1).cast("int"))
    random = spark.range(n_random).select(F.lit(1).alias("label"), kinds.alias("token"))
    every = max(1, docs.count() // n_docs)
    text = text_of()
    for rule in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, rule, " ")
    own = docs.where(F.pmod(F.xxhash64(F.lit("secrets"), "doc_id", "text"), F.lit(every)) == 0).select(F.lit(0).alias("label"), F.explode(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9+/_=-])(?:[A-Z]?[a-z]{5,}|[A-Z]{6,})(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("token"))
    return random.unionByName(identifiers(spark, n_random).select(F.lit(0).alias("label"), "token")).unionByName(own)


def ratios(sample: DataFrame, prior: float = 200.0) -> list[float]:
    """The table of log P(b after a | random) - log P(b after a | ordinary) for all pairs of ASCII codes.

    Pairs are smoothed by ``prior`` counts spread as the model's single characters, those by one count each, so a few secrets among the
    ordinary tokens do not make their pairs ordinary. At most 2 * 128 * 128 counts come to the driver.
    """
    pairs: dict[tuple[int, int, int], int] = {(r[0], r[1], r[2]): r[3] for r in _pairs(sample).collect() if r[1] < _CHARS and r[2] < _CHARS}
    first: dict[tuple[int, int], int] = {}
    single: dict[tuple[int, int], int] = {}
    total = {0: 0, 1: 0}
    for (label, a, b), n in pairs.items():
        first[label, a] = first.get((label, a), 0) + n
        single[label, b] = single.get((label, b), 0) + n
        total[label] += n

    def log(label: int, a: int, b: int) -> float:
        alone = (single.get((label, b), 0) + 1) / (total[label] + _CHARS)
        return math.log((pairs.get((label, a, b), 0) + prior * alone) / (first.get((label, a), 0) + prior))

    return [log(1, a, b) - log(0, a, b) for a in range(_CHARS) for b in range(_CHARS)]


def ratio_table(sample: DataFrame) -> Column:
    return F.split(F.lit(",".join(f"{x:.5f}" for x in ratios(sample))), ",").cast("array<double>")


def ratio(token: Column, table: Column) -> Column:
    """The sum over the token's character pairs; characters are ASCII."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    n = F.size(codes) - 1
    return F.aggregate(F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: F.get(table, a * _CHARS + b)), F.lit(0.0), lambda s, x: s + x)


def scan(docs: DataFrame, min_chars: int = 16, threshold: float = 10.0, n_docs: int = 4000, n_random: int = 6000) -> DataFrame:
    """``(doc_id, assign, access, hex, markov)`` for each row: arrays of ``(start, end)`` in code points, end exclusive.

    Null text counts as empty: empty arrays. Rows are independent: repeated and null doc_ids are kept. Other columns are not read. An empty
    table gives an empty table. ``n_docs`` bounds the sample that adds words to the ordinary model; all documents are scanned, whole.
    """
    table, text = ratio_table(labelled_sample(docs, n_docs, n_random)), F.col("text")
    token, plain = r"[A-Za-z0-9+/_=-]{%d,}" % min_chars, F.lower(text)
    named = (text.contains(":") | text.contains("=")) & (plain.contains("passw") | plain.contains("secret") | plain.contains("token") | plain.contains("api"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).select("doc_id", "text", named.alias("named"))
    rows = rows.select(
        "doc_id",
        "text",
        matches(text, ASSIGN, F.col("named")).alias("assign"),
        matches(text, ASSIGN, F.col("named"), 2).alias("values"),
        matches(text, ACCESS, text.contains("AKIA")).alias("access"),
        matches(text, HEX, text.rlike(HEX)).alias("hex"),
        matches(text, token, text.rlike(token)).alias("markov"),
    )
    long = F.transform("values", lambda v: F.char_length(v) >= 6)
    random = F.transform("markov", lambda t: ratio(t, table) >= threshold)
    return rows.select("doc_id", spans(text, ASSIGN, F.col("assign"), long).alias("assign"), spans(text, ACCESS, F.col("access")).alias("access"), spans(text, HEX, F.col("hex")).alias("hex"), spans(text, token, F.col("markov"), random).alias("markov"))


KINDS = ("assign", "access", "hex", "markov")


def listed(*kinds: str) -> Column:
    """The spans of these kinds as ``kind:start:end``, by start, then kind as listed, comma-joined."""

    def marked(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("said")))

    return F.array_join(F.transform(F.array_sort(F.concat(*[marked(i, k) for i, k in enumerate(kinds)])), lambda s: s["said"]), ",")
