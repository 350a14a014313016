"""Secret scans with character Markov models, in SQL functions only.

Two first-order Markov chains over characters are counted from labelled
samples: random strings (values of the base rules and hashes written in hex
and base 64) and ordinary identifiers (letter and digit-only tokens of the
documents outside base matches, and the identifiers below).  A run of 16 or
more token characters is a secret when the log-likelihood ratio of the two
chains exceeds ``LEAST_RATIO``, the log odds of an ordinary token to a random
one.  Base matches stay whatever their ratio; added spans touch none of them.

Positions come from ``split`` and ``regexp_extract_all`` of the same pattern:
what stands between the matches and the matches themselves, summed up.

Results per case: null and empty texts have no spans; whole texts are scanned
at any length; spans that start together are ordered by kind; an empty table
gives an empty result (the chains then know the fixed samples only); only the
id and text columns are read; repeated rows have the same spans and count
again in the chains.  The chains count the transitions of all documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm import common as C

ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
LEAST_RATIO = 14.0              # about a million ordinary tokens for a random one
SAMPLE_HASHES = 2_000           # generated random strings of each form
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_WIDTH = len(_ALPHABET) + 1     # 0 stands for any other character
_CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
_BLOCK = 64

# Ordinary identifiers of programs and systems (labelled samples).
IDENTIFIERS = """
getElementById addEventListener toLowerCase HttpServletRequest AbstractFactoryBean IllegalArgumentException
max_partition_bytes shuffle_partitions read_timeout_seconds default_batch_size connection_pool_size user_profile_image
spark-sql-adaptive x86_64-linux-gnu en_US-utf-8 python3-dev-packages requirements-dev-2024 release-candidate-1
usr/local/lib/python3/site-packages src/main/resources/application home/user/projects/readme var/log/system/messages
CONTENT_TYPE_APPLICATION_JSON MAX_RETRY_COUNT ENVIRONMENT_VARIABLES DEFAULT_CONFIGURATION_PATH
2024-01-15 2023-12-31 1999-06-07 00000000000000000000 1234567890123456 ========================
------------------------ ________________________ internationalization characteristically uncharacteristic
""".split()


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _starts(sizes: Column) -> Column:
    """Running sums before each element, block by block to stay linear."""
    def block_sums(s, blocks):
        return F.transform(blocks, lambda b: F.aggregate(F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0),
                                                         lambda a, x: a + x))

    def before(values, first):
        """[first, first + v0, first + v0 + v1, …], one longer than ``values``."""
        return F.aggregate(values, F.array(first),
                           lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    def all_starts(s):
        blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(s) / _BLOCK).cast("int") - 1, F.lit(0)))
        return _let(blocks, lambda bs: _let(before(block_sums(s, bs), F.lit(0)), lambda offs: F.flatten(F.transform(
            bs, lambda b: _let(F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK)), lambda part: F.slice(
                before(part, offs[b]), F.lit(1), F.size(part)))))))

    return _let(sizes, all_starts)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points."""
    def place(gaps, found):
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        ends = F.zip_with(_starts(sizes), sizes, lambda a, n: a + n)
        return F.zip_with(ends, found, lambda e, m: F.struct(
            (e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda m: F.when(F.size(m) == 0, F.expr(
        "cast(array() as array<struct<start:int,end:int,value:string>>)")).otherwise(
            _let(F.split(text, pattern, -1), lambda g: place(g, m))))


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"),
        s["value"].alias("value")))


_NO_SPANS = "cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"


def base_spans(text: Column) -> Column:
    """Sorted array<struct<start, kind, end, value>> of the base rules."""
    none = F.expr(_NO_SPANS)
    assign = F.when(text.rlike("(?i)password|passwd|secret|token|api_?key"), _kind(F.filter(
        matches(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6), "assign"))
    access = F.when(text.contains("AKIA"), _kind(F.filter(
        matches(text, ACCESS), lambda s: F.length(s["value"]) >= 20), "access"))
    # a run of 24 or more is the same as a maximal run that is long enough
    hexes = F.when(text.rlike("[0-9a-f]{24}"), _kind(matches(text, "(?<![0-9a-f])[0-9a-f]{24,}"), "hex"))
    return F.array_sort(F.concat(*[F.coalesce(c, none) for c in (assign, access, hexes)]))


def _codes(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(_ALPHABET), c))


def _pairs(value: Column) -> Column:
    """Numbers of the character pairs of a string."""
    return _let(_codes(value), lambda c: F.zip_with(
        F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.size(c)),
        lambda a, b: a * _WIDTH + b))


def samples(docs: DataFrame, text_col: str) -> DataFrame:
    """(random, value): the labelled samples of both chains, from all documents."""
    spark = docs.sparkSession
    some = docs.select(F.col(text_col).cast("string").alias("text"))
    value = F.regexp_extract("s.value", ASSIGN, 2)
    found = some.select(F.explode(base_spans(F.col("text"))).alias("s")).select(
        F.lit(True).alias("random"), F.when(F.col("s.kind") == 0, value).otherwise(F.col("s.value")).alias("value")
        ).where("length(value) >= 16")
    plain = some.select(F.explode(F.regexp_extract_all(
        "text", F.lit("(?<![A-Za-z0-9+/_=-])(?:[A-Za-z]{8,}|[0-9]{8,})(?![A-Za-z0-9+/_=-])"), F.lit(0))
        ).alias("value")).select(F.lit(False).alias("random"), "value")
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    made = spark.range(SAMPLE_HASHES).select(F.lit(True).alias("random"), F.explode(F.array(
        digest, base64, F.translate(base64, "+/", "-_"), F.regexp_replace(base64, "[+/=]", ""),
        F.upper(digest))).alias("value"))
    fixed = spark.createDataFrame([(False, w) for w in IDENTIFIERS], "random boolean, value string")
    return found.unionByName(plain).unionByName(made).unionByName(fixed)


def fit(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Log ratio of the transition probabilities of both chains, by pair number."""
    pairs = samples(docs, text_col).select("random", F.explode(_pairs(F.col("value"))).alias("p"))
    count = {True: [1.0] * _WIDTH ** 2, False: [1.0] * _WIDTH ** 2}     # one added to every transition
    for r in pairs.groupBy("random", "p").count().collect():           # at most 2 x _WIDTH² rows
        count[r.random][r.p] += r["count"]
    total = {k: [sum(v[a * _WIDTH:(a + 1) * _WIDTH]) for a in range(_WIDTH)] for k, v in count.items()}
    return [math.log(count[True][p] / total[True][p // _WIDTH]) - math.log(count[False][p] / total[False][p // _WIDTH])
            for p in range(_WIDTH ** 2)]


def markov_spans(text: Column, ratios: list[float]) -> Column:
    """Spans of the token runs that look random."""
    table = F.expr("cast(split('" + " ".join(repr(r) for r in ratios) + "', ' ') as array<double>)")
    score = lambda v: F.aggregate(_pairs(v), F.lit(0.0), lambda a, p: a + table[p])
    return _kind(F.filter(matches(text, _CANDIDATE), lambda s: score(s["value"]) > LEAST_RATIO), "markov")


def scan(df: DataFrame, ratios: list[float], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, base, added): sorted spans with kind numbers of ``KINDS``; added ones touch no base span."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    added = _let(F.struct(base_spans(text).alias("base"), markov_spans(text, ratios).alias("m")), lambda s: F.struct(
        s["base"].alias("base"), F.filter(s["m"], lambda m: ~F.exists(
            s["base"], lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))).alias("added")))
    return df.select(F.col(id_col), added.alias("s")).select(id_col, "s.base", "s.added")


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", kinds[s["kind"]], s["start"], s["end"])), ",")


def op10_secret_scan(spark, sf_dir) -> DataFrame:
    """Base and added spans of every document."""
    docs = C.table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in KINDS[:3]],
                        F.size("added").cast("long").alias("n_markov"),
                        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
                        _written(F.concat("base", "added")).alias("spans"))
