"""Registered few-shot / GLUE-style queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions import arrays as AR
from veil.functions.ranking import positions
from veil.operators import demos as DM
from veil.operators import fewshot as FS
from veil.operators import lmdata as L
from veil.plans import sqlfrag as S
from veil.plans.registry import register
from veil.plans.tables import read

TAB = "\t"


def _doc_sents(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    clean = lambda c: F.trim(F.regexp_replace(c, "\n", " "))
    return d.select("doc_id", "lang", "source",
                    F.coalesce(F.col("quality").cast("string"), F.lit("0")).alias("label"),
                    clean(F.split_part("text", F.lit("."), F.lit(1))).alias("s1"),
                    clean(F.split_part("text", F.lit("."), F.lit(2))).alias("s2"))


SQL_DOC_SENTS = """
(SELECT doc_id, lang, source, coalesce(CAST(quality AS VARCHAR), '0') AS label,
        trim(replace(split_part(text, '.', 1), chr(10), ' ')) AS s1,
        trim(replace(split_part(text, '.', 2), chr(10), ' ')) AS s2
 FROM documents LEFT JOIN labels USING (doc_id))"""


def _tsv(spark, sf_dir, fields, header):
    """Tab-separated lines in doc order, a header line at line 0."""
    d = _doc_sents(spark, sf_dir)
    lines = positions(d, [], ["doc_id"], out="__p").select(
        (F.col("__p") + 1).alias("line_no"), F.concat_ws(TAB, *fields).alias("value"))
    head = d.sparkSession.createDataFrame([(0, header)], "line_no long, value string")
    return head.unionByName(lines)


def _sql_tsv(fields_sql: str) -> str:
    return (f"(SELECT row_number() OVER (ORDER BY doc_id) AS line_no, {fields_sql} AS value FROM {SQL_DOC_SENTS})")


def _sql_glue(task: str, fields_sql: str) -> str:
    a, b, lab, guid_from, skip = FS.GLUE_LAYOUT[task]
    f = "string_split(value, chr(9))"
    label = f"{f}[-1]" if lab == -1 else f"{f}[{lab + 1}]"
    guid = "CAST(line_no AS VARCHAR)" if guid_from == "row" else f"{f}[1]"
    tb = f"{f}[{b + 1}]" if b is not None else "CAST(NULL AS VARCHAR)"
    return (f"SELECT 'train-' || {guid} AS guid, {f}[{a + 1}] AS text_a, {tb} AS text_b, {label} AS label "
            f"FROM {_sql_tsv(fields_sql)}")


MRPC_SQL_FIELDS = "label || chr(9) || doc_id || chr(9) || doc_id || chr(9) || s1 || chr(9) || s2"
QNLI_SQL_FIELDS = "doc_id || chr(9) || s1 || chr(9) || s2 || chr(9) || label"
SST2_SQL_FIELDS = "s1 || chr(9) || label"


@register("f1_glue_mrpc", _sql_glue("mrpc", MRPC_SQL_FIELDS))
def f1_glue_mrpc(spark, sf_dir):
    lines = _tsv(spark, sf_dir, ["label", "doc_id", "doc_id", "s1", "s2"], "Quality\t#1 ID\t#2 ID\t#1 String\t#2 String")
    return FS.glue_examples(lines, "mrpc", "train")


@register("f1_glue_qnli", _sql_glue("qnli", QNLI_SQL_FIELDS))
def f1_glue_qnli(spark, sf_dir):
    lines = _tsv(spark, sf_dir, ["doc_id", "s1", "s2", "label"], "index\tquestion\tsentence\tlabel")
    return FS.glue_examples(lines, "qnli", "train")


# Layouts of eight columns and more: the sentences stand where the layout wants them.
_WIDE = ["doc_id", "lang", "source", "s1", "s2", "lang", "source", "s1", "s2", "label"]
_WIDE_TASKS = {"mnli": _WIDE, "snli": _WIDE, "sts-b": _WIDE, "rte": ["doc_id", "s1", "s2", "label"],
               "wnli": ["doc_id", "s1", "s2", "label"], "cola": ["source", "label", "lang", "s1"],
               "qqp": ["doc_id", "source", "lang", "s1", "s2", "label"]}


def _register_layout(task: str, fields: list[str]):
    @register(f"f1_glue_{task.replace('-', '')}", _sql_glue(task, " || chr(9) || ".join(fields))
              + (" UNION ALL SELECT 'train-0', '4', CAST(NULL AS VARCHAR), '2'" if not FS.GLUE_LAYOUT[task][4] else ""))
    def query(spark, sf_dir):
        header = "\t".join(str(k + 1) for k in range(len(fields)))
        return FS.glue_examples(_tsv(spark, sf_dir, fields, header), task, "train")
    query.__doc__ = f"Documents as lines of the {task} layout."
    return query


for _task, _fields in _WIDE_TASKS.items():
    _register_layout(_task, _fields)


def _register_textcls(task: str, sql_text: str):
    @register(f"f2_textcls_{task.replace('-', '')}", f"""
SELECT 'test-' || CAST(doc_id AS VARCHAR) AS guid, {sql_text} AS text_a, source AS label FROM documents
""")
    def query(spark, sf_dir):
        d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("c0"), F.col("lang").alias("c1"),
                                                    F.col("n_chars").cast("string").alias("c2"), F.col("text").alias("c3"))
        return FS.textcls_examples(d, task, "test", ["c0", "c1", "c2", "c3"], "doc_id")
    query.__doc__ = f"Rows of a headerless file of the {task} layout."
    return query


for _task, _sql in (("trec", "lang"), ("yelp_review_full", "lang"), ("ag_news", "lang || '. ' || CAST(n_chars AS VARCHAR)"),
                    ("yahoo_answers", "lang || ' ' || CAST(n_chars AS VARCHAR) || ' ' || text")):
    _register_textcls(_task, _sql)


@register("f1_glue_sst2", _sql_glue("sst-2", SST2_SQL_FIELDS))
def f1_glue_sst2(spark, sf_dir):
    lines = _tsv(spark, sf_dir, ["s1", "label"], "sentence\tlabel")
    return FS.glue_examples(lines, "sst-2", "train", first_label="0")


@register("f2_textcls_examples", f"""
SELECT 'train-' || CAST(doc_id AS VARCHAR) AS guid, concat_ws(' ', source, s1, nullif(s2, '')) AS text_a, lang AS label
FROM {SQL_DOC_SENTS}
""")
def f2_textcls_examples(spark, sf_dir):
    """yahoo_answers layout: c0 label, c1–c3 text parts (empty ones as null)."""
    d = _doc_sents(spark, sf_dir).select("doc_id", F.col("lang").alias("c0"), F.col("source").alias("c1"),
                                         F.col("s1").alias("c2"), F.when(F.col("s2") != "", F.col("s2")).alias("c3"))
    return FS.textcls_examples(d, "yahoo_answers", "train", ["c0", "c1", "c2", "c3"], "doc_id")


TEMPLATE = "*cls**sent_0*_It_was*mask*.*sep+*"


@register("f3_render_template", f"""
SELECT doc_id, '<s>' || s1 || ' It was' || '<mask>' || '.' || '</s>' AS prompt FROM {SQL_DOC_SENTS}
""")
def f3_render_template(spark, sf_dir):
    d = _doc_sents(spark, sf_dir)
    return d.select("doc_id", FS.render_template(TEMPLATE, [F.col("s1")]).alias("prompt"))


PAIR_TEMPLATE = "*cls**sent_0*?*mask*,*+sentl_1**sep+*"


def _sql_pair(first: str, second: str, word: str) -> str:
    return f"{first} || '?' || '{word}' || ',' || ' ' || lower({second}[1:1]) || {second}[2:] || '</s>'"


@register("f4_expand_template", f"""
SELECT doc_id, '<s>' || {_sql_pair('s1', 's2', '<mask>')} || {_sql_pair("('A ' || s1)", "('A ' || s2)", 'great')}
               || {_sql_pair("('B ' || s1)", "('B ' || s2)", 'fair')} || {_sql_pair("('C ' || s1)", "('C ' || s2)", 'terrible')} AS prompt
FROM {SQL_DOC_SENTS}
""")
def f4_expand_template(spark, sf_dir):
    """A sentence-pair template replicated per label (three labels): copy i speaks of the i-th demonstration pair."""
    t = FS.expand_template(PAIR_TEMPLATE, num_labels=3)
    d = _doc_sents(spark, sf_dir)
    pairs = [F.col("s1"), F.col("s2")]
    for mark in "ABC":
        pairs += [F.concat(F.lit(f"{mark} "), F.col("s1")), F.concat(F.lit(f"{mark} "), F.col("s2"))]
    return d.select("doc_id", FS.render_template(t, pairs, ["great", "fair", "terrible"]).alias("prompt"))


@register("f4_expand_in_context", f"""
SELECT doc_id, 'B ' || s1 || ' It was' || lang || '.' || '</s>' || 'A ' || s1 || ' It was' || source || '.' || '</s>'
               || '<s>' || s1 || ' It was' || '<mask>' || '.' || '</s>' AS prompt
FROM {SQL_DOC_SENTS}
""")
def f4_expand_in_context(spark, sf_dir):
    """Two in-context examples at the head: the later one first, the query last with its ``*cls*``."""
    t = FS.expand_template(TEMPLATE, num_demos=2, head=True)
    d = _doc_sents(spark, sf_dir)
    sents = [F.col("s1"), F.concat(F.lit("A "), F.col("s1")), F.concat(F.lit("B "), F.col("s1"))]
    return d.select("doc_id", FS.render_template(t, sents, demo_labels=[F.col("source"), F.col("lang")]).alias("prompt"))


@register("f5_fit_inputs", """
WITH v AS (SELECT doc_id, list_transform(range(len(string_split(text, ' '))), lambda i: CAST(i % 50 + 1 AS INTEGER)) AS ids FROM documents),
f AS (SELECT doc_id, len(ids) AS n, CASE WHEN len(ids) >= 64 THEN ids[len(ids) - 63:]
        ELSE list_concat(ids, list_transform(range(64 - len(ids)), lambda i: 0)) END AS input_ids FROM v WHERE len(ids) >= 7)
SELECT doc_id, input_ids, list_transform(range(64), lambda i: CAST(CASE WHEN i < n THEN 1 ELSE 0 END AS INTEGER)) AS attention_mask,
       CAST(list_position(input_ids, 7) - 1 AS INTEGER) AS mask_pos FROM f
""")
def f5_fit_inputs(spark, sf_dir):
    """Ids, attention mask and place of the mask (id 7) of every document of seven words or more, the tail of 64 kept."""
    ids = F.transform(F.split("text", " "), lambda x, i: (i % 50 + 1).cast("int"))
    d = read(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).where(F.size("ids") >= 7)
    return d.select("doc_id", FS.fit_inputs("ids", 64, truncate_head=True, mask_id=7).alias("x")).select("doc_id", "x.*")


@register("f5_fit_length", """
WITH v AS (SELECT item_id, list_transform(range(len(string_split(text, ' '))), lambda i: CAST(i + 1 AS INTEGER)) AS ids
           FROM benchmark)
SELECT item_id,
       CASE WHEN len(ids) >= 12 THEN ids[1:12] ELSE list_concat(ids, list_transform(range(12 - len(ids)), lambda i: 0)) END AS tail,
       CASE WHEN len(ids) >= 12 THEN ids[len(ids) - 11:] ELSE list_concat(ids, list_transform(range(12 - len(ids)), lambda i: 0)) END AS head
FROM v
""")
def f5_fit_length(spark, sf_dir):
    """Word positions of each benchmark text as ids, fitted to 12."""
    b = read(spark, sf_dir, "benchmark")
    ids = F.transform(F.split("text", " "), lambda x, i: (i + 1).cast("int"))
    d = b.select("item_id", ids.alias("ids"))
    return d.select("item_id", FS.fit_length("ids", 12).alias("tail"), FS.fit_length("ids", 12, truncate_head=True).alias("head"))


def _qs(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % 5 == 0), e.where(F.col("vec_id") % 5 != 0)


SQL_SIMS = """
q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 5 = 0),
s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 5 <> 0),
lim AS (SELECT CAST(floor((count(*) // 10) * 0.5) AS INTEGER) AS k FROM s),
p AS (SELECT q.vec_id AS query_id, s.vec_id AS support_id, s.label,
             list_sum(list_transform(list_zip(q.v, s.v), lambda z: z[1] * z[2]))
             / (sqrt(list_sum(list_transform(q.v, lambda x: x * x))) * sqrt(list_sum(list_transform(s.v, lambda x: x * x)))) AS sim
      FROM q, s),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, label ORDER BY sim DESC, support_id) AS INTEGER) AS rank FROM p),
demo AS (SELECT query_id, support_id, label, sim, rank FROM r WHERE rank <= (SELECT k FROM lim))"""


def _demo(spark, sf_dir, lists=False):
    q, s = _qs(spark, sf_dir)
    return FS.demo_filter(q, s, "vec_id", "embedding", "label", num_labels=10, rate=0.5, lists=lists)


@register("f6_demo_filter", f"WITH {SQL_SIMS} SELECT query_id, support_id, label, round(sim, 6) AS sim, rank FROM demo")
def f6_demo_filter(spark, sf_dir):
    return _demo(spark, sf_dir).withColumn("sim", F.round("sim", 6))


# The nearest k demonstrations per label.  Some support rows have no label; the
# regression label is the label number, with the median as the border of two buckets.
DEMO_K, DEMO_MEDIAN = 8, 4.0


def _sql_topk(label: str, num_labels: int, rate: float, exclude_self: bool) -> str:
    """CTE ``topk``: all similarities, ranked; the label may be null."""
    support = "SELECT vec_id, label, embedding FROM embeddings" + ("" if exclude_self else " WHERE vec_id % 5 <> 0")
    query = "SELECT vec_id, embedding FROM embeddings WHERE vec_id % 5 = 0"
    return f"""
q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM ({query})),
s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v
      FROM (SELECT vec_id, {label} AS label, embedding FROM ({support})) WHERE label IS NOT NULL),
lim AS (SELECT least({DEMO_K}, CAST(floor(((count(*) - {int(exclude_self)}) // {num_labels}) * {rate}) AS INTEGER)) AS k FROM s),
pairs AS (SELECT q.vec_id AS query_id, s.vec_id AS support_id, s.label,
             list_sum(list_transform(list_zip(q.v, s.v), lambda z: z[1] * z[2]))
             / (sqrt(list_sum(list_transform(q.v, lambda x: x * x))) * sqrt(list_sum(list_transform(s.v, lambda x: x * x)))) AS sim
      FROM q, s {"WHERE q.vec_id <> s.vec_id" if exclude_self else ""}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, label ORDER BY sim DESC, support_id) AS INTEGER) AS rank FROM pairs),
topk AS (SELECT * FROM ranked WHERE rank <= (SELECT k FROM lim))"""


SQL_TOPK = _sql_topk("CASE WHEN vec_id % 7 <> 3 THEN label END", 10, 0.5, False)
SQL_TOPK_REG = _sql_topk(f"CASE WHEN label <= {DEMO_MEDIAN} THEN 0 WHEN label > {DEMO_MEDIAN} THEN 1 END", 2, 0.5, True)


def _topk(spark, sf_dir):
    q, s = _qs(spark, sf_dir)
    s = s.withColumn("label", F.when(F.col("vec_id") % 7 != 3, F.col("label")))
    return DM.nearest_per_label(q, s, "vec_id", "embedding", "label", DEMO_K, num_labels=10, rate=0.5)


def _topk_regression(spark, sf_dir):
    q, _ = _qs(spark, sf_dir)
    e = read(spark, sf_dir, "embeddings").withColumn("bucket", DM.buckets_at_median(F.col("label").cast("double"), DEMO_MEDIAN))
    return DM.nearest_per_label(q, e, "vec_id", "embedding", "bucket", DEMO_K, num_labels=2, rate=0.5, exclude_self=True)


@register("f6_demo_topk", f"WITH {SQL_TOPK} SELECT query_id, support_id, label, round(sim, 6) AS sim, rank FROM topk")
def f6_demo_topk(spark, sf_dir):
    """Nearest demonstrations per label by pivots and bounds; rows without a label are none."""
    return _topk(spark, sf_dir).withColumn("sim", F.round("sim", 6))


@register("f6_demo_topk_regression", f"""
WITH {SQL_TOPK_REG} SELECT query_id, support_id, label, round(sim, 6) AS sim, rank FROM topk
""")
def f6_demo_topk_regression(spark, sf_dir):
    """Two buckets at the median, the query itself left out (training)."""
    return _topk_regression(spark, sf_dir).withColumn("sim", F.round("sim", 6))


def _sql_drawn(ctes: str, seed: int, groups: str, limit: int) -> str:
    return f"""
WITH {ctes},
rep AS (SELECT topk.*, sample FROM topk, (SELECT unnest(range(0, 2)) AS sample)),
o AS (SELECT *, row_number() OVER (PARTITION BY {groups}
                                   ORDER BY {S.hash_key(seed, 'query_id', 'sample', 'support_id')}, support_id) AS rn FROM rep)
SELECT query_id, sample, label, support_id FROM o WHERE rn <= {limit}
"""


@register("f7_sample_demo_per_bucket", _sql_drawn(SQL_TOPK_REG, 3, "query_id, sample, label", 1))
def f7_sample_demo_per_bucket(spark, sf_dir):
    """One demonstration per bucket of a regression task, drawn from the nearest."""
    rep = FS.replicate(_topk_regression(spark, sf_dir), 2)
    return FS.sample_demo_per_label(rep, 3).select("query_id", F.col("sample").cast("bigint").alias("sample"),
                                                   "label", "support_id")


@register("f8_sample_in_context_topk", _sql_drawn(SQL_TOPK, 5, "query_id, sample", 4))
def f8_sample_in_context_topk(spark, sf_dir):
    """Four demonstrations a query, drawn from the nearest of every label."""
    rep = FS.replicate(_topk(spark, sf_dir), 2)
    return FS.sample_in_context(rep, 4, 5).select("query_id", F.col("sample").cast("bigint").alias("sample"),
                                                  "label", "support_id")


@register("f7_sample_demo_per_label", f"""
WITH {SQL_SIMS},
rep AS (SELECT demo.*, sample FROM demo, (SELECT unnest(range(0, 2)) AS sample)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, sample, label
                                   ORDER BY {S.hash_key(3, 'query_id', 'sample', 'support_id')}, support_id) AS rn FROM rep)
SELECT query_id, sample, label, support_id FROM o WHERE rn = 1
""")
def f7_sample_demo_per_label(spark, sf_dir):
    rep = FS.replicate(_demo(spark, sf_dir, lists=True).withColumnRenamed("support_ids", "support_id"), 2)
    return FS.sample_demo_per_label(rep, 3).select("query_id", F.col("sample").cast("bigint").alias("sample"),
                                                   "label", "support_id")


@register("f8_sample_in_context", f"""
WITH {SQL_SIMS},
rep AS (SELECT demo.*, sample FROM demo, (SELECT unnest(range(0, 2)) AS sample)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, sample
                                   ORDER BY {S.hash_key(5, 'query_id', 'sample', 'support_id')}, support_id) AS rn FROM rep)
SELECT query_id, sample, support_id FROM o WHERE rn <= 4
""")
def f8_sample_in_context(spark, sf_dir):
    rep = FS.replicate(_demo(spark, sf_dir, lists=True).withColumnRenamed("support_ids", "support_id"), 2)
    return FS.sample_in_context(rep, 4, 5).select("query_id", F.col("sample").cast("bigint").alias("sample"),
                                                  "support_id")


@register("f9_replicate", """
SELECT vec_id, sample FROM embeddings, (SELECT unnest(range(0, 3)) AS sample) WHERE vec_id % 5 = 0
""")
def f9_replicate(spark, sf_dir):
    q, _ = _qs(spark, sf_dir)
    return FS.replicate(q.select("vec_id"), 3).withColumn("sample", F.col("sample").cast("bigint"))


@register("f10_ensemble_predict", """
WITH x AS (SELECT vec_id // 4 AS q, i - 1 AS pos, avg(CAST(embedding[i] AS DOUBLE)) AS m
           FROM (SELECT vec_id, embedding, unnest(range(1, 11)) AS i FROM embeddings) GROUP BY vec_id // 4, i)
SELECT q, CAST(arg_max(pos, (m, -pos)) AS INTEGER) AS pred FROM x GROUP BY q
""")
def f10_ensemble_predict(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("q"),
                                                 F.slice("embedding", 1, 10).alias("logits"))
    return FS.ensemble_predict(e, "q", "logits").withColumn("pred", F.col("pred").cast("int"))


SQL_HOLDOUT = f"""
(SELECT doc_id, CASE WHEN r < n - floor(n * 0.1) THEN 'train' ELSE 'dev' END AS split
 FROM (SELECT doc_id, row_number() OVER (ORDER BY {S.hash_key(11, 'doc_id')}, doc_id) - 1 AS r, count(*) OVER () AS n
       FROM documents))"""


@register("f11_holdout", f"SELECT * FROM {SQL_HOLDOUT}")
def f11_holdout(spark, sf_dir):
    return FS.holdout(read(spark, sf_dir, "documents").select("doc_id"), 0.1, 11, "doc_id")


MATCHED = [f"src{i}" for i in range(10)]


@register("f12_holdout_by_group", f"""
WITH g AS (SELECT doc_id, CASE WHEN source IN ({', '.join(S.q(m) for m in MATCHED)}) THEN 'matched' ELSE 'mismatched' END AS grp,
                  count(*) OVER () AS n FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {S.hash_key(13, 'doc_id')}, doc_id) - 1 AS r FROM g)
SELECT doc_id, CASE WHEN r < floor(floor(n * 0.1) / 2) THEN 'dev_' || grp ELSE 'train' END AS split FROM r
""")
def f12_holdout_by_group(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    return FS.holdout_by_group(d, "source", MATCHED, 13, "doc_id").select("doc_id", "split")


@register("f13_relabel_splits", f"""
SELECT doc_id, CASE split WHEN 'dev' THEN 'test' WHEN 'test' THEN 'dev' ELSE split END AS split FROM {SQL_HOLDOUT}
""")
def f13_relabel_splits(spark, sf_dir):
    h = f11_holdout(spark, sf_dir)
    return h.select("doc_id", FS.relabel_splits("split").alias("split"))


def _vocab64(spark, sf_dir):
    """Vocabulary ids 0..63 = the first 64 tokens of the benchmark texts in token
    order; word-initial = capitalised."""
    b = read(spark, sf_dir, "benchmark")
    v = L.build_vocab(b, "text").where(F.col("id") <= 64)
    return v.select("token", (F.col("id") - 1).alias("id"), F.col("token").rlike("^[A-Z]").alias("word_initial"))


SQL_VOCAB64 = f"""
v64 AS (SELECT token, id - 1 AS id, regexp_matches(token, '^[A-Z]') AS word_initial
        FROM (SELECT token, CAST(dense_rank() OVER (ORDER BY token) AS INTEGER) AS id
              FROM (SELECT DISTINCT unnest({S.tokens('text')}) AS token FROM benchmark)) WHERE id <= 64),
lw AS (SELECT label % 2 AS label, i - 1 AS id, avg(CAST(embedding[i] AS DOUBLE)) AS mean_logit
       FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label % 2, i),
likely AS (SELECT label, id, token, mean_logit,
                  CAST(row_number() OVER (PARTITION BY label ORDER BY mean_logit DESC, id) AS INTEGER) AS rank
           FROM lw JOIN v64 USING (id) WHERE word_initial QUALIFY rank <= 4)"""


def _likely(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("label"), "embedding")
    return FS.likely_words(e, _vocab64(spark, sf_dir), "label", "embedding", 4)


@register("f14_likely_words", f"""
WITH {SQL_VOCAB64} SELECT label, id, token, round(mean_logit, 6) AS mean_logit, rank FROM likely
""")
def f14_likely_words(spark, sf_dir):
    l = _likely(spark, sf_dir)
    return l.select("label", F.col("id").cast("long").alias("id"), "token", F.round("mean_logit", 6).alias("mean_logit"),
                    F.col("rank").cast("int").alias("rank"))


@register("f15_neighbor_words", f"""
WITH {SQL_VOCAB64},
wv AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
seeds AS (SELECT label, id AS seed_id FROM likely WHERE rank = 1),
j AS (SELECT l.label, l.id, greatest(0.0, 1 - list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: z[1] * z[2]))
             / (sqrt(list_sum(list_transform(a.vec, lambda x: x * x))) * sqrt(list_sum(list_transform(b.vec, lambda x: x * x))))) AS distance
      FROM likely l JOIN wv a ON a.id = l.id JOIN seeds s ON s.label = l.label JOIN wv b ON b.id = s.seed_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY distance, id) AS INTEGER) AS nrank FROM j)
SELECT label, id, round(distance, 6) AS distance, nrank FROM r WHERE nrank <= 2
""")
def f15_neighbor_words(spark, sf_dir):
    """Word vectors: the embedding row whose vec_id is the word id."""
    l = _likely(spark, sf_dir)
    seeds = l.where(F.col("rank") == 1).select("label", F.col("id").alias("seed_id"))
    wv = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    n = FS.neighbor_words(l.select("label", "id"), seeds, wv, 2)
    return n.select("label", F.col("id").cast("long").alias("id"), F.round("distance", 6).alias("distance"),
                    F.col("nrank").cast("int").alias("nrank"))


@register("f16_search_label_words", f"""
WITH {SQL_VOCAB64},
c0 AS (SELECT id AS w0, rank AS r0 FROM likely WHERE label = 0),
c1 AS (SELECT id AS w1, rank AS r1 FROM likely WHERE label = 1),
pr AS (SELECT (r0 - 1) * (SELECT count(*) FROM c1) + (r1 - 1) AS pairing, w0, w1 FROM c0, c1),
ex AS (SELECT label % 2 AS y, CAST(embedding AS DOUBLE[]) AS l FROM embeddings),
acc AS (SELECT pairing, w0, w1, avg(CASE WHEN (CASE WHEN l[w0 + 1] >= l[w1 + 1] THEN 0 ELSE 1 END) = y THEN 1.0 ELSE 0.0 END) AS accuracy
        FROM pr, ex GROUP BY pairing, w0, w1),
r AS (SELECT *, row_number() OVER (ORDER BY accuracy DESC, pairing) AS rank FROM acc)
SELECT CAST(pairing AS INTEGER) AS pairing, w0 || ',' || w1 AS words, round(accuracy, 6) AS accuracy, rank FROM r WHERE rank <= 3
""")
def f16_search_label_words(spark, sf_dir):
    """Binary task (label parity): every pairing of the 4 likely words per class."""
    l = _likely(spark, sf_dir).select("label", "id", "rank").collect()   # ≤ 4 words per class
    cands = {}
    for r in sorted(l, key=lambda r: (r["label"], r["rank"])):
        cands.setdefault(r["label"], []).append(int(r["id"]))
    e = read(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("y"), "embedding")
    s = FS.search_label_words(e, cands, "embedding", "y", 3)
    return s.select(F.col("pairing").cast("int").alias("pairing"), "words", F.round("accuracy", 6).alias("accuracy"),
                    F.col("rank").cast("long").alias("rank"))


@register("f16_search_label_words_corr", f"""
WITH {SQL_VOCAB64},
c0 AS (SELECT id AS w0, rank AS r0 FROM likely WHERE label = 0),
c1 AS (SELECT id AS w1, rank AS r1 FROM likely WHERE label = 1),
pr AS (SELECT (r0 - 1) * (SELECT count(*) FROM c1) + (r1 - 1) AS pairing, w0, w1 FROM c0, c1),
ex AS (SELECT CAST(label AS DOUBLE) AS y, CAST(embedding AS DOUBLE[]) AS l FROM embeddings)
SELECT CAST(pairing AS INTEGER) AS pairing, w0 || ',' || w1 AS words,
       round(CASE WHEN w0 = w1 THEN -1.0 ELSE corr(1 / (1 + exp(l[w0 + 1] - l[w1 + 1])), y) END, 6) AS correlation
FROM pr, ex GROUP BY pairing, w0, w1
""")
def f16_search_label_words_corr(spark, sf_dir):
    """Regression (the label as a number): every pairing by the correlation of its second probability."""
    l = _likely(spark, sf_dir).select("label", "id", "rank").collect()   # ≤ 4 words per class
    cands = {}
    for r in sorted(l, key=lambda r: (r["label"], r["rank"])):
        cands.setdefault(r["label"], []).append(int(r["id"]))
    e = read(spark, sf_dir, "embeddings").select(F.col("label").alias("y"), "embedding")
    s = FS.search_label_words(e, cands, "embedding", "y", -1, correlation=True)
    return s.select(F.col("pairing").cast("int").alias("pairing"), "words", F.round("correlation", 6).alias("correlation"))


def _sql_pairings(words: int, top: int) -> str:
    return f"""
WITH ex AS (SELECT label % 3 AS y, CAST(embedding AS DOUBLE[]) AS l FROM embeddings),
w AS (SELECT unnest(range({words})) AS w),
pr AS (SELECT (a.w * {words} + b.w) * {words} + c.w AS pairing, a.w AS w0, b.w AS w1, c.w AS w2 FROM w a, w b, w c),
acc AS (SELECT pairing, w0, w1, w2, count(*) FILTER (WHERE
          CASE y WHEN 0 THEN l[w0 + 1] >= l[w1 + 1] AND l[w0 + 1] >= l[w2 + 1]
                 WHEN 1 THEN l[w1 + 1] > l[w0 + 1] AND l[w1 + 1] >= l[w2 + 1]
                 ELSE l[w2 + 1] > l[w0 + 1] AND l[w2 + 1] > l[w1 + 1] END) / count(*) AS accuracy
        FROM pr, ex GROUP BY pairing, w0, w1, w2),
r AS (SELECT *, row_number() OVER (ORDER BY accuracy DESC, pairing) AS rank FROM acc)
SELECT pairing, w0 || ',' || w1 || ',' || w2 AS words, round(accuracy, 6) AS accuracy, rank FROM r WHERE rank <= {top}
"""


def _three_classes(spark, sf_dir, words, top, **how):
    e = read(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("y"), "embedding")
    s = FS.search_label_words(e, {c: range(words) for c in range(3)}, "embedding", "y", top, **how)
    return s.select("pairing", "words", F.round("accuracy", 6).alias("accuracy"), F.col("rank").cast("long").alias("rank"))


@register("f16_search_label_words_wide", _sql_pairings(64, 5))
def f16_search_label_words_wide(spark, sf_dir):
    """Three classes with every coordinate as a candidate word: 262,144 pairings, scored by tiles."""
    return _three_classes(spark, sf_dir, 64, 5)


@register("f16_search_label_words_bounds", _sql_pairings(16, 5))
def f16_search_label_words_bounds(spark, sf_dir):
    """Three classes of sixteen words, searched by the bounds of boxes."""
    return _three_classes(spark, sf_dir, 16, 5, exhaustive=100)


@register("f17_bounded_label", """
SELECT vec_id, [round(1 - (label / 2.0) / 5.0, 6), round((label / 2.0) / 5.0, 6)] AS bounded,
       round(((label / 2.0) / 5.0) * 5.0, 6) AS back
FROM embeddings
""")
def f17_bounded_label(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") / 2.0).alias("y"))
    b = FS.bounded_label("y")
    return e.select("vec_id", F.transform(b, lambda x: F.round(x, 6)).alias("bounded"),
                    F.round(FS.unbounded_label(b[1]), 6).alias("back"))


@register("f18_label_word_logits", """
SELECT vec_id, [embedding[4], embedding[8]] AS label_logits FROM embeddings
""")
def f18_label_word_logits(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", FS.label_word_logits("embedding", [3, 7]).alias("label_logits"))
