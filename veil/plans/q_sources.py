"""Registered source / sink round trips.

Each query writes data derived from the driver's tables in the reference's
file format to a fresh folder under the shared checkpoint folder, reads it
back with the matching reader and returns the result; the SQL twin computes
the same rows straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.operators import dialogue as D
from veil.operators import fewshot as FS
from veil.operators import lmdata as L
from veil.functions.ranking import positions
from veil.plans import sqlfrag as S
from veil.plans.q_lmdata import dart_examples, e2e_lines, webnlg_entries
from veil.plans.registry import register
from veil.plans.tables import SQL_TURNS, read, turns
from veil.sources import io

LANGS = ["de", "en", "es", "fr"]


@register("s1_s2_read_dialogues", f"SELECT conversation_id, turn, role, utterance, domain FROM ({SQL_TURNS})")
def s1_s2_read_dialogues(spark, sf_dir):
    """Turns written as ``<domain>.tsv`` CSV files and read back; the domain
    comes from the file name (a missing domain file is skipped)."""
    folder = io.scratch(spark, "dialogues")
    paths = io.write_dialogues(turns(spark, sf_dir), folder)
    return io.read_dialogues(spark, paths + [f"{folder}/finance.tsv"])


@register("s1_read_multiline_dialogues", """
SELECT CAST(doc_id AS VARCHAR) AS conversation_id, CAST(n_chars AS INTEGER) AS turn, source AS role,
       nullif(text, '') AS utterance, upper(lang) AS domain
FROM documents
""")
def s1_read_multiline_dialogues(spark, sf_dir):
    """Whole documents as utterances: fields with line breaks, quotes and commas,
    one file per domain, cut into records by the quote parities of its blocks."""
    d = read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("conversation_id"), F.col("n_chars").cast("int").alias("turn"),
        F.col("source").alias("role"), F.col("text").alias("utterance"), F.col("lang").alias("domain"))
    return io.read_dialogues(spark, io.write_dialogues(d, io.scratch(spark, "multiline")))


@register("s12_read_multiline_attack_results", """
SELECT text AS prompt, nullif(substr(text, 1, doc_id % 3 * 40), '') AS gen, CAST(n_chars AS DOUBLE) AS target_ppl, doc_id % 2 = 0 AS success
FROM documents
""")
def s12_read_multiline_attack_results(spark, sf_dir):
    """Attack results whose prompts are whole documents and whose generations break lines."""
    d = read(spark, sf_dir, "documents")
    res = d.select(F.col("text").alias("prompt"), F.substring("text", F.lit(1), (F.col("doc_id") % 3 * 40).cast("int")).alias("gen"),
                   F.col("n_chars").cast("double").alias("target_ppl"), F.lit(1.0).alias("ref_ppl"),
                   F.lit(2.0).alias("lower_ppl"), F.lit(None).cast("double").alias("zlib"),
                   (F.col("doc_id") % 2 == 0).alias("success"))
    path = io.scratch(spark, "attack_lines") + "/results.csv"
    io.write_attack_results(res, path)
    return io.read_attack_results(spark, path).select("prompt", "gen", "target_ppl", "success")


SQL_DOC_LINES = """
(SELECT lang, doc_id, i, s AS value,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) - 1 AS line_no
 FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS s,
              generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""


def _lang_files(spark, sf_dir):
    """One text file per language, lines in (doc_id, line) order."""
    folder = io.scratch(spark, "lines")
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("i", "value"))
    paths = []
    for lang in LANGS:
        p = f"{folder}/{lang}.txt"
        dl = d.where(F.col("lang") == lang).withColumn("__o", F.struct("doc_id", "i"))
        io.write_lines(dl, p, "__o")
        paths.append(p)
    return paths


@register("s3_read_lines", f"""
SELECT CAST(list_position({S.sql_list(LANGS)}, lang) - 1 AS INTEGER) AS file_idx, line_no, value
FROM {SQL_DOC_LINES} WHERE line_no < 50
""")
def s3_read_lines(spark, sf_dir):
    """First 50 lines of each language file, files in list order."""
    r = io.read_lines(spark, _lang_files(spark, sf_dir), max_examples=50)
    return r.select(F.col("file_idx").cast("int").alias("file_idx"), F.col("line_no").cast("long").alias("line_no"),
                    "value")


@register("s4_read_prompts", f"""
WITH t AS ({SQL_TURNS})
SELECT {S.py_strip("line")} AS value
FROM (SELECT unnest(string_split('  <_soc_> ' || {S.format_turn(True)} || '  ', chr(10))) AS line FROM t)
""")
def s4_read_prompts(spark, sf_dir):
    """Prompt files (one formatted turn per line) read back stripped."""
    folder = io.scratch(spark, "prompts")
    t = turns(spark, sf_dir)
    t = t.select(F.concat(F.lit("  <_soc_> "), D.format_turn(True), F.lit("  ")).alias("value"),
                 F.struct("conversation_id", "turn").alias("__o"))
    paths = []
    for k in range(2):
        p = f"{folder}/part{k}_prompts.txt"
        io.write_lines(t.where(F.crc32(F.col("__o.conversation_id")) % 2 == k), p, "__o")
        paths.append(p)
    return io.read_prompts(spark, paths).select("value")


@register("s5_read_keywords", """
SELECT lang AS domain, lower(w) AS phrase
FROM (SELECT lang, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3]) AS w
      FROM (SELECT lang, list_filter(string_split(text, ' '), lambda x: length(x) BETWEEN 3 AND 4) AS l
            FROM (SELECT lang, arg_min(text, doc_id) AS text FROM documents GROUP BY lang)))
""")
def s5_read_keywords(spark, sf_dir):
    """A ``{domain: [phrase]}`` dictionary made of words of each language's first
    document, written as one JSON object and read back lower-cased."""
    import json as _json
    d = read(spark, sf_dir, "documents")
    first = d.groupBy("lang").agg(F.min_by("text", "doc_id").alias("text"))
    words = first.select("lang", F.slice(F.array_distinct(F.filter(F.split("text", " "),
                                                                 lambda x: F.length(x).between(3, 4))), 1, 3).alias("w"))
    kw = {r["lang"]: list(r["w"]) for r in words.collect()}                 # one small dictionary
    folder = io.scratch(spark, "keywords")
    spark.createDataFrame([(_json.dumps(kw),)], "value string").coalesce(1).write.mode("overwrite").text(folder)
    return io.read_keywords(spark, folder)


@register("s6_split_manifest_roundtrip", """
SELECT domain, split, CAST(pos AS BIGINT) AS pos, conversation_id
FROM (SELECT dom AS domain, cid AS conversation_id, CASE WHEN r < floor(n * 0.1) THEN 'test' WHEN r < 2 * floor(n * 0.1) THEN 'valid' ELSE 'train' END AS split,
             CASE WHEN r < floor(n * 0.1) THEN r WHEN r < 2 * floor(n * 0.1) THEN r - floor(n * 0.1) ELSE r - 2 * floor(n * 0.1) END AS pos
      FROM (SELECT dom, cid, row_number() OVER (PARTITION BY dom ORDER BY md5('0' || ':' || cid), cid) - 1 AS r,
                   count(*) OVER (PARTITION BY dom) AS n
            FROM (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS cid,
                                  ['AIRLINE', 'MEDIA', 'INSURANCE'][CAST(conv_id % 3 + 1 AS INTEGER)] AS dom FROM conversations)))
""")
def s6_split_manifest_roundtrip(spark, sf_dir):
    m = D.split_conversations(turns(spark, sf_dir), 0.1, 0.1, seed=0)
    path = io.scratch(spark, "manifest")
    io.write_split_manifest(m, path)
    return io.read_split_manifest(spark, path)


@register("s7_read_glue_tsv", """
SELECT 'dev-' || CAST(doc_id AS VARCHAR) AS guid, lang AS text_a, source AS text_b, CAST(n_chars AS VARCHAR) AS label
FROM documents
""")
def s7_read_glue_tsv(spark, sf_dir):
    """A QNLI-layout TSV (index, question, sentence, label) written and parsed."""
    d = read(spark, sf_dir, "documents")
    folder = io.scratch(spark, "glue")
    head = spark.createDataFrame([((-1,), "index\tquestion\tsentence\tlabel")], "__o struct<doc_id:long>, value string")
    body = d.select(F.struct("doc_id").alias("__o"),
                    F.concat_ws("\t", F.col("doc_id").cast("string"), "lang", "source",
                                F.col("n_chars").cast("string")).alias("value"))
    io.write_lines(head.unionByName(body), folder, "__o")
    return FS.glue_examples(io.read_tsv_lines(spark, folder), "qnli", "dev")


@register("s8_read_headerless_csv", """
SELECT 'train-' || CAST(doc_id AS VARCHAR) AS guid, source || '. ' || lang AS text_a, CAST(doc_id % 4 AS VARCHAR) AS label
FROM documents
""")
def s8_read_headerless_csv(spark, sf_dir):
    """An ag_news-style CSV without header (label, title, description)."""
    d = read(spark, sf_dir, "documents")
    folder = io.scratch(spark, "agnews")
    (d.select(F.struct("doc_id").alias("__o"), (F.col("doc_id") % 4).cast("string").alias("c0"),
              F.col("source").alias("c1"), F.col("lang").alias("c2"))
     .repartitionByRange("__o").sortWithinPartitions("__o").drop("__o")
     .write.mode("overwrite").option("header", False).csv(folder))
    rows = io.read_headerless_csv(spark, folder, 3)
    rows = rows.withColumn("guid_no", F.col("line_no"))
    ex = FS.textcls_examples(rows, "ag_news", "train", ["c0", "c1", "c2"], "line_no")
    # line numbers follow doc_id order: map back to doc ids for the comparison
    ids = read(spark, sf_dir, "documents").select("doc_id")
    from veil.functions.ranking import positions
    pos = positions(ids, [], ["doc_id"], out="line_no")
    return (ex.withColumn("line_no", F.regexp_extract("guid", r"(\d+)$", 1).cast("long"))
            .join(pos, "line_no").select(F.concat(F.lit("train-"), F.col("doc_id").cast("string")).alias("guid"),
                                         "text_a", "label"))


@register("s9_read_src_tgt", f"""
SELECT split_part(value, '||', 1) AS src, split_part(value, '||', 2) AS tgt
FROM (SELECT 'name : ' || p_name || ' | brand : ' || p_brand || '||' || p_type AS value FROM part
      UNION ALL SELECT 'broken line without separator' FROM part WHERE p_partkey % 10 = 0)
WHERE len(string_split(value, '||')) = 2
""")
def s9_read_src_tgt(spark, sf_dir):
    """E2E lines (plus malformed and blank ones) in a text file, parsed back."""
    folder = io.scratch(spark, "e2e")
    lines = e2e_lines(spark, sf_dir)
    bad = read(spark, sf_dir, "part").where(F.col("p_partkey") % 10 == 0).select(
        "p_partkey", F.lit("broken line without separator").alias("value"))
    blank = read(spark, sf_dir, "part").where(F.col("p_partkey") % 10 == 1).select("p_partkey", F.lit("   ").alias("value"))
    io.write_lines(lines.unionByName(bad).unionByName(blank), folder, "p_partkey")
    return L.split_src_tgt(spark.read.text(folder)).select("src", "tgt")


@register("s10_read_webnlg", f"""
SELECT p_partkey AS entry_id, p_name || ' : brand : ' || p_brand || ' | ' || p_name || ' : type : ' || p_type AS src,
       unnest([p_type || ' ' || p_name, p_name || ' of ' || p_brand]) AS tgt,
       unnest([CASE WHEN p_size % 3 = 0 THEN 'bad' ELSE 'good' END, 'good']) AS comment
FROM part
""")
def s10_read_webnlg(spark, sf_dir):
    """WebNLG nested JSON written in the reference layout and read back."""
    folder = io.scratch(spark, "webnlg")
    io.write_webnlg(webnlg_entries(spark, sf_dir), folder)
    back = io.read_webnlg(spark, folder, multi_line=False)
    src = F.array_join(F.transform("modifiedtripleset", lambda t: F.concat_ws(" : ", t["subject"], t["property"],
                                                                              t["object"])), " | ")
    out = back.select(F.col("eid").alias("entry_id"), src.alias("src"), F.explode("lexicalisations").alias("lx"))
    return out.select("entry_id", "src", F.col("lx.lex").alias("tgt"), F.col("lx.comment").alias("comment"))


@register("s11_read_dart", """
SELECT p_partkey AS example_id, len([p_type, p_name || ' of ' || p_brand]) AS n_annotations,
       p_name || ' : brand : ' || p_brand || ' | ' || p_name || ' : size : ' || CAST(p_size AS VARCHAR) AS src
FROM part
""")
def s11_read_dart(spark, sf_dir):
    folder = io.scratch(spark, "dart")
    io.write_dart(dart_examples(spark, sf_dir), folder)
    lin = L.linearize_dart(io.read_dart(spark, folder, multi_line=False))
    return lin.groupBy("example_id", "src").agg(F.count(F.lit(1)).cast("int").alias("n_annotations"))


def _documents_of(records, number: str, head: str = "", tail: str = ""):
    """Lines with JSON arrays of at most fifty records each, as one document a line."""
    body = F.concat_ws(", ", F.transform(F.sort_array(F.collect_list(F.struct(F.col(number), "record"))), lambda r: r["record"]))
    return records.groupBy(F.floor(F.col(number) / 50).alias("__d")).agg(
        F.concat(F.lit(head + "["), body, F.lit("]" + tail)).alias("value")).select("value")


@register("s10_read_webnlg_documents", """
SELECT p_partkey AS eid, CAST(p_partkey % 50 + 1 AS INTEGER) AS entry_id, p_name AS subject, p_type || ' }], {" ' || p_brand AS lex
FROM part
""")
def s10_read_webnlg_documents(spark, sf_dir):
    """Documents of many entries, the layout of the reference, cut into records at their braces."""
    p = read(spark, sf_dir, "part")
    entry = F.struct(
        F.array(F.struct(F.lit("good").alias("comment"), F.concat("p_type", F.lit(' }], {" '), "p_brand").alias("lex"))).alias("lexicalisations"),
        F.array(F.struct(F.col("p_name").alias("subject"), F.lit("{").alias("property"), F.lit("\\").alias("object"))).alias("modifiedtripleset"),
        F.col("p_partkey").cast("long").alias("eid"))
    rows = p.select("p_partkey", F.to_json(F.create_map((F.col("p_partkey") % 50 + 1).cast("string"), entry)).alias("record"))
    folder = io.scratch(spark, "webnlg_documents")
    _documents_of(rows, "p_partkey", '{"version": 1, "entries": ', "}").write.text(folder)
    back = io.read_webnlg(spark, folder)
    return back.select("eid", "entry_id", F.col("modifiedtripleset")[0]["subject"].alias("subject"),
                       F.col("lexicalisations")[0]["lex"].alias("lex"))


@register("s11_read_dart_documents", """
SELECT p_partkey AS example_id, p_name || ' : {"brand": [ : ' || p_brand AS triple, p_type || chr(10) || '}' AS text FROM part
""")
def s11_read_dart_documents(spark, sf_dir):
    """Arrays of many examples; strings hold braces, brackets, quotes and escaped line ends."""
    p = read(spark, sf_dir, "part")
    example = F.struct(
        F.array(F.array("p_name", F.lit('{"brand": ['), "p_brand")).alias("tripleset"),
        F.array(F.struct(F.concat("p_type", F.lit("\n}")).alias("text"))).alias("annotations"),
        F.col("p_partkey").cast("long").alias("example_id"))
    folder = io.scratch(spark, "dart_documents")
    _documents_of(p.select("p_partkey", F.to_json(example).alias("record")), "p_partkey").write.text(folder)
    return io.read_dart(spark, folder).select(
        "example_id", F.array_join(F.col("tripleset")[0], " : ").alias("triple"), F.col("annotations")[0]["text"].alias("text"))


@register("s14_read_metric_log_documents", """
SELECT event_id AS global_step, round(value, 6) AS ppl FROM events
""")
def s14_read_metric_log_documents(spark, sf_dir):
    """Metric logs of many records a document."""
    from veil.plans.q_metrics import _metric_log
    log = _metric_log(spark, sf_dir)
    rows = log.select("global_step", F.to_json(F.struct(*log.columns)).alias("record"))
    folder = io.scratch(spark, "metric_documents")
    _documents_of(rows, "global_step").write.text(folder)
    back = io.read_metric_log(spark, folder, "global_step long, train struct<model: struct<ppl: double, "
                                             "eval_losses: double, lr: double>>")
    return back.select("global_step", F.round("train.model.ppl", 6).alias("ppl"))


@register("s12_s18_attack_results_roundtrip", """
SELECT doc_id % 997 AS k, count(*) AS n, count(*) FILTER (WHERE doc_id % 7 = 0) AS n_null_gen,
       round(sum(n_chars / 100.0), 6) AS target_sum
FROM documents GROUP BY doc_id % 997
""")
def s12_s18_attack_results_roundtrip(spark, sf_dir):
    """Attack results CSV (empty generations come back null) and its ratio-sorted copy."""
    d = read(spark, sf_dir, "documents")
    res = d.select(F.col("doc_id").cast("string").alias("prompt"),
                   F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("lang")).alias("gen"),
                   (F.col("n_chars") / 100.0).alias("target_ppl"), (F.col("doc_id") + 1.0).alias("ref_ppl"),
                   F.lit(2.0).alias("lower_ppl"), F.lit(None).cast("double").alias("zlib"),
                   (F.col("doc_id") % 2 == 0).alias("success"))
    folder = io.scratch(spark, "attack")
    io.write_attack_results(res, f"{folder}/results.csv", f"{folder}/ratio.csv")
    back = io.read_attack_results(spark, f"{folder}/results.csv")
    return back.groupBy((F.col("prompt").cast("long") % 997).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gen").isNull()).alias("n_null_gen"),
        F.round(F.sum("target_ppl"), 6).alias("target_sum"))


@register("s18_ratio_order", """
SELECT prompt, CAST(row_number() OVER (ORDER BY round(n_chars / 100.0 / (doc_id + 1.0), 12), doc_id) - 1 AS BIGINT) AS place
FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS prompt, n_chars FROM documents WHERE doc_id % 7 <> 0)
""")
def s18_ratio_order(spark, sf_dir):
    """The ratio copy of the attack results: rows with a generation, by target over reference perplexity."""
    d = read(spark, sf_dir, "documents")
    res = d.select(F.col("doc_id").cast("string").alias("prompt"),
                   F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("lang")).alias("gen"),
                   (F.col("n_chars") / 100.0).alias("target_ppl"), (F.col("doc_id") + 1.0).alias("ref_ppl"),
                   F.lit(2.0).alias("lower_ppl"), F.lit(None).cast("double").alias("zlib"), F.lit(True).alias("success"))
    folder = io.scratch(spark, "ratio")
    io.write_attack_results(res, f"{folder}/results.csv", f"{folder}/ratio.csv")
    back = io.with_line_order(spark.read.schema(io.ATTACK_SCHEMA).option("header", True).csv(f"{folder}/ratio.csv"))
    # the place in the file; equal ratios (at 1e-12) by the id, as in the twin
    placed = positions(back, [], io.LINE_ORDER, out="line").withColumn(
        "ratio", F.round(F.col("target_ppl") / F.col("ref_ppl"), 12))
    first = placed.groupBy("ratio").agg(F.min("line").alias("first"))
    within = positions(placed.select("prompt", "ratio", F.col("prompt").cast("long").alias("id")), ["ratio"], ["id"], out="k")
    return within.join(first, "ratio").select("prompt", (F.col("first") + F.col("k")).alias("place"))


@register("s13_read_vectors", """
SELECT vec_id AS idx, CAST(floor((vec_id - 100) / 64) AS BIGINT) AS batch, label
FROM embeddings WHERE vec_id >= 100 AND vec_id < 100 + 300
""")
def s13_read_vectors(spark, sf_dir):
    folder = io.scratch(spark, "vectors")
    read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "embedding", "label") \
        .write.mode("overwrite").parquet(folder)
    v = io.read_vectors(spark, folder, start=100, n=300, batch_size=64)
    return v.select("idx", F.col("batch").cast("long").alias("batch"), "label")


@register("s14_read_metric_log", """
SELECT event_id AS global_step, round(value, 6) AS ppl FROM events
""")
def s14_read_metric_log(spark, sf_dir):
    from veil.plans.q_metrics import _metric_log
    folder = io.scratch(spark, "metrics")
    io.write_metric_log(_metric_log(spark, sf_dir), folder)
    back = io.read_metric_log(spark, folder, "global_step long, train struct<model: struct<ppl: double, "
                                             "eval_losses: double, lr: double>>", multi_line=False)
    return back.select("global_step", F.round("train.model.ppl", 6).alias("ppl"))


@register("s15_write_split_text", f"""
WITH t AS ({SQL_TURNS}),
c AS (SELECT domain, conversation_id, '<_soc_> ' || string_agg({S.format_turn(True)}, ' ' ORDER BY turn) || ' <_eoc_>' AS text FROM t GROUP BY ALL)
SELECT CASE WHEN CAST(conversation_id AS BIGINT) % 5 = 0 THEN 'test' ELSE 'train' END AS split,
       lower(domain) || kind AS name, unnest(string_split(text, chr(10))) AS value
FROM c, (SELECT unnest(['', '_prompts', '_prompts_full']) AS kind)
""")
def s15_write_split_text(spark, sf_dir):
    """Assembled conversations written as ``<split>/<domain>{kind}.txt`` for each kind, read back line by line."""
    c = D.assemble_conversations(turns(spark, sf_dir))
    c = c.withColumn("split", F.when(F.col("conversation_id").cast("long") % 5 == 0, "test").otherwise("train"))
    folder = io.scratch(spark, "splits")
    out = None
    for kind in ("", "_prompts", "_prompts_full"):
        for path in io.write_split_text(c, folder, kind):
            split, name = path.split("/")[-2:]
            part = spark.read.text(path).select(F.lit(split).alias("split"), F.lit(name[:-4]).alias("name"), "value")
            out = part if out is None else out.unionByName(part)
    return out


@register("s16_write_redacted", f"""
SELECT conversation_id, turn, role, {S.redact_with_list("utterance", S.sql_list(['the', 'of', 'la', 'der']))} AS utterance
FROM ({SQL_TURNS})
""")
def s16_write_redacted(spark, sf_dir):
    from veil.operators import redaction as R
    t = turns(spark, sf_dir)
    red = R.redact_keywords(t, ["the", "of", "la", "der"], "utterance")
    folder = io.scratch(spark, "redacted")
    io.write_redacted(red.withColumnRenamed("conversation_id", "conversationId").withColumnRenamed("turn", "turnNumber")
                      .withColumnRenamed("role", "authorRole"), folder)
    back = spark.read.schema(io.DIALOGUE_SCHEMA).option("header", True).option("multiLine", True) \
        .option("escape", '"').csv(folder)
    return back.select(F.col("conversationId").alias("conversation_id"), F.col("turnNumber").alias("turn"),
                       F.col("authorRole").alias("role"), F.coalesce("utterance", F.lit("")).alias("utterance"))


@register("s17_write_generations", f"""
WITH t AS ({SQL_TURNS})
SELECT CASE WHEN turn % 2 = 0 THEN 'train' ELSE 'eval' END AS split, CAST(turn // 2 AS INTEGER) AS step,
       conversation_id AS context, utterance AS gen FROM t
""")
def s17_write_generations(spark, sf_dir):
    t = turns(spark, sf_dir).select(F.when(F.col("turn") % 2 == 0, "train").otherwise("eval").alias("split"),
                                    F.floor(F.col("turn") / 2).cast("int").alias("step"),
                                    F.col("conversation_id").alias("context"), F.col("utterance").alias("gen"))
    folder = io.scratch(spark, "gens")
    io.write_generations(t, folder)
    back = io.read_generations(spark, folder)
    return back.select("split", F.col("step").cast("int").alias("step"), "context", "gen")
