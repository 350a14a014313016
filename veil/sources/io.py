"""Sources and sinks (S1–S18) in the reference's file formats.

Every reader declares its schema (no inference).  Line order inside text
files comes from the scan itself: ``_metadata.file_block_start`` orders the
splits of a file and ``monotonically_increasing_id`` the lines inside a
split; line numbers are distributed ranks over this order, so no file or
folder passes through one task.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veil.functions.ranking import positions
from veil.session import checkpoint_dir
from veil.sources.json_split import json_records, read_json_records
from veil.sources.multiline import read_csv

DIALOGUE_SCHEMA = T.StructType([
    T.StructField("conversationId", T.StringType()),
    T.StructField("turnNumber", T.IntegerType()),
    T.StructField("authorRole", T.StringType()),
    T.StructField("utterance", T.StringType()),
])

ATTACK_SCHEMA = T.StructType([
    T.StructField("prompt", T.StringType()), T.StructField("gen", T.StringType()),
    T.StructField("target_ppl", T.DoubleType()), T.StructField("ref_ppl", T.DoubleType()),
    T.StructField("lower_ppl", T.DoubleType()), T.StructField("zlib", T.DoubleType()),
    T.StructField("success", T.BooleanType()),
])


# quoted fields as they are: blanks at their ends stay
CSV_OUT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/veil_io/{name}_{uuid.uuid4().hex[:12]}"


def _existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Keep the paths that exist (Hadoop FS check on the driver: metadata only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            out.append(p)
    return out


def with_line_order(df: DataFrame) -> DataFrame:
    """Add (``folder``, ``file``, ``__blk``, ``__mid``): lines are in order of
    (file name, split start, position inside the split).  Spark's part files
    are zero-padded, so a folder written in order reads back in order."""
    return df.select("*", F.col("_metadata.file_path").alias("file"),
                     F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1).alias("folder"),
                     F.col("_metadata.file_block_start").alias("__blk"),
                     F.monotonically_increasing_id().alias("__mid"))


LINE_ORDER = ("file", "__blk", "__mid")


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as the scan's metadata spells it (scheme and all)."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hp).toUri().toString()


def _same_place(file: Column, path: str) -> Column:
    """Whether a file is ``path`` or lies in the folder ``path``, however its scheme is written."""
    plain = path.split(":", 1)[1].lstrip("/")
    name = F.regexp_replace(file, "^[a-z0-9]+:/*", "")
    return (name == plain) | name.startswith(plain + "/")


# S1 / S2 ----------------------------------------------------------------------
def domain_from_path(path_col="file", upper: bool = True):
    """Domain = file stem (a Spark output folder named ``<stem>.tsv`` counts as the file)."""
    p = F.col(path_col) if isinstance(path_col, str) else path_col
    stem = F.coalesce(F.nullif(F.regexp_extract(p, r"([^/]+)\.tsv(/|$)", 1), F.lit("")),
                      F.regexp_extract(p, r"([^/]+?)(\.[^./]*)?$", 1))
    return F.upper(stem) if upper else stem


def read_dialogues(spark: SparkSession, paths: Sequence[str] | str, skip_missing: bool = True) -> DataFrame:
    """Comma-separated dialogue files with a header (although named ``.tsv``);
    the domain is the file stem, upper-cased (Q4); missing files are skipped.
    Fields may hold line breaks, and yet a file is read by several tasks."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if skip_missing:
        paths = _existing(spark, paths)
    d = read_csv(spark, paths, DIALOGUE_SCHEMA)
    return d.select(F.col("conversationId").alias("conversation_id"), F.col("turnNumber").alias("turn"),
                    F.col("authorRole").alias("role"), F.col("utterance"),
                    domain_from_path(F.col("file")).alias("domain"))


def write_dialogues(df: DataFrame, folder: str) -> list[str]:
    """One ``<domain lower>.tsv`` (CSV with header) per domain; returns the paths."""
    domains = [r[0] for r in df.select("domain").distinct().collect()]    # the domain set: small
    out = []
    for d in sorted(domains):
        path = f"{folder}/{d.lower()}.tsv"
        (df.where(F.col("domain") == d)
         .select(F.col("conversation_id").alias("conversationId"), F.col("turn").alias("turnNumber"),
                 F.col("role").alias("authorRole"), "utterance")
         .write.mode("overwrite").options(**CSV_OUT).csv(path))
        out.append(path)
    return out


# S3 / S4 -----------------------------------------------------------------------
def read_lines(spark: SparkSession, paths: Sequence[str], max_examples: int | None = None,
               keep_linebreaks: bool = False) -> DataFrame:
    """Text lines, the first n per file, files concatenated in list order →
    (file_idx, line_no, value)."""
    d = with_line_order(spark.read.text(list(paths)))
    which = F.coalesce(*[F.when(_same_place(F.col("file"), _qualified(spark, p)), F.lit(i)) for i, p in enumerate(paths)])
    d = positions(d.withColumn("file_idx", which), ["file_idx"], LINE_ORDER, out="line_no")
    if max_examples is not None:
        d = d.where(F.col("line_no") < max_examples)
    v = F.concat("value", F.lit("\n")) if keep_linebreaks else F.col("value")
    return d.select("file_idx", "line_no", v.alias("value"))


def read_prompts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All lines of the listed prompt files, stripped."""
    from veil.functions.text import py_strip
    return read_lines(spark, paths).withColumn("value", py_strip("value"))


def write_lines(df: DataFrame, path: str, order_col: str, col: str = "value") -> None:
    """Text file(s) in ``order_col`` order (range-partitioned: parts are in order)."""
    df.select(order_col, col).repartitionByRange(order_col).sortWithinPartitions(order_col) \
        .select(col).write.mode("overwrite").text(path)


# S5 ---------------------------------------------------------------------------
def read_keywords(spark: SparkSession, path: str, per_domain: bool = True) -> DataFrame:
    """JSON ``{domain: [phrase]}`` → (domain, phrase) lower-cased (or phrase only)."""
    raw = spark.read.text(path, wholetext=True)                         # a small dictionary file
    m = raw.select(F.from_json("value", "map<string, array<string>>").alias("m"))
    d = m.select(F.explode("m").alias("domain", "phrases")).select("domain", F.explode("phrases").alias("phrase"))
    d = d.withColumn("phrase", F.lower("phrase"))
    return d if per_domain else d.select("phrase")


# S6 ---------------------------------------------------------------------------
def write_split_manifest(manifest: DataFrame, path: str) -> None:
    """Long form ``(domain, split, pos, conversation_id)`` as JSON lines,
    partitioned by domain and split (no domain is ever gathered into one row)."""
    manifest.write.mode("overwrite").partitionBy("domain", "split").json(path)


def read_split_manifest(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """Either the long JSON-lines form or the reference's nested JSON
    ``{domain: {test: [id], valid: [id], train: [id]}}``."""
    if not nested:
        return spark.read.schema("pos long, conversation_id string, domain string, split string").json(path) \
            .select("domain", "split", "pos", "conversation_id")
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.from_json("value", "map<string, map<string, array<string>>>").alias("m"))
    d = m.select(F.explode("m").alias("domain", "s")).select("domain", F.explode("s").alias("split", "ids"))
    return d.select("domain", "split", F.posexplode("ids").alias("pos", "conversation_id"))


# S7 / S8 -----------------------------------------------------------------------
def read_tsv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a GLUE TSV with their line number (header is line 0)."""
    d = with_line_order(spark.read.text(path))
    return positions(d, ["folder"], LINE_ORDER, out="line_no").select("line_no", "value")


def read_headerless_csv(spark: SparkSession, path: str, n_cols: int) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n_cols)])
    d = with_line_order(spark.read.schema(schema).option("header", False).option("multiLine", False).csv(path))
    return positions(d, ["folder"], LINE_ORDER, out="line_no").drop("folder", "file", "__blk", "__mid")


# S9 is lmdata.split_src_tgt over read.text ------------------------------------------

# S10 / S11 ---------------------------------------------------------------------
WEBNLG_ENTRY = ("struct<lexicalisations: array<struct<comment: string, lex: string>>, "
                "modifiedtripleset: array<struct<subject: string, property: string, object: string>>, eid: long>")


def read_webnlg(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``{entries: [{"<i+1>": {...}}]}`` documents → one row per entry
    (``entry_id`` = i+1 inside its document, ``eid`` the entry's own id).
    ``multi_line``: large documents, as the reference ships them, read by
    several tasks; ``False`` for files with one document per line (our writer)."""
    if multi_line:
        rows = json_records(spark, [path], level=2)
        m = F.map_entries(F.from_json("record", f"map<string, {WEBNLG_ENTRY}>"))[0]
        return rows.select(m.alias("m")).select(F.col("m.key").cast("int").alias("entry_id"), "m.value.*")
    raw = spark.read.schema(f"entries array<map<string, {WEBNLG_ENTRY}>>").json(path)
    e = raw.select(F.posexplode("entries").alias("i", "m"))
    return e.select((F.col("i") + 1).alias("entry_id"),
                    F.element_at("m", (F.col("i") + 1).cast("string")).alias("x")).select("entry_id", "x.*")


def write_webnlg(entries: DataFrame, path: str, key_col: str = "entry_id") -> None:
    """The nested reference layout, one document of one entry per line; the
    entry is number 1 of its document and keeps its id in ``eid``."""
    item = F.struct("lexicalisations", "modifiedtripleset", F.col(key_col).cast("long").alias("eid"))
    doc = F.struct(F.array(F.create_map(F.lit("1"), item)).alias("entries"))
    entries.select(F.to_json(doc).alias("value")).write.mode("overwrite").text(path)


def _write_arrays(df: DataFrame, path: str) -> None:
    """A JSON array of one record per line."""
    df.select(F.to_json(F.array(F.struct(*df.columns))).alias("value")).write.mode("overwrite").text(path)


def write_dart(examples: DataFrame, path: str) -> None:
    """DART layout: JSON arrays of examples, one example per line."""
    _write_arrays(examples, path)


def read_dart(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``[{tripleset: [[s, p, o]], annotations: [{text}]}]``: a JSON array per file
    (``multi_line``, read by several tasks) or per line."""
    schema = "tripleset array<array<string>>, annotations array<struct<text: string>>, example_id long"
    if multi_line:
        return read_json_records(spark, [path], schema).drop("file", "record_no")
    return spark.read.schema(schema).json(path)


# S12 / S18 ----------------------------------------------------------------------
def read_attack_results(spark: SparkSession, path: str) -> DataFrame:
    """Attack CSV with header; an empty ``gen`` comes back null.  Line breaks in
    fields do not keep a file from being read by several tasks."""
    return read_csv(spark, [path], ATTACK_SCHEMA).drop("file", "record_no")


def write_attack_results(df: DataFrame, path: str, ratio_path: str | None = None,
                         target_col: str = "target_ppl", ref_col: str = "ref_ppl") -> None:
    cols = [c.name for c in ATTACK_SCHEMA]
    out = df.select(*[F.col(c).cast(ATTACK_SCHEMA[c].dataType) for c in cols])
    out.write.mode("overwrite").options(**CSV_OUT).csv(path)
    if ratio_path:
        r = F.try_divide(target_col, ref_col)
        (out.where(F.col("gen").isNotNull() & (F.length("gen") > 0))
         .orderBy(F.when(F.isnan(r), None).otherwise(r).asc_nulls_first())
         .write.mode("overwrite").options(**CSV_OUT).csv(ratio_path))


# S13 ---------------------------------------------------------------------------
def read_vectors(spark: SparkSession, path: str, start: int = 0, n: int | None = None,
                 batch_size: int | None = None, idx_col: str = "idx") -> DataFrame:
    """Vectors stored as parquet ``(idx, vec array<float>)``; window
    ``[start, start+n)`` pushed to the scan; optional batch number."""
    d = spark.read.parquet(path).where(F.col(idx_col) >= start)
    if n is not None:
        d = d.where(F.col(idx_col) < start + n)
    if batch_size:
        d = d.withColumn("batch", F.floor((F.col(idx_col) - start) / batch_size))
    return d


# S14 ---------------------------------------------------------------------------
def write_metric_log(log: DataFrame, path: str) -> None:
    """The reference layout: JSON arrays of records, one record per line."""
    _write_arrays(log, path)


def read_metric_log(spark: SparkSession, path: str, schema: str | None = None,
                    multi_line: bool = True) -> DataFrame:
    """Records of a JSON array; with a schema one large array is read by several tasks."""
    if schema and multi_line:
        return read_json_records(spark, [path], schema).drop("file", "record_no")
    r = spark.read.option("multiLine", multi_line)
    return (r.schema(schema) if schema else r).json(path)


# S15 / S16 / S17 ------------------------------------------------------------------
def write_split_text(df: DataFrame, path: str, kind: str = "") -> list[str]:
    """``<split>/<domain>{kind}.txt`` (each a folder of part files); returns the
    paths.  ``kind`` ∈ {"", "_prompts", "_prompts_full"}."""
    out = []
    for r in df.select("split", "domain").distinct().orderBy("split", "domain").collect():    # splits × domains
        target = f"{path}/{r['split']}/{r['domain'].lower()}{kind}.txt"
        df.where((F.col("split") == r["split"]) & (F.col("domain") == r["domain"])) \
            .select(F.col("text").alias("value")).write.mode("overwrite").text(target)
        out.append(target)
    return out


def write_redacted(df: DataFrame, path: str, domain_col: str = "domain") -> None:
    """Redacted dialogue CSV; the domain column is dropped before writing."""
    d = df.drop(domain_col) if domain_col in df.columns else df
    d.write.mode("overwrite").options(**CSV_OUT).csv(path)


def write_generations(df: DataFrame, path: str, context_col: str = "context", gen_col: str = "gen",
                      partition_cols: Sequence[str] = ("split", "step")) -> None:
    """JSON lines ``{context, gen}`` per split and step."""
    d = df.select(*partition_cols, F.to_json(F.struct(F.col(context_col).alias("context"),
                                                      F.col(gen_col).alias("gen"))).alias("value"))
    d.write.mode("overwrite").partitionBy(*partition_cols).text(path)


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.text(path)
    return d.select("*", F.from_json("value", "context string, gen string").alias("j")).select(
        *[c for c in d.columns if c != "value"], "j.context", "j.gen")
