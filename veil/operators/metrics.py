"""Evaluation metrics and run selection.

Token-level quantities arrive as long tables ``(key…, pos, …)``; logits as
``array<double>`` columns.  Everything is an aggregation or a window; ranks
over a whole table use the range-partitioned ``positions`` helper.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions import arrays as AR
from veil.functions.ranking import null_safe_join, positions

IGNORE_INDEX = -100

# --- fixed values: dev objective priority and logged metric white-list -------
DEV_OBJECTIVE_ORDER = ["mnli/acc", "mnli-mm/acc", "f1", "mcc", "pearson", "acc"]
METRIC_WHITELIST = ["ppl", "eval_losses"]
# --- end of fixed values ------------------------------------------------------


# M1 -----------------------------------------------------------------------------
def example_loss(tok: DataFrame, key_cols: Sequence[str], nll_col: str = "nll",
                 label_col: str = "label") -> DataFrame:
    """Σ NLL over positions whose (shifted) label is not −100, / their count."""
    valid = F.col(label_col) != IGNORE_INDEX
    return tok.groupBy(*key_cols).agg(
        (F.sum(F.when(valid, F.col(nll_col))) / F.count_if(valid)).alias("loss"))


def shift_labels(tok: DataFrame, key_cols: Sequence[str], pos_col: str = "pos", label_col: str = "label") -> DataFrame:
    """Every position gets the label of the next one of its sequence; the last position goes."""
    w = Window.partitionBy(*key_cols).orderBy(pos_col)
    return tok.withColumn("__last", F.lead(pos_col).over(w).isNull()).withColumn(
        label_col, F.lead(label_col).over(w)).where(~F.col("__last")).drop("__last")


def token_losses(tok: DataFrame, key_cols: Sequence[str], logits_col: str, pos_col: str = "pos",
                 label_col: str = "label") -> DataFrame:
    """(key…, pos, label, nll, entropy) from logits: labels are shifted by one here;
    ignored positions stay, with null figures."""
    d = shift_labels(tok.select(*key_cols, pos_col, label_col, logits_col), key_cols, pos_col, label_col)
    valid = F.col(label_col) != IGNORE_INDEX
    lsm = AR.log_softmax(AR.to_double(logits_col))
    d = d.withColumn("__lp", lsm)
    entropy = -F.aggregate("__lp", F.lit(0.0), lambda a, x: a + F.exp(x) * x)
    return d.select(*key_cols, pos_col, label_col,
                    F.when(valid, -F.try_element_at("__lp", F.when(valid, F.col(label_col) + 1))).alias("nll"),
                    F.when(valid, entropy).alias("entropy"))


def valid_entropy(tok: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Mean entropy over the valid positions of ``token_losses``; null where there is none."""
    return tok.groupBy(*key_cols).agg(F.avg("entropy").alias("entropy"), F.count("entropy").alias("n"))


# M2 -----------------------------------------------------------------------------
def split_perplexity(batch_loss: DataFrame, split_col: str = "split", loss_col: str = "loss",
                     n_col: str = "n", batch_col: str = "batch", max_batches: int | None = None) -> DataFrame:
    """exp(Σ loss·n / Σ n) per split, optionally over the first batches only."""
    b = batch_loss if max_batches is None else batch_loss.where(F.col(batch_col) < max_batches)
    return b.groupBy(split_col).agg(
        F.exp(F.sum(F.col(loss_col) * F.col(n_col)) / F.sum(n_col)).alias("ppl"))


# M3 -----------------------------------------------------------------------------
def token_entropy(logits) -> Column:
    """−Σ p ln p of softmax(logits)."""
    lsm = AR.log_softmax(AR.to_double(logits))
    return -F.aggregate(lsm, F.lit(0.0), lambda a, x: a + F.exp(x) * x)


# M4 -----------------------------------------------------------------------------
def sequence_logprob(tok: DataFrame, key_cols: Sequence[str], lp_col: str = "logprob",
                     label_col: str = "label") -> DataFrame:
    """Sum and means of token log-probs; ignored positions count as 0 in the
    mean (Q8), ``*_valid`` is the mean over valid positions only."""
    valid = F.col(label_col) != IGNORE_INDEX
    lp = F.when(valid, F.col(lp_col)).otherwise(F.lit(0.0))
    return tok.groupBy(*key_cols).agg(
        F.sum(lp).alias("sequence_logprob"), F.avg(lp).alias("token_logprob"),
        F.avg(F.when(valid, F.col(lp_col))).alias("token_logprob_valid"))


# M5 -----------------------------------------------------------------------------
def binary_metrics(df: DataFrame, pred_col: str, label_col: str) -> DataFrame:
    """accuracy, F1 (positive class 1) and Matthews correlation."""
    p, y = F.col(pred_col), F.col(label_col)
    tp = F.count_if((p == 1) & (y == 1)).cast("double")
    tn = F.count_if((p == 0) & (y == 0)).cast("double")
    fp = F.count_if((p == 1) & (y == 0)).cast("double")
    fn = F.count_if((p == 0) & (y == 1)).cast("double")
    agg = df.agg(tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"),
                 F.avg((p == y).cast("double")).alias("acc"))
    f1 = F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    den = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn"))
                 * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    mcc = F.when(den == 0, F.lit(0.0)).otherwise((F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / den)
    return agg.select("acc", f1.alias("f1"), mcc.alias("mcc"))


# --- fixed values: metrics of a task -------------------------------------------
TASK_METRICS = {
    "cola": ["mcc"],
    "sst-2": ["acc"], "mnli": ["acc"], "mnli-mm": ["acc"], "qnli": ["acc"], "rte": ["acc"], "wnli": ["acc"],
    "mrpc": ["acc", "f1", "acc_and_f1"], "qqp": ["acc", "f1", "acc_and_f1"],
    "sts-b": ["pearson", "spearmanr", "corr"],
    "snli": ["acc"], "mr": ["acc"], "sst-5": ["acc"], "subj": ["acc"], "trec": ["acc"], "cr": ["acc"], "mpqa": ["acc"],
}
# --- end of fixed values ------------------------------------------------------


def task_metrics(df: DataFrame, task: str, pred_col: str, label_col: str, id_col: str) -> DataFrame:
    """(task, metric, value): the metrics that the task is judged by."""
    if task not in TASK_METRICS:
        raise KeyError(task)
    wanted = TASK_METRICS[task]
    if "pearson" in wanted:
        row = pearson_spearman(df, pred_col, label_col, id_col).select("pearson", F.col("spearman").alias("spearmanr"))
        row = row.withColumn("corr", (F.col("pearson") + F.col("spearmanr")) / 2)
    elif wanted == ["acc"]:
        row = accuracy(df, pred_col, label_col)
    else:
        row = binary_metrics(df, pred_col, label_col).withColumn("acc_and_f1", (F.col("acc") + F.col("f1")) / 2)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in wanted]))
    return row.select(F.lit(task).alias("task"), pairs.alias("x")).select("task", "x.metric", "x.value")


def accuracy(df: DataFrame, pred_col: str, label_col: str) -> DataFrame:
    return df.agg(F.avg((F.col(pred_col) == F.col(label_col)).cast("double")).alias("acc"))


def average_ranks(df: DataFrame, value_col: str, tie_col: str, out: str) -> DataFrame:
    """1-based ranks with ties averaged, without a single-partition window."""
    p = positions(df, [], [F.col(value_col), F.col(tie_col)], out="__p")
    avg_rank = p.groupBy(value_col).agg((F.avg("__p") + 1).alias(out))
    return null_safe_join(df, avg_rank, [value_col])


def pearson_spearman(df: DataFrame, x: str, y: str, id_col: str) -> DataFrame:
    r = average_ranks(average_ranks(df, x, id_col, "__rx"), y, id_col, "__ry")
    pear = df.agg(F.corr(x, y).alias("pearson"))
    spear = r.agg(F.corr("__rx", "__ry").alias("spearman"))
    return pear.join(spear, how="inner")


# M6 -----------------------------------------------------------------------------
def xent_and_zero_one(df: DataFrame, logits_col: str, label_col: str,
                      group_cols: Sequence[str] = ()) -> DataFrame:
    lsm = AR.log_softmax(AR.to_double(logits_col))
    xent = -F.element_at(lsm, F.col(label_col) + 1)
    err = (AR.argmax(logits_col) != F.col(label_col)).cast("double")
    return df.groupBy(*group_cols).agg(F.avg(xent).alias("xent"), F.avg(err).alias("zero_one"))


# M7 -----------------------------------------------------------------------------
def dev_objective(metrics_map, on_missing: str = "error",
                  order: Sequence[str] = tuple(DEV_OBJECTIVE_ORDER)) -> Column:
    """Struct(name, value) of the first present metric in the fixed order."""
    m = F.col(metrics_map) if isinstance(metrics_map, str) else metrics_map
    name = None
    for k in order:
        cond = m.getItem(k).isNotNull()
        name = F.when(cond, F.lit(k)) if name is None else name.when(cond, F.lit(k))
    name = name.otherwise(F.raise_error(F.lit("no dev objective present")) if on_missing == "error"
                          else F.lit(None).cast("string"))
    return F.struct(name.alias("objective"), m.getItem(name).alias("value"))


# M8 -----------------------------------------------------------------------------
def best_checkpoint(df: DataFrame, group_cols: Sequence[str], step_col: str = "step",
                    value_col: str = "value") -> DataFrame:
    """Strictly-better replaces: the maximum value, the earliest step on ties."""
    return df.groupBy(*group_cols).agg(
        F.max_by(F.col(step_col), F.struct(F.col(value_col), -F.col(step_col))).alias("best_step"),
        F.max(value_col).alias("best_value"))


# M9 -----------------------------------------------------------------------------
def flatten_metrics(log: DataFrame, splits: Sequence[str] = ("train", "val", "eval"),
                    whitelist: Sequence[str] = tuple(METRIC_WHITELIST), step_col: str = "global_step",
                    model_field: str = "model") -> DataFrame:
    """Nested ``{split: {model: {metric: value}}}`` records → (step, split, metric, value)."""
    parts = []
    for sp in splits:
        st = log.schema[sp].dataType[model_field].dataType
        for m in st.fieldNames():
            if m in whitelist:
                parts.append(F.struct(F.lit(sp).alias("split"), F.lit(m).alias("metric"),
                                      F.col(f"{sp}.{model_field}.{m}").cast("double").alias("value")))
    return log.select(F.col(step_col).alias("step"), F.explode(F.array(*parts)).alias("__m")).select(
        "step", "__m.split", "__m.metric", "__m.value")


# M10 ----------------------------------------------------------------------------
def grid_select(runs: DataFrame, group_cols: Sequence[str], setting_col: str,
                train_col: str = "train_loss", test_col: str = "test_loss") -> DataFrame:
    """Per group, the setting with the lowest mean train loss over seeds
    (smallest setting on ties), with mean and population std of train/test."""
    per = runs.groupBy(*group_cols, setting_col).agg(
        F.avg(train_col).alias("train_mean"), F.stddev_pop(train_col).alias("train_std"),
        F.avg(test_col).alias("test_mean"), F.stddev_pop(test_col).alias("test_std"))
    best = per.groupBy(*group_cols).agg(
        F.min_by(F.struct(setting_col, "train_mean", "train_std", "test_mean", "test_std"),
                 F.struct("train_mean", setting_col)).alias("b"))
    return best.select(*group_cols, "b.*")


# M11 ----------------------------------------------------------------------------
def iterate_average(df: DataFrame, group_cols: Sequence[str], step_col: str, value_col: str,
                    out: str = "running_avg") -> DataFrame:
    """Running mean ``avg·t/(t+1) + x/(t+1)`` = running sum / running count,
    computed with distributed prefix sums (a metric stream may hold a third of
    all rows; it is never sent to one task)."""
    from veil.functions.ranking import running_sum
    r = running_sum(df, group_cols, [step_col], value_col)
    return r.withColumn(out, F.col("running_sum") / F.col("running_n"))


# M12 ----------------------------------------------------------------------------
def windowed_loss(df: DataFrame, step_col: str, loss_col: str, logging_steps: int,
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean loss since the last log point, logged every ``logging_steps``
    (1-based steps): a bucketed aggregation, so no ordered pass is needed."""
    bucket = F.ceil(F.col(step_col) / F.lit(logging_steps))
    return (df.groupBy(*group_cols, bucket.alias("__b"))
            .agg(F.max(step_col).alias("__last"), (F.sum(loss_col) / F.lit(logging_steps)).alias("loss"))
            .where(F.col("__last") == F.col("__b") * logging_steps)
            .select(*group_cols, F.col("__last").alias("step"), "loss"))
