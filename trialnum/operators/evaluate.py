"""Predictions against gold: exact or loose match, overall, per fold or inner.

The confusion cells only need counts of row pairs with the same key. Both sides are one
tagged table, counted by (key, value) and then by key, and products of the counts are added up. That gives the
numbers of the row-by-row outer join without building it and reads each table once: a key that
holds a third of all rows collapses in the map-side aggregation and no pair of rows is ever emitted.
``match_rows`` gives the joined rows themselves where they are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["precision", "recall", "accuracy", "f1"]
TOLERANCE = 0.1


def exact_match(gold: Column, pred: Column) -> Column:
    """Equal values or both missing; never NULL."""
    return gold.eqNullSafe(pred)


def loose_match(total: Column, poss: Column, pred: Column, known: Column, tolerance: float) -> Column:
    """One of the possible values, the total, the total within the tolerance, or both missing.

    ``known`` tells whether the document is annotated at all; if not, nothing matches.
    """
    low = total * (F.lit(1.0) - F.lit(float(tolerance)))
    high = total * (F.lit(1.0) + F.lit(float(tolerance)))
    near = (low <= pred) & (pred <= high)
    possible = F.array_contains(F.filter(poss, lambda p: p.isNotNull()), pred)
    hit = (
        F.coalesce(possible, F.lit(False))
        | F.coalesce(total == pred, F.lit(False))
        | F.coalesce(near, F.lit(False))
        | (total.isNull() & pred.isNull())
    )
    return F.coalesce(known, F.lit(False)) & hit


def _keys(df: DataFrame, value: str, *more: str) -> DataFrame:
    return df.select(F.col("pmid").cast("bigint").alias("pmid"), F.col(value).alias(value), *more)


def match_rows(
    gold: DataFrame,
    pred: DataFrame,
    annotations: DataFrame | None = None,
    how: str = "full_outer",
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Gold and prediction rows joined on ``pmid`` with null flags and the ``same`` flag.

    With ``annotations (pmid, total, poss)`` the match is the loose one. The outer
    join is an inner join and two anti joins: unlike a full outer join, the
    adaptive planner can split hot keys in each of them.
    """
    fold = ["fold_id"] if "fold_id" in gold.columns else []
    g = _keys(gold, "tt_sample_size", *fold)
    p = _keys(pred, "pred_ss")
    rows = g.join(p, "pmid", "inner")
    if how == "full_outer":
        only_gold = g.join(p.select("pmid").distinct(), "pmid", "left_anti")
        only_pred = p.join(g.select("pmid").distinct(), "pmid", "left_anti")
        rows = rows.unionByName(only_gold, allowMissingColumns=True).unionByName(
            only_pred, allowMissingColumns=True
        )
    if annotations is None:
        same = exact_match(F.col("tt_sample_size"), F.col("pred_ss"))
    else:
        ann = annotations.select(
            F.col("pmid").cast("bigint").alias("pmid"), "total", "poss", F.lit(True).alias("_known")
        )
        rows = rows.join(ann, "pmid", "left")
        same = loose_match(
            F.col("total"), F.col("poss"), F.col("pred_ss"), F.col("_known"), tolerance
        )
    return rows.select(
        "pmid", "tt_sample_size", *fold, "pred_ss",
        F.col("tt_sample_size").isNull().alias("no_ss"),
        F.col("pred_ss").isNull().alias("no_pred_ss"),
        same.alias("same"),
    )


def _added(df: DataFrame, keys: list[str], *names: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def confusion_exact(
    gold: DataFrame, pred: DataFrame, by_fold: bool = False, how: str = "full_outer"
) -> DataFrame:
    """TP, TN, FP, FN, joined rows and gold rows, in one row or one row per fold."""
    fold = F.col("fold_id") if by_fold else F.lit(0)
    sides = gold.select(
        F.col("pmid").cast("bigint").alias("pmid"), F.col("tt_sample_size").alias("value"), fold.alias("fold_id"),
        F.lit(1).cast("bigint").alias("g"), F.lit(0).cast("bigint").alias("p"),
    )
    # values meet as they are: a gold number of 50.7 is no 50
    other = _keys(pred, "pred_ss").select(
        "pmid", F.col("pred_ss").alias("value"), F.lit(None).alias("fold_id"), F.lit(0).cast("bigint").alias("g"), F.lit(1).cast("bigint").alias("p")
    )
    counts = _added(sides.unionByName(other), ["pmid", "value", "fold_id"], "g", "p")
    # gold rows of the folds that a value stands in, with the predictions that are equal
    golds = F.collect_list(F.when(F.col("g") > 0, F.struct("fold_id", "g")))
    values = counts.groupBy("pmid", "value").agg(F.sum("p").alias("p"), golds.alias("golds"))
    some = F.col("value").isNotNull().cast("int")
    entries = F.concat(
        F.array(F.struct(F.lit(None).cast(counts.schema["fold_id"].dataType).alias("fold_id"), F.lit(False).alias("is_gold"), F.lit(0).cast("bigint").alias("g"), F.col("p").alias("p"))),
        F.transform("golds", lambda x: F.struct(x["fold_id"].alias("fold_id"), F.lit(True).alias("is_gold"), x["g"].alias("g"), F.lit(0).cast("bigint").alias("p"))),
    )
    rows = values.select("pmid", some.alias("some"), F.col("p").alias("equal"), F.inline(entries))
    rows = rows.select(
        "pmid", "fold_id", "is_gold", F.col("g").alias("g_all"), (F.col("g") * F.col("some")).alias("g_some"),
        F.col("p").alias("p_all"), (F.col("p") * F.col("some")).alias("p_some"), (F.col("g") * F.col("equal") * F.col("some")).alias("tp"),
    )
    folds = _added(rows, ["pmid", "fold_id", "is_gold"], "g_all", "g_some", "p_all", "p_some", "tp")
    g_all, g_some = F.coalesce("gold.g_all", F.lit(0)), F.coalesce("gold.g_some", F.lit(0))
    # a side without rows takes part as one row of NULLs
    g_rows, p_rows = F.greatest(g_all, F.lit(1)), F.greatest("p_all", F.lit(1))
    taken = (g_all > 0) & (F.col("p_all") > 0) if how == "inner" else F.lit(True)
    tp = F.coalesce("gold.tp", F.lit(0))
    cells = {
        "tp": tp,
        "tn": (g_rows - g_some) * (p_rows - F.col("p_some")),
        "fp": g_rows * F.col("p_some") - tp,
        "fn": g_some * (p_rows - F.col("p_some")),
        "joined_rows": g_rows * p_rows,
    }
    return _cells(_per_key(folds, ["p_all", "p_some"], ["g_all", "g_some", "tp"]), cells, g_all, taken, by_fold)


def _per_key(folds: DataFrame, pred: list[str], gold: list[str]) -> DataFrame:
    """One row per key and fold of its gold rows, or per key without any, with the key's ``pred`` counts.

    The list that is held for a key has one entry for each of its folds.
    """
    listed = F.collect_list(F.when(F.col("is_gold"), F.struct("fold_id", *gold)))
    keys = folds.groupBy("pmid").agg(*[F.sum(c).alias(c) for c in pred], listed.alias("golds"))
    return keys.select(*pred, F.explode_outer("golds").alias("gold"))


def _cells(rows: DataFrame, cells: dict[str, Column], g_all: Column, taken: Column, by_fold: bool) -> DataFrame:
    """Cells added up, with the row count that accuracy divides by: all gold rows, or the fold's joined rows."""
    sums = {name: F.when(taken, cell).otherwise(0) for name, cell in cells.items()}
    sums["gold_rows"] = sums["joined_rows"] if by_fold else g_all
    totals = [F.coalesce(F.sum(cell), F.lit(0)).alias(name) for name, cell in sums.items()]
    if not by_fold:
        return rows.agg(*totals)
    return rows.where("gold.fold_id IS NOT NULL").groupBy(F.col("gold.fold_id").alias("fold_id")).agg(*totals)


def confusion_loose(
    gold: DataFrame,
    pred: DataFrame,
    annotations: DataFrame,
    by_fold: bool = False,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """As ``confusion_exact``, matching against ``annotations (pmid, total, poss)``, one row per document.

    Whether a prediction matches depends on its document only, so predictions are
    judged once per distinct (pmid, value), gold rows counted per fold before.
    """
    fold = F.col("fold_id") if by_fold else F.lit(0)
    none = F.lit(0).cast("bigint")
    g = gold.select(F.col("pmid").cast("bigint").alias("pmid"), fold.alias("fold_id"), F.col("tt_sample_size").isNotNull().cast("bigint").alias("some"))
    g = g.groupBy("pmid", "fold_id").agg(F.count(F.lit(1)).alias("g_all"), F.sum("some").alias("g_some"))
    p = _keys(pred, "pred_ss").groupBy("pmid", "pred_ss").agg(F.count(F.lit(1)).alias("n"))
    sides = g.select("*", F.lit(True).alias("is_gold"), none.alias("n")).unionByName(
        p.select("*", F.lit(False).alias("is_gold"), none.alias("g_all"), none.alias("g_some")), allowMissingColumns=True
    )
    ann = annotations.select(
        F.col("pmid").cast("bigint").alias("pmid"), "total", "poss", F.lit(True).alias("_known")
    )
    # a gold row has no prediction here, so for it this tells whether a missing one would match
    same = loose_match(F.col("total"), F.col("poss"), F.col("pred_ss"), F.col("_known"), tolerance)
    judged = sides.join(ann, "pmid", "left").withColumn("same", same)
    has, predicted = F.col("pred_ss").isNotNull(), F.col("n")
    rows = judged.select(
        "pmid", "fold_id", "is_gold", "g_all", "g_some", predicted.alias("p_all"),
        F.when(F.col("same"), predicted).otherwise(0).alias("p_same"),
        F.when(has & ~F.col("same"), predicted).otherwise(0).alias("p_wrong"),
        F.when(~has, predicted).otherwise(0).alias("p_none"),
        F.when(F.col("is_gold") & F.col("same"), 1).otherwise(0).alias("none_same"),
    )
    keys = _per_key(rows, ["p_all", "p_same", "p_wrong", "p_none", "none_same"], ["g_all", "g_some"])
    g_all, g_some = F.coalesce("gold.g_all", F.lit(0)), F.coalesce("gold.g_some", F.lit(0))
    g_rows = F.greatest(g_all, F.lit(1))
    # documents without a prediction row meet the match rule with a NULL prediction
    missing = F.col("p_all") == 0
    p_same = F.when(missing, F.least("none_same", F.lit(1))).otherwise(F.col("p_same"))
    p_none = F.when(missing, 1).otherwise(F.col("p_none"))
    cells = {
        "tp": g_some * p_same,
        "tn": (g_rows - g_some) * p_none,
        "fp": g_rows * F.col("p_wrong"),
        "fn": g_some * p_none,
        "joined_rows": g_rows * F.greatest("p_all", F.lit(1)),
    }
    return _cells(keys, cells, g_all, F.lit(True), by_fold)


def metrics(confusion: DataFrame) -> DataFrame:
    """Precision, recall, accuracy and F1 of confusion rows; NULL where a divisor is 0."""
    keep = [c for c in ("fold_id",) if c in confusion.columns]
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    accuracy = F.try_divide(F.col("tp") + F.col("tn"), F.col("gold_rows"))
    rows = confusion.select(
        *keep, precision.alias("precision"), recall.alias("recall"), accuracy.alias("accuracy")
    )
    f1 = F.try_divide(
        2 * (F.col("precision") * F.col("recall")), F.col("precision") + F.col("recall")
    )
    return rows.withColumn("f1", f1)


def evaluate_exact(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return metrics(confusion_exact(gold, pred))


def evaluate_exact_cv(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row per fold; accuracy is over the fold's joined rows."""
    return metrics(confusion_exact(gold, pred, by_fold=True))


def evaluate_exact_predicted(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Only documents that have a prediction row; accuracy is still over all gold rows."""
    return metrics(confusion_exact(gold, pred, how="inner"))


def evaluate_loose(
    gold: DataFrame, pred: DataFrame, annotations: DataFrame, tolerance: float = TOLERANCE
) -> DataFrame:
    return metrics(confusion_loose(gold, pred, annotations, tolerance=tolerance))


def evaluate_loose_cv(
    gold: DataFrame, pred: DataFrame, annotations: DataFrame, tolerance: float = TOLERANCE
) -> DataFrame:
    return metrics(confusion_loose(gold, pred, annotations, by_fold=True, tolerance=tolerance))


def fold_summary(fold_metrics: DataFrame) -> DataFrame:
    """Least, greatest and mean value of every metric over the folds, one row per metric."""
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]
        )
    )
    return (
        fold_metrics.select(pairs.alias("m"))
        .groupBy(F.col("m.metric").alias("metric"))
        .agg(
            F.min("m.value").alias("min"),
            F.max("m.value").alias("max"),
            F.avg("m.value").alias("mean"),
        )
    )
