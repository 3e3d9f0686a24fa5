"""Evaluation: confusion matrices, per-class reports, AUC, latencies, decision rules.

Frames have y_true and y_pred (classes 0..3: human benign, human phishing, generated
benign, generated phishing). Each report is one aggregate of conditional sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = (0, 1, 2, 3)
PHISHING, GENERATED = (1, 3), (2, 3)


def ratio(top: Column, bottom: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(bottom == 0, 0.0).otherwise(top.cast("double") / bottom)


def scored(truth: DataFrame, predicted: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, y_true, y_pred of the records that both tables have."""
    return truth.select(key, "y_true").join(predicted.select(key, "y_pred"), key)


def confusion_matrix(df: DataFrame) -> DataFrame:
    """y_true and a column for each predicted class, all classes, zeros filled in."""
    counts = df.groupBy("y_true").pivot("y_pred", list(CLASSES)).count()
    rows = df.sparkSession.createDataFrame([(c,) for c in CLASSES], "y_true int")
    return rows.join(counts, "y_true", "left").na.fill(0).select("y_true", *(F.col(str(c)).alias(f"pred_{c}") for c in CLASSES))


def class_report(df: DataFrame) -> DataFrame:
    """class, precision, recall, f1, support for each class."""
    t, p = F.col("y_true"), F.col("y_pred")
    sums = [x for c in CLASSES for x in (F.count_if((t == c) & (p == c)).alias(f"tp{c}"), F.count_if(p == c).alias(f"p{c}"), F.count_if(t == c).alias(f"t{c}"))]
    one = df.agg(*sums)
    rows = F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"tp{c}").alias("tp"), F.col(f"p{c}").alias("p"), F.col(f"t{c}").alias("t")) for c in CLASSES))
    r = one.select(F.inline(rows))
    return r.select("class", ratio(F.col("tp"), F.col("p")).alias("precision"), ratio(F.col("tp"), F.col("t")).alias("recall"), ratio(2 * F.col("tp"), F.col("p") + F.col("t")).alias("f1"), F.col("t").alias("support"))


def summary(df: DataFrame) -> DataFrame:
    """accuracy, macro and weighted scores over the four classes."""
    r = class_report(df)
    n = F.sum("support")
    out = r.agg(ratio(F.sum(F.col("recall") * F.col("support")), n).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"))
    return out


def binary_metrics(df: DataFrame, positive: tuple[int, ...] = PHISHING) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall, f1, fpr and bypass rate of a set of classes against the rest."""
    t, p = F.col("y_true").isin(*positive), F.col("y_pred").isin(*positive)
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    recall = ratio(tp, tp + fn)
    return c.select("*", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), recall.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"), (1 - recall).alias("bypass_rate"))


def cohort_rates(df: DataFrame) -> DataFrame:
    """cohort, rate: the share of each true class that is called phishing (false positives of benign ones, recall of the others)."""
    return df.groupBy(F.col("y_true").alias("cohort")).agg(F.avg(F.col("y_pred").isin(*PHISHING).cast("int")).alias("rate"), F.count("*").alias("n"))


def auc_one_vs_rest(df: DataFrame, probs: tuple[str, ...] = ("p0", "p1", "p2", "p3")) -> DataFrame:
    """class, auc by rank sums, ties at their mean rank; null where a class or its rest is empty.

    Scores from 0 to 1 are counted by value, so that ties cost nothing, and summed up in
    blocks, so that no task sorts all of them.
    """
    long = df.select("y_true", F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(p).alias("score")) for c, p in enumerate(probs)))).alias("x")).select("x.*", (F.col("x.class") == F.col("y_true")).alias("hit"))
    per = long.groupBy("class", "score").agg(F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    per = per.withColumn("block", F.floor(F.col("score") * 4096))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = per.groupBy("class", "block").agg(F.sum("neg").alias("neg"))
    blocks = blocks.select("class", "block", F.coalesce(F.sum("neg").over(before("class").orderBy("block")), F.lit(0)).alias("below"))
    inside = F.coalesce(F.sum("neg").over(before("class", "block").orderBy("score")), F.lit(0))
    won = per.join(blocks, ["class", "block"]).withColumn("won", F.col("pos") * (F.col("below") + inside + F.col("neg") / 2))
    out = won.groupBy("class").agg(F.sum("won").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select("class", F.expr("try_divide(w, p * n)").alias("auc"))


def macro_auc(df: DataFrame, probs: tuple[str, ...] = ("p0", "p1", "p2", "p3")) -> DataFrame:
    """auc: the mean of the classes' one-vs-rest areas; null if a class or its rest is empty."""
    per = auc_one_vs_rest(df, probs)
    return per.agg(F.when(F.count("auc") == len(probs), F.avg("auc")).alias("auc"))


def quantiles(df: DataFrame, col: str, shares: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """keys and a column for each share: exact quantiles, interpolated, of a number's distinct values and their counts.

    Values are counted first and summed up in blocks of their order, so that no task holds a
    group's values and none sorts more than a block's.
    """
    keys = keys or []
    x = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("__x"))
    per = x.groupBy(*keys, "__x").agg(F.count("*").alias("__c")).withColumn("__all", F.lit(0))
    # doubles in their order: the exponent and the first bits of the fraction
    low = F.log2(F.greatest(F.abs("__x"), F.lit(2.0**-60)))
    per = per.withColumn("__b", F.floor(F.signum("__x") * (low + 61) * 64))
    group = [*keys, "__all"]
    blocks = per.groupBy(*group, "__b").agg(F.sum("__c").alias("__n"))
    whole = Window.partitionBy(*group)
    blocks = blocks.select(*group, "__b", (F.sum("__n").over(whole.orderBy("__b")) - F.col("__n")).alias("__o"), F.sum("__n").over(whole).alias("__total"))
    upto = F.col("__o") + F.sum("__c").over(Window.partitionBy(*group, "__b").orderBy("__x"))
    r = per.join(blocks, [*group, "__b"]).withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("__c"))
    out = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("__total") - 1)
        value = lambda k: F.max(F.when((F.col("__from") <= k) & (k < F.col("__to")), F.col("__x")))
        low, high, part = value(F.floor(at)), value(F.ceil(at)), F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return r.groupBy(*keys).agg(*out) if keys else r.agg(*out)


def latency_stats(df: DataFrame, col: str = "latency_ms") -> DataFrame:
    """mean, median and 95th percentile (interpolated) of positive latencies, and messages a second; zeros without any."""
    ok = df.filter(F.col(col) > 0)
    out = ok.agg(F.avg(col).alias("mean_ms")).crossJoin(quantiles(ok, col, {"median_ms": 0.5, "p95_ms": 0.95}))  # one row each
    return out.na.fill(0.0).withColumn("per_second", ratio(F.lit(1000.0), F.col("mean_ms")))


def best_class(probs: Column) -> Column:
    """The first of the largest."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def decision_rules(probs: Column) -> dict[str, Column]:
    """The three rules for phishing that are in use: by class or mass (service), by mass (baseline), by class (exported model)."""
    c = best_class(probs)
    by_class = c.isin(*PHISHING)
    mass = (probs[1] + probs[3]) >= 0.5
    return {"predicted_class": c, "service": by_class | mass, "baseline": mass, "exported": by_class}


# Reply of the filter daemon, and actions that count as spam.
DAEMON_REPLY = r"(?i)Spam:\s*(True|False|Yes|No)\s*;\s*([-\d.]+)\s*/\s*([-\d.]+)"
SPAM_ACTIONS = ("reject", "add header")


def daemon_verdict(reply: Column) -> dict[str, Column]:
    """is_spam, score, threshold, action of a text reply; not spam, 0 and 5 without one."""
    flag = F.lower(F.regexp_extract(reply, DAEMON_REPLY, 1))
    number = lambda k, default: F.coalesce(F.regexp_extract(reply, DAEMON_REPLY, k).try_cast("double"), F.lit(default))
    spam = flag.isin("true", "yes")
    return {"is_spam": spam, "score": number(2, 0.0), "threshold": number(3, 5.0), "action": F.when(spam, "spam").otherwise("ham")}


def service_verdict(reply: Column) -> dict[str, Column]:
    """The same of a JSON reply, with the names of its symbols."""
    j = F.from_json(reply, "score double, required_score double, action string, is_spam boolean, symbols map<string,string>")
    action = F.coalesce(j["action"], F.lit("no action"))
    return {
        "is_spam": F.coalesce(j["is_spam"], F.lit(False)) | action.isin(*SPAM_ACTIONS),
        "score": F.coalesce(j["score"], F.lit(0.0)),
        "threshold": F.coalesce(j["required_score"], F.lit(15.0)),
        "action": action,
        "symbols": F.array_sort(F.coalesce(F.map_keys(j["symbols"]), F.array().cast("array<string>"))),
    }


def side_by_side(df: DataFrame, system: str = "system") -> DataFrame:
    """A row for each system over rows of (system, y_true of four classes, flagged, latency_ms): counts, scores, catch and bypass rates of phishing by origin, false alarms by origin, latencies.

    A null flag is no alarm, as of an engine that gave no answer; ``unanswered`` counts them. A row without y_true is left out, one without a system is the system null.
    """
    rows = df.filter("y_true is not null").select(F.col(system).alias("system"), "y_true", F.coalesce("flagged", F.lit(False)).alias("flagged"), F.col("flagged").isNull().alias("none"), "latency_ms")
    t, hit = F.col("y_true").isin(*PHISHING), F.col("flagged")
    count = lambda c, name: F.count_if(c).alias(name)
    sums = rows.groupBy("system").agg(
        F.count("*").alias("n"), count(t & hit, "tp"), count(~t & hit, "fp"), count(~t & ~hit, "tn"), count(t & ~hit, "fn"), count(F.col("none"), "unanswered"),
        *(count(F.col("y_true") == c, f"n{c}") for c in CLASSES), *(count((F.col("y_true") == c) & hit, f"hit{c}") for c in CLASSES),
        F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).alias("mean_ms"),
    )
    spread = quantiles(rows.filter("latency_ms > 0"), "latency_ms", {"median_ms": 0.5, "p95_ms": 0.95}, ["system"]).withColumnRenamed("system", "__s")
    both = sums.join(spread, sums["system"].eqNullSafe(spread["__s"]), "left")  # a row for each system
    c = {k: F.col(k) for k in (*sums.columns,)}
    ms = {k: F.coalesce(F.col(k), F.lit(0.0)) for k in ("mean_ms", "median_ms", "p95_ms")}
    return both.select(
        "system", "n", "unanswered", "tp", "fp", "tn", "fn",
        ratio(c["tp"] + c["tn"], c["n"]).alias("accuracy"), ratio(c["tp"], c["tp"] + c["fp"]).alias("precision"), ratio(c["tp"], c["tp"] + c["fn"]).alias("recall"),
        ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]).alias("f1"), ratio(c["fp"], c["fp"] + c["tn"]).alias("fpr"),
        ratio(c["hit1"], c["n1"]).alias("human_phishing_recall"), ratio(c["hit3"], c["n3"]).alias("generated_phishing_recall"), (1 - ratio(c["hit3"], c["n3"])).alias("generated_phishing_bypass"),
        c["hit0"].alias("human_benign_alarms"), c["n0"].alias("human_benign"), c["hit2"].alias("generated_benign_alarms"), c["n2"].alias("generated_benign"),
        *(v.alias(k) for k, v in ms.items()), ratio(F.lit(1000.0), ms["mean_ms"]).alias("per_second"),
    )


def transposed(report: DataFrame, label: str = "system") -> DataFrame:
    """A few systems' report with a row for each measure and a column for each system, as tables for people are."""
    names = [c for c in report.columns if c != label]
    long = report.select(label, F.posexplode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in names))).alias("at", "x"))
    wide = long.select(F.coalesce(F.col(label).cast("string"), F.lit("unknown")).alias(label), "at", "x.*").groupBy("at", "measure").pivot(label).agg(F.first("value"))
    return wide.orderBy("at").drop("at")
