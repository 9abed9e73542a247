"""Text forms: basket files, itemset-support lists, rule lines, histogram lines, run logs and run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import dataset_name, items_text

BOUNDS = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0]
RUNS_SCHEMA = (
    "db string, eps double, epsh double, c0 double, rmax int, nits int, bf int, seed bigint, leaves bigint, time double, tpl double, "
    "rules bigint, rules50 bigint, prec50 double, realrls bigint, recall double"
)


def parse_baskets(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Baskets (tid, items) from column ``value``: positive numbers split by blanks; a repeated item counts once.

    Blank lines are empty baskets. Tokens that are no positive int are dropped, or raise when ``strict``.
    """
    tokens = F.filter(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lambda t: t != "")
    number = lambda t: t.try_cast("int")
    if strict:
        number = lambda t: F.when(t.try_cast("int") > 0, t.try_cast("int")).otherwise(F.raise_error(F.concat(F.lit("not an item: "), t)).cast("int"))
    items = F.array_sort(F.array_distinct(F.filter(F.transform(tokens, number), lambda x: x > 0)))
    return lines.select(F.monotonically_increasing_id().alias("tid"), items.alias("items"))


def read_baskets(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """One basket per line of a text file."""
    return parse_baskets(spark.read.text(path), strict)


def parse_itemset_supports(lines: DataFrame, rmax: int | None = None) -> DataFrame:
    """(itemset, support) from lines ``i1 i2 ... (support)``; sets of more than ``rmax`` items are dropped."""
    support = F.regexp_extract("value", r"\((\d+)\)\s*$", 1)
    names = F.filter(F.split(F.trim(F.regexp_replace("value", r"\(\d+\)\s*$", "")), r"\s+"), lambda t: t != "")
    parsed = lines.where(support != "").select(F.array_sort(F.transform(names, lambda t: t.cast("int"))).alias("itemset"), support.cast("bigint").alias("support"))
    return parsed if rmax is None else parsed.where(F.size("itemset") <= rmax)


def read_itemset_supports(spark: SparkSession, path: str, rmax: int | None = None) -> DataFrame:
    return parse_itemset_supports(spark.read.text(path), rmax)


def format_itemset_supports(supports: DataFrame) -> DataFrame:
    return supports.select(F.concat(items_text("itemset"), F.lit(" ("), F.col("support").cast("string"), F.lit(")")).alias("value"))


def format_rule(antecedent: Column | str = "antecedent", consequent: Column | str = "consequent", conf: Column | str = "conf") -> Column:
    return F.format_string("%s -> %s | c=%7.6f", items_text(antecedent), items_text(consequent), F.col(conf) if isinstance(conf, str) else conf)


def write_rules_text(rules: DataFrame, path: str) -> None:
    rules.select(format_rule().alias("value")).write.text(path)


def histogram_lines(hist: DataFrame, *keys: str) -> DataFrame:
    """Lines ``\\tbound\\tn\\tfrac\\tcum_n\\tcum_frac`` of a histogram, with its key columns kept."""
    return hist.select(*keys, "bin", F.format_string("\t%3.2f\t%10d\t%3.2f\t%12d\t%3.2f", "bound", "n", "frac", "cum_n", "cum_frac").alias("value"))


def parse_histogram_lines(lines: DataFrame, *keys: str) -> DataFrame:
    """The histogram of such lines; a bound that is none of the ten raises."""
    parts = F.split("value", "\t")
    number = lambda i: F.trim(F.get(parts, F.lit(i)))
    bound = number(1).try_cast("double")
    checked = F.when(bound.isin(BOUNDS), bound).otherwise(F.raise_error(F.concat(F.lit("not a bound: "), F.coalesce(F.col("value"), F.lit("null")))).cast("double"))
    return lines.select(*keys, checked.alias("bound"), number(2).cast("bigint").alias("n"), number(3).cast("double").alias("frac"), number(4).cast("bigint").alias("cum_n"), number(5).cast("double").alias("cum_frac"))


def parse_run_logs(lines: DataFrame) -> DataFrame:
    """One row of the run table per file of (file, value) log lines. Fields are found by the begin of their lines; a run whose
    histogram is incomplete has nulls there."""
    v = F.col("value")
    words = F.filter(F.split(F.trim(v), r"\s+"), lambda t: t != "")
    word = lambda i: F.element_at(words, i)
    call = v.startswith("./dph")
    at = lambda cond, col: F.max(F.when(cond, col))
    got = lines.groupBy("file").agg(
        at(call, dataset_name(word(2))).alias("db"),
        *(at(call, F.get(words, F.lit(i)).try_cast(kind)).alias(name) for i, name, kind in ((3, "eps", "double"), (4, "epsh", "double"), (5, "c0", "double"), (6, "rmax", "int"), (7, "nits", "int"), (8, "bf", "int"), (9, "seed", "bigint"))),
        at(v.startswith("Total leaves"), F.get(words, F.lit(2)).try_cast("bigint")).alias("leaves"),
        at(v.startswith("Total time"), F.get(words, F.lit(2)).try_cast("double")).alias("time"),
        at(v.startswith("\t0.00"), F.get(words, F.lit(3)).try_cast("bigint")).alias("rules"),
        at(v.startswith("\t0.50"), F.get(words, F.lit(3)).try_cast("bigint")).alias("rules50"),
        at(v.startswith("Real"), F.get(F.filter(words, lambda t: t.rlike(r"^\d")), F.lit(1)).try_cast("bigint")).alias("realrls"),
        at(v.startswith("Recall"), F.get(F.filter(words, lambda t: t.rlike(r"^\d|inf")), F.lit(1)).try_cast("double")).alias("recall"),
    )
    order = [c.strip().split()[0] for c in RUNS_SCHEMA.split(",")]
    return got.withColumns({"tpl": F.try_divide("time", "leaves"), "prec50": F.try_divide("rules50", "rules")}).select("file", *order)


def read_run_logs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per log file of a folder, not of the folders in it."""
    return parse_run_logs(spark.read.option("recursiveFileLookup", "false").text(folder).select(F.col("_metadata.file_path").alias("file"), "value"))


def format_run_logs(runs: DataFrame, hist: DataFrame) -> DataFrame:
    """(run, value): the whole log of each run. ``runs``: run and columns of the run table; ``hist``: its histogram, by run."""
    ten = histogram_lines(hist, "run").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("bin", "value"))).alias("ten"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    call = F.concat_ws(" ", F.lit("./dph"), F.concat(F.lit("data/"), F.col("db"), F.lit(".dat")), F.lit("real.dat"), *(F.col(c).cast("string") for c in ("eps", "epsh", "c0", "rmax", "nits", "bf", "seed")))
    lines = F.concat(
        F.array(
            F.lit("Called with: argc=10"), call, F.concat(F.lit("Total leaves "), zero("leaves")), F.concat(F.lit("Rules saved: "), zero("rules"), F.lit(", minconf: 0.00, maxconf: 1.00")),
            F.lit("Total time:  0.50"), F.lit("Final histogram:"),
        ),
        F.coalesce(F.transform("ten", lambda x: x["value"]), F.array().cast("array<string>")),
        F.array(F.concat(F.lit("Real   :   1   "), zero("realrls"), F.lit("   1")), F.lit("Recall :   0.10   0.25   0.10")),
    )
    return runs.join(ten, "run", "left").select("run", F.array_join(lines, "\n").alias("value"))


def write_run_logs(logs: DataFrame, folder: str) -> None:
    """A folder with a log file for each (run, value), in a folder of the run's name."""
    logs.select("run", "value").repartition("run").write.partitionBy("run").text(folder)


def read_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, pos, value) of the lines of all log files of a folder, in the order of each file. A log is short: it is read as one text.

    Logs that are folders of their run's name go by that name, others by their path.
    """
    whole = spark.read.text(folder, wholetext=True)
    file = F.concat(F.lit("logs/"), F.col("run").cast("string")) if "run" in whole.columns else F.col("_metadata.file_path")
    return whole.select(file.alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "value"))


def log_sections(lines: DataFrame) -> DataFrame:
    """(file, pos, value, section, header, line): the running number of the section that a line is in, the header that it begins with, the
    line's number in it. A header is a line that ends with a colon; what comes before the first one is section 0."""
    own = Window.partitionBy("file").orderBy("pos")
    numbered = lines.withColumn("section", F.sum(F.when(F.col("value").rlike(r"^\S.*:$"), 1).otherwise(0)).over(own))
    within = Window.partitionBy("file", "section").orderBy("pos")
    return numbered.withColumns({"header": F.when(F.col("section") > 0, F.first("value").over(within)), "line": F.row_number().over(within) - 1})


def final_histograms(lines: DataFrame) -> DataFrame:
    """(file, experiment, expected, rules_saved, bound, n, cum_n) of the ten lines after the last header of a final histogram in each log.

    The experiment is the call without program, data set and seed; ``expected`` is its last number. Logs without a call, without ten whole lines, or
    without the number of rules are left out.
    """
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "")
    call = F.max(F.when(F.col("value").startswith("./dph"), F.slice(words, 3, F.greatest(F.size(words) - 3, F.lit(0)))))
    saved = F.max(F.when(F.col("value").startswith("Rules saved:"), F.regexp_extract("value", r"^Rules saved:\s*(\d+)", 1).try_cast("bigint")))
    runs = lines.groupBy("file").agg(call.alias("call"), saved.alias("rules_saved"))
    runs = runs.select("file", F.array_join("call", "\t").alias("experiment"), F.element_at("call", -1).try_cast("bigint").alias("expected"), "rules_saved")
    found = log_sections(lines).where((F.col("header") == "Final histogram:") & F.col("line").between(1, len(BOUNDS)))
    last = found.withColumn("last", F.max("section").over(Window.partitionBy("file"))).where((F.col("section") == F.col("last")) & F.col("value").rlike(r"^\t[01]\.\d+\t *\d+\t *[^\t]+\t *\d+\t *\S+$"))
    parsed = parse_histogram_lines(last, "file")
    whole = parsed.withColumn("bounds", F.size(F.collect_set("bound").over(Window.partitionBy("file")))).where(F.col("bounds") == len(BOUNDS))
    return whole.join(runs, "file").where("experiment IS NOT NULL AND rules_saved IS NOT NULL").select("file", "experiment", "expected", "rules_saved", "bound", "n", "cum_n")


def write_runs(runs: DataFrame, path: str) -> None:
    runs.write.csv(path, sep="\t", header=True)


def read_runs(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, schema=RUNS_SCHEMA)
