"""Quality rules as a bitmask ledger, DataFrame operations only.

``ledger`` evaluates every rule once and stores the measurements and one long of failure bits per document. Policies are
named, versioned sets of rules; applying one is a bitwise AND with its mask, and the ablation report (what each rule
rejects, alone and together) is an aggregation over the distinct failure masks. Everything runs in one pass over the
texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_SPACE = " \t\n\x0b\x0c\r"
#: Up to this many words the position fits in the 16 low bits beside a 48-bit hash.
PACKED_WORDS = 65_536


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` is true; it may refer to the measurement columns only."""

    name: str
    fails: str


#: Bit k of ``failure_bits`` belongs to RULES[k]. Rules are only ever appended, so that old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 5 * word_chars"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("no_words", "n_words = 0"),
    Rule("long_words", "n_words > 0 AND word_chars > 30 * n_words"),
)
#: A policy is the tuple of rules that it enforces.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "long_words"),
}


def policy_mask(policy: str | tuple[str, ...]) -> int:
    """The bits of the rules that a policy enforces."""
    names = [r.name for r in RULES]
    return sum(1 << names.index(n) for n in (POLICIES[policy] if isinstance(policy, str) else policy))


def _windows(n: Column) -> Column:
    """Start positions of the 3-word windows."""
    return F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))


def _hash(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    ``n_lines`` counts the lines that have a word. Equal 3-word windows are found by sorting their hashes together with
    their positions: in one long each for texts of up to PACKED_WORDS words, in a struct with the full hash beyond. Neighbours of equal hash in
    that order are then compared by their words; in a text where any two of them differ, the windows are sorted by the words themselves. So
    hashes only make it faster.
    """
    # an exploded row would be shuffled by (document, window); sorting inside the row needs no shuffle
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    trimmed = F.btrim(F.col("t"), F.lit(WORD_SPACE))
    split = text.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = split.withColumns({"n": F.size("words"), "lines": lines})
    w, n = F.col("words"), F.col("n")
    packed = F.sort_array(F.transform(_windows(n), lambda i: _hash(w, i).bitwiseAND(F.lit(-PACKED_WORDS)).bitwiseOR(i.cast("long"))))
    wide = F.sort_array(F.transform(_windows(n), lambda i: F.struct(_hash(w, i).alias("h"), i.alias("i"))))
    small = n <= PACKED_WORDS
    sorted_ = counted.withColumns({"packed": F.when(small, packed), "wide": F.when(~small, wide)})
    p, q = F.col("packed"), F.col("wide")

    def equal(i: Column, j: Column) -> Column:
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    def at_low(k: Column) -> Column:
        return F.get(p, k).bitwiseAND(F.lit(PACKED_WORDS - 1)).cast("int")

    def pairs(a: Column) -> Column:
        return F.when(F.size(a) >= 2, F.sequence(F.lit(1), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))

    def both(found: Column, position) -> Column:
        return F.flatten(F.transform(found, lambda k: F.array(position(k), position(k - 1))))

    # equal windows stand side by side; of each such pair both positions count
    touching = F.when(small, F.filter(pairs(p), lambda k: F.shiftrightunsigned(F.get(p, k).bitwiseXOR(F.get(p, k - 1)), 16) == 0)).otherwise(F.filter(pairs(q), lambda k: F.get(q, k)["h"] == F.get(q, k - 1)["h"]))
    touched = sorted_.withColumn("touching", touching)
    where = lambda k: F.when(small, at_low(k)).otherwise(F.get(q, k)["i"])
    same = touched.withColumn("same", F.filter("touching", lambda k: equal(where(k), where(k - 1))))
    # only where windows of equal hash differ
    plain = F.sort_array(F.transform(_windows(n), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))))
    exact = same.withColumn("exact", F.when(F.size("same") < F.size("touching"), plain))
    x = F.col("exact")
    twins = F.filter(pairs(x), lambda k: equal(F.get(x, k)["i"], F.get(x, k - 1)["i"]))
    repeated = F.when(x.isNull(), both(F.col("same"), where)).otherwise(both(twins, lambda k: F.get(x, k)["i"]))
    found = exact.select("doc_id", "t", "words", "n", "lines", F.array_distinct(repeated).alias("at"))
    at = F.col("at")
    values = F.struct(
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.concat(at, F.transform(at, lambda x: x + 1), F.transform(at, lambda x: x + 2)))).cast("long").alias("n_repeat_words"),
    )
    # a filter on a measurement would otherwise be pushed below the steps above, and repeat each of them within the next; below
    # something that isn't deterministic nothing is pushed
    return found.select("doc_id", F.when(F.spark_partition_id() >= 0, values).alias("m")).select("doc_id", "m.*")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of each document and ``failure_bits``, in which every rule has been evaluated once.

    A null text is measured as an empty one, which has no words and no lines. Null ids and repeated rows are kept, one
    ledger row each. An empty table gives an empty ledger. Other columns are ignored, whatever their names.
    """
    bits = None
    for k, rule in enumerate(RULES):
        bit = F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured(docs, id_col, text_col).withColumn("failure_bits", bits)


def apply_policy(entries: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """Add ``kept``: no rule of the policy has failed. The texts are not read again."""
    return entries.withColumn("kept", F.col("failure_bits").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablations(entries: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and the number kept without it.

    Documents are first counted per distinct mask, of which there are 2^rules at most; the rest works on those rows.
    """
    mask = policy_mask(policy)
    masks = entries.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    named = [(k, r.name) for k, r in enumerate(RULES) if mask >> k & 1]
    rule = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, name in named)))
    each = masks.select("bits", "n", rule.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
