"""Quality rules as a ledger of failure bits.

Every rule looks at a text once. The ledger keeps what was measured and one bit
per failed rule; versioned policies are masks over the bits, so a new policy, or
the question what a rule alone costs, needs no text.

A null text counts as empty. Repeated rows are judged each. Columns of the input
pass through; columns named ``measures`` and ``failed`` are replaced.
"""

from pyspark.sql import functions as F

from tillroll.llm.measures import measures


def share(part, whole, percent):
    """part / whole > percent / 100, in whole numbers; false if there is nothing."""
    return F.lit(100) * F.col(f"measures.{part}") > F.lit(percent) * F.col(f"measures.{whole}")


#: Rules in the order of their bits; a rule gives true for a text that fails.
RULES = {
    "few_words": lambda: F.col("measures.n_words") < 50,
    "repeated_words": lambda: share("n_repeat_words", "n_words", 50),
    "symbols": lambda: share("n_symbols", "n_words", 10),
    "repeated_lines": lambda: share("n_dup_lines", "n_lines", 50),
    "short_words": lambda: F.col("measures.word_chars") < 2 * F.col("measures.n_words"),
    "long_words": lambda: F.col("measures.word_chars") > 16 * F.col("measures.n_words"),
    "shouting": lambda: share("n_upper", "n_letters", 40),
    "loud": lambda: share("n_loud", "n_words", 20),
    "few_letters": lambda: F.lit(2) * F.col("measures.n_letters") < F.col("measures.word_chars"),
    # distinct words grow about with the square root of a text's length
    "few_distinct_words": lambda: F.col("measures.n_distinct_words")
    * F.col("measures.n_distinct_words")
    < 4 * F.col("measures.n_words"),
}

#: Policies by version: the rules that reject a text.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}


def bit(rule):
    return 1 << list(RULES).index(rule)


def mask(rules):
    return sum(bit(rule) for rule in rules)


def with_ledger(docs, text="text"):
    """``docs`` with ``measures`` (a struct) and ``failed`` (a bit per failed rule)."""
    measured = docs.withColumn("measures", measures(F.col(f"`{text}`").cast("string")))
    bits = [F.when(fails(), bit(rule)).otherwise(0).cast("long") for rule, fails in RULES.items()]
    failed = bits[0]
    for one in bits[1:]:
        failed = failed.bitwiseOR(one)
    return measured.withColumn("failed", failed)


def rejected(policy, failed="failed"):
    """True for the rows of a ledger that a policy rejects."""
    return F.col(failed).bitwiseAND(mask(POLICIES[policy])) != 0


def ablation(ledger, policy, failed="failed"):
    """One row per rule of a policy: documents that fail it, and that fail only it.

    The rows are counted per bit pattern first, of which there are at most
    2 ** rules; an empty ledger has no failures.
    """
    rules = POLICIES[policy]
    patterns = ledger.groupBy(F.col(failed).bitwiseAND(mask(rules)).alias("pattern")).count()
    cells = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.col("pattern").bitwiseAND(bit(rule)).alias("own"),
            F.col("pattern").bitwiseAND(mask(rules) - bit(rule)).alias("others"),
        )
        for rule in rules
    ]
    return (
        patterns.select("count", F.explode(F.array(*cells)).alias("cell"))
        .groupBy("cell.rule")
        .agg(
            F.sum(F.when(F.col("cell.own") != 0, F.col("count")).otherwise(0)).alias("failing"),
            F.sum(
                F.when((F.col("cell.own") != 0) & (F.col("cell.others") == 0), F.col("count"))
                .otherwise(0)
            ).alias("failing_only_this"),
        )
    )


def common_failures(ledger, group, failed="failed"):
    """Per group, the bits some document and the bits every document fails."""
    return ledger.groupBy(group).agg(
        F.bit_or(failed).alias("failed_by_some"), F.bit_and(failed).alias("failed_by_all")
    )
