"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger keeps one failure bit per
rule and the measurements behind it, and is written as a table with the version of its
rules (kept_ledger); a policy is a versioned set of rules (a mask) that is applied to the
stored bits, so that a new policy or an ablation reads the ledger and never the texts again.
The pipeline's stage applies a policy as it measures, each entry with its row, as it
wants the rows and not the ledger.

Defined cases: a null text has no words and fails ``min_words``; empty texts
likewise; repeated rows each get their row; very long texts are measured as a
whole, a row at a time; extra columns are ignored by the ledger and stay as they
are in the stage; an empty table gives an empty ledger.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import SPACE, map_arrow, stored, table, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_bar_words")
LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
SYMBOLS = re.compile(r"[#*$%&|<>]")

#: Rule name -> bit, in ledger order. New rules are appended; bits never move.
RULES = ("min_words", "repeat_words", "symbol_rate", "dup_lines", "shouting", "table_junk", "word_length")


def rule_conditions(d: str = "") -> dict[str, str]:
    """Each rule's failure as SQL over the measurements, in integers."""
    return {
        "min_words": "n_words < 50",
        "repeat_words": "100 * n_repeat_words > 50 * n_words",
        "symbol_rate": "10 * n_symbols > word_chars",
        "dup_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
        "shouting": "10 * n_upper_words > 6 * n_words AND n_words >= 20",
        "table_junk": "10 * n_bar_words > 2 * n_words AND n_words >= 10",
        "word_length": "n_words > 0 AND (word_chars > 25 * n_words OR word_chars < 2 * n_words)",
    }


#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("min_words", "repeat_words"),
    "v1": ("min_words", "repeat_words", "symbol_rate", "shouting", "table_junk", "word_length"),
    "v2": RULES,
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = words_of(text)
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    upper = bars = 0
    if n:
        upper = sum(1 for w in words if len(w) > 1 and w.isupper())
        bars = words.count("|")
    return (n, sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), _repeats(words), len(lines), upper, bars)


def _repeats(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n - 2:
        return 0
    count = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if count[window] > 1:
            covered += i + 3 - max(end, i)
            end = i + 3
    return covered


def measurements(docs: DataFrame, carried: bool = False) -> DataFrame:
    """doc_id and the measurements of each row; words and lines are of the whole text. ``carried``: and the row itself, as _fathom_row."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("_fathom_row")
            rows = [measure(t) for t in row.field(names.index("text") if carried else 1).to_pylist()]
            columns = list(zip(*rows)) if rows else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays([row.field(names.index("doc_id") if carried else 0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns), *([row] if carried else [])], ["doc_id", *MEASURES, *(["_fathom_row"] if carried else [])])

    rows = docs.select(F.struct(*names if carried else ("doc_id", "text")).alias("_fathom_row"))
    return map_arrow(rows, run, LEDGER + (f", _fathom_row {rows.schema[0].dataType.simpleString()}" if carried else ""))


def ledger(docs: DataFrame, carried: bool = False) -> DataFrame:
    """Measurements and ``failures``, whose bit i is set where rule i fails."""
    bits: Column = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule_conditions()[rule]), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs, carried).withColumn("failures", bits)


#: Goes up with any change of a rule's condition or of what is measured.
RULE_VERSION = 1


def kept_ledger(docs: DataFrame) -> DataFrame:
    """The ledger, written once to the shared folder and read from there, with rule_version."""
    return stored(ledger(docs).withColumn("rule_version", F.lit(RULE_VERSION)))[0]


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds base_failed and kept by a stored policy."""
    return entries.withColumn("base_failed", F.col("failures").bitwiseAND(F.lit(mask("base"))) != 0).withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents it fails, and those that only it rejects.

    The rows are first summed by distinct bit pattern (at most 2**rules of them).
    """
    patterns = entries.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r")
    failed = patterns.select("*", rules)
    hit = F.col("failures").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("failures").bitwiseAND(F.lit(mask(policy))) == F.col("r.bit")
    return failed.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = apply_policy(kept_ledger(table(spark, sf_dir, "documents")))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule of the current policy: documents it fails, and those that only it rejects."""
    return ablations(kept_ledger(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps, with their own columns.

    Each ledger entry carries its row, so the policy reads the failure bits without a join or a shuffle.
    """
    return apply_policy(ledger(docs, carried=True)).where("kept").select(*[F.col("_fathom_row")[c].alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
 coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
 len(list_filter(words, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x)))::BIGINT AS n_upper_words, len(list_filter(words, lambda x: x = '|'))::BIGINT AS n_bar_words
 FROM w LEFT JOIN p USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > word_chars THEN 4 ELSE 0 END
 + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END + CASE WHEN 10 * n_upper_words > 6 * n_words AND n_words >= 20 THEN 16 ELSE 0 END
 + CASE WHEN 10 * n_bar_words > 2 * n_words AND n_words >= 10 THEN 32 ELSE 0 END + CASE WHEN n_words > 0 AND (word_chars > 25 * n_words OR word_chars < 2 * n_words) THEN 64 ELSE 0 END)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failures = 0 AS kept, failures FROM f
"""

ABLATIONS_SQL = f"WITH ledger AS ({ORACLE_SQL}), rules AS (SELECT unnest({list(POLICIES[CURRENT])}) AS rule, unnest({[1 << RULES.index(r) for r in POLICIES[CURRENT]]}) AS bit) SELECT rule, count_if(failures & bit <> 0)::BIGINT AS n_failed, count_if(failures & {mask(CURRENT)} = bit)::BIGINT AS n_only FROM rules, ledger GROUP BY rule"
