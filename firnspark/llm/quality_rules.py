"""Rule ledger: each rule is evaluated once into a bit; policies and ablations read the bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, and the symbols that are counted: fixed values.
BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Measurements that the ledger holds, all long.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails`, SQL over the measurements, is true."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version rejects what fails any of its rules."""

    version: str
    rules: tuple[str, ...]


#: Bits are never reused: a new rule takes the next one, so old ledgers stay readable.
RULES = (
    Rule(0, "too_few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbol_heavy", "10 * n_symbols > 5 * n_words"),
    Rule(3, "long_words", "word_chars > 25 * n_words"),
    Rule(4, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule(5, "too_short_words", "word_chars < 2 * n_words"),
)
BASE = Policy("base", ("too_few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", tuple(r.name for r in RULES)))}


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    by = {r.name: r.bit for r in rules}
    return sum(1 << by[name] for name in set(policy.rules))


def _without(text: Column, chars: str, by: str = "") -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def measured(docs: DataFrame, text_col: str, window: int) -> DataFrame:
    """docs with its measurements, in columns of MEASURES; native expressions only."""
    # The caller's columns travel in one struct, so that no name of theirs can meet one of the steps'.
    docs = docs.select(F.struct("*").alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    blank = _without(text, BLANKS, " ")
    has_word = lambda line: F.length(_without(line, BLANKS + " ")) > 0
    out = docs.withColumns({"_words": F.array_remove(F.split(blank, " "), ""), "_lines": F.filter(F.split(text, "\n"), has_word)})
    last = F.size("_words") - (window - 1)
    hashed = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(*[F.element_at("_words", i + k) for k in range(window)]))
    out = out.withColumn("_h", F.when(last >= 1, hashed).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(_without(blank, " ")).cast("long"),
        "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        # Few texts hold a window twice; only those pay for the sort.
        "_twice": F.size(F.array_distinct("_h")) < F.size("_h"),
    }).drop("_words", "_lines")
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(F.col("_twice"), pairs)).drop("_h", "_twice")
    # Sorted by hash, a window is found again where a neighbour has its hash: shifted copies of the array meet.
    n = F.size("_sorted")
    nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    out = out.withColumn("_near", F.when(F.col("_sorted").isNotNull(), F.arrays_zip(
        F.col("_sorted").alias("own"),
        F.concat(nothing, F.slice("_sorted", 1, n - 1)).alias("before"),
        F.concat(F.slice("_sorted", 2, n - 1), nothing).alias("after"))))
    again = F.filter("_near", lambda x: (x["own"]["h"] == x["before"]["h"]) | (x["own"]["h"] == x["after"]["h"]))
    out = out.withColumn("_at", F.array_sort(F.transform(again, lambda x: x["own"]["i"])))
    covered = F.aggregate(
        "_at", F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return out.select("own.*", *[F.coalesce(covered, F.lit(0)).cast("long").alias(c) if c == "n_repeat_words" else c for c in MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id, the measurements, and failed_bits with a bit for each failed rule.

    Words are runs of anything but the six ASCII blanks; a null text is an empty one, with every
    measurement 0 (so it fails too_few_words). Windows of words are compared by 64-bit hash within
    a text. Repeated rows are judged one by one, other columns are dropped. No shuffle, no Python.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_bits(own, "text", window, rules).drop("text")


def with_bits(docs: DataFrame, text_col: str = "text", window: int = 5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measurements and failed_bits; its columns of these names are replaced."""
    found = measured(docs.drop(*(set(MEASURES) | {"failed_bits"}) - {text_col}), text_col, window)
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return found.withColumn("failed_bits", bits)


def applied(found: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, name: str = "kept") -> DataFrame:
    """The ledger with a boolean column: whether the policy keeps the document."""
    return found.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0)


def ablations(found: DataFrame, policies: dict[str, Policy] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents failing the rule, and those failing only it.

    One aggregation over the bits, whose single row is then laid out by policy and rule. An empty
    ledger gives zeros.
    """
    wanted = [(v, r.name, 1 << r.bit, mask(p, rules)) for v, p in sorted(policies.items()) for r in rules if r.name in p.rules]
    bits = F.col("failed_bits")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.lit(1))), F.lit(0)).cast("long")
    rows = [
        F.struct(F.lit(v).alias("policy"), F.lit(name).alias("rule"), total(bits.bitwiseAND(F.lit(bit)) != 0).alias("failed"),
                 total(bits.bitwiseAND(F.lit(every)) == bit).alias("failed_alone"))
        for v, name, bit, every in wanted
    ]
    return found.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def judged(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """The ledger under the base rules and a policy: columns base_failed and kept are added."""
    found = applied(applied(ledger(docs), BASE, name="_base"), policy)
    return found.withColumn("base_failed", ~F.col("_base")).withColumn("kept", F.col("kept") & F.col("_base")).drop("_base")


_BLANK = r"[^\x20\x09-\x0D]"
ORACLE_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '{_BLANK}+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_BLANK}')) AS lines FROM t
), m AS (
  SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM w
), g AS (
  SELECT r, i, words[i:i + 4] AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), d AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1
), c AS (
  SELECT r, CAST(sum(least(5, coalesce(i - before, 5))) AS BIGINT) AS n_repeat_words
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM d) GROUP BY r
), a AS (
  SELECT m.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN c USING (r)
), b AS (
  SELECT *, CAST({" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)} AS BIGINT) AS failed_bits FROM a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, failed_bits,
       (failed_bits & {mask(BASE)}) <> 0 AS base_failed, (failed_bits & {mask(POLICIES["v1"])}) = 0 AS kept
FROM b
"""
