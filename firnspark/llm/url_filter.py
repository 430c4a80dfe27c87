"""URL filter: allow/block rules by host and path, else a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnspark.llm.common import lower_ascii


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case. One strict term rejects, as do `enough` distinct soft terms."""

    strict: tuple[str, ...]
    soft: tuple[str, ...]
    enough: int = 2


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def read_vocabulary(path: str = os.path.join(os.path.dirname(__file__), "url_terms.tsv"), enough: int = 2) -> Vocabulary:
    """The terms of a file: a term and its weight (strict or soft) a line, with a tab between; # begins a remark."""
    with open(path, encoding="utf-8") as f:
        found = [line.rstrip("\n").split("\t") for line in f if line.strip() and not line.startswith("#")]
    if bad := [x for x in found if len(x) != 2 or x[1] not in ("strict", "soft") or x[0] != x[0].lower()]:
        raise ValueError(f"no terms with weights: {bad[:3]}")
    return Vocabulary(*(tuple(sorted({t for t, w in found if w == weight})) for weight in ("strict", "soft")), enough)


VOCABULARY = read_vocabulary()

RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a ``://`` or for a null url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lower_ascii(host), path


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), else null.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def automaton(words: Vocabulary) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in (*words.strict, *words.soft):
        found.add_word(term, (term, term in words.strict))
    found.make_automaton()
    return found


def term_hits(words: Vocabulary):
    """A pandas UDF: text -> distinct strict and soft terms between boundaries.

    A boundary is an end of the text or any character but a-z and 0-9.
    """

    @F.pandas_udf("struct<n_strict:long,n_soft:long>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = automaton(words)
        inner = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for texts in batches:
            strict, soft = [], []
            for text in texts:
                seen: set[tuple[str, bool]] = set()
                for end, item in found.iter(text):
                    start = end + 1 - len(item[0])
                    if (start == 0 or text[start - 1] not in inner) and (end + 1 == len(text) or text[end + 1] not in inner):
                        seen.add(item)
                n = sum(1 for _, hard in seen if hard)
                strict.append(n)
                soft.append(len(seen) - n)
            yield pd.DataFrame({"n_strict": strict, "n_soft": soft}, dtype="int64")

    return hits


def judge_urls(pages: DataFrame, words: Vocabulary = VOCABULARY, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, n_strict, n_soft.

    The longest fitting rule decides; without one, the vocabulary over the whole url (scheme, query and
    fragment too) blocks on one strict or `words.enough` distinct soft terms. Urls without a scheme have
    empty host and path, so no rule fits them, but their terms count; null and empty ones have no hits. Repeated rows and ids stay as they are; other columns
    are dropped, so their names can't clash. No shuffle; an empty table gives an empty one.
    """
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), lower_ascii(F.coalesce(F.col(url_col), F.lit(""))).alias("whole"))
    scored = split.withColumn("hits", term_hits(words)(F.col("whole")))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("hits.n_strict") >= 1) | (F.col("hits.n_soft") >= words.enough), "block").otherwise("allow")
    return scored.withColumn("r", rule).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), own).alias("verdict"),
        F.col("hits.n_strict").alias("n_strict"), F.col("hits.n_soft").alias("n_soft"),
    )


def _sql_hits(terms: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS BIGINT)" for t in terms)


def _sql_rule(field: str, rules: tuple[Rule, ...]) -> str:
    cases = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, field)}'"
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    ]
    return "CASE " + " ".join(cases) + " END"


ORACLE_SQL = f"""
WITH a AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, u, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a
), c AS (
  SELECT page_id, u, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b
), e AS (
  SELECT page_id, host, path, {_sql_rule("text", RULES)} AS rule, {_sql_rule("verdict", RULES)} AS ruled,
         {_sql_hits(VOCABULARY.strict)} AS n_strict, {_sql_hits(VOCABULARY.soft)} AS n_soft FROM c
)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN n_strict >= 1 OR n_soft >= {VOCABULARY.enough} THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict, n_soft
FROM e
"""
