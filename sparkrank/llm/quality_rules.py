"""Quality rules: a ledger of rule failures as bits.

Each rule is evaluated once per document. The ledger keeps the measurements and one long whose bit k says
that rule k failed. Policies are versioned masks over those bits: another policy, or the effect of leaving
out a rule, is bitwise arithmetic on the ledger and reads no text.

Words are runs of characters other than the six ASCII white space characters. Null and empty texts have no
words and fail ``few_words``. Repeated rows are judged each for itself; nothing is ranked, so there are no ties. Texts
of any length are measured whole. An empty table gives an empty ledger. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrank.llm.common import ddl, documents, per_batch, texts

MEASURES = {n: pa.int64() for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")}
WINDOW = 5
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rule k is bit k. Each is a predicate over the measurements that holds if the document fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
    ("capitals", "10 * n_upper > 5 * word_chars"),
    ("word_length", "word_chars > 25 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: A policy rejects a document if any bit of its mask is set.
POLICIES = {"base-1": BASE, "strict-1": (1 << len(RULES)) - 1}
POLICY = "strict-1"


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """How many words are in a window of five words that the text holds twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    code = ids[:n].astype(np.int64)
    base = distinct
    for k in range(1, WINDOW):
        if base > (1 << 62) // distinct:  # too long to pack: number the windows so far
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            base = n
        code = code * distinct + ids[k : n + k]
        base *= distinct
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        covered[k : n + k] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    lines, seen, repeats = 0, set(), 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            repeats += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeats, repeated_words(ids, max(1, len(known))), lines, len(raw) - len(raw.translate(None, UPPER))


def measurements(docs: DataFrame) -> DataFrame:
    def run(ids, whole):
        return ids, *zip(*map(measure, whole), strict=True)

    return texts(docs).mapInArrow(per_batch(run, MEASURES), ddl(MEASURES))


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failures``, the bits of the failed rules."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measurements(docs).withColumn("failures", total)


def rejects(policy: str, failures: Column | None = None) -> Column:
    return ((F.col("failures") if failures is None else failures).bitwiseAND(F.lit(POLICIES[policy])) != 0)


def ablations(book: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of a policy: how many documents fail it, and how many it alone rejects (those that leaving
    it out would bring back). Documents are first counted by failure bits, of which there are few."""
    mask = POLICIES[policy]
    by_bits = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = [(name, b) for name, b in BIT.items() if b & mask]
    sums = [F.sum(F.when(F.col("bits").bitwiseAND(F.lit(b)) != 0, F.col("n")).otherwise(0)).alias(f"f_{n}") for n, b in names]
    sums += [F.sum(F.when(F.col("bits") == b, F.col("n")).otherwise(0)).alias(f"o_{n}") for n, b in names]
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(f"f_{n}"), F.lit(0)).alias("n_failed"), F.coalesce(F.col(f"o_{n}"), F.lit(0)).alias("n_only")) for n, _ in names])
    return by_bits.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(documents(spark, sf_dir))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rejects("base-1").alias("base_failed"), (~rejects(POLICY)).alias("kept"), "failures")


OP4_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, string_split(text, chr(10)) as ls from d),
m as (select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as n_upper, ws,
  list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as wl from w),
g as (select doc_id, i, array_to_string(ws[i:i+4], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from m where len(ws) > 4)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as c from g) where c > 1),
cov as (select doc_id, count(distinct i + k)::bigint as n from rep, (select unnest(range(0, 5)) as k) group by doc_id),
x as (select m.doc_id, n_words, word_chars, n_symbols, (len(wl) - len(list_distinct(wl)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, len(wl)::bigint as n_lines, n_upper
  from m left join cov on m.doc_id = cov.doc_id),
b as (select *, (case when n_words < 10 then 1 else 0 end + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end + case when 10 * n_symbols > 3 * n_words then 4 else 0 end
  + case when 10 * n_dup_lines > 5 * n_lines then 8 else 0 end + case when 10 * n_upper > 5 * word_chars then 16 else 0 end + case when word_chars > 25 * n_words then 32 else 0 end)::bigint as failures from x)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed, failures = 0 as kept, failures from b
"""
