"""Quality rules as a bitmask ledger (native: DataFrame functions only).

``ledger`` measures each document once and stores one failure bit for each
rule.  Policies are named sets of rules, kept in versions; applying one to a
ledger, or computing what each of its rules rejects alone, reads the bits and
never the text again.

Edge cases: a null or empty text has no words, so every count is 0 and the
``few_words`` bit is set; repeated rows and rows with a null id are measured
row by row like any other; an empty table gives an empty ledger; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

#: Measurements in the ledger, all long.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


@dataclass(frozen=True)
class Rule:
    """A rule fails a document when ``fails``, a test of the measurements, is true."""

    bit: int
    name: str
    fails: Callable[[Column], Column]


#: Bits are never reused: a new version of a rule gets a new bit.
RULES = [
    Rule(0, "few_words", lambda m: m["n_words"] < 50),
    Rule(1, "repeated_words", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 50),
    Rule(2, "symbol_ratio", lambda m: m["n_symbols"] * 100 > m["n_words"] * 10),
    Rule(3, "duplicate_lines", lambda m: m["n_dup_lines"] * 100 > m["n_lines"] * 60),
    Rule(4, "short_words", lambda m: m["word_chars"] < m["n_words"] * 2),
    Rule(5, "long_words", lambda m: m["word_chars"] > m["n_words"] * 20),
    Rule(6, "upper_case", lambda m: m["n_upper"] * 100 > m["word_chars"] * 60),
]


@dataclass(frozen=True)
class Policy:
    """Documents that fail any of ``rules`` are rejected."""

    version: str
    rules: tuple[str, ...]
    mask: int = field(init=False)

    def __post_init__(self) -> None:
        bits = {r.name: r.bit for r in RULES}
        object.__setattr__(self, "mask", sum(1 << bits[r] for r in self.rules))


BASE = Policy("base", ("few_words", "repeated_words"))
V1 = Policy("v1", (*BASE.rules, "symbol_ratio", "duplicate_lines", "short_words", "long_words", "upper_case"))
V2 = Policy("v2", (*BASE.rules, "symbol_ratio", "short_words", "long_words"))
POLICIES = {p.version: p for p in (BASE, V1, V2)}


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that the array holds twice or more, the first included.

    Windows are compared by a 64-bit hash within one document.  Sorting
    (hash, position) brings equal windows together; the lengths of the union of
    their positions follow from the gaps between sorted starts.
    """
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))

    def window(i: Column) -> Column:
        key = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.struct(key.alias("h"), i.alias("i"))

    def repeated(s: Column) -> Column:
        def twin(x: Column, j: Column) -> Column:
            before, after = F.get(s, j - 1)["h"], F.get(s, j + 1)["h"]
            return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return let(F.sort_array(F.transform(starts, window)), lambda s: let(repeated(s), covered))


def entry_of(text_col: Column) -> Column:
    """The ledger entry of a text: a struct of the measurements and ``fail_bits``, evaluated once."""
    text = F.coalesce(text_col, F.lit(""))

    def bits(m: Column) -> Column:
        out = F.lit(0).cast("long")
        for r in RULES:
            out = out.bitwiseOR(F.when(r.fails(m), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
        return F.struct(*[m[x].alias(x) for x in MEASURES], out.alias("fail_bits"))

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
        measures = let(
            line_counts,
            lambda c: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (c["n"] - c["d"]).cast("long").alias("n_dup_lines"),
                repeat_words(words).alias("n_repeat_words"),
                c["n"].cast("long").alias("n_lines"),
                F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
            ),
        )
        return let(measures, bits)

    return let(words_of(text_col), of)


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id, the measurements and ``fail_bits``."""
    one = df.select(F.col(id_col), entry_of(F.col(text_col)).alias("__m"))
    return one.select(id_col, *[F.col(f"__m.{m}").alias(m) for m in [*MEASURES, "fail_bits"]])


def verdict(policy: Policy, bits: str = "fail_bits") -> Column:
    """True where a policy keeps the document."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def ablation(rows: DataFrame, policies: list[Policy] | None = None) -> DataFrame:
    """What each rule of each policy does: documents that fail it, that only it rejects, kept with and without it.

    The ledger is first summed to one row for each failure mask (at most two to
    the number of rules), so the expansion to policies and rules is small.
    """
    policies = policies or list(POLICIES.values())
    masks = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    names = {r.name: r for r in RULES}
    plan = [F.struct(F.lit(p.version).alias("policy"), F.lit(r).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << names[r].bit).cast("long").alias("bit")) for p in policies for r in p.rules]
    x = masks.select("fail_bits", "n", F.explode(F.array(*plan)).alias("p")).select("fail_bits", "n", "p.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    rest = hit.bitwiseAND(F.bitwise_not(F.col("bit")))
    add = lambda test, name: F.sum(F.when(test, F.col("n")).otherwise(F.lit(0))).alias(name)
    return x.groupBy("policy", "rule").agg(
        add(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, "n_failed"),
        add(hit == F.col("bit"), "n_only_this"),
        add(hit == 0, "n_kept"),
        add(rest == 0, "n_kept_without"),
        F.bit_or(F.when(hit != 0, hit).otherwise(F.lit(0).cast("long"))).alias("rules_seen"),
    )


def kept_documents(docs: DataFrame, policy: Policy = V1, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the policy keeps, with their columns unchanged.

    The text is measured once, in the filter itself; nothing is shuffled.
    """
    return docs.where(entry_of(F.col(text_col))["fail_bits"].bitwiseAND(F.lit(policy.mask)) == 0)
