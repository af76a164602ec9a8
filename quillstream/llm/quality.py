"""Quality rules as a short-circuit cascade.

Each rule has an expression that is true where a text fails. A bounded sample gives each rule's cost (time to
evaluate it) and selectivity (share that it rejects); the cascade then asks the rules by falling rejection per cost
and stops at the first that fails. The order changes what is computed, never the verdict.

Defined results: a null or empty text has no words and fails the length rule; an empty table gives an empty result;
rows that repeat an id, or have none, are judged each for itself; columns of any other name pass `cascade` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import fresh, let, text_or_empty, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: A-Z and the capitals of Latin-1.
CAPITALS = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0xDF)] if c != 0xD7)
WORD_CHARS = " \t\n\x0b\f\r"


def repeated_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Each window becomes one long: its hash's leading bits over its position's bits. Sorted, equal windows are
    neighbours; those that share the leading bits are compared word for word. Where neighbours share the bits but not
    the words (a collision), the text is counted again from the windows themselves, so the count is exact.
    """
    n = F.size(w)
    bits = F.length(F.bin(n.cast("long")))
    at = lambda i, k: F.get(w, i + k)
    same = lambda i, j: (at(i, 0) == at(j, 0)) & (at(i, 1) == at(j, 1)) & (at(i, 2) == at(j, 2))

    def from_parts(p: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), p["bits"]) - F.lit(1).cast("long")
        sorted_ = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
        return F.transform(F.array(sorted_), lambda s: _covered(s, low, same, w, n))[0]

    # array(x) then transform binds x once, so that it is not evaluated again at each use
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(F.transform(F.array(F.struct(bits.alias("bits"))), from_parts)[0])


def _covered(s: Column, low: Column, same: Callable, w: Column, n: Column) -> Column:
    pos = lambda x: x.bitwiseAND(low).cast("int")
    alike = lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(low)) == 0
    near = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda k: alike(F.get(s, k), F.get(s, k - 1)))

    def found(near: Column) -> Column:
        clash = F.exists(near, lambda k: ~same(pos(F.get(s, k)), pos(F.get(s, k - 1))))
        starts = F.sort_array(F.array_distinct(F.flatten(F.transform(near, lambda k: F.array(pos(F.get(s, k)), pos(F.get(s, k - 1)))))))
        return F.when(F.size(near) == 0, F.lit(0).cast("long")).when(clash, _exactly(w, n)).otherwise(_span(starts))

    return F.transform(F.array(near), found)[0]


def _span(starts: Column) -> Column:
    """Words covered by 3-word windows at these sorted starts."""
    return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).cast("long").alias("n"), x.alias("last")), lambda a: a["n"])


def _exactly(w: Column, n: Column) -> Column:
    """The same from the windows' words: sorted, equal windows are neighbours."""
    window = lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(3)]).alias("g"), i.alias("i"))

    def found(s: Column) -> Column:
        twin = lambda k: F.get(s, k)["g"] == F.get(s, k - 1)["g"]
        pairs = F.transform(F.filter(F.sequence(F.lit(1), F.size(s) - 1), twin), lambda k: F.array(F.get(s, k)["i"], F.get(s, k - 1)["i"]))
        return _span(F.sort_array(F.array_distinct(F.flatten(pairs))))

    return let(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window)), found)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WORD_CHARS, "")) > 0)
    return F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0]


def count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measures(t: Column, w: Column) -> dict[str, Column]:
    """Measures of a text and its words."""
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.translate(t, WORD_CHARS, "")).cast("long"),
        "n_symbols": count_of(t, SYMBOLS),
        "n_dup_lines": repeated_lines(t),
        "n_repeat_words": repeated_words(w),
        "n_lines": F.size(F.split(t, "\n")).cast("long"),
        "n_capitals": count_of(t, CAPITALS),
    }


def over_words(text: str, body: Callable[[Column, Column], Column]) -> Column:
    """body(text, words), both evaluated once."""
    return let(text_or_empty(text), lambda t: let(words(t), lambda w: body(t, w)))


@dataclass(frozen=True)
class Rule:
    """fails: from a measure's lookup to the condition under which the text is rejected."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: Fixed thresholds, none of which meets ordinary prose; the first two are the base rules.
RULES = (
    Rule("few_words", lambda m: m("n_words") < MIN_WORDS),
    Rule("repetitive", lambda m: 100 * m("n_repeat_words") > MAX_REPEAT_PERCENT * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > 3 * m("n_words")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
    Rule("repeated_lines", lambda m: (m("n_dup_lines") > 3) & (2 * m("n_dup_lines") > m("n_lines"))),
    Rule("capitals", lambda m: 2 * m("n_capitals") > m("word_chars")),
)


def verdict(order: list[Rule], value: Callable[[str], Column]) -> Column:
    """Name of the first rule in this order that fails, else null; later rules are not evaluated."""
    out = None
    for rule in order:
        out = F.when(rule.fails(value), F.lit(rule.name)) if out is None else out.when(rule.fails(value), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string"))


def rule_order(df: DataFrame, text: str = "text", id_column: str = "doc_id", sample_rows: int = 2000, rules=RULES) -> list[tuple[Rule, float, float]]:
    """Rules with their cost (median nanoseconds a text) and rejected share on a sample, best rejection per cost first.

    The sample (sample_rows rows, the bound) is read by the ids of the table's first rows: only the id column is looked
    through for it, and the reader skips row groups without them. One job asks each of its texts every rule and reads
    the clock in between. A table without ids is asked in the given order.
    """
    ids = [r[0] for r in df.select(id_column).filter(F.col(id_column).isNotNull()).head(sample_rows)]
    if not ids:
        return [(rule, 1.0, 0.0) for rule in rules]
    sample = df.select(id_column, text).filter(F.col(id_column).isin(ids)).limit(sample_rows)
    clock = lambda: F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    asked = [clock().alias("t0"), over_words(text, lambda t, w: F.size(w) < 0).alias("f0"), clock().alias("t1")]
    for k, rule in enumerate(rules, 1):
        asked += [over_words(text, lambda t, w, r=rule: r.fails(_lazy(t, w))).alias(f"f{k}"), clock().alias(f"t{k + 1}")]
    spent = lambda k: F.percentile_approx(F.col(f"t{k + 1}") - F.col(f"t{k}"), 0.5)
    columns = [c for k in range(len(rules) + 1) for c in (spent(k).alias(f"cost{k}"), F.avg(F.col(f"f{k}").cast("double")).alias(f"share{k}"))]
    row = sample.select(*asked).agg(*columns).head()
    base = row["cost0"] or 0  # the splitting into words, which all rules share
    found = [(rule, max(1.0, float((row[f"cost{k}"] or 0) - base)), row[f"share{k}"] or 0.0) for k, rule in enumerate(rules, 1)]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def _lazy(t: Column, w: Column) -> Callable[[str], Column]:
    """Measures by name; each is computed only where a rule that is asked needs it."""
    return measures(t, w).__getitem__


def cascade(df: DataFrame, order: list[Rule], text: str = "text", into: str = "rejected_by") -> DataFrame:
    """Adds `into`: the first rule in this order that fails, else null; raises ValueError if df has such a column."""
    if fresh(df, into) != into:
        raise ValueError(f"column {into} is taken")
    return df.withColumn(into, over_words(text, lambda t, w: verdict(order, _lazy(t, w))))


def filter_quality(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows that no rule rejects, with df's own columns."""
    order = [rule for rule, _, _ in rule_order(df, text, id_column)]
    into = fresh(df, "rejected_by")
    return cascade(df, order, text, into).filter(F.col(into).isNull()).select(*[df[c] for c in df.columns])


#: The measures that measure_quality returns, needed for every row.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure_quality(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row: the base measures, base_failed, kept and rejected_by.

    The base measures are returned for every row, so they are computed once and the rules on them read the results; the
    cascade asks in the sampled order, and what only its other rules need is computed where it gets to them.
    """
    order = [rule for rule, _, _ in rule_order(df, text, id_column)]
    base = {r.name: r for r in RULES}

    def judged(t: Column, w: Column) -> Column:
        lazy = measures(t, w)

        def told(m: Column) -> Column:
            value = lambda k: m[k] if k in BASE else lazy[k]
            failed = base["few_words"].fails(value) | base["repetitive"].fails(value)
            return F.struct(m.alias("m"), failed.alias("base_failed"), verdict(order, value).alias("rejected_by"))

        return let(F.struct(*[lazy[k].alias(k) for k in BASE]), told)

    rows = df.select(F.col(id_column).alias("id"), over_words(text, judged).alias("j"))
    measured = [F.col(f"j.m.{k}").alias(k) for k in BASE]
    return rows.select(F.col("id").alias(id_column), *measured, F.col("j.base_failed").alias("base_failed"), F.col("j.rejected_by").isNull().alias("kept"), F.col("j.rejected_by").alias("rejected_by"))
