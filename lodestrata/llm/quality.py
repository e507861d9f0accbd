"""Rule bitmask ledger: every rule is evaluated once; policies and ablations only read the bits.

The ledger has a row a document: what was measured, and one bit for each failed rule. A policy is a
mask with a version; a document passes if none of the mask's bits is set. Ablations come from sums of
bit tests over the ledger, so trying another policy never reads a text again. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, words

#: Rule -> (bit, SQL over the measurements that is true for a failure). All comparisons are of whole numbers.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_windows": (1, "100 * n_repeat_words > 50 * n_words"),
    "word_length": (2, "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    "symbols": (3, "10 * n_symbols > n_words"),
    "repeated_lines": (4, "10 * n_dup_lines > 4 * n_lines"),
    "few_letters": (5, "100 * n_letters < 70 * word_chars"),
    "shouting": (6, "100 * n_upper > 60 * n_letters and n_letters > 0"),
    "bullets": (7, "10 * n_bullet_lines > 9 * n_lines"),
    "ellipses": (8, "10 * n_ellipsis_lines > 3 * n_lines"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_bullet_lines", "n_ellipsis_lines")
#: How lines begin that are items of a list, and how those end that break off, white space around them aside.
BULLETS, ELLIPSES = ("-", "*", "•", "‣", "▪", "◦"), ("...", "…")
BLANKS = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Policy:
    """A named, numbered choice of rules."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in set(self.rules))


BASE = Policy(1, ("few_words", "repeated_windows"))
STANDARD = Policy(2, tuple(RULES))
POLICIES = {p.version: p for p in (BASE, STANDARD)}


def repeat_words(w: str) -> str:
    """SQL for the number of words of the array column w that lie in a 3-word window found twice or more.

    Where all windows differ, as in most texts, that is all there is to it. Else they are sorted with their places, so
    equal ones are neighbours: n log n in the text's length. Lambdas bind each intermediate array once.
    """
    hashes = f"transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2]))"
    windows = "sort_array(transform(hs, (h, i) -> struct(h, i as p)))"
    twice = "transform(filter(transform(s, (x, j) -> struct(x.p as p, get(s, j - 1).h <=> x.h or get(s, j + 1).h <=> x.h as twice)), x -> x.twice), x -> x.p)"
    cover = "aggregate(transform(q, (x, j) -> least(3, coalesce(get(q, j + 1) - x, 3))), 0L, (a, x) -> a + x)"
    some = f"transform(array({windows}), s -> transform(array(sort_array({twice})), q -> {cover})[0])[0]"
    return f"case when size({w}) < 3 then 0L else transform(array({hashes}), hs -> case when size(array_distinct(hs)) = size(hs) then 0L else {some} end)[0] end"


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the measures, failed): one row for each row of docs, failed holding a bit a failed rule.

    Words are runs of anything but ASCII white space; a null text has none, so it measures 0 everywhere
    and fails few_words. Repeated rows and null ids stay as they are. keep names columns of docs to carry; one that
    is called like a column of the ledger gets underscores added. Words and lines of a text are arrays of its row, so a
    task needs some thirty times the size of the longest text. An empty table gives an empty one.
    """
    kept_names = _clear_of(keep)
    at = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).alias(f"kept_{c}") for c in keep), F.coalesce(F.col(text_col), F.lit("")).alias("ledger_text"))
    t = F.col("ledger_text")
    arrays = (
        at.withColumn("ledger_words", words(t))
        .withColumn("ledger_lines", F.split(t, "\n"))
        .withColumn("ledger_lines", F.filter("ledger_lines", lambda x: x.rlike(WORD)))
    )
    measures = (
        F.size("ledger_words").cast("long"),
        F.length(F.array_join("ledger_words", "")).cast("long"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        (F.size("ledger_lines") - F.size(F.array_distinct("ledger_lines"))).cast("long"),
        F.expr(repeat_words("ledger_words")),
        F.size("ledger_lines").cast("long"),
        F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("long"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long"),
        F.size(F.filter("ledger_lines", lambda x: F.substring(F.ltrim(x, F.lit(BLANKS)), 1, 1).isin(*BULLETS))).cast("long"),
        F.size(F.filter("ledger_lines", lambda x: _ends(F.rtrim(x, F.lit(BLANKS))))).cast("long"),
    )
    # measured once: a filter on the results can't be pushed below a generator and so never repeats the work
    once = F.explode(F.array(F.struct(*(m.alias(n) for n, m in zip(MEASURES, measures)))))
    measured = arrays.select("doc_id", *(f"kept_{c}" for c in keep), once.alias("m")).select("doc_id", *(f"kept_{c}" for c in keep), "m.*")
    failed = " + ".join(f"case when {sql} then {1 << bit}L else 0L end" for bit, sql in RULES.values())
    out = measured.withColumn("failed", F.expr(failed))
    return out.select("doc_id", *(F.col(f"kept_{c}").alias(name) for c, name in zip(keep, kept_names)), *MEASURES, "failed")


def _ends(line: Column) -> Column:
    return line.endswith(ELLIPSES[0]) | line.endswith(ELLIPSES[1])


def _clear_of(keep: tuple[str, ...]) -> list[str]:
    taken, out = {"doc_id", "failed", *MEASURES}, []
    for name in keep:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def passes(policy: Policy, failed: str | Column = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) == 0 if isinstance(failed, str) else failed.bitwiseAND(F.lit(policy.mask)) == 0


def ablations(book: DataFrame, policies: dict[int, Policy] = POLICIES) -> DataFrame:
    """(version, rule, rows, kept, failing, only): for each rule of each policy, how many rows the policy keeps,
    how many fail the rule, and how many fail it alone, which would be kept without it. One aggregation over the ledger; an empty ledger gives zeros."""
    pairs = [(p, r) for p in policies.values() for r in sorted(set(p.rules), key=lambda r: RULES[r][0])]
    bits = lambda m: F.col("failed").bitwiseAND(F.lit(m))
    sums = [F.count("*").alias("rows")]
    for i, (p, r) in enumerate(pairs):
        one = 1 << RULES[r][0]
        sums += [F.count_if(bits(p.mask) == 0).alias(f"kept{i}"), F.count_if(bits(one) != 0).alias(f"failing{i}"), F.count_if(bits(p.mask) == one).alias(f"only{i}")]
    rows = F.array(*(F.struct(F.lit(p.version).alias("version"), F.lit(r).alias("rule"), "rows", F.col(f"kept{i}").alias("kept"), F.col(f"failing{i}").alias("failing"), F.col(f"only{i}").alias("only")) for i, (p, r) in enumerate(pairs)))
    return book.agg(*sums).select(F.explode(rows).alias("x")).select("x.*")


def quality_verdicts(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The ledger, written once, with base_failed and kept under the policy."""
    return verdicts(cut(ledger(docs), "ledger"), policy)


def verdicts(book: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """A stored ledger with what a policy says of its rows; no text is read."""
    return book.select("doc_id", *MEASURES, "failed", F.lit(policy.version).alias("policy_version"), (~passes(BASE)).alias("base_failed"), (passes(policy) & passes(BASE)).alias("kept"))


def quality_ablations(docs: DataFrame) -> DataFrame:
    """Ablations of all policies over the ledger, written once and read for each of them."""
    return ablations(cut(ledger(docs), "ledger"))


_W = r"[^\x20\x09-\x0D]+"
_LEDGER = rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
m as (select doc_id, t, regexp_extract_all(t, '{_W}') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) l from d),
g as (select doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from m)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) c from g) where c > 1),
p as (select doc_id, count(*) n_repeat_words from (select distinct doc_id, i + unnest([0, 1, 2]) p from r) group by doc_id),
x as (select doc_id, cast(len(w) as bigint) n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines,
  cast(coalesce(n_repeat_words, 0) as bigint) n_repeat_words, cast(len(l) as bigint) n_lines,
  cast(length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) as bigint) n_letters, cast(length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) as bigint) n_upper,
  cast(len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣▪◦]'))) as bigint) n_bullet_lines,
  cast(len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) as bigint) n_ellipsis_lines
  from m left join p using (doc_id)),
f as (select *, {" + ".join(f"case when {sql} then cast({1 << bit} as bigint) else 0 end" for bit, sql in RULES.values())} failed from x)
"""
ORACLE = _LEDGER + f"select *, {STANDARD.version} policy_version, (failed & {BASE.mask}) <> 0 base_failed, (failed & {STANDARD.mask}) = 0 kept from f"
_PAIRS = ", ".join(f"({p.version}, '{r}', {p.mask}, {1 << RULES[r][0]})" for p in POLICIES.values() for r in p.rules)
ABLATIONS = _LEDGER + f"""
select version, rule, count(failed) as rows, cast(count_if((failed & mask) = 0) as bigint) kept, cast(count_if((failed & one) <> 0) as bigint) failing, cast(count_if((failed & mask) = one) as bigint) as only
from (values {_PAIRS}) p(version, rule, mask, one) left join f on true group by version, rule
"""
