"""Cleaning of messages: ordered delete / replace / trim rules in one narrow pass, audit, counters, keep-first duplicates.

``clean_pass`` runs the rules once and stores what they did beside each row; rows, audit, counts and duplicates all come from that table,
so the source is read once, and a task that is run again leaves its rows once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.tables import stored

NEUTRAL = 2
#: Emoticons of the two kinds, starts of addresses, punctuation that is trimmed.
POSITIVES, NEGATIVES = (":)", ":-)", ":D"), (":(", ":-(", "D:")
URL_HEADERS = ("http:", "https:", "www.")
PUNCTUATION = r"[!\?\"\.;,\:\*]"


@dataclass(frozen=True)
class Rule:
    """Rules are equal by pattern and replacement, not by name. Patterns are Java's.

    ``needs``: groups of plain texts; a message without one of each group can't match, so the pattern isn't tried on it.
    """

    name: str
    pattern: str
    action: str = "trim"
    to: str = ""
    plain: bool = False
    needs: tuple[tuple[str, ...], ...] = ()

    def __eq__(self, other):
        return isinstance(other, Rule) and (self.action, self.pattern, self.to, self.plain) == (other.action, other.pattern, other.to, other.plain)

    def __hash__(self):
        return hash((self.action, self.pattern, self.to, self.plain))

    def matches(self, text: Column) -> Column:
        found = text.rlike(self.pattern)
        for group in reversed(self.needs):
            found = reduce(Column.__or__, [text.contains(x) for x in group]) & found
        return found

    def replacement(self) -> str:
        """``to`` as Java writes it."""
        return re.sub(r"([\\$])", r"\\\1", self.to) if self.plain else expanded(self.to, *groups_of(self.pattern))


def groups_of(pattern: str) -> tuple[int, dict[str, int]]:
    """How many groups a Java pattern captures, and the numbers of those with a name."""
    n, names, depth, i = 0, {}, 0, 0
    while i < len(pattern):
        if pattern.startswith(r"\Q", i):
            end = pattern.find(r"\E", i)
            i = len(pattern) if end < 0 else end
        elif pattern[i] == "[":
            depth += 1
        elif pattern[i] == "]":
            depth = max(0, depth - 1)
        elif pattern[i] == "(" and not depth:
            named = re.compile(r"\?<([A-Za-z][A-Za-z0-9]*)>").match(pattern, i + 1)
            if named or not pattern.startswith("?", i + 1):
                n += 1
                if named:
                    names[named[1]] = n
        i += 2 if pattern[i : i + 1] == "\\" else 1
    return n, names


def expanded(to: str, n: int, names: dict[str, int]) -> str:
    """A replacement with ``$1``, ``$name``, ``${name}`` and ``$$`` in Java's form. A name is as long as it can be; one that the pattern
    hasn't is nothing; any other ``$``, and a backslash, is itself."""
    out = []
    for ref, plain in re.findall(r"(\$\$|\$\{[^}]*\}|\$[0-9A-Za-z_]+)|(.)", to, re.DOTALL):
        if ref == "$$":
            out.append(r"\$")
        elif ref:
            name = ref[1:].strip("{}")
            k = int(name) if name.isascii() and name.isdigit() else names.get(name)
            if k is not None and k <= n:
                out.append(f"${k}")
        else:
            behind = bool(out) and out[-1][0] == "$"  # a digit behind a group's number would be part of it
            out.append("\\" + plain if plain in "\\$" or behind and plain.isdigit() else plain)
    return "".join(out)


def delete(name: str, pattern: str, needs: tuple[tuple[str, ...], ...] = ()) -> Rule:
    """Drops a message in which the pattern is found."""
    return Rule(name, pattern, "delete", needs=needs)


def replace(name: str, pattern: str, to: str, plain: bool = False) -> Rule:
    """Replaces every match by ``to``, in which ``$1``, ``$name`` and ``${name}`` are what groups captured and ``$$`` is a dollar; or by ``to``
    as it stands (``plain``)."""
    return Rule(name, pattern, "replace", to, plain)


def trim(name: str, pattern: str) -> Rule:
    """Takes every match out."""
    return Rule(name, pattern, "trim")


def mixed_emotions(positives: Sequence[str] = POSITIVES, negatives: Sequence[str] = NEGATIVES) -> Rule:
    """Deletes messages with both kinds of emoticon on one line, in any order."""
    p, n = ("(?:" + "|".join(re.escape(x) for x in own) + ")" for own in (positives, negatives))
    return delete("mixed emotions", f"(?d){p}.*{n}|{n}.*{p}", (tuple(positives), tuple(negatives)))


def default_rules(positives: Sequence[str] = POSITIVES, negatives: Sequence[str] = NEGATIVES, url_headers: Sequence[str] = URL_HEADERS) -> list[Rule]:
    """Mixed emotions and retweets go; addresses, users and punctuation are taken out, in this order."""
    headers = "|".join(h.rstrip(".") + "." if h.endswith(".") else re.escape(h) for h in url_headers)
    return [mixed_emotions(positives, negatives), delete("retweet", r"( |^)RT( |\z)", (("RT",),)), trim("url", rf"({headers})[^ ]*( |\z)"), trim("user", r"( |^)@[^ ]*( |\z)"), trim("punctuation", PUNCTUATION)]


def order_rules(rules: Sequence[Rule]) -> list[Rule]:
    """Deletions first, then replacements, then trims; otherwise the given order."""
    return sorted(rules, key=lambda r: ("delete", "replace", "trim").index(r.action))


def _applied(df: DataFrame, rules: Sequence[Rule], text_col: str) -> DataFrame:
    """Adds t0..tn (the text before each rule and at the end), d0..dn (deleted so far) and h0.. (whether the rule did something), each once.

    Columns are chained, not nested: an expression that contains all earlier ones twice would double with each rule. A trim has done something
    where the text is another one; a replacement where its pattern is found, be the text the same.
    """
    df = df.withColumn("_t0", F.col(text_col)).withColumn("_d0", F.col(text_col).isNull())
    for i, rule in enumerate(rules):
        text, dead = F.col(f"_t{i}"), F.col(f"_d{i}")
        if rule.action == "delete":
            df = df.withColumn(f"_h{i}", ~dead & rule.matches(text)).withColumns({f"_t{i + 1}": text, f"_d{i + 1}": dead | F.col(f"_h{i}")})
        else:
            df = df.withColumns({f"_t{i + 1}": F.regexp_replace(text, rule.pattern, rule.replacement()), f"_d{i + 1}": dead})
            df = df.withColumn(f"_h{i}", ~dead & (rule.matches(text) if rule.action == "replace" else text != F.col(f"_t{i + 1}")))
    return df


def apply_rules(df: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """The messages that no rule deletes, with what the rules leave of them. A text trimmed to '' stays; null texts go."""
    n, names = len(rules), df.columns
    return _applied(df, rules, text_col).filter(~F.col(f"_d{n}")).select(*[F.col(f"_t{n}").alias(c) if c == text_col else F.col(f"`{c}`") for c in names])


def _records(rules: Sequence[Rule], texts: bool = True) -> Column:
    """An array of what the rules did to a row of ``_applied``: rule_no, before, after (null if deleted)."""
    told = [F.lit(i).alias("rule_no") for i in range(len(rules))]
    kept = [(F.col(f"_t{i}").alias("before"), F.when(F.lit(r.action != "delete"), F.col(f"_t{i + 1}")).alias("after")) if texts else () for i, r in enumerate(rules)]
    records = [F.when(F.col(f"_h{i}"), F.struct(told[i], *kept[i])) for i in range(len(rules))]
    kind = "array<struct<rule_no:int,before:string,after:string>>" if texts else "array<struct<rule_no:int>>"
    return F.filter(F.array(*records), lambda x: x.isNotNull()).cast(kind) if rules else F.array().cast(kind)


def _named(no: Column, values: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), no + 1) if values else F.lit(None).cast("string")


def _audit(rows: DataFrame, rules: Sequence[Rule], id_col: str) -> DataFrame:
    """``rows`` has ``_did``, an array of records."""
    told = rows.select(id_col, F.explode("_did").alias("r"))
    no = F.col("r.rule_no")
    return told.select(id_col, no.alias("rule_no"), _named(no, [r.name for r in rules]).alias("rule"), _named(no, [r.action for r in rules]).alias("action"), "r.before", "r.after")


def _counts(sums: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row n0, n1, ... as a row a rule."""
    names = {"delete": "deletion", "replace": "replacement", "trim": "trim"}
    whole = [F.struct(F.lit(f"{r.name} {names[r.action]}").alias("rule"), F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("long").alias("n")) for i, r in enumerate(rules)]
    return sums.select(F.explode(F.array(*whole)).alias("r")).select("r.*") if rules else sums.sparkSession.createDataFrame([], "rule string, n long")


def rule_audit(df: DataFrame, rules: Sequence[Rule], text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """row_id, rule_no, rule, action, before, after, for every rule that did something to a message it reached."""
    return _audit(_applied(df, rules, text_col).select(id_col, _records(rules).alias("_did")), rules, id_col)


def rule_counts(df: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """rule, n: messages each rule did something to, rules without any too; one aggregation for all rules."""
    return _counts(_applied(df, rules, text_col).agg(F.count("*"), *[F.count_if(f"_h{i}").alias(f"n{i}") for i in range(len(rules))]), rules)


def _digest(text: Column) -> Column:
    """128 bits of a text; of no text, none."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))


def dedup_keep_first(df: DataFrame, text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """Of rows with one text the first by ``row_id``; null texts are alike, and an id names one row.

    First ids are found on digests, which partial hash aggregation collapses before they travel; then a semi-join keeps their rows, so a
    text travels once. ``df`` is evaluated twice: store it first where it is costly.
    """
    firsts = df.groupBy(_digest(F.col(text_col)).alias("_key")).agg(F.min(id_col).alias("_first"))
    named = df.withColumn("_own", _digest(F.col(text_col)))
    kept = named.join(firsts, (F.col("_own") == F.col("_key")) & F.col(f"`{id_col}`").eqNullSafe(F.col("_first")), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def dup_count(df: DataFrame, text_col: str = "text") -> DataFrame:
    """n: rows that ``dedup_keep_first`` drops."""
    return df.groupBy(_digest(F.col(text_col))).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))


def assign_rating(df: DataFrame, rating_col: str | None = None) -> DataFrame:
    """Adds ``rating`` from its column, or neutral where there is none."""
    return df.withColumn("rating", F.coalesce(F.col(rating_col).try_cast("int"), F.lit(NEUTRAL)) if rating_col else F.lit(NEUTRAL))


@dataclass(frozen=True)
class Cleaned:
    """What one pass of the rules gave: rows (row_id, rating, text), audit, counts (rule, n) and duplicates (n)."""

    rows: DataFrame
    audit: DataFrame | None
    counts: DataFrame
    duplicates: DataFrame


def clean_pass(df: DataFrame, rules: Sequence[Rule] | None = None, rating_col: str | None = None, text_col: str = "text", id_col: str = "row_id", audit: bool = True) -> Cleaned:
    """Clean once, with all that is to be told about it: rules, then keep-first duplicates; the source is scanned and matched once.

    The pass is stored: a row's rating, its text, whether it stays, and what each rule did to it (with the texts before and after if
    ``audit``). Null texts go without a record.
    """
    rules = default_rules() if rules is None else list(rules)
    done = _applied(assign_rating(df, rating_col), rules, text_col)
    n = len(rules)
    made = stored(done.select(id_col, "rating", F.when(~F.col(f"_d{n}"), F.col(f"_t{n}")).alias(text_col), (~F.col(f"_d{n}")).alias("_stays"), _records(rules, audit).alias("_did")), "cleaning")
    left = made.filter("_stays").select(id_col, "rating", text_col)
    counts = made.select(F.explode("_did.rule_no").alias("no")).agg(F.count("*"), *[F.count_if(F.col("no") == i).alias(f"n{i}") for i in range(n)])
    return Cleaned(dedup_keep_first(left, text_col, id_col), _audit(made, rules, id_col) if audit else None, _counts(counts, rules), dup_count(left, text_col))


def clean(df: DataFrame, rules: Sequence[Rule] | None = None, rating_col: str | None = None, text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """row_id, rating, text: rules, then keep-first duplicates."""
    rows = apply_rules(assign_rating(df, rating_col), default_rules() if rules is None else rules, text_col)
    return dedup_keep_first(stored(rows.select(id_col, "rating", text_col), "cleaned"), text_col, id_col)
