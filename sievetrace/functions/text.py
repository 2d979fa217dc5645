"""Text functions over columns; none of them leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievetrace.functions.arithmetic import let

#: Words that no kept action may hold (fixed values).
FORBIDDEN = ("sorry", "admit", "unsafe")
#: Heads of actions that count as automation (fixed values).
AUTOMATION = ("simp", "simp_all", "aesop", "omega", "linarith", "nlinarith", "ring", "ring_nf", "norm_num", "exact?", "apply?", "grind", "decide", "tauto", "polyrith")
#: A session's state when nothing is left to do, and the mark of whole-file verification (fixed values).
NO_GOALS = "no goals"
PLACEHOLDER_STATE = "<verified by lean-cli>"
DIAGNOSTICS_LIMIT = 1500
#: White space that is stripped (fixed values: Unicode's, and the four separators of ASCII).
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def truthy(c: Column) -> Column:
    """Not null and not empty."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def strip(c: Column) -> Column:
    """Without white space at the ends, by Unicode's notion of it."""
    return F.btrim(c, F.lit(WHITE))


def lstrip(c: Column) -> Column:
    """Without white space at the start."""
    return F.ltrim(c, F.lit(WHITE))


def lines(c: Column) -> Column:
    """Lines, by any line break."""
    return F.split(c, r"\R")


def _without(mark: str) -> Callable[[Column], Column]:
    return lambda x: F.when((F.length(x) >= 2) & x.startswith(mark) & x.endswith(mark), strip(F.substr(x, F.lit(2), F.length(x) - 2))).otherwise(x)


def clean_line(c: Column) -> Column:
    """One proposal line without comment, list mark, enclosing quotes and stray backticks."""
    c = let(c, lambda x: F.when(x.contains("--"), F.regexp_replace(x, r"(?U)\s*--.*$", "")).otherwise(x))
    c = let(lstrip(c), lambda x: F.when(x.rlike("^[0-9*+-]"), F.regexp_replace(F.regexp_replace(x, r"(?U)^\d+[.)]\s+", ""), r"(?U)^\s*[-*+]\s+", "")).otherwise(x))
    c = strip(c)
    for mark in ("`", '"', "'"):
        c = let(c, _without(mark))
    return strip(F.btrim(c, F.lit("`")))


def split_proposals(raw: Column, blocks: bool = False) -> Column:
    """Raw model output as an array: without block comments and fences, by line or by blank line; blank parts go."""
    c = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?s)/-.*?-/", "")
    c = F.regexp_replace(c, r"(?m)^[ \t]*```.*$", "")
    parts = F.split(c, r"\n\s*\n") if blocks else lines(c)
    return F.filter(parts, lambda x: F.length(strip(x)) > 0)


def contains_forbidden(c: Column) -> Column:
    """Whether a forbidden word stands there as a whole word, in any case."""
    low = F.lower(c)
    there = reduce(or_, (low.contains(w) for w in FORBIDDEN))  # most texts have none: no pattern is run on them
    return F.coalesce(there & low.rlike(rf"(?U)\b({'|'.join(FORBIDDEN)})\b"), F.lit(False))


def clean_candidate(c: Column) -> Column:
    """A proposal: a single line is cleaned; of a block the first line is, and the others stay."""
    c = F.rtrim(c, F.lit(WHITE))
    return strip(F.concat(clean_line(F.regexp_extract(c, r"^[^\n]*", 0)), F.regexp_replace(c, r"^[^\n]*", "")))


def clean_candidates(array: Column) -> Column:
    """Struct of kept proposals and what fell away: cleaned, first of equals, without forbidden words."""
    cleaned = F.filter(F.transform(F.filter(array, lambda x: x.isNotNull()), clean_candidate), lambda x: F.length(x) > 0)

    def told(clean: Column, distinct: Column, kept: Column) -> Column:
        return F.struct(
            kept.alias("kept"),
            F.size(array).alias("raw"),
            F.size(clean).alias("clean"),
            (F.size(clean) - F.size(distinct)).alias("duplicates"),
            (F.size(distinct) - F.size(kept)).alias("forbidden"),
        )

    return let(cleaned, lambda c: let(F.array_distinct(c), lambda d: let(F.filter(d, lambda x: ~contains_forbidden(x)), lambda k: told(c, d, k))))


def head(c: Column) -> Column:
    """First token of an action, after white space and opening brackets; empty where there is none."""
    token = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?U)^\s*+\(*+\s*+(\S+)", 1)
    return F.regexp_replace(token, "[,;]+$", "")


def is_automation(c: Column) -> Column:
    """Whether an action's head is an automation head."""
    return head(c).isin(*AUTOMATION)


def count_goals(c: Column) -> Column:
    """Goals of a printed state: 0 for none, else its blocks between blank lines, at least 1."""
    blocks = F.size(F.filter(F.split(c, "\n\n"), lambda b: F.length(strip(b)) > 0))
    return F.when(truthy(c) & (strip(c) != NO_GOALS), F.greatest(F.lit(1), blocks)).otherwise(0)


def count_turnstiles(c: Column) -> Column:
    """Goals by their turnstiles, at least 1; null for no text."""
    return F.when(truthy(c), F.greatest(F.lit(1), F.length(c) - F.length(F.replace(c, F.lit("⊢"), F.lit("")))))


def goal_line(c: Column, mark: str = "⊢") -> Column:
    """First line that starts with ``mark``, stripped; else the whole text, stripped."""
    found = F.filter(lines(c), lambda x: lstrip(x).startswith(mark))
    return F.coalesce(strip(F.get(found, F.lit(0))), strip(c))


def normalise_error(c: Column, suffix: str = "lean") -> Column:
    """First line of an error without the temporary file's name and place; its name ends in ``suffix``."""
    c = F.regexp_replace(c, rf"(?m)^.*?[^\s:/\\]+\.{suffix}:\d+:\d+:\s*", "")
    return strip(F.get(lines(strip(c)), F.lit(0)))


def preview(c: Column, n: int = 60) -> Column:
    """First ``n`` characters, with dots if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def diagnostics(err: Column, out: Column, limit: int = DIAGNOSTICS_LIMIT) -> Column:
    """Error output before standard output, stripped and cut at a number of characters."""
    both = F.filter(F.array(strip(F.coalesce(err, F.lit(""))), strip(F.coalesce(out, F.lit("")))), lambda x: F.length(x) > 0)
    c = strip(F.array_join(both, "\n"))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("...[truncated]"))).otherwise(c)


def render_template(template: Column, placeholder: Column, action: Column, imports: Column) -> Column:
    """Source text: non-blank imports, a blank line, the template with every placeholder replaced, a final newline."""
    named = F.filter(F.coalesce(imports, F.array().cast("array<string>")), lambda x: F.length(strip(x)) > 0)
    body = F.replace(template, placeholder, action)
    return F.concat(F.when(F.size(named) > 0, F.concat(F.array_join(named, "\n"), F.lit("\n\n"))).otherwise(""), F.regexp_replace(body, "\n+$", ""), F.lit("\n"))


def backend_name(c: Column) -> Column:
    """A backend's name in its one spelling."""
    return F.replace(F.lower(strip(c)), F.lit("_"), F.lit("-"))


STYLES = {
    "conservative": "Give up to {k} safe single steps, one on each line; prefer the plainest closers.",
    "diverse": "Give up to {k} really different next steps, one on each line; at most one of them automation.",
    "no_automation": "Give up to {k} elementary steps, one on each line; no automation of any kind.",
    "tactic_block": "Give up to {k} short blocks of two to five lines, with one blank line between blocks.",
}


def prompt(name: Column, statement: Column, state: Column, k: int, style: str | None = "diverse") -> Column:
    """The request for proposals; an unknown style is ``diverse``."""
    wish = STYLES.get(style or "", STYLES["diverse"]).format(k=k)
    return F.concat(F.lit("Theorem: "), name, F.lit("\nStatement:\n"), statement, F.lit("\n\nCurrent proof state:\n"), state, F.lit(f"\n\n{wish}"))


def escape_newlines(c: Column) -> Column:
    """Newlines as a backslash and an n."""
    return F.replace(c, F.lit("\n"), F.lit("\\n"))
