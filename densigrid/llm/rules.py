"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Each rule bounds a ratio of two measures of a text (or a measure, over 1).  The measures are columns, computed once for each
row; nothing is shuffled and no user function runs.  A text is kept if no rule rejects it.

Words stand between blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns; lines end with a line feed.
A null text has no words and no lines, like an empty one, and is rejected for its length.  Texts are measured whole, in
time n log n; repeated rows and equal texts get equal results, an empty table gives no rows, columns ``keep`` come back
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densigrid.llm.ship import let, quoted

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed list: characters that count as symbols.
SYMBOLS = r"[^#*$%&|<>]"
#: Fixed list: frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "it", "for",
    "der", "die", "das", "und", "ist", "von", "zu", "ein", "nicht", "den",
    "le", "la", "les", "et", "de", "des", "est", "un", "une", "que", "pour",
    "el", "los", "y", "en", "por", "con", "para", "una", "del", "se",
)

#: Words with a letter; function words, whatever is around them but letters; words of two characters or more with capitals and no other
#: letters.  Each match takes its word to the end, in time linear in the text.
_IN = r"[^\x20\x09-\x0D"
LETTERED = rf"{_IN}\p{{L}}]*+\p{{L}}{_IN}]*+"
STOPPED = rf"(?<!{_IN}]){_IN}\p{{L}}]*+(?:{'|'.join(STOP_WORDS)})(?:(?!\p{{L}}){_IN}\p{{L}}]*+)(?!{_IN}])"
SHOUTED = rf"(?<!{_IN}])(?={_IN}]{{2}}){_IN}\p{{Ll}}\p{{Lo}}\p{{Lu}}]*+\p{{Lu}}{_IN}\p{{Ll}}\p{{Lo}}]*+(?!{_IN}])"


@dataclass(frozen=True)
class Rule:
    """Rejects a text whose ``scale`` x ``part`` lies below ``least`` x ``whole`` or above ``most`` x ``whole``: integers, so
    bounds are exact.  ``base``: the rule is one of those that every version has."""

    name: str
    part: str
    whole: str = "one"
    scale: int = 1
    least: int | None = None
    most: int | None = None
    base: bool = False

    def rejects(self, measure: dict[str, Column]) -> Column:
        part, whole = measure[self.part] * self.scale, measure[self.whole]
        out = []
        if self.least is not None:
            out.append(part < whole * self.least)
        if self.most is not None:
            out.append(part > whole * self.most)
        return reduce(lambda a, b: a | b, out)

    def sql(self) -> str:
        """The same as text, over columns named like the measures."""
        whole = "1" if self.whole == "one" else self.whole
        parts = [f"{self.scale} * {self.part} {sign} {bound} * {whole}" for sign, bound in (("<", self.least), (">", self.most)) if bound is not None]
        return f"({' OR '.join(parts)})"


RULES = (
    Rule("too_short", "n_words", least=50, base=True),
    Rule("repeated_words", "n_repeat_words", "n_words", scale=100, most=50, base=True),
    Rule("too_long", "n_words", most=10_000_000),
    Rule("word_length", "word_chars", "n_words", scale=10, least=30, most=120),
    Rule("symbols", "n_symbols", "n_words", scale=100, most=10),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", scale=100, most=50),
    Rule("no_letters", "n_lettered_words", "n_words", scale=100, least=70),
    Rule("stop_words", "n_stop_words", "n_words", scale=1000, least=20),
    Rule("shouting", "n_shouted_words", "n_words", scale=100, most=40),
    Rule("bullets", "n_bullet_lines", "n_lines", scale=100, most=90),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", scale=100, most=30),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lettered_words", "n_stop_words", "n_shouted_words", "n_bullet_lines", "n_ellipsis_lines")


def count(items: Column, test) -> Column:
    return F.size(F.filter(items, test)).cast("long")


def repeated(words: Column) -> Column:
    """Words inside windows of three that the text has twice or more: equal windows are neighbours in sorted order.

    Windows are sorted by a hash first, and by their words only where hashes meet; where all hashes differ, nothing is sorted.
    """
    three = lambda i: [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(*three(i)))

    def alike(found: Column) -> Column:
        same = lambda x, k: x["w"].eqNullSafe(F.get(found, k)["w"])
        return F.transform(F.filter(found, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    by_hash = lambda h: let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("w"), i.alias("i")))), alike)
    by_words = lambda at: let(F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", *three(i)).alias("w"), i.alias("i")))), alike)
    # Each window covers three words, less those that the next one covers too.
    covered = lambda at: F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    counted = lambda h: let(F.sort_array(by_words(by_hash(h))), covered)
    none = F.lit(0).cast("long")
    return F.when(F.size(words) > 3, let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), counted(h)).otherwise(none))).otherwise(none)


def measured(text: Column) -> Column:
    """A struct of MEASURES of a text."""
    whole = F.coalesce(text.cast("string"), F.lit(""))

    def of_words(words: Column, t: Column) -> dict[str, Column]:
        found = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
        return {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long"),
            "n_repeat_words": repeated(words),
            "n_lettered_words": found(t, LETTERED),
            "n_stop_words": found(F.lower(t), STOPPED),
            "n_shouted_words": found(t, SHOUTED),
        }

    def of_lines(lines: Column) -> dict[str, Column]:
        return {
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_bullet_lines": count(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•·][\x20\x09-\x0D]")),
            "n_ellipsis_lines": count(lines, lambda x: x.rlike(r"(?:[.][.][.]|…)[\x20\x09-\x0D]*$")),
        }

    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    words = let(whole, lambda t: let(F.filter(F.split(t, SPACE), lambda w: w != ""), lambda ws: F.struct(*[v.alias(n) for n, v in of_words(ws, t).items()])))
    rows = let(lines, lambda ls: F.struct(*[v.alias(n) for n, v in of_lines(ls).items()]))
    return let(F.struct(words.alias("w"), rows.alias("l")), lambda m: F.struct(*[(m["l"] if "lines" in n else m["w"])[n].alias(n) for n in MEASURES]))


def judged(documents: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """keep..., MEASURES, failed (names of the rules that reject the text), base_failed, kept."""

    def verdict(m: Column) -> Column:
        measure = {n: m[n] for n in MEASURES} | {"one": F.lit(1)}
        failed = F.filter(F.array(*[F.when(r.rejects(measure), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
        base = [r.name for r in rules if r.base]
        return let(failed, lambda f: F.struct(*[m[n].alias(n) for n in MEASURES], F.array_join(f, ",").alias("failed"), F.arrays_overlap(f, F.array(*map(F.lit, base))).alias("base_failed"), (F.size(f) == 0).alias("kept")))

    out = documents.select(*[F.col(quoted(c)) for c in keep], let(measured(F.col(text)), verdict).alias("judged__"))
    return out.select(*[F.col(quoted(c)) for c in keep], "judged__.*")


def clean(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    from densigrid.llm.ship import fresh

    name = fresh(documents, "rules_kept")
    held = documents.withColumn(name, let(measured(F.col("text")), lambda m: ~F.coalesce(F.greatest(*[r.rejects({n: m[n] for n in MEASURES} | {"one": F.lit(1)}) for r in rules]), F.lit(False))))
    return held.where(F.col(name)).drop(name)
