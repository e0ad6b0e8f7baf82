"""Names as words: camel-case splitting, stems, namespaces and paths, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_camel(name: Column) -> Column:
    once = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(once, "([A-Z])([A-Z][a-z])", "$1 $2")


def words(name: Column) -> Column:
    """Words of three letters or more that are not numbers, lower-cased."""
    parts = F.split(F.lower(split_camel(name)), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once for the row, however often use names it and wherever."""
    return F.transform(F.array(value), use)[0]


def _cut(word: Column, ending: str, by: str = "") -> tuple[Column, Column]:
    """Whether an ending can go (three letters must stay), and the word without it."""
    rest = F.length(word) - len(ending)
    return word.endswith(ending) & (rest >= 3), F.concat(F.substr(word, F.lit(1), rest), F.lit(by))


def _first_cut(word: Column, rules: tuple[tuple[str, str | None], ...]) -> Column:
    """The first rule that applies; a rule without replacement keeps the word as it is."""
    out: Column | None = None
    for ending, by in rules:
        fits, cut = (word.endswith(ending), word) if by is None else _cut(word, ending, by)
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(word)


def stem(word: Column) -> Column:
    """A crude English stem. The endings are fixed values, tried in order, in two rounds; then a final e of longer words goes.

    Each round is bound to a variable, so it is worked out once.
    """
    first = (("ies", "y"), ("sses", "ss"), ("ss", None), ("s", ""), ("ed", ""), ("ing", ""), ("er", ""))
    second = (("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("ments", ""), ("ment", ""), ("ity", ""))

    def last(w: Column) -> Column:
        return F.when((F.length(w) > 4) & w.endswith("e"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)

    rounds = F.transform(F.transform(F.array(_first_cut(word, first)), lambda w: _first_cut(w, second)), last)
    return rounds[0]


def stems(name: Column) -> Column:
    return F.array_distinct(F.transform(F.array_distinct(words(name)), stem))


def namespace_of(ident: Column) -> Column:
    """Segments before the class; a service prefix and a member are left out."""
    bare = F.substring_index(F.regexp_replace(ident, r"^[^\\@]*@", ""), "::", 1)
    parts = F.split(bare, r"\\")
    return F.slice(parts, 1, F.size(parts) - 1)


def short_name(ident: Column) -> Column:
    return F.element_at(F.split(F.substring_index(ident, "::", 1), r"\\"), -1)


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_test_path(path: Column) -> Column:
    """A directory of tests (fixed names, in any case), or a file named as a test."""
    folders = F.transform(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda s: F.lower(s))
    return F.arrays_overlap(folders, F.array(*(F.lit(x) for x in ("tests", "test", "spec", "specs", "__tests__", "behat")))) | path.rlike(r"(Test|TestCase|Spec|Cest)\.php$")
