"""Tokens, stems, languages and path predicates as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .patterns import anchored, glob_b, glob_p


def tokenize_p(text: Column) -> Column:
    """Profile P: lower-cased identifiers, each followed by its letter runs if it has several."""
    ids = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_]*"), F.lit(0))

    def parts(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0))
        return F.when(F.size(runs) > 1, F.concat(F.array(t), runs)).otherwise(F.array(t))

    return F.flatten(F.transform(ids, parts))


def bag_p(text: Column) -> Column:
    """The tokens of tokenize_p in any order, for counting: the identifiers, then the letter runs of those that have several. No lambda, so it compiles."""
    ids = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_]*"), F.lit(0))
    several = F.regexp_extract_all(F.array_join(ids, " "), F.lit("(?<![a-z0-9_])[a-z]+[0-9_]+[a-z][a-z0-9_]*"), F.lit(0))
    return F.concat(ids, F.regexp_extract_all(F.array_join(several, " "), F.lit("[a-z]+"), F.lit(0)))


def counts_p(text: Column, terms: list[str]) -> tuple[Column, list[Column]]:
    """Of the tokens of tokenize_p, without making them: how many there are, and how many are each term.

    An identifier is what a run of [a-z0-9_] has from its first letter on. Letter runs count too where an identifier has several,
    so a term counts as an identifier, and as a run, less the runs that are alone in theirs.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda p: F.regexp_count(low, F.lit(p))
    whole = lambda p: rf"(?<![a-z0-9_])[0-9_]*{p}(?![a-z0-9_])"
    several = F.when(low.rlike("[a-z][0-9_]+[a-z]"), count("[a-z]+") - count(whole("[a-z]+[0-9_]*"))).otherwise(0)

    def occurrences(t: str) -> Column:
        n = count(whole(t))
        if re.fullmatch("[a-z]+", t):
            n = n + count(f"(?<![a-z]){t}(?![a-z])") - count(whole(f"{t}[0-9_]*"))
        return F.when(low.contains(t), n).otherwise(0)

    return count("[a-z][a-z0-9_]*") + several, [occurrences(t) for t in terms]


def stem(w: Column) -> Column:
    """Profile B: the first ending that fits and leaves three characters."""
    cases = reduce(lambda c, r: (F if c is None else c).when(F.endswith(w, F.lit(r[0])) & (F.length(w) - len(r[0]) + len(r[1]) >= 3), F.concat(F.substring(w, F.lit(1), F.length(w) - len(r[0])), F.lit(r[1]))), fixed.STEM_RULES, None)
    return F.when(F.length(w) < 4, w).otherwise(cases.otherwise(w))


def tokenize_b(text: Column, stop: bool = False, stems: bool = False) -> Column:
    """Profile B: camel case, _ and - split; lower case; runs of ASCII word characters longer than one."""
    t = F.lower(F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "[_-]", " "))
    out = F.filter(F.split(t, r"[\s\W]+", -1), lambda x: F.length(x) > 1)
    if stop:
        out = F.filter(out, lambda x: ~x.isin(*fixed.STOPWORDS))
    return F.transform(out, stem) if stems else out


def query_tokens_p(query: str) -> list[str]:
    out: list[str] = []
    for t in re.findall(r"[a-z][a-z0-9_]*", query.lower()):
        runs = re.findall("[a-z]+", t)
        out += [t, *runs] if len(runs) > 1 else [t]
    return out


def stem_word(w: str) -> str:
    for end, new in fixed.STEM_RULES if len(w) >= 4 else []:
        if w.endswith(end) and len(w) - len(end) + len(new) >= 3:
            return w[: len(w) - len(end)] + new
    return w


def query_tokens_b(query: str) -> list[str]:
    t = re.sub("[_-]", " ", re.sub("([a-z])([A-Z])", r"\1 \2", query)).lower()
    return [stem_word(w) for w in re.split(r"[\s\W]+", t, flags=re.ASCII) if len(w) > 1 and w not in fixed.STOPWORDS]


def important_terms(query: str) -> set[str]:
    """Names after a dot and quoted terms, lower-cased."""
    quoted = [a or b for a, b in re.findall(r"\"([^\"]+)\"|'([^']+)'", query)]
    return {x.lower() for x in re.findall(r"\.(\w+)", query, re.ASCII)} | {re.sub("['\"]", "", x).lower() for x in quoted}


def token_estimate(text: Column) -> Column:
    """Tokens as a quarter of the characters, rounded up: this engine's own offline estimate."""
    return F.ceil(F.length(text) / 4).cast("long")


def parse_budget(text: str | int) -> int:
    """50000, "50k" or "1.5m" as a number of tokens; ValueError for anything else."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([km]?)", str(text).strip().lower())
    if not m:
        raise ValueError(f"not a token budget: {text}")
    return int(float(m[1]) * {"": 1, "k": 1_000, "m": 1_000_000}[m[2]])


def summary_line(content: Column, most: int = 200) -> Column:
    """A chunk in a line without a model: the first comment or docstring among its first five lines, else its first line."""
    lines = F.split(F.regexp_replace(content, r"^\s+|\s+$", ""), "\n", -1)
    notes = F.filter(F.transform(F.slice(lines, 1, 5), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.rlike("^(\"\"\"|'''|#|//)"))
    note = F.get(notes, F.lit(0))
    clean = F.when(note.rlike("^[\"']"), F.regexp_replace(note, "^[\"']+|[\"']+$", "")).otherwise(F.regexp_replace(note, "^[#/ ]+", ""))
    return F.substring(F.coalesce(clean, lines[0]), 1, most)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def language_p(path: Column) -> Column:
    """By the suffix; null if unknown or for a name that only begins with a dot."""
    return _lookup(F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1)), fixed.LANGUAGES_P)


def language_b(path: Column) -> Column:
    """By what follows the last dot of the path, or the whole path; `text` if unknown."""
    return F.coalesce(_lookup(F.lower(F.substring_index(path, ".", -1)), fixed.LANGUAGES_B), F.lit("text"))


def ignored_p(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))
    dirs = F.array(*(F.lit(x) for x in fixed.IGNORE_DIRS))
    return F.arrays_overlap(F.split(path, "/"), dirs) | basename(path).isin(*fixed.IGNORE_FILES) | ext.isin(*fixed.BINARY_P)


def matches_p(path: Column, patterns: list[str]) -> Column:
    """Whether one of fnmatch's patterns fits the path or its last part."""
    fit = lambda c, p: c.rlike(anchored(glob_p(p)))
    return reduce(lambda a, b: a | b, (fit(path, p) | fit(basename(path), p) for p in patterns), F.lit(False))


def matches_b(path: Column, patterns: list[str]) -> Column:
    """Whether one of the path globs fits the path."""
    return reduce(lambda a, b: a | b, (path.rlike(anchored(glob_b(p))) for p in patterns), F.lit(False))


#: Every kind of line end, as a regex.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def count_lines_p(content: Column) -> Column:
    """Lines of every kind of end; an empty last line doesn't count."""
    return F.when(content == "", 0).otherwise(F.size(F.split(F.regexp_replace(content, f"(?:{LINE_ENDS})\\z", ""), LINE_ENDS, -1)))


def within_limits(content: Column, profile: str = "P") -> Column:
    """Not over 1 MiB nor 20,000 lines. P counts every kind of line end and no empty last line; B counts line feeds."""
    lines = count_lines_p(content) if profile == "P" else F.size(F.split(content, "\n", -1))
    return (F.octet_length(content) <= fixed.MAX_BYTES) & (lines <= fixed.MAX_FILE_LINES)


def importance_p(path: Column) -> Column:
    parts, name = F.split(F.lower(path), "/"), F.lower(basename(path))
    depth = F.size(parts)
    some = lambda xs: F.arrays_overlap(parts, F.array(*(F.lit(x) for x in xs)))
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    s = F.lit(0.5) + add(name.isin(*fixed.ENTRY_P), 0.3) + add(name.rlike("^(main|index|app)"), 0.15) + add((name == "__init__.py") & (depth <= 3), 0.1)
    s = s + add(some(fixed.HIGH_DIRS_P), 0.1) - add(some(fixed.LOW_DIRS_P), 0.2) - F.greatest(depth - 5, F.lit(0)) * 0.1
    s = s - add(name.rlike(r"\.(json|yaml|yml)$") & ~name.isin("package.json", "tsconfig.json"), 0.1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def importance_b(path: Column, root_bonus: bool = False) -> Column:
    """A file in no directory counts as one directory deep, so it has the root's bonus only if asked for."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    depth = F.greatest(F.size(dirs), F.lit(0 if root_bonus else 1))
    some = lambda xs: F.arrays_overlap(dirs, F.array(*(F.lit(x) for x in xs)))
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    s = F.lit(0.5) + add(basename(path).isin(*fixed.ENTRY_B), 0.3) + add(some(fixed.HIGH_DIRS_B), 0.1) - add(some(fixed.LOW_DIRS_B), 0.2)
    s = s - add(path.rlike("|".join(fixed.LOW_NAMES_B)), 0.15) - F.greatest(depth - 3, F.lit(0)) * 0.05 + add(depth == 0, 0.1)
    lang = language_b(path)
    s = s - add(lang.isin("markdown", "mdx"), 0.1) - add(lang.isin("json", "yaml"), 0.05)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
