"""Scalar column functions of the audit: languages, paths, texts, labels. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import constants as K


def _strings(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


# --- languages ----------------------------------------------------------------------------------


def normalise_language(name: Column) -> Column:
    """Lower case, aliases resolved; null and empty give the empty string."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(_lookup(low, K.LANGUAGE_ALIASES), low)


def _of_language(language: Column, part: int, default: Iterable[str]) -> Column:
    out = F.when(F.lit(False), _strings([]))
    for name, parts in K.LANGUAGES.items():
        out = out.when(normalise_language(language) == name, _strings(parts[part]))
    return out.otherwise(_strings(default))


def markdown_tag(language: Column) -> Column:
    """What follows a code fence; empty for an unknown language."""
    return F.coalesce(_lookup(normalise_language(language), K.MARKDOWN_TAGS), F.lit(""))


def source_extensions() -> list[str]:
    """Extensions of all languages, each once."""
    return list(dict.fromkeys(e for parts in K.LANGUAGES.values() for e in parts[0]))


def catalog_aliases(language: Column) -> Column:
    return _of_language(language, 1, K.DEFAULT_ALIASES)


def type_kinds(language: Column) -> Column:
    return _of_language(language, 2, [])


def resource_signals(language: Column) -> Column:
    """Common signals, then the language's own, each once."""
    return F.array_distinct(F.concat(_strings(K.COMMON_SIGNALS), _of_language(language, 3, [])))


def language_compatible(languages: Column, target: Column) -> Column:
    """No languages at all, one among the target's aliases, or a target of ``all``."""
    return (F.lower(target) == "all") | languages.isNull() | (F.size(languages) == 0) | F.arrays_overlap(languages, catalog_aliases(target))


# --- paths --------------------------------------------------------------------------------------


def path_segments(path: Column, lower: bool = True) -> Column:
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.split(F.lower(clean) if lower else clean, "/")


def extension(path: Column, lower: bool = True) -> Column:
    """Last extension with its dot, of the last segment; a leading dot makes none."""
    found = F.regexp_extract(path, r"[^/\\.][^/\\]*?(\.[^./\\]*)$", 1)
    return F.lower(found) if lower else found


def has_segment(path: Column, names: Iterable[str], lower: bool = True) -> Column:
    return F.arrays_overlap(path_segments(path, lower), _strings(names))


def blacklisted(path: Column) -> Column:
    return has_segment(path, K.INDEX_BLACKLIST)


def ignored_dir(path: Column, coverage: bool = False) -> Column:
    return has_segment(path, K.COVERAGE_IGNORE if coverage else K.PRESCAN_IGNORE, lower=False)


def generated_file(path: Column) -> Column:
    return F.lower(path).rlike(r"(\.min\.js|\.min\.css|\.map|\.bundle\.js)$|\.min\.")


def extension_allowed(path: Column, extensions: Iterable[str]) -> Column:
    extensions = list(extensions)
    return extension(path).isin(extensions) if extensions else F.lit(True)


def reachability(path: Column) -> Column:
    return F.when(has_segment(path, K.REACH_LOW), "low").when(has_segment(path, K.REACH_HIGH), "high").otherwise("medium")


def file_url(path: Column, root: str = "") -> Column:
    """URL of a file; a relative path lies below ``root``, the project's absolute folder."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    below = F.concat(F.lit(root.rstrip("/") + "/"), clean)
    return F.concat(F.lit("file://"), F.when(F.startswith(clean, F.lit("/")), clean).otherwise(below))


def extension_language(path: Column, coverage: bool = False, lower: bool = True) -> Column:
    return _lookup(extension(path, lower), K.SINK_EXTENSIONS if coverage else K.EXTENSION_LANGUAGE)


# --- names and texts ------------------------------------------------------------------------------


def keyword_fallback(text: Column, otherwise: Column | None = None) -> Column:
    """First three words of four letters or more; without one ``otherwise`` (default: the text)."""
    words = F.slice(F.regexp_extract_all(text, F.lit(r"(?U)\b\w{4,}\b"), 0), 1, 3)
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(text if otherwise is None else otherwise)


def semantic_intents(intents: Column) -> Column:
    """Whether any intent has four or more words."""
    words = lambda x: F.size(F.filter(F.split(F.trim(x), r"\s+"), lambda t: t != ""))
    return F.coalesce(F.exists(intents, lambda x: words(x) >= 4), F.lit(False))


def test_name(name: Column, language: Column) -> Column:
    """Names of tests: fixed substrings; Test* in Go; test* in any case in Python."""
    hit = F.lit(False)
    for word in K.TEST_KEYWORDS:
        hit = hit | F.contains(name, F.lit(word))
    lang = normalise_language(language)
    return hit | ((lang == "go") & F.startswith(name, F.lit("Test"))) | ((lang == "python") & F.startswith(F.lower(name), F.lit("test")))


def below_snippet_floor(code: Column) -> Column:
    """Empty, under 30 characters without outer white space, or under 6 lines."""
    bare = F.regexp_replace(code, r"^\s+|\s+$", "")
    return code.isNull() | (F.length(bare) < 30) | (F.size(F.split(code, "\n", -1)) < 6)


def boilerplate(path: Column, name: Column, code: Column, language: Column, extensions: Iterable[str]) -> Column:
    return ~extension_allowed(path, extensions) | blacklisted(path) | test_name(name, language) | below_snippet_floor(code)


_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def clean_code(block: Column) -> Column:
    """Inside of the first fence, without a first line that is blank or a language tag, each line
    without a number and the one white space after it; without a fence the text, trimmed. Null: empty."""
    parts = F.split(block, "```", -1)
    body = F.regexp_replace(F.get(parts, F.lit(1)), rf"({_LINE_END})\z", "")
    lines = F.split(body, _LINE_END, -1)
    first = F.regexp_replace(F.get(lines, F.lit(0)), r"(?U)^\s+|\s+\z", "")
    kept = F.when((first == "") | first.isin(K.FENCE_TAGS), F.slice(lines, 2, F.size(lines))).otherwise(lines)
    inside = F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"(?U)^\d+\s", "")), "\n")
    return F.when(F.coalesce(block, F.lit("")) == "", "").when(F.size(parts) < 3, F.regexp_replace(block, r"(?U)^\s+|\s+\z", "")).otherwise(inside)


def embed_text(name: Column, code: Column, lines: int = K.EMBED_LINES) -> Column:
    return F.concat(name, F.lit("\n"), F.array_join(F.slice(F.split(code, "\n", -1), 1, lines), "\n"))


def preview(text: Column, limit: int = 80) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def first_lines(text: Column, n: int = K.CONTEXT_LINES) -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, n), "\n")


def truncate_context(text: Column, limit: int = K.CONTEXT_CHARS) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n... (truncated)"))).otherwise(text)


def header_name(line: Column, strict: bool = False) -> Column:
    """Name of the function whose header the line is, else null.

    The compatible reading also takes statements such as ``return json(x)`` for headers; ``strict``
    leaves out names and lines of control keywords.
    """
    if not strict:
        return _named(line, K.HEADER_ANY)
    keywords = r"^\s*(return|else|if|for|while|switch|case|throw|new|await|yield|do|goto|delete|not|and|or|in|raise|assert|print)\b"
    last = _named(line, K.HEADERS[-1])
    loose = F.when(F.contains(line, F.lit("(")) & ~line.rlike(keywords), F.get(F.filter(F.array(last), lambda x: ~x.isin("if", "for", "while", "switch", "return", "catch", "sizeof")), F.lit(0)))
    return F.coalesce(_named(line, K.HEADER_NAMED), loose)


def _named(line: Column, pattern: str) -> Column:
    return F.get(F.regexp_extract_all(line, F.lit(pattern), 1), F.lit(0))


def defined_name(line: Column) -> Column:
    """The name that a line of one of the plain definition forms defines, else null."""
    return _named(line, K.HEADER_NAMED)


def type_names(code: Column, language: Column) -> Column:
    """Candidate type names of a snippet, without the ignored ones: the first eight in order.

    Capitalised names, in C and C++ also names that end in _t, and names after the language's own
    kinds of types. An unknown language has none.
    """
    lang, found = normalise_language(language), F.when(F.lit(False), _strings([]))
    names = lambda pattern, group: F.regexp_extract_all(code, F.lit("(?U)" + pattern), group)
    for name, (_, _, kinds, _) in K.LANGUAGES.items():
        parts = [names(r"\b[A-Z][a-zA-Z0-9_]+\b", 0)] if name in K.CAMEL_LANGUAGES else []
        if name in ("c", "cpp"):
            parts.append(names(r"\b[a-z0-9_]+_t\b", 0))
        if kinds:
            parts.append(names(rf"\b(?:{'|'.join(kinds)})\s+([A-Za-z_][A-Za-z0-9_]*)\b", 1))
        found = found.when(lang == name, F.concat(*parts))
    found = F.coalesce(found.otherwise(_strings([])), _strings([]))
    return F.slice(F.array_sort(F.array_except(F.array_distinct(found), _strings(K.IGNORED_TYPES))), 1, K.TYPE_LIMIT)


def _literally(word: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c == "_") else c for c in word)


def word_bounded(text: Column, word: str) -> Column:
    """``word`` literally, not inside a longer word."""
    return text.rlike(rf"(?<!\w){_literally(word)}(?!\w)")


def is_regex_signal(signal: str) -> bool:
    return any(c in signal for c in ".\\(")


def signal_hit(line: Column, signal: str) -> Column:
    return line.rlike(signal) if is_regex_signal(signal) else word_bounded(line, signal)


def any_signal_hit(line: Column, signals: list[str]) -> Column:
    """Whether any signal hits, by one alternation."""
    words = [_literally(s) for s in signals if not is_regex_signal(s)]
    parts = [rf"(?<!\w)(?:{'|'.join(words)})(?!\w)"] if words else []
    return line.rlike("|".join(parts + [f"(?:{s})" for s in signals if is_regex_signal(s)]))


# --- labels ---------------------------------------------------------------------------------------


def hide_none(text: Column) -> Column:
    return F.nullif(text, F.lit("None"))


def weakness_label(classes: Column, fallback: Column) -> Column:
    named = F.array_join(F.transform(classes, lambda c: F.concat(F.lit("CWE-"), c)), " / ")
    return F.when(F.size(classes) > 0, named).otherwise(fallback)


def entrypoint(first_caller: Column, path: Column) -> Column:
    return F.coalesce(first_caller, F.concat(F.lit("Reachability Hint: "), reachability(path)))


def module_label(path: Column, line: Column) -> Column:
    return F.concat(F.lit("[module-level] "), path, F.lit(":"), line.cast("string"))


def adaptive_k(n: Column) -> Column:
    """A twentieth of n, half to even, from 5 to 30; 30 where n is not positive."""
    k = F.bround(n.cast("decimal(20,0)") * F.lit("0.05").cast("decimal(3,2)"), 0).cast("int")
    return F.when(n <= 0, 30).otherwise(F.greatest(F.lit(5), F.least(F.lit(30), k)))


def source_rank(source: Column) -> Column:
    return F.coalesce(F.array_position(_strings(K.SOURCE_ORDER), source).cast("int") - 1, F.lit(-1))


def triage(n_true: Column, has_path: Column, has_missing: Column) -> Column:
    return (
        F.when((n_true >= 2) & has_path, "verified").when((n_true >= 1) | has_missing, "needs_review").otherwise("false_positive")
    )
