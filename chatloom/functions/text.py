"""Text columns: slugs, tokens, search predicates, code-fence reduction."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, functions as F

# Token shapes that must give the same names everywhere.
ARCHIVE_NAME = r"(?iU)[\w][\w.\-]*?\.zip"
FILE_NAME = (
    r"(?iU)\b[\w\-./]+\.(?:py|ps1|psm1|md|json|jsonl|sh|ts|js|tsx|jsx|"
    r"yaml|yml|toml|sql|txt|csv|ipynb|cfg|ini|rs|go|c|cpp|h)\b"
)
NAME_CUT = (
    r"(?iUs)(?:[-_ ]\d{4}[-_]\d{2}[-_]\d{2}\b|[-_ ]\d{8}[-_]\d{6}\b|[-_ ]\d{8}\b"
    r"|[-_ ]v\d|[0-9a-f]{12,}).*$"
)
NAME_VERSION = r"(?iU)[-_ ]v(\d+(?:[._]\d+){0,3})\b"
HEX_NAME = r"(?i)^[0-9a-f]{8,}$"
SHORT_NUMBER_NAME = r"^\d{1,4}$"
EXPORT_DATE = r"-(\d{4}-\d{2}-\d{2})-"
FENCE = r"(?sU)```([\w+\-.]*)\n(.*?)```"
LINE_END = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"
PROSE_CAP = 1200
CUT_MARK = " …[truncated]"

# Extension classes.
EXTENSION_CLASS = {
    "code": ["py", "ps1", "psm1", "sh", "ts", "js", "tsx", "jsx", "rs", "go", "c", "cpp", "h", "sql"],
    "data": ["json", "jsonl", "csv", "yaml", "yml", "toml"],
    "doc": ["md", "txt"],
    "notebook": ["ipynb"],
    "config": ["cfg", "ini"],
}


def let(value: Column, body) -> Column:
    """``body`` of a value named once, so that long expressions are not repeated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_text(c: Column) -> Column:
    """Is there anything but white space? Stops at the first such character."""
    return c.rlike(r"(?U)\S")


def nonblank(c: Column) -> Column:
    """The stripped text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def kebab(c: Column) -> Column:
    """Lower-case slug of letters and digits joined by single dashes."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""
    )


def human_title(slug: Column) -> Column:
    named = F.initcap(F.trim(F.translate(slug, "-_", "  ")))
    return F.when(F.length(named) > 0, named).otherwise(slug)


def title_keywords(title: Column, n: int = 12) -> Column:
    return F.slice(F.filter(F.split(kebab(title), "-"), lambda w: w != ""), 1, n)


def archive_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.zip$", "")


def archive_slug(name: Column) -> Column:
    return kebab(F.regexp_replace(archive_stem(name), NAME_CUT, ""))


def archive_version(name: Column) -> Column:
    found = F.regexp_extract(archive_stem(name), NAME_VERSION, 1)
    return F.nullif(F.replace(found, F.lit("_"), F.lit(".")), F.lit(""))


def is_version_archive(name: Column) -> Column:
    """A named release, not a hash or a bare number."""
    stem, slug = archive_stem(name), archive_slug(name)
    junk = F.lit(False)
    for part in (stem, slug):
        junk = junk | part.rlike(HEX_NAME) | part.rlike(SHORT_NUMBER_NAME)
    return (slug != "") & ~junk


def export_date(basename: Column) -> Column:
    return F.nullif(F.regexp_extract(basename, EXPORT_DATE, 1), F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def extension_class(name: Column) -> Column:
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    out = F.lit("other")
    for cls, exts in EXTENSION_CLASS.items():
        out = F.when(name.contains(".") & ext.isin(exts), F.lit(cls)).otherwise(out)
    return out


def words(c: Column) -> Column:
    """Lower-case ASCII letter-or-digit tokens, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def salient_words(c: Column, longer_than: int = 3) -> Column:
    """Distinct long words, longest first, then alphabetical."""
    distinct = F.filter(F.array_distinct(words(c)), lambda w: F.length(w) > longer_than)
    keyed = F.transform(distinct, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda x: x["w"])


def lexical_overlap(question: Column, text: Column, longer_than: int = 2) -> Column:
    """Share of the question's distinct words that the text contains (0 without words)."""
    asked = F.array_distinct(F.filter(words(question), lambda w: F.length(w) > longer_than))
    return F.when(
        F.size(asked) > 0, F.size(F.array_intersect(asked, words(text))) / F.size(asked)
    ).otherwise(F.lit(0.0))


def lines(c: Column) -> Column:
    return F.split(c, LINE_END)


# --- search ---------------------------------------------------------------


def _glob_body(pattern: str) -> str:
    """Java regex of a shell glob, without its anchors."""
    translated = fnmatch.translate(pattern)
    return re.sub(r"^\(\?s:|\)(\\Z|\\z)$", "", translated)


def name_matches(c: Column, query: str | None) -> Column:
    """Case-folded list filter: a glob must match the whole text, a literal anywhere."""
    if not query:
        return F.lit(True)
    low, q = F.lower(F.coalesce(c, F.lit(""))), query.lower()
    if set(q) & set("*?[]"):
        return low.rlike(rf"\A(?s:{_glob_body(q)})\z")
    return low.contains(q)


def search_regex(pattern: str, ignore_case: bool = False, word: bool = False) -> str:
    """Regex that finds single occurrences, for spans and whole-word search."""
    body = _glob_body(pattern)
    if word:
        body = rf"(?<!\w)(?:{body})(?!\w)"
    return ("(?iuU)" if ignore_case else "(?U)") + body


def text_matches(c: Column, pattern: str, ignore_case: bool = False, word: bool = False) -> Column:
    """Text search predicate: contains, implicit ``*glob*``, or whole word."""
    text = F.coalesce(c, F.lit(""))
    if word:
        return text.rlike(search_regex(pattern, ignore_case, word=True))
    if ignore_case:
        text, pattern = F.lower(text), pattern.lower()
    if set(pattern) & set("*?[]"):
        glob = ("" if pattern.startswith("*") else "*") + pattern + ("" if pattern.endswith("*") else "*")
        return text.rlike(rf"\A(?s:{_glob_body(glob)})\z")
    return text.contains(pattern)


def first_matching_line(c: Column, pattern: str, **how) -> Column:
    hit = F.filter(lines(c), lambda ln: text_matches(ln, pattern, **how))
    return strip(F.coalesce(F.try_element_at(hit, F.lit(1)), F.lit("")))


#: Hits whose lengths are summed as one block.
SPAN_BLOCK = 64


def match_spans(c: Column, regex: str) -> Column:
    """``array<struct<start, end, matched>>`` of all occurrences, 0-based, end exclusive.

    A regex split leaves one gap more than hits, so the gap and the hit before a hit
    give its start. Lengths are summed in blocks first: a hit adds up the blocks
    before its own and the hits before it inside, not all hits of the text.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)

    def spans(both: Column) -> Column:
        steps = F.transform(both["hits"], lambda h, i: F.length(h) + F.length(F.get(both["gaps"], i)))
        return let(steps, lambda lengths: placed(both, lengths))

    def placed(both: Column, lengths: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(SPAN_BLOCK))
        return let(F.transform(starts, lambda s: total(F.slice(lengths, s, F.lit(SPAN_BLOCK)))), lambda sums: F.transform(
            both["hits"], lambda hit, i: span(both, lengths, sums, hit, i)))

    def span(both: Column, lengths: Column, sums: Column, hit: Column, i: Column) -> Column:
        block = F.floor(i / SPAN_BLOCK).cast("int")
        before = total(F.slice(sums, F.lit(1), block)) + total(F.slice(lengths, block * SPAN_BLOCK + 1, i - block * SPAN_BLOCK))
        start = before + F.length(F.get(both["gaps"], i))
        return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("matched"))

    pieces = F.struct(F.regexp_extract_all(c, F.lit(regex), F.lit(0)).alias("hits"), F.split(c, regex, -1).alias("gaps"))
    return let(pieces, spans)


# --- reduction ------------------------------------------------------------


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def cap(c: Column, n: int = PROSE_CAP, mark: str = CUT_MARK) -> Column:
    return let(c, lambda x: F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(mark))).otherwise(x))


def reduce_prose(c: Column, max_prose: int = PROSE_CAP) -> Column:
    """Replace code fences by one-line notes, squeeze blank lines, cap the prose."""
    return let(c, lambda x: cap(squeeze(_fences_to_notes(x)), max_prose))


def _fences_to_notes(c: Column) -> Column:
    langs = F.regexp_extract_all(c, F.lit(FENCE), F.lit(1))
    bodies = F.regexp_extract_all(c, F.lit(FENCE), F.lit(2))

    def note(lang: Column, body: Column) -> Column:
        return let(F.regexp_replace(body, "\n+$", ""), lambda kept: line_note(lang, kept))

    def line_note(lang: Column, kept: Column) -> Column:
        n = F.when(kept == "", F.lit(0)).otherwise(F.size(F.split(kept, "\n")))
        inked = F.filter(F.transform(lines(kept), strip), lambda ln: ln != "")
        first = F.substring(F.coalesce(F.try_element_at(inked, F.lit(1)), F.lit("")), 1, 80)
        label = F.when(lang == "", F.lit("txt")).otherwise(lang)
        return F.concat(
            F.lit("\n‹code "), label, F.lit(" "), n.cast("string"), F.lit("ln :: "), first, F.lit("›\n")
        )

    notes = F.zip_with(langs, bodies, note)
    woven = F.zip_with(F.split(c, FENCE, -1), notes, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit(""))))
    return F.when(F.contains(c, F.lit("```")), F.array_join(woven, "")).otherwise(c)
