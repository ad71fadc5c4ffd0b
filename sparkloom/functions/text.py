"""Text mining as column expressions: terms, tokens, frames, codes. All stay in the JVM.

Patterns begin where a run begins (or where the last match ended), so that long runs are read once; repeated groups are
possessive, so that long chains need no stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Not counted as tokens; shorter words than three letters never are.
STOPWORDS = sorted("with that this from into when while should without their does used uses self test case tests issue actual expected fix bug error traceback exception for are and can get its not the use".split(), key=lambda w: (len(w), w[::-1]))
#: Not counted as keywords.
PLAIN = sorted("failure exception traceback problem issue return returns used use using under while without with when this there their the that should not just its into get from for does case can bug are and error".split(), key=lambda w: (len(w), w[::-1]))
VERBS = sorted("check test shell flush migrate validate loaddata dumpdata startapp sqlflush inspectdb runserver dbshell sqlmigrate startproject collectstatic makemessages diffsettings makemigrations showmigrations squashmigrations changepassword createsuperuser compilemessages sendtestemail sqlsequencereset".split())
#: Upper-case words that would be constants by their length, but aren't.
NO_CONSTANTS = ("POSTGRES", "ROLLBACK")
WORD = r"[\p{L}\p{N}_]"
#: What Python takes for white space.
BLANK = r"\s\x0B\x1C-\x1F\x85\p{Z}"
IDENT = "[A-Za-z_][A-Za-z0-9_]*+"
_DOTTED = rf"(?:(?<![A-Za-z_])|\G){IDENT}(?:\.{IDENT})++"
_PY = r"(?:(?<![A-Za-z0-9_./-])|\G)[A-Za-z0-9_./-]+\.py"
_NOPATH = rf"[^:\"'{BLANK}]"
_SHORT = rf"[A-Za-z]:[\\/]{_NOPATH}+?\.py:[0-9]+|(?:(?<!{_NOPATH})|\G){_NOPATH}+?\.py:[0-9]+"
_EXPLICIT = rf"(?:(?<![A-Za-z_])|\G)(?:(?:{IDENT}/)++{IDENT}\.py|{IDENT}/{IDENT}(?:/{IDENT})++)"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def first_by(values: Column, key) -> Column:
    """The values without later ones of a key seen before, in order; by sorting, so that it takes no time in the square."""
    keyed = F.array_sort(F.transform(values, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    firsts = let(keyed, lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["k"] != e["k"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def first_by_lower(values: Column) -> Column:
    """The values without later ones that differ in case only."""
    return first_by(values, F.lower)


def tokens(text: Column) -> Column:
    """Lower-cased identifiers, each followed by its camel and snake parts; those of one or two signs and stopwords go."""
    whole = _all(text, "[A-Za-z][A-Za-z0-9_]*")
    parts = F.flatten(F.transform(whole, lambda t: F.concat(F.array(F.lower(t)), F.transform(F.split(F.regexp_replace(t, "([a-z0-9])([A-Z])", "$1_$2"), "_"), F.lower))))
    return F.filter(parts, lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS))


def _quoted(text: Column) -> Column:
    trimmed = F.transform(_all(text, "`([^`\n]+)`", 1), lambda x: F.regexp_replace(x, rf"^[{BLANK}]+|[{BLANK}]+$", ""))
    return F.filter(trimmed, lambda t: t != "")


def code_terms(text: Column) -> Column:
    """Back-quoted spans, dotted names and .py paths as they come, then capitalised words of three or more signs; first spelling of each."""
    capital = F.filter(_all(text, WORD + "+"), lambda t: t.rlike("^[A-Z][a-zA-Z0-9_]{2,}$"))
    return first_by_lower(F.concat(_quoted(text), _all(text, f"{_DOTTED}|{_PY}"), capital))


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)```.*?```", " ")


def issue_terms(text: Column) -> Column:
    """What looks like code, in fenced blocks first: .py paths, then names with a dot, an underscore or an inner capital; outside
    of them, back-quoted spans come before these. First spelling of each."""
    telling = lambda t: t.contains(".") | t.contains("_") | F.substr(t, F.lit(2)).rlike(r"\p{Lu}")
    names = lambda t: F.filter(_all(t, r"[A-Za-z_][A-Za-z0-9_.]{2,}"), telling)
    blocks = F.flatten(F.transform(_all(text, "(?s)```(.*?)```", 1), lambda b: F.concat(_all(b, _PY), names(b))))
    return first_by_lower(F.concat(blocks, let(_plain(text), lambda p: F.concat(_quoted(p), _all(p, _PY), names(p)))))


def keywords(text: Column) -> Column:
    """Distinct lower-cased words of three or more letters that aren't plain, in order; fenced blocks don't count."""
    words = _all(F.lower(_plain(text)), "[A-Za-z_][A-Za-z0-9_]{2,}")
    return F.array_distinct(F.filter(words, lambda t: ~t.isin(PLAIN)))


def _frame(whole: Column) -> Column:
    """(path, line, symbol) of a matched reference."""
    native = whole.startswith('File "')
    path = F.when(native, F.regexp_extract(whole, '^File "([^"\n]+)"', 1)).otherwise(F.regexp_extract(whole, r"(?s)^(.*\.py):[0-9]+$", 1))
    line = F.when(native, F.regexp_extract(whole, '", line ([0-9]+)', 1)).otherwise(F.regexp_extract(whole, ":([0-9]+)$", 1))
    symbol = F.when(native, F.regexp_extract(whole, ", in ([A-Za-z_][A-Za-z0-9_.]*)$", 1)).otherwise("")
    return F.struct(F.translate(path, "\\", "/").alias("path"), line.try_cast("long").alias("line"), symbol.alias("symbol"))


def _frames(found: Column) -> Column:
    key = lambda f: F.struct(F.lower(f["path"]), f["line"], F.lower(f["symbol"]))
    return first_by(F.filter(F.transform(found, _frame), lambda f: f["line"].isNotNull()), key)


def trace_frames(text: Column) -> Column:
    """array<struct<path, line, symbol>> of the first ranker: interpreter frames with their functions, then path:line references;
    each once, whatever the case. Backslashes become slashes."""
    native = r'File "[^"\n]+", line [0-9]+, in [A-Za-z_][A-Za-z0-9_.]*'
    return _frames(F.concat(_all(text, native), _all(text, _SHORT)))


def frames(text: Column) -> Column:
    """The same for the second ranker: with or without a function (which doesn't count), in the order of the text."""
    native = r'File "[^"\n]+", line [0-9]+'
    return F.transform(_frames(_all(text, f"{native}|{_SHORT}")), lambda f: F.struct(f["path"].alias("path"), f["line"].alias("line")))


def explicit_paths(text: Column) -> Column:
    """Distinct lower-cased slash paths to .py files, and folders of three or more parts, as they come."""
    return F.array_distinct(F.transform(_all(text, _EXPLICIT), F.lower))


def error_codes(text: Column) -> Column:
    """Distinct codes such as models.E001: prefix in lower, code in upper case."""
    found = _all(text, rf"(?<!{WORD})[A-Za-z][A-Za-z_]{{1,15}}\.[EWew][0-9]{{3,4}}(?!{WORD})")
    return F.array_distinct(F.transform(found, lambda t: F.concat(F.lower(F.substring_index(t, ".", 1)), F.lit("."), F.upper(F.substring_index(t, ".", -1)))))


def upper_constants(text: Column) -> Column:
    """Distinct words of five or more capitals, with an underscore or eight signs; some are no constants."""
    return F.array_distinct(F.filter(_all(text, WORD + "+"), lambda t: t.rlike("^[A-Z][A-Z0-9_]{4,}$") & (t.contains("_") | (F.length(t) >= 8)) & ~t.isin(*NO_CONSTANTS)))


def verbs(text: Column) -> Column:
    """The management verbs that stand between blanks, quotes or the like, sorted."""
    found = _all(F.lower(text), rf"(?<![^`'\"./{BLANK}])(?:{'|'.join(VERBS)})(?![^`'\":({BLANK}])")
    return F.array_sort(F.array_distinct(found))


def dunders(text: Column) -> Column:
    """Names of up to 16 signs after double underscores, up to the end of the word, in the lower-cased text, as often as they stand."""
    return _all(F.lower(text), rf"__([a-z][a-z0-9_]{{1,15}})(?!{WORD})", 1)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def preset(text: Column, given: str = "test-fix") -> Column:
    """The preset that a text asks for; a given one other than test-fix stays."""
    if given != "test-fix":
        return F.lit(given)
    low = F.lower(text)
    hit = lambda *words: F.array_contains(F.transform(strings(list(words)), lambda w: F.contains(low, w)), True)
    return F.when(hit("traceback", "crash", "exception", "error"), "crash-fix").when(hit("test", "assert", "failure"), "test-fix").otherwise("issue-fix")


def gold_files(patch: Column) -> Column:
    """Sorted distinct files of a diff."""
    return F.sort_array(F.array_distinct(F.concat(_all(patch, r"(?m)^diff --git a/(\S+)", 1), _all(patch, r"(?m)^--- a/(\S+)", 1))))


def tail(name: Column) -> Column:
    """What follows the last dot, in lower case."""
    return F.lower(F.element_at(F.split(name, r"\."), -1))
