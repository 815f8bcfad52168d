"""Column builders for text: ids, tokens, sentences, headings, links. All are Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"
# private-use characters mark what a regex has found, so that split() can take the parts
_HEAD, _MID, _END = "\ue001", "\ue002", "\ue003"

#: Endings in the order in which they are tried, longest matches not first: "tion" hides "ation".
STEM_ENDINGS = tuple("ing tion ations ation ies es s ed".split())


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def label(c: Column, limit: int = 96) -> Column:
    return F.regexp_replace(cut(F.replace(strip(c), F.lit("\n"), F.lit(" ")), limit), r"(?U)\s+$", "")


def _slug(c: Column, limit: int) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.regexp_replace(cut(s, limit), "^$", "item"), F.lit("item"))


def node_id(prefix: str | Column, value: Column) -> Column:
    """prefix:slug:first 10 digits of sha1."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(p, F.lit(":"), _slug(value, 70), F.lit(":"), cut(F.sha1(value.cast("binary")), 10))


def scoped(source: Column, value: Column) -> Column:
    """The value within its source, if there is one."""
    return F.when(F.coalesce(source, F.lit("")) != "", F.concat(source, F.lit(NUL), value)).otherwise(value)


def scoped_id(prefix: str | Column, source: Column, value: Column) -> Column:
    return node_id(prefix, scoped(source, value))


def corpus_id(prefix: str | Column, value: Column) -> Column:
    """The variant for files and folders: every odd character one underscore, 16 digits."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    digest = cut(F.sha1(value.cast("binary")), 16)
    slug = F.regexp_replace(cut(F.regexp_replace(F.lower(value), r"(?U)[^\p{L}\p{N}]", "_"), 80), "^_+|_+$", "")
    return F.concat(p, F.lit(":"), F.when(slug == "", digest).otherwise(slug), F.lit(":"), digest)


def word_slug(c: Column, limit: int | None = None) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\W+", "_"), "^_+|_+$", "")
    return cut(s, limit) if limit else s


def schema_table_id(name: Column, source: Column) -> Column:
    value = scoped(source, name)
    return F.when(F.coalesce(source, F.lit("")) == "", F.replace(F.lower(name), F.lit(" "), F.lit("_"))).otherwise(
        F.concat(_slug(name, 70), F.lit(":"), cut(F.sha1(value.cast("binary")), 10))
    )


def media_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), _slug(value, 100))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(c), r"(?U)[\W_]+"), lambda t: t != "")


def stem(t: Column) -> Column:
    """Without the first of STEM_ENDINGS that leaves at least 3 characters."""
    out = F
    for e in STEM_ENDINGS:
        fits = F.endswith(t, F.lit(e)) & (F.char_length(t) - len(e) >= 3)
        short = F.substring(t, F.lit(1), F.char_length(t) - len(e))
        out = F.when(fits, short) if out is F else out.when(fits, short)
    return out.otherwise(t)


def stems(c: Column) -> Column:
    """The distinct stems of a text."""
    return F.array_distinct(F.transform(tokens(F.coalesce(c, F.lit(""))), stem))


def sentences(c: Column, least: int = 30) -> Column:
    """Sentences of at least ``least`` characters, white space squeezed."""
    parts = F.transform(F.split(squeeze(c), r"(?<=[?!.])\s+"), strip)
    return F.filter(parts, lambda s: F.char_length(s) >= least)


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n{2,}"), strip), lambda p: p != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body names it; inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_lines(c: Column) -> Column:
    """As Python's splitlines: no last empty line."""
    parts = F.split(c, "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]")
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def sections(c: Column, before: str | None = "Preface", alone: str = "Document") -> Column:
    """Array of (title, level, content) by ATX headings. Text before the first heading is a section titled
    ``before`` (None: dropped); a text without headings is one section titled ``alone``."""
    marked = F.regexp_replace(c, r"(?dm)^(#{1,6})(?U:\s+)(.+)$", f"{_HEAD}$1{_MID}$2{_END}")
    one = lambda title, text: F.array(F.struct(F.lit(title).alias("title"), F.lit(1).alias("level"), text.alias("content")))

    def read(parts: Column) -> Column:
        made = F.transform(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda p: F.struct(
                strip(F.substring_index(F.substring_index(p, _END, 1), _MID, -1)).alias("title"),
                F.char_length(F.substring_index(p, _MID, 1)).alias("level"),
                strip(F.regexp_replace(p, f"(?s)^.*?{_END}", "")).alias("content"),
            ),
        )
        first = strip(parts[0])
        none = F.size(parts) == 1
        if before is None:
            return F.when(none, one(alone, first)).otherwise(made)
        return F.when(none, one(alone, first)).when(first != "", F.concat(one(before, first), made)).otherwise(made)

    return let(F.split(marked, _HEAD), read)


def urls(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?U)https?://[^\])>\s]+"), F.lit(0)), lambda u: F.regexp_replace(u, "[.,]+$", ""))


def citations(c: Column) -> Column:
    """Numbers in brackets, each for itself, then (Author, year)."""
    numbers = F.regexp_extract_all(c, F.lit(r"[\[](\p{Nd}+(?:\s*,\s*\p{Nd}+)*)[\]]"), F.lit(1))
    named = F.regexp_extract_all(c, F.lit(r"[(]([A-Z][-a-zA-Z]+(?:\s+et\s+al[.])?,\s*(?:20|19)\p{Nd}{2})[)]"), F.lit(1))
    return F.concat(F.flatten(F.transform(numbers, lambda n: F.transform(F.split(n, ","), strip))), named)


def phrases(c: Column) -> Column:
    """Runs of two to five words that begin with an ASCII letter, as they stand."""
    word = r"[a-zA-Z][-0-9a-zA-Z]*"
    return F.regexp_extract_all(c, F.lit(rf"(?U)\b{word}(?:\s+{word}){{1,4}}\b"), F.lit(0))


_NO_CONCEPT = sorted(["the " + x for x in ("paper", "document")] + ["this " + x for x in ("paper", "document")] + ["we " + x for x in ("show", "propose", "present")] + ["our approach"])
_POINTERS = sorted("these those this that when where there".split())


def concept(c: Column) -> Column:
    """A phrase in its normal form; '' if it is none worth a concept."""
    n = F.lower(F.btrim(squeeze(c), F.lit(" `_*[]();:,.")))
    n = F.regexp_replace(n, r"(?U)\s*/\s*", "/")
    words = F.filter(F.split(n, r"(?U)\s+"), lambda w: w != "")
    bad = (F.size(words) < 2) | n.isin(_NO_CONCEPT) | F.get(words, F.lit(0)).isin(_POINTERS) | (F.char_length(n) < 8)
    return F.when(bad, F.lit("")).otherwise(n)


CLAIM_CUES = sorted(["the contribution", "this paper proposes", "this document describes"] + ["we " + v for v in ("show", "find", "propose", "present", "introduce", "demonstrate")])
EVIDENCE_CUES = sorted("% accuracy precision recall reduces improves achieves experiment benchmark evaluation".split() + ["results show"])


def has_cue(c: Column, cues: list[str]) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in cues))


_COMMON = "would with which where when using through this these there their that shows show paper more into have from during document could between being before because also after about".split()


def support_terms(c: Column) -> Column:
    """Distinct terms of at least 4 characters that say what a sentence is about."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[a-zA-Z][-0-9a-zA-Z]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, _COMMON)))


CHART_CUES = {
    "legend": ["legend"],
    "axis": ["y-axis", "x-axis", "axis"],
    "pie_chart": ["slice", "pie"],
    "bar_chart": ["histogram", "bar"],
    "line_chart": ["trend", "line"],
    "table": ["total", "column", "row"],
}


def chart_cues(c: Column) -> Column:
    """Names of the chart elements that a text mentions, sorted."""
    low = F.lower(c)
    found = [F.when(F.rlike(low, F.lit(rf"(?U)\b(?:{'|'.join(words)})\b")), name) for name, words in CHART_CUES.items()]
    when = F.rlike(low, F.lit(r"(?U)\b(q[1-4]|(?:20|19)\d{2})\b")) & F.rlike(low, F.lit(r"(?U)\b(growth|rate|revenue|\$|%)\b"))
    return F.array_sort(F.array_compact(F.array(*found, F.when(when, "time_series_or_metric_chart"))))


def whole_word(content: Column, literal: Column) -> Column:
    """Whether the literal stands in content as a whole word, in any case."""
    safe = F.regexp_replace(literal, r"\\E", r"\\\\E\\\\\\\\E\\\\Q")
    return F.regexp_like(content, F.concat(F.lit(r"(?iuU)(?<!\w)\Q"), safe, F.lit(r"\E(?!\w)")))


def link_targets(c: Column) -> Column:
    """Targets of Markdown links and images, of href and src attributes, and of wiki links, in that order."""
    markdown = F.regexp_extract_all(c, F.lit(r"""!?[\[][^\]]*[\]][(]([^\s)]+)(?:\s+["][^"]*["])?[)]"""), F.lit(1))
    html = F.regexp_extract_all(c, F.lit(r"""(?i)(?:src|href)\s*=\s*(?:"|')([^'"]+)(?:"|')"""), F.lit(1))
    wiki = F.regexp_extract_all(c, F.lit(r"[\[]{2}([^#|\]]+)(?:#[^|\]]+)?(?:[|][^\]]+)?[\]]{2}"), F.lit(1))
    return F.filter(F.transform(F.concat(markdown, html, wiki), strip), lambda t: t != "")


def resolve_path(parent: Column, target: Column, suffixes: list[str]) -> Column:
    """The relative path that a link from a file in ``parent`` means; null if it leaves the corpus, is absolute,
    has a scheme, or no supported suffix."""
    outside = F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:|^//"))
    raw = F.regexp_replace(target, r"[?#].*$", "")
    raw = strip(F.url_decode(F.replace(F.regexp_replace(raw, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))))
    parts = F.filter(F.split(F.concat_ws("/", parent, raw), "/"), lambda p: ~p.isin("", "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(acc.isNull() | ((p == "..") & (F.size(acc) == 0)), F.lit(None).cast("array<string>"))
        .when(p == "..", F.slice(acc, F.lit(1), F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(p))),
    )
    out = F.nullif(F.array_join(folded, "/"), F.lit(""))
    suffix = F.lower(F.regexp_extract(out, r"[^/.][^/]*(\.[^./]+)$", 1))
    return F.when(~outside & (raw != "") & ~raw.startswith("/") & suffix.isin(suffixes), out)


_GENERIC = sorted("summary results references problem overview methodology method introduction document decision context conclusion background abstract".split())


def alias(c: Column) -> Column:
    """A label as other texts would write it; '' if too general to be sought."""
    base = F.regexp_replace(F.regexp_extract(F.replace(c, F.lit("\\"), F.lit("\\")), r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")
    v = F.when(F.rlike(c, F.lit(r"[/\\]")), base).otherwise(c)
    v = F.btrim(F.regexp_replace(F.translate(v, "_-", "  "), r"(?U)\s+", " "), F.lit(" ][)(;:,."))
    low = F.lower(v)
    one = F.size(F.split(low, " ")) == 1
    bad = low.isin(["", *_GENERIC]) | (F.char_length(low) < 4) | (one & ~F.rlike(low, F.lit(r"(?U)\d")) & (F.char_length(low) < 8))
    return F.when(bad, F.lit("")).otherwise(v)
