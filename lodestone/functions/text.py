"""Tokenising and normalising as column expressions, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, EngineConfig

#: ASCII white space; an explicit class, as engines differ on what \s holds.
BLANK = " \\t\\n\\r\\f\\x0B"
ENTITY = "&[A-Za-z0-9#]{1,31};"


def strip_punct(token: Column) -> Column:
    """Only the ASCII letters of a token; digits go, too."""
    return F.regexp_replace(token, "[^A-Za-z]", "")


def s_stem(term: Column) -> Column:
    """...ies becomes ...y; otherwise a final es or s is dropped."""
    n = F.length(term)
    return (
        F.when(term.endswith("ies"), F.concat(F.substring(term, F.lit(1), n - 3), F.lit("y")))
        .when(term.endswith("es"), F.substring(term, F.lit(1), n - 2))
        .when(term.endswith("s"), F.substring(term, F.lit(1), n - 1))
        .otherwise(term)
    )


def stem(term: Column, stemmer: str) -> Column:
    return s_stem(term) if stemmer == "s" else term


def normalise(token: Column, stemmer: str = "none") -> Column:
    """The index term of a raw token, '' if nothing is left. Letters are reduced before lower-casing, which is then ASCII only."""
    return stem(F.lower(strip_punct(token)), stemmer)


def plain_tokens(text: Column, config: EngineConfig = DEFAULT) -> Column:
    """Runs of digits or of letters, in pieces of at most ``max_term_length``."""
    n = config.max_term_length
    return F.regexp_extract_all(text, F.lit(f"[0-9]{{1,{n}}}|[A-Za-z]{{1,{n}}}"), F.lit(0))


def query_tokens(query: Column) -> Column:
    """Runs of digits or letters of any length."""
    return F.regexp_extract_all(query, F.lit("[0-9]+|[A-Za-z]+"), F.lit(0))


def terms_of(tokens: Column, stemmer: str = "none") -> Column:
    """Index terms of an array of raw tokens, in order, without empty ones.

    Tokens hold no line breaks, so a document is normalised as one string, with one pass of the expression, not word by word.
    """
    letters = F.lower(F.regexp_replace(F.array_join(tokens, "\n"), "[^A-Za-z\n]+", ""))
    terms = F.array_remove(F.split(letters, "\n"), "")
    return F.filter(F.transform(terms, lambda t: stem(t, stemmer)), lambda t: t != "") if stemmer != "none" else terms


def _flags(config: EngineConfig) -> str:
    return "(?is)" if config.case_insensitive_html else "(?s)"


def html_titles(html: Column, config: EngineConfig = DEFAULT) -> Column:
    """Raw text of the first title element that isn't empty, else ''; script and style elements are gone first."""
    found = F.regexp_extract_all(_unscripted(html, config), F.lit(_flags(config) + "<title>([^<]*)<"), F.lit(1))
    return F.coalesce(F.get(F.filter(found, lambda t: t != ""), F.lit(0)), F.lit(""))


def decode_markup(text: Column) -> Column:
    """The three references that mark-up needs, &lt; &gt; &amp;, and no others."""
    for name, char in (("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def _unscripted(html: Column, config: EngineConfig) -> Column:
    f = _flags(config)
    return F.regexp_replace(F.regexp_replace(html, f + "<script.*?(</script>|\\z)", " "), f + "<style.*?(</style>|\\z)", " ")


def html_body(html: Column, config: EngineConfig = DEFAULT) -> Column:
    """Text outside title, script and style elements; every tag is a word boundary. Entities stay."""
    untitled = F.regexp_replace(_unscripted(html, config), _flags(config) + "<title>[^<]*(<[^>]*>?|\\z)", " ")
    return F.regexp_replace(untitled, "<[^>]*(>|\\z)", " ")


def _letters_decoded(text: Column) -> Column:
    """Numeric references to ASCII letters, the only entities that can add to a term, as these letters."""
    out = text
    for code in (*range(65, 91), *range(97, 123)):
        out = F.regexp_replace(out, f"&#(0*{code}|x0*(?i:{code:x}));", chr(code))
    return F.when(text.contains("&#"), out).otherwise(text)


def html_index_body(html: Column, config: EngineConfig = DEFAULT) -> Column:
    """Text of HTML for indexing; entities join what they stand between."""
    return F.regexp_replace(_letters_decoded(html_body(html, config)), ENTITY, "")


def html_index_tokens(html: Column, config: EngineConfig = DEFAULT) -> Column:
    """Words of HTML for indexing: runs without blanks, in pieces."""
    return F.regexp_extract_all(html_index_body(html, config), F.lit(f"[^{BLANK}<]{{1,{config.max_term_length}}}"), F.lit(0))


def trec_docno(doc: Column, config: EngineConfig = DEFAULT) -> Column:
    return F.regexp_extract(doc, rf"<[{BLANK}]*DOCNO[{BLANK}]*>?[{BLANK}]*({config.docno_pattern})", 1)


def trec_body(doc: Column, config: EngineConfig = DEFAULT) -> Column:
    """What follows the document number, without tags; their contents stay."""
    rest = F.regexp_replace(doc, rf"(?s)^.*?<[{BLANK}]*DOCNO[{BLANK}]*>?[{BLANK}]*{config.docno_pattern}", " ")
    return F.regexp_replace(rest, "<[^>]*(>|\\z)", " ")
