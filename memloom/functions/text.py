"""Column functions over text. Each tokenizer has its own name because their rules differ."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stopwords of the content-term tokenizer.
CONTENT_STOPWORDS = [
    "about", "after", "also", "and", "are", "but", "for", "from", "has", "have", "into", "that", "the",
    "their", "then", "there", "they", "this", "was", "were", "with", "would",
]
# Words an entity view ignores when it normalises a name, and generic capitalised words.
ENTITY_TERM_STOPWORDS = [
    "about", "after", "again", "also", "and", "any", "are", "because", "been", "but", "can", "did", "for",
    "from", "get", "got", "had", "has", "have", "her", "him", "his", "how", "into", "just", "like", "not",
    "now", "out", "said", "she", "that", "the", "their", "them", "then", "they", "this", "was", "were",
    "what", "when", "with", "you", "your",
]
GENERIC_NAMES = [
    "A", "An", "And", "Anything", "Are", "As", "At", "But", "Can", "Did", "Do", "Does", "For", "Good",
    "Great", "Have", "Hey", "Hi", "How", "I", "If", "In", "It", "Its", "Me", "My", "No", "Oh", "Ok",
    "Okay", "So", "That", "The", "Then", "There", "They", "This", "To", "Was", "We", "Well", "What",
    "When", "Where", "Who", "Why", "Wow", "Yes", "You",
]
# Question words dropped by the retrieval form of entity tokens.
QUESTION_WORDS = ["What", "When", "Where", "Which", "Would", "Could", "Should", "The", "How", "Why"]

CONTENT_PATTERN = r"[A-Za-z][A-Za-z0-9_'-]{2,}"
LEXICAL_PATTERN = r"[A-Za-z0-9_'-]+"
NAME_PATTERN = r"(?U)\b[A-Z][a-zA-Z]{2,}\b"


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(value) for value in values])


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def squeeze(text: Column | str) -> Column:
    """Strip and collapse runs of whitespace; a single blank, by far the commonest run, is no match."""
    return F.trim(F.regexp_replace(col_of(text), r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def content_terms(text: Column | str) -> Column:
    """Lower-cased words of three or more characters that are not stopwords; order and repeats kept."""
    return F.filter(_long_words(text), lambda t: ~t.isin(CONTENT_STOPWORDS))


def _long_words(text: Column | str) -> Column:
    """Lower-cased words of three or more characters."""
    return F.transform(F.regexp_extract_all(col_of(text), F.lit(CONTENT_PATTERN), F.lit(0)), F.lower)


def term_set(text: Column | str) -> Column:
    """Distinct content terms in order of appearance."""
    return F.array_except(_long_words(text), _words(CONTENT_STOPWORDS))


def raw_tokens(text: Column | str) -> Column:
    """Lexical tokens before lower-casing; explode them and lower the rows to stay inside generated code."""
    return F.regexp_extract_all(col_of(text), F.lit(LEXICAL_PATTERN), F.lit(0))


def token_count(text: Column | str) -> Column:
    """Number of lexical tokens without building them."""
    return F.regexp_count(col_of(text), F.lit(LEXICAL_PATTERN))


def lexical_tokens(text: Column | str) -> Column:
    """Tokens of the lexical scorer: every run of word characters, lower-cased."""
    return F.transform(raw_tokens(text), F.lower)


def entity_view_terms(text: Column | str) -> Column:
    """Distinct entity-view terms: lexical tokens of three or more characters, no stopwords, no numbers."""
    return F.array_distinct(
        F.filter(
            lexical_tokens(text),
            lambda t: (F.length(t) >= 3) & ~t.isin(ENTITY_TERM_STOPWORDS) & ~t.rlike(r"^[0-9]+$"),
        )
    )


def name_tokens(text: Column | str) -> Column:
    """Distinct capitalised words, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(col_of(text), F.lit(NAME_PATTERN), F.lit(0)))


def query_names(text: Column | str) -> Column:
    """Capitalised words without question words."""
    return F.array_except(name_tokens(text), _words(QUESTION_WORDS))


def jaccard(left: Column, right: Column) -> Column:
    """Set similarity of two arrays without repeats; 0 when either is empty."""
    shared = F.size(F.array_intersect(left, right))
    return F.when(
        (F.size(left) > 0) & (F.size(right) > 0), shared / (F.size(left) + F.size(right) - shared)
    ).otherwise(F.lit(0.0))


def coverage(query: Column, document: Column) -> Column:
    """Share of the query set found in the document set; 0 when either is empty."""
    return F.when(
        (F.size(query) > 0) & (F.size(document) > 0), F.size(F.array_intersect(query, document)) / F.size(query)
    ).otherwise(F.lit(0.0))


def entity_or_term_overlap(
    query_entities: Column, query_terms: Column, doc_entities: Column, doc_terms: Column
) -> Column:
    """Name overlap when both sides have names, term overlap otherwise."""
    return F.when(
        (F.size(query_entities) > 0) & (F.size(doc_entities) > 0),
        F.size(F.array_intersect(query_entities, doc_entities)) / F.size(query_entities),
    ).otherwise(F.least(F.lit(1.0), coverage(query_terms, doc_terms)))


def safe_id(value: Column | str) -> Column:
    """Letters, digits, ``-`` and ``_`` survive; everything else becomes ``_``; 80 characters at most."""
    return F.left(F.regexp_replace(col_of(value), r"[^\p{L}\p{N}_-]", "_"), F.lit(80))


# Cues of a status, an update and a conflict.
STATUS_CUES = [("outdated", "not anymore|no longer|changed|instead"), ("exception", "except|unless"), ("disputed", "maybe|possibly|unclear|not sure")]
UPDATE_CUE = "changed|updated|now|instead|no longer"
CONFLICT_CUE = "not |never|contradict|wrong"


def infer_status(text: Column | str) -> Column:
    """First matching cue decides: outdated, exception, disputed, else active."""
    lowered = F.lower(col_of(text))
    return F.coalesce(*[F.when(_holds(lowered, cues), name) for name, cues in STATUS_CUES], F.lit("active"))


def _holds(text: Column, cues: str) -> Column:
    """Whether one of the cues, which are plain words, occurs; a search of bytes costs a fraction of a pattern's."""
    return reduce(or_, [F.contains(text, F.lit(cue)) for cue in cues.split("|")])


def looks_like_update(text: Column | str) -> Column:
    return _holds(F.lower(col_of(text)), UPDATE_CUE)


def looks_conflicting(left: Column, right: Column) -> Column:
    return _holds(F.concat_ws(" ", F.lower(left), F.lower(right)), CONFLICT_CUE)


def anchor_text(text: Column | str, max_terms: int = 6) -> Column:
    def label(terms: Column) -> Column:
        named = F.concat(F.lit("Topic: "), F.array_join(F.slice(terms, 1, max_terms), ", "))
        return F.when(F.size(terms) == 0, F.lit("General memory")).otherwise(named)

    return let(term_set(text), label)


def parse_support_ids(value: Column | str) -> Column:
    """Turn ids from a list literal, a comma list, a single id or null."""
    text = F.trim(F.coalesce(col_of(value), F.lit("")))
    bare = F.when(text.rlike(r"^\[.*\]$"), F.regexp_extract(text, r"^\[(.*)\]$", 1)).otherwise(text)
    parts = F.transform(F.split(bare, ","), lambda p: F.trim(F.regexp_replace(F.trim(p), r"""^['"]+|['"]+$""", "")))
    return F.filter(parts, lambda p: p != "")


def normalize_entity(name: Column | str) -> Column:
    """Key of an entity name: lower-cased tokens without stopwords joined by ``_``; '' for generic words."""
    value = squeeze(name)
    kept = F.filter(lexical_tokens(value), lambda t: ~t.isin(ENTITY_TERM_STOPWORDS))
    return F.when(value.isin(GENERIC_NAMES) | (value == ""), F.lit("")).otherwise(F.array_join(kept, "_"))


def slug(value: Column | str) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(col_of(value)), r"[^a-z0-9_]+", "_"), F.lit("_"))
    return F.when(clean == "", F.lit("entity")).otherwise(clean)


def canonical_session(value: Column | str) -> Column:
    """Session key of a turn or session id: ``c1:raw:D3:12`` and ``session_3`` both give ``D3``."""
    text = F.trim(F.coalesce(col_of(value), F.lit("")))
    tail = F.when(text.contains(":raw:"), F.regexp_extract(text, r"(?s):raw:(.*)$", 1)).otherwise(text)
    head = F.split(tail, ":").getItem(0)
    marked = F.regexp_extract(head, r"\b(D[0-9]+)\b", 1)
    numbered = F.regexp_extract(F.lower(head), r"session[_ -]*([0-9]+)", 1)
    return (
        F.when(marked != "", marked)
        .when(numbered != "", F.concat(F.lit("D"), F.regexp_replace(numbered, r"^0+(?=[0-9])", "")))
        .otherwise(head)
    )


def session_number(value: Column | str) -> Column:
    """First number in a session id, null when there is none."""
    digits = F.regexp_extract(F.coalesce(col_of(value), F.lit("")), r"([0-9]+)", 1)
    return F.when(digits != "", digits.cast("bigint"))


def truncate_at_word(text: Column, limit: int) -> Column:
    """Cut a text at a word boundary and close it with a full stop."""
    value = squeeze(text)
    cut = F.left(value, F.lit(max(1, limit - 1)))
    short = F.when(cut.contains(" "), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(value) <= limit, value).otherwise(
        F.concat(F.regexp_replace(short, r"[ ,;:.]+$", ""), F.lit("."))
    )


def turn_order(turn_id: Column | str) -> Column:
    """Sort key of a turn id: letters with a zero-padded session number, then the turn number."""
    text = F.coalesce(col_of(turn_id), F.lit(""))
    pattern = r"^([A-Za-z]+)([0-9]+):([0-9]+)"
    prefix = F.regexp_extract(text, pattern, 1)
    session = F.regexp_extract(text, pattern, 2)
    padded = F.when(F.length(session) >= 4, F.regexp_replace(session, r"^0+(?=[0-9]{4})", "")).otherwise(
        F.lpad(session, 4, "0")
    )
    turn = F.regexp_extract(text, pattern, 3)
    return F.struct(
        F.when(prefix != "", F.concat(prefix, padded)).otherwise(text).alias("session"),
        F.lit(0).alias("kind"),
        F.when(turn != "", turn.cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("number"),
        text.alias("id"),
    )


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body`` (keeps inlined plans small)."""
    return F.transform(F.array(value), body).getItem(0)
