"""Text functions on columns, all on the JVM side: markup, references, phrases, names, sentences, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headings from which on a text is references.
REFERENCE_HEADINGS = ("References", "See also", "External links", "Notes", "Further reading", "Bibliography")
#: Tags whose content is no text, and tags that end a line.
SILENT_TAGS = ("script", "style", "nav", "header", "footer")
LINE_TAGS = ("p", "br", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#64;", "@"), ("&amp;", "&"))
#: Words that may stand with numbers in a phrase that is only an amount.
AMOUNT_WORDS = ("to", "and", "or", "per", "percent", "percentage", "approx", "approximately")
#: Headings and labels of course pages that are no concepts.
PAGE_WORDS = (
    "questions", "question", "exercises", "exercise", "problems", "problem",
    "homework", "assignment", "assignments", "syllabus", "curriculum",
    "prerequisites", "prerequisite", "references", "reference", "bibliography",
    "readings", "reading", "schedule", "grading", "exam", "exams", "midterm",
    "final", "chapter", "section", "part", "module", "unit", "lecture",
    "lectures", "lab", "labs", "tutorial", "tutorials", "course overview",
    "overview", "course description", "description", "introduction",
    "conclusion", "appendix", "index", "glossary", "summary", "review",
    "objectives", "learning objectives", "table of contents", "contents",
    "notes", "further reading", "see also", "external links", "difficulty",
    "study", "types", "some fields",
)
#: Words that make a phrase in capitals a heading, and words that do so before a number or letter.
PAGE_STEMS = ("question", "problem", "exercise", "chapter", "section", "module", "lecture", "syllabus", "exam")
NUMBERED = ("chapter", "section", "part", "module", "unit", "lecture", "lab", "assignment", "question", "exercise", "problem")
#: Words that no concept begins or ends with.
EDGE_WORDS = (
    "a", "an", "the", "this", "that", "these", "those", "there",
    "and", "or", "but", "nor", "for", "yet", "so",
    "of", "in", "to", "with", "from", "at", "by", "on", "as", "into",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "considered", "called", "known", "using", "based", "which", "who", "what",
    "e.g.", "eg", "i.e.", "ie", "hence", "such", "including", "like", "etc", "etc.",
)


def strip_references(text: Column) -> Column:
    """The text before the first reference heading on a line of its own."""
    return F.regexp_replace(text, rf"(?is)\n={{2,}} *(?:{'|'.join(REFERENCE_HEADINGS)}) *={{2,}}(?:\n.*)?\z", "")


def html_to_text(html: Column) -> Column:
    """Markup taken out: silent elements whole, line tags as line ends, other tags as blanks; then entities, references and blanks."""
    t = html
    for tag in SILENT_TAGS:
        t = F.regexp_replace(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{'|'.join(LINE_TAGS)})(?: [^>]*)?/?>", "\n")
    t = F.regexp_replace(t, r"<[^>\n]+>", " ")
    for entity, plain in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(plain))
    lines = F.transform(F.split(strip_references(t), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return F.array_join(F.filter(lines, lambda x: F.length(x) > 1), "\n")


def clean_phrase(p: Column) -> Column:
    """Without a leading article, edge punctuation and repeated blanks; null for under three characters or with brackets and signs."""
    t = F.regexp_replace(F.trim(p), r"(?i)^(?:the|an|a) +", "")
    t = F.regexp_replace(t, r"^[.,;:!?'\"()*-]+|[.,;:!?'\"()*-]+$", "")
    t = F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))
    return F.when((F.length(t) >= 3) & ~t.rlike(r"[\[\]{}<>=+]"), t)


def is_amount(p: Column) -> Column:
    """Whether a phrase is only a number, a range, a percentage or an amount in words."""
    low = F.lower(F.trim(p))
    rest = F.filter(F.split(F.regexp_replace(low, r"[^a-z ]", " "), " +"), lambda x: x != "")
    ranged = low.rlike(r"^[0-9]+(?:\.[0-9]+)? ?%?(?: ?(?:-|–|to) ?[0-9]+(?:\.[0-9]+)? ?%?)?$")
    return ranged | ~low.rlike(r"[a-z]") | F.forall(rest, lambda x: x.isin(*AMOUNT_WORDS))


def is_page_word(p: Column) -> Column:
    """Whether a phrase is a heading or label of a page, no concept."""
    t = F.trim(p)
    low = F.lower(t)
    shouted = (F.upper(t) == t) & t.rlike("[A-Z]") & (F.length(t) >= 3) & F.exists(F.array(*map(F.lit, PAGE_STEMS)), lambda s: F.contains(low, s))
    return low.isin(*PAGE_WORDS) | low.rlike(rf"^(?:{'|'.join(NUMBERED)}) +(?:[0-9]+|[a-z])$") | shouted


def well_formed(p: Column) -> Column:
    """Whether a phrase has more than three characters and neither begins nor ends with an edge word, and is no amount or page word."""
    words = F.split(F.lower(F.trim(p)), r"[ \t\r\n]+")
    return (F.length(F.trim(p)) > 3) & ~F.element_at(words, 1).isin(*EDGE_WORDS) & ~F.element_at(words, -1).isin(*EDGE_WORDS) & ~is_amount(p) & ~is_page_word(p)


def normalize_name(name: Column) -> Column:
    """Lower-case singular form: articles and possessives dropped, plural of the last word undone."""
    t = F.regexp_replace(F.lower(F.trim(name)), r"^(?:a|an|the) +", "")
    t = F.regexp_replace(t, r"['’]s(?= |$)|['’](?= |$)", "")
    t = F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))
    last = F.element_at(F.split(t, " "), -1)
    n = F.length(last)
    es = last.rlike(r"(?:s|x|ch|sh)es$")
    cut = F.when(last.endswith("ies") & (n > 3), F.lit(3)).when(es & (n > 4), F.lit(2)).when(last.endswith("s") & ~last.rlike("(?:ss|us|is)$") & (n > 3), F.lit(1)).otherwise(F.lit(0))
    end = F.when(cut == 3, F.lit("y")).otherwise(F.lit(""))
    return F.concat(F.substring(t, F.lit(1), F.length(t) - cut), end)


def sentences(text: Column, least: int = 20) -> Column:
    """Sentences of at least ``least`` characters: cut at line ends and after . ! or ? with white space."""
    cut = F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\n"), "\n+")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def sections(text: Column, separator: str = "\n\n", least: int = 20) -> Column:
    """Parts between separators, stripped, of at least ``least`` characters."""
    return F.filter(F.transform(F.split(text, separator), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def chunks(text: Column, longest: int = 8000, size: int = 6000, most: int = 0) -> Column:
    """The text itself, or pieces of ``size`` characters if it has more than ``longest``; ``most`` 0 keeps all of them."""
    n = F.ceil(F.length(text) / size).cast("int")
    n = F.least(n, F.lit(most)) if most else n
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(F.length(text) > longest, pieces).otherwise(F.array(text))


def bow_buckets(text: Column, dims: int = 384) -> Column:
    """Bucket of each word of a text: the first 32 bits of its MD5, modulo ``dims``."""
    words = F.filter(F.split(F.lower(text), r"[ \t\r\n]+"), lambda w: w != "")
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % dims).cast("int"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
