"""Extraction of metadata and scores from text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import AFFILIATIONS, col

AFFILIATION = r"\b(" + "|".join(AFFILIATIONS) + r")\b"
# Fixed value: the pattern of a DOI.
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"

# Dataset names in the order in which they are looked for.
DATASETS = ("ACE2005", "ACE 2005", "ACE05", "MAVEN", "RAMS", "WikiEvents", "RichERE", "ERE", "CASIE", "FewEvent")
# A field of study and the phrases that name it, in the order in which they are looked for.
FIELD_RULES = (
    ("Few-shot", ("few-shot",)),
    ("Zero-shot", ("zero-shot",)),
    ("Doc-level", ("document-level", "doc-level")),
    ("Argument Extraction", ("argument",)),
    ("Trigger Identification", ("trigger",)),
    ("Event Detection", ("event detection",)),
    ("Event Argument Role Labeling", ("role labeling",)),
    ("Joint Extraction", ("joint",)),
    ("Open-domain", ("open-domain", "open domain")),
    ("Cross-lingual", ("cross-lingual", "cross lingual")),
    ("Low-resource", ("low-resource", "low resource")),
)
# Event and role names that the schema fallback looks for.
EVENTS = ("Attack", "Conflict", "Movement", "Transaction", "Contact", "Life", "Personnel", "Justice", "Business", "Artifact", "Generic Event", "Nested Event")
ROLES = ("Agent", "Victim", "Target", "Attacker", "Instrument", "Time", "Place", "Location", "Entity", "Argument", "Trigger")
# Spellings of concept names.
CONCEPT_SPELLINGS = {
    "attacking": "attack",
    "attacked": "attack",
    "conflicts": "conflict",
    "confliction": "conflict",
    "movement event": "movement",
    "transaction event": "transaction",
    "contact event": "contact",
    "life event": "life",
    "personnel event": "personnel",
    "justice event": "justice",
}
# Words that do not count in a venue's acronym.
VENUE_STOPWORDS = ("of", "the", "and", "for", "on", "in", "to", "a", "an", "international", "conference", "symposium", "workshop", "annual", "acm", "ieee", "sig", "transactions", "journal")


def clean_line(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))


def lines(c: Column | str) -> Column:
    return F.split(F.coalesce(col(c), F.lit("")), "\n")


def guess_title(c: Column | str) -> Column:
    """The longest plausible line of the first 30: 10 to 200 characters, no abstract, address, link or affiliation; the first on ties."""
    ok = F.filter(F.transform(F.slice(lines(c), 1, 30), lambda x: clean_line(x)), lambda x: F.length(x).between(10, 200) & ~F.lower(x).rlike(f"abstract|@|http|www|{AFFILIATION}"))
    most = F.array_max(F.transform(ok, lambda x: F.length(x)))
    return F.get(F.filter(ok, lambda x: F.length(x) == most), F.lit(0))


def guess_year(c: Column | str, low: int = 1980, high: int = 2035) -> Column:
    """The latest year named in the text."""
    years = F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0)), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: y.between(low, high)))


def guess_abstract(c: Column | str, mark: str = "abstract") -> Column:
    """What stands after the mark up to the introduction or keywords, of 50 characters at least and 2000 at most."""
    body = F.trim(F.regexp_extract(F.coalesce(col(c), F.lit("")), rf"(?is)(?:^|[^\p{{L}}\p{{N}}_]){mark}[:\n ](.*?)(?:[^\p{{L}}]introduction|[^\p{{L}}]keywords|$)", 1))
    return F.when(F.length(body) >= 50, F.substring(body, 1, 2000))


def first_doi(c: Column | str) -> Column:
    d = F.regexp_extract(F.coalesce(col(c), F.lit("")), DOI, 0)
    return F.when(d != "", d)


def all_dois(c: Column | str, limit: int = 30) -> Column:
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(DOI), F.lit(0))
    lower = F.transform(found, lambda d: F.lower(d))
    return F.slice(F.filter(found, lambda d, i: F.array_position(lower, F.lower(d)) == i + 1), 1, limit)


def guess_journal(c: Column | str) -> Column:
    hit = F.filter(F.slice(lines(c), 1, 50), lambda x: F.lower(x).rlike("proceedings|conference|journal|transactions"))
    return clean_line(F.get(hit, F.lit(0)))


def guess_authors(c: Column | str, title: Column) -> Column:
    """The first of the four lines after the title that reads like names; nothing after an abstract."""
    all_lines = F.transform(lines(c), lambda x: clean_line(x))
    at = F.array_position(all_lines, title)
    after = F.when(at > 0, F.slice(all_lines, at.cast("int") + 1, 4)).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform(after, lambda x: F.lower(x).startswith("abstract")), True)
    before = F.when(stop > 0, F.slice(after, 1, stop.cast("int") - 1)).otherwise(after)
    names = F.filter(before, lambda x: (x != "") & ~F.lower(x).rlike(AFFILIATION) & (x.contains(",") | F.lower(x).contains(" and ") | (F.size(F.split(x, " ")) <= 8)))
    return F.get(names, F.lit(0))


def references_section(c: Column | str, tail: int = 20000, least: int = 400) -> Column:
    """The end of a text from its references mark; all of the tail if that is long enough, else nothing."""
    end = F.right(F.coalesce(col(c), F.lit("")), F.lit(tail))
    low = F.lower(end)
    at = F.coalesce(*[F.when(F.locate(m, low) > 0, F.locate(m, low)) for m in ("references", "bibliography", "参考文献")])
    return F.when(at.isNotNull(), F.substring(end, at, F.length(end))).when(F.length(end) >= least, end)


def note_links(c: Column | str) -> Column:
    """``[[...]]`` names in a note: trimmed, 160 characters at most, first of equal ones ignoring case."""
    found = F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\[\[([^\]]*)\]\]"), F.lit(1)), lambda x: F.substring(F.trim(x), 1, 160))
    found = F.filter(found, lambda x: x != "")
    lower = F.transform(found, lambda x: F.lower(x))
    return F.filter(found, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def infer_field(c: Column | str) -> Column:
    """The first field of study one of whose phrases the text holds; null without any."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    out = F.lit(None).cast("string")
    for name, phrases in reversed(FIELD_RULES):
        for phrase in phrases:
            out = F.when(text.contains(phrase), name).otherwise(out)
    return out


def schema_fallback(c: Column | str) -> Column:
    """``(events, roles, confidence)``: known words that the text holds."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    of = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: text.contains(F.lower(w)))
    return F.struct(of(EVENTS).alias("events"), of(ROLES).alias("roles"), F.lit(0.35).alias("confidence"))


def lenient_json(c: Column | str, schema: str) -> Column:
    """JSON of the whole text, or of what stands between its first ``{`` and last ``}``."""
    whole = F.from_json(col(c), schema)
    inner = F.from_json(F.regexp_extract(col(c), r"(?s)(\{.*\})", 1), schema)
    return F.when(F.expr("true") & F.try_parse_json(col(c)).isNotNull(), whole).otherwise(inner)


def venue_norm(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "))


def venue_acronym(c: Column | str) -> Column:
    """Initials of a venue's words without stop words, where there are two or more."""
    words = F.filter(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*VENUE_STOPWORDS))
    return F.when(F.size(words) >= 2, F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")))


def venue_candidates(c: Column | str) -> Column:
    """Acronyms that may name a venue: its runs of capitals and its initials."""
    runs = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\b[A-Z]{2,10}\b"), F.lit(0))
    return F.array_distinct(F.array_compact(F.concat(runs, F.array(venue_acronym(c)))))


def author_names(c: Column | str) -> Column:
    """Author structs of a comma list: the last word is the last name."""
    names = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    parts = lambda x: F.split(x, " +")
    return F.transform(names, lambda x: F.struct(F.array_join(F.slice(parts(x), 1, F.greatest(F.size(parts(x)) - 1, F.lit(0))), " ").alias("first"), F.element_at(parts(x), -1).alias("last")))


def canonical_concept(c: Column | str) -> Column:
    """A concept's canonical name: lower case words, known spellings replaced, three words and 80 characters at most."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9一-鿿]+", " "))
    mapping = F.create_map(*[F.lit(x) for pair in CONCEPT_SPELLINGS.items() for x in pair])
    short = F.substring(F.array_join(F.slice(F.split(F.coalesce(F.element_at(mapping, words), words), " "), 1, 3), " "), 1, 80)
    return F.when(short != "", short)


def title_by_font(spans: Column | str, within: float = 0.5) -> Column:
    """The title of a first page given as lines ``array<struct<y, size, text>>``: those set largest, from top to bottom.

    ``size`` is the largest of a line's letters; lines within half a point of the largest count. A title has 10 to 200
    characters, else there is none.
    """
    known = F.filter(F.transform(col(spans), lambda x: F.struct(x["y"].alias("y"), x["size"].alias("size"), clean_line(x["text"]).alias("text"))), lambda x: x["text"] != "")
    most = F.array_max(F.transform(known, lambda x: x["size"]))
    # stable by height: lines of one height stay in their order
    top = F.filter(F.transform(known, lambda x, i: F.struct(x["y"].alias("y"), i.alias("i"), x["size"].alias("size"), x["text"].alias("text"))), lambda x: x["size"] >= most - within)
    text = clean_line(F.array_join(F.transform(F.array_sort(top), lambda x: x["text"]), " "))
    return F.when((most > 0) & F.length(text).between(10, 200), text)


def name_of_creators(creators: Column | str) -> Column:
    """``array<struct<firstName, lastName>>`` as names joined by commas; null without any."""
    full = F.transform(col(creators), lambda c: F.trim(F.concat_ws(" ", F.nullif(F.trim(F.coalesce(c["firstName"], F.lit(""))), F.lit("")), F.nullif(F.trim(F.coalesce(c["lastName"], F.lit(""))), F.lit("")))))
    return F.nullif(F.array_join(F.filter(full, lambda n: n != ""), ", "), F.lit(""))


def first_year(c: Column | str) -> Column:
    """The first year from 1900 to 2099 that a text names as a word of its own."""
    return F.nullif(F.regexp_extract(F.coalesce(col(c).cast("string"), F.lit("")), r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")
