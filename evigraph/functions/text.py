"""Text functions as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words and the alias dictionary of the domain.
STOPWORDS = (
    "что", "уже", "делали", "по", "при", "какой", "был", "какая", "какие", "как", "и",
    "с", "в", "во", "для", "а", "если", "на", "или", "за", "все", "the", "what", "was",
    "did", "for", "are", "is",
)
SYNONYMS = {
    "electrowinning": "электроэкстракция",
    "electrowinning of nickel": "электроэкстракция никеля",
    "catholyte": "католит",
    "catholyte circulation": "циркуляции католита",
    "flash smelting": "взвешенной плавки",
    "fluidized bed furnace": "печь взвешенной плавки",
    "пвп": "печь взвешенной плавки",
    "heap leaching": "кучное выщелачивание",
    "deep well injection": "закачка в глубокие горизонты",
    "deep injection": "закачка в глубокие горизонты",
    "matte": "штейн",
    "slag": "шлак",
    "pgm": "мпг",
    "reverse osmosis": "обратный осмос",
    "ion exchange": "ионный обмен",
    "electrodialysis": "электродиализ",
    "dry residue": "сухой остаток",
    "desalination": "обессоливани",
    "overcoring": "полной разгрузки керна",
    "sodium antimonate": "антимонат натрия",
}
SUBSCRIPT_DIGITS = "₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹"
PLAIN_DIGITS = "01234567890123456789"
SNIPPET_MARKER = r"(?iu)\[\s*(?:para|paragraph|page|slide|table|стр\.?|страница|слайд|таблица)\s*\d+\s*\]"
LOCATION_LABELS = {"page": "стр.", "slide": "слайд", "table": "таблица"}

WORD = r"[\p{L}\p{N}_-]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Lambda bodies have no common-subexpression elimination: an expression repeated in one is
    computed again per element. Binding it as the variable of a one-element transform avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def tokenize(text: Column) -> Column:
    """Words of two or more characters that are no stop words, case kept."""
    return F.filter(words(text), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*STOPWORDS))


def word_match(a: Column, b: Column) -> Column:
    """Equal, or both of 4+ characters with a common prefix of max(3, 60% of the shorter)."""
    short = F.least(F.length(a), F.length(b))
    prefix = F.greatest(F.lit(3), F.floor(short * 3 / 5).cast("int"))
    return (a == b) | ((short >= 4) & (F.substring(a, 1, prefix) == F.substring(b, 1, prefix)))


def name_words(name: Column) -> Column:
    """Lower-case words of three or more characters; duplicates are kept."""
    return F.filter(words(F.lower(name)), lambda w: F.length(w) > 2)


def match_key(word: Column) -> Column:
    """Blocking key of ``word_match``: words that match always agree on their first 3 characters."""
    return F.substring(word, 1, 3)


def name_similarity(a: Column, b: Column) -> Column:
    """Share of the words of ``a`` that match a word of ``b``; not symmetric."""
    both = F.struct(name_words(a).alias("a"), name_words(b).alias("b"))
    return let(
        both,
        lambda w: F.when(
            (F.size(w["a"]) == 0) | (F.size(w["b"]) == 0),
            F.when(F.trim(F.lower(a)) == F.trim(F.lower(b)), 1.0).otherwise(0.0),
        ).otherwise(F.size(F.filter(w["a"], lambda x: F.exists(w["b"], lambda y: word_match(x, y)))) / F.size(w["a"])),
    )


LATIN = "[A-Za-z]"
CYRILLIC = "[А-Яа-яЁё]"


def script_language(text: Column) -> Column:
    """Language class by the share of Cyrillic letters; only texts in both scripts are counted."""
    def by_share(t: Column) -> Column:
        # In UTF-8 a Latin letter is one byte and a Cyrillic one two, so one pass gives both counts.
        counts = let(
            F.regexp_replace(t, "[^A-Za-zА-Яа-яЁё]+", ""),
            lambda kept: F.struct(F.length(kept).alias("letters"), (F.octet_length(kept) - F.length(kept)).alias("cyrillic")),
        )
        return let(
            counts,
            lambda n: F.when(n["cyrillic"] / n["letters"] > 0.7, "ru").when(n["cyrillic"] / n["letters"] < 0.15, "en").otherwise("mixed"),
        )

    def classified(t: Column) -> Column:
        scripts = F.struct(t.rlike(LATIN).alias("latin"), t.rlike(CYRILLIC).alias("cyrillic"))
        return F.when(F.trim(t) == "", "unknown").otherwise(
            let(
                scripts,
                lambda s: F.when(s["latin"] & s["cyrillic"], by_share(t)).when(s["latin"], "en").when(s["cyrillic"], "ru").otherwise("other"),
            )
        )

    # The text may be an expression of its own (translated, cut); it is computed once.
    return let(text, classified)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_id(etype: Column, name: Column) -> Column:
    """64 bits of sha1 over the folded name: no clash in sight at billions of names."""
    return F.concat(etype, F.lit("_"), F.substring(F.sha1(F.lower(F.trim(name))), 1, 16))


def normalize_subscripts(text: Column) -> Column:
    return F.lower(F.translate(text, SUBSCRIPT_DIGITS, PLAIN_DIGITS))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_snippet(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, SNIPPET_MARKER, " "), r"\s{2,}", " ")
    return F.trim(F.regexp_replace(bare, r"^\s*[·,;:—-]\s*", ""))


def clean_location(location: Column) -> Column:
    """Page, slide and table numbers grouped by kind in order of appearance; paragraphs hidden."""
    token = r"(?i)(paragraph|para|page|slide|table)\s*(\d+)"
    pairs = F.filter(
        F.transform(
            F.split(location, ","),
            lambda t: F.struct(
                F.lower(F.regexp_extract(t, token, 1)).alias("kind"), F.regexp_extract(t, token, 2).alias("num")
            ),
        ),
        lambda p: p["kind"].isin("page", "slide", "table"),
    )
    labels = F.create_map(*[F.lit(x) for kv in LOCATION_LABELS.items() for x in kv])

    def shown(pairs: Column) -> Column:
        return F.array_join(
            F.transform(
                F.array_distinct(F.transform(pairs, lambda p: p["kind"])),
                lambda k: F.concat(
                    labels[k],
                    F.lit(" "),
                    F.array_join(
                        F.array_distinct(F.transform(F.filter(pairs, lambda p: p["kind"] == k), lambda p: p["num"])), ", "
                    ),
                ),
            ),
            " · ",
        )

    return F.coalesce(let(pairs, shown), F.lit(""))


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", ""))


def extract_year(text: Column) -> Column:
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?:19|20)\d{2}", 0)
    return F.when(found != "", found.cast("int"))


def parse_biblio_line(line: Column) -> Column:
    """``authors - venue, year - publisher`` as struct(authors, venue, year)."""
    parts = F.transform(F.split(line, " - "), lambda p: F.trim(p))
    authors = F.filter(
        F.transform(F.split(F.get(parts, F.lit(0)), "[,;]"), lambda a: F.trim(a)),
        lambda a: (a != "") & ~F.contains(a, F.lit("…")),
    )
    venue = F.trim(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r",?\s*(?:19|20)\d{2}.*$", ""))
    return F.struct(authors.alias("authors"), venue.alias("venue"), extract_year(line).alias("year"))


def typed_attributes(json: Column, not_facts: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Numbers and texts of a JSON object by their JSON type: "12" and "NaN" are texts, 12 is a number.

    Numbers under ``not_facts`` are kept as texts; nulls leave; nested values stay JSON text.
    """
    bag = F.coalesce(F.from_json(json, "map<string,variant>"), F.create_map().cast("map<string,variant>"))

    def is_fact(k: Column, v: Column) -> Column:
        return let(F.schema_of_variant(v), lambda kind: (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & ~k.isin(*not_facts))

    def is_text(k: Column, v: Column) -> Column:
        return v.isNotNull() & (F.schema_of_variant(v) != "VOID") & ~is_fact(k, v)

    numbers = F.transform_values(F.map_filter(bag, lambda k, v: v.isNotNull() & is_fact(k, v)), lambda k, v: v.cast("double"))
    texts = F.transform_values(F.map_filter(bag, is_text), lambda k, v: v.cast("string"))
    return numbers, texts


def safe_slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, "[^a-zA-Z0-9_]", "_"), 1, 48)


def strip_fences(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(raw), r"(?m)^```(?:json)?|```$", ""))


def outer_object(raw: Column) -> Column:
    """The outermost ``{...}`` of a completion, null if there is none."""
    found = F.regexp_extract(strip_fences(raw), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def outer_array(raw: Column) -> Column:
    found = F.regexp_extract(strip_fences(raw), r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def parse_string_array(raw: Column) -> Column:
    """The strings of the first-to-last ``[...]``; other items are skipped, null if it does not parse."""
    items = F.from_json(outer_array(raw), "array<string>", {"mode": "PERMISSIVE"})
    # Items are read back as text, so quoted originals are told from numbers by their JSON form.
    kinds = F.from_json(outer_array(raw), "array<variant>", {"mode": "PERMISSIVE"})
    return F.when(
        items.isNotNull(),
        F.transform(
            F.filter(F.arrays_zip(items.alias("s"), kinds.alias("v")), lambda p: F.schema_of_variant(p["v"]) == "STRING"),
            lambda p: p["s"],
        ),
    )
