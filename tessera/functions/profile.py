"""Profile of documents and signals of chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import DOMAIN_TERMS, DOMAIN_WEIGHTS, PLAIN_WEIGHTS
from .text import HANGUL, INDENTED, LEGAL, chars_of, count_of, has_code, has_legal_structure, has_list, has_table, numeric_density, sentences, token_set, tokens, whitespace_words

TABLES = (r"\|[^\n]*\|[^\n]*\|", r"(?i)<table[\s>]", r"\t[^\n]*\t")
HEADINGS = r"(?m)^#{1,6}\s+|<[hH][1-6][\s>]"


def _tables(text: Column) -> Column:
    return count_of(text, TABLES[0]) + count_of(text, TABLES[1]) + count_of(text, TABLES[2])


def _lists(text: Column) -> Column:
    return count_of(text, r"(?m)^[ \t]*[-*•]\s+") + count_of(text, r"(?m)^[ \t]*\d+[.)]\s+")


def _code(text: Column) -> Column:
    return (F.floor(count_of(text, "```") / 2) + F.floor(count_of(text, INDENTED + r"\S") / 3)).cast("int")


def paragraphs(text: Column) -> Column:
    return count_of(text, r"\n[ \t\f\r]*\n\s*") + 1


def structure(text: Column, tables: Column | None = None) -> Column:
    breaks = F.floor((F.length(text) - F.length(F.replace(text, F.lit("\n\n"), F.lit("")))) / 2)
    return (
        F.when(text.rlike(LEGAL), "legal_hierarchical")
        .when(text.rlike(HEADINGS), "hierarchical")
        .when((_tables(text) if tables is None else tables) > 0, "tabular")
        .when(breaks >= 3, "paragraphed")
        .otherwise("flat")
    )


def information_type(tables: Column, code: Column, lists: Column, paragraph_count: Column, legal: Column) -> Column:
    """The best of five scored kinds, from their counts; mixed if the second has more than half of the best."""
    scored = F.array(
        *(
            F.struct(score.alias("score"), F.lit(-i).alias("turn"), F.lit(name).alias("name"))
            for i, (name, score) in enumerate(
                {
                    "narrative": F.when((paragraph_count >= 3) & (tables == 0) & (code == 0), 2.0).otherwise(0.0),
                    "tabular": F.when(tables >= 3, 3.0).when(tables >= 1, 1.5).otherwise(0.0),
                    "code": F.when(code >= 2, 3.0).when(code >= 1, 1.5).otherwise(0.0),
                    "enumeration": F.when(lists >= 5, 2.0).when(lists >= 2, 1.0).otherwise(0.0),
                    "legal": F.when(legal, 3.0).otherwise(0.0),
                }.items()
            )
        )
    )
    order = F.sort_array(scored, asc=False)
    first, second = order[0], order[1]
    return F.when(first["score"] == 0, "narrative").when((second["score"] > 0) & (second["score"] > first["score"] * 0.5), "mixed").otherwise(first["name"])


def heading_depth(text: Column) -> Column:
    """The most # of a Markdown heading, else the highest number of an HTML heading, else 0."""
    marks = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6})\s+"), F.lit(1)), F.length))
    levels = F.array_max(F.regexp_extract_all(text, F.lit(r"(?i)<h([1-6])"), F.lit(1)))
    return F.coalesce(marks, levels.cast("int"), F.lit(0))


def sentence_length(text: Column) -> Column:
    """Words of an average sentence; 0 without sentences."""
    parts = sentences(text)
    words = F.aggregate(F.transform(parts, lambda s: F.size(whitespace_words(s))), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(parts) > 0, F.round(words / F.size(parts), 6)).otherwise(0.0)


def vocabulary_richness(text: Column) -> Column:
    return F.size(token_set(text)) / F.greatest(F.size(tokens(text)), F.lit(1))


def information_density(text: Column) -> Column:
    ink = F.length(F.translate(text, " \n\t", ""))
    return F.round(ink / F.greatest(F.length(text), F.lit(1)), 3)


def language_counts(text: Column) -> dict[str, Column]:
    """Hangul (ko), Chinese (zh) and Latin (en) characters of the whole text."""
    return {"ko": chars_of(text, HANGUL[1:-1]), "zh": chars_of(text, r"\x{4E00}-\x{9FFF}"), "en": chars_of(text, "a-zA-Z")}


def language_shares(n: dict[str, Column]) -> dict[str, Column]:
    """Share of each language, from the counts."""
    total = F.greatest(n["ko"] + n["zh"] + n["en"], F.lit(1))
    return {k: F.round(v / total, 2) for k, v in n.items()}


def primary_language(s: dict[str, Column]) -> Column:
    """The language of most characters, from counts or shares; the first of ko, zh and en where they are equal."""
    return F.when(s["ko"] + s["zh"] + s["en"] == 0, "unknown").when((s["ko"] >= s["zh"]) & (s["ko"] >= s["en"]), "ko").when(s["zh"] >= s["en"], "zh").otherwise("en")


def domain_terms(words: Column, lower: Column) -> dict[str, Column]:
    """Terms of each domain that are words of the text, or of more than three letters and inside it."""
    out = {}
    for domain, terms in DOMAIN_TERMS.items():
        whole = F.array_intersect(words, F.array(*map(F.lit, terms)))
        inside = F.filter(F.array(*(F.lit(t) for t in terms if len(t) > 3)), lambda t: F.contains(lower, t))
        out[domain] = F.sort_array(F.array_union(whole, inside))
    return out


def domain_scores(found: dict[str, Column], legal: Column, numeric: Column, tables: Column) -> dict[str, Column]:
    """Number of terms of each domain; legal structure, many numbers and tables count too."""
    out = {d: F.size(x) for d, x in found.items()}
    out["legal"] = out["legal"] + F.when(legal, 5).otherwise(0)
    out["financial"] = out["financial"] + F.when(numeric > 0.15, 2).otherwise(0) + F.when(tables >= 3, 1).otherwise(0)
    return out


def domain(scores: dict[str, Column]) -> Column:
    """The domain of most terms, the first of equal ones; general without any."""
    best = F.greatest(*scores.values())
    out = F.when(best == 0, "general")
    for name, s in scores.items():
        out = out.when(s == best, name)
    return out


def domain_confidence(scores: dict[str, Column]) -> Column:
    """How clearly the best domain leads the second, to two places."""
    order = F.sort_array(F.array(*scores.values()), asc=False)
    best, second = order[0], order[1]
    share = best / (best + second) * F.least(F.lit(1.0), best / 3)
    return F.when(best == 0, 0.0).when(second == 0, F.least(F.lit(1.0), best / 5)).otherwise(F.floor(share * 100 + 0.5) / 100)


def domain_weight(name: Column, index: int) -> Column:
    """Recommended weight of the vector (0), question (1) or keyword (2) list for texts of a domain."""
    out = F.lit(PLAIN_WEIGHTS[index])
    for d, weights in DOMAIN_WEIGHTS.items():
        out = F.when(name == d, weights[index]).otherwise(out)
    return out


def needs_expansion(requires_context: Column, completeness: Column) -> Column:
    """Whether a chunk should be shown with its neighbours."""
    return requires_context | (completeness < 0.5)


def skips_compression(information: Column, table: Column) -> Column:
    """Whether every word of a chunk counts."""
    return information.isin("tabular", "legal", "code") | table


def recommended_strategy(structure_type: Column, information: Column, paragraph_count: Column) -> Column:
    return (
        F.when(structure_type.isin("hierarchical", "legal_hierarchical") | (information == "tabular"), "structural")
        .when(paragraph_count >= 3, "semantic")
        .otherwise("fixed")
    )


def chunk_information_type(text: Column) -> Column:
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        F.when(has_legal_structure(text), "legal")
        .when(has_table(text), "tabular")
        .when(has_code(text), "code")
        .when(has_list(text) & (lines > 3), "enumeration")
        .otherwise("narrative")
    )
