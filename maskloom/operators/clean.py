"""Cleaning and de-duplication of text sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import text as tx
from maskloom.operators.tokens import shifted

# Markers of notes, word counts and tails with their share of the text.
NOTE_MARKERS = ("\nNote:", "\n(Note:", "\n[Note:", "\nPlease note")
COUNT_MARKERS = ("\nWord count:", "\nWord Count:", "\n(Word Count:", "\nEssay Length:")
TAIL_MARKERS = (
    ("Retrieved from", 0.8),
    ("Word Count", 0.8),
    ("References", 0.7),
    ("\n\nReference", 0.7),
    ("**Note:**", 0.8),
    ("Please note", 0.8),
)
LAST_PARAGRAPH_SHARE = 0.95
# Fixed value: characters between the starts of placeholders that count as one.
NEAR_LINKS = 10
# Lines that stand for a link.
LINK_LINES = (
    r"\nURL: [^\n]+\]\n\n",
    r"\nURL: \[[^\n]+$",
    r"\n[\(\[]URL: [^\n]+\n\n",
    r"\nPersonal URL: [^\n]+\n\n",
    r"\nPersonal URL: [^\n]+$",
    r"\n ?\[URL\][\[\(][^\n]+\n\n",
    r"\n\[URL\][\[\(][^\n]+$",
    r"\n\[URL[^\n]+\]\n",
    r"\n\[URL[^\n]+$",
    r"\n\[URL\][^\n]+\n",
)


def cut_at_markers(text: Column, markers: Sequence[str], share: float = 0.8) -> Column:
    """Cut at the first hit of a marker whose last hit lies past `share` of the text."""

    def step(t: Column, marker: str) -> Column:
        late = tx.last_index(t, marker) > share * F.length(t)
        return F.when(late, F.substring(t, F.lit(1), tx.first_index(t, marker))).otherwise(t)

    return reduce(lambda t, m: tx.let(t, lambda x: step(x, m)), markers, text)


def remove_note(text: Column) -> Column:
    return cut_at_markers(text, NOTE_MARKERS)


def remove_word_count(text: Column) -> Column:
    return cut_at_markers(text, COUNT_MARKERS)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def remove_here_is(text: Column) -> Column:
    """Drop a preamble that starts with `Here`; a text without a blank line stays as it is."""

    def step(t: Column) -> Column:
        gap = F.instr(t, "\n\n")
        rest = strip(F.substring(t, gap + 2, F.length(t)))
        return F.when(strip(t).startswith("Here") & (gap > 0), rest).otherwise(t)

    return tx.let(text, step)


def url_outside_brackets(text: Column) -> Column:
    """`URL` outside `<<...>>`, line by line."""
    return F.regexp_replace(text, "<<.*>>", "<<>>").contains("URL")


def no_pii(names: Column, famous: Column, text: Column, pattern: str = "<<URL>>") -> Column:
    return (F.length(names) == 0) & (F.length(famous) == 0) & ~text.contains(pattern)


def has_placeholders(text: Column) -> Column:
    return text.contains("<personal") | text.contains("<public")


def is_failed(text: Column) -> Column:
    return text.contains("<|ERROR|>")


def cut_tails(text: Column) -> Column:
    """Cut at the first hit of a tail marker past its share, then a last paragraph at the very end."""

    def step(t: Column, marker: tuple[str, float]) -> Column:
        at = tx.first_index(t, marker[0])
        return F.when(at > marker[1] * F.length(t), F.substring(t, F.lit(1), at)).otherwise(t)

    def last_paragraph(t: Column) -> Column:
        at = tx.last_index(t, "\n\n")
        return F.when(at > LAST_PARAGRAPH_SHARE * F.length(t), F.substring(t, F.lit(1), at)).otherwise(t)

    return tx.let(reduce(lambda t, m: tx.let(t, lambda x: step(x, m)), TAIL_MARKERS, text), last_paragraph)


def normalize_links(text: Column) -> Column:
    """Link lines become ` <URL> `; of placeholders less than ten characters apart the first stays."""
    return first_placeholders(F.regexp_replace(text, "|".join(LINK_LINES), " <URL> "))


# A written-out link, what stands for one, and the characters between them that make them one.
HYPERLINK = r"https?://(?:www\.)?[-a-zA-Z0-9@:%._+~#=]{2,256}\.[a-z]{2,6}[-a-zA-Z0-9@:%_+.~#?&/=]*|www\.[a-zA-Z0-9.-]+\.[a-z]{2,6}"
PLACEHOLDER = r"<URL>|\[URL\]"
NEAR_PLACEHOLDER = 4


def fold_links(text: Column) -> Column:
    """Hyperlinks one to four characters from a placeholder, on either side, become ` <URL> `, wherever they stand in the text.

    Links and placeholders are taken in order in one pass, with the text before each; a link looks at what is
    next to it on both sides. A link that is equal to one near a placeholder goes with it.
    """
    both = F.lit(f"{PLACEHOLDER}|{HYPERLINK}")

    def fold(t: Column) -> Column:
        hits, gaps = F.regexp_extract_all(t, both, F.lit(0)), F.split(t, both, -1)
        sizes = F.transform(gaps, F.length)
        zipped = F.arrays_zip(
            hits.alias("hit"), gaps.alias("gap"), sizes.alias("size"),
            shifted(hits, -1).alias("before"), shifted(hits, 1).alias("after"), shifted(sizes, 1).alias("room"),
        )
        return tx.let(zipped, rebuilt)

    def rebuilt(z: Column) -> Column:
        stands = lambda h: h.isin("<URL>", "[URL]")
        close = lambda n: n.between(1, NEAR_PLACEHOLDER)
        near = F.filter(
            z,
            lambda x: ~stands(x["hit"])
            & (F.coalesce(stands(x["before"]) & close(x["size"]), F.lit(False)) | F.coalesce(stands(x["after"]) & close(x["room"]), F.lit(False))),
        )
        return tx.let(
            F.transform(near, lambda x: x["hit"]),
            lambda gone: F.array_join(
                F.transform(z, lambda x: F.concat(x["gap"], F.when(F.array_contains(gone, x["hit"]), " <URL> ").otherwise(F.coalesce(x["hit"], F.lit(""))))),
                "",
            ),
        )

    return F.when(text.contains("URL"), tx.let(text, fold)).otherwise(text)


def normalize_near_links(text: Column) -> Column:
    """`normalize_links` with hyperlinks near a placeholder folded into it first."""
    lines = F.regexp_replace(text, "|".join(LINK_LINES), " <URL> ")
    return first_placeholders(fold_links(lines))


def first_placeholders(text: Column) -> Column:
    """Drop each `URL`, with a character on both sides, that begins less than `NEAR_LINKS` after one before it.

    One fold over the parts between placeholders carries the text so far, the start of the last
    placeholder (also of a dropped one) and the end of what belongs to the last one kept. A line break is
    never one of the characters beside a placeholder.
    """

    def step(s: Column, part: Column) -> Column:
        size = F.length(s["out"])
        before = ((size > s["end"]) & ~s["out"].endswith("\n")).cast("int")
        start = size - before
        after = ((F.length(part) > 0) & ~part.startswith("\n")).cast("int")
        seen = s["end"] <= size  # the U of an adjoining placeholder belongs to the one before
        near = seen & (s["last"] >= 0) & (start - s["last"] < NEAR_LINKS) & (start > s["last"])
        dropped = F.concat(F.substring(s["out"], F.lit(1), start), F.substring(part, after + 1, F.length(part)))
        kept = F.concat(s["out"], F.lit("URL"), part)
        # at a text end or a line break nothing beside the placeholder is taken; an adjoining one lends its U
        until = size + 3 + F.when(F.length(part) == 0, 1).otherwise(after)
        return F.struct(
            F.when(near, dropped).otherwise(kept).alias("out"),
            F.when(seen & ~near, start).otherwise(s["last"]).cast("int").alias("last"),
            F.when(near | ~seen, s["end"]).otherwise(until).cast("int").alias("end"),
        )

    def fold(t: Column) -> Column:
        parts = F.split(t, "URL", -1)
        first = F.struct(F.get(parts, F.lit(0)).alias("out"), F.lit(-1).alias("last"), F.lit(0).alias("end"))
        out = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), first, step)["out"]
        return F.when(F.size(parts) > 2, out).otherwise(t)

    return tx.let(text, fold)


def link_lines(text: Column) -> Column:
    """The lines that mention a URL."""
    return F.filter(F.split(text, "\n"), lambda line: line.contains("URL"))


def clean_names(raw: Column) -> Column:
    """Names from a generated list, in order."""
    head = raw
    for stop in ("\n\n", "\nNote:", "\n(Note:", "\nUser:"):
        head = F.substring_index(head, stop, 1)
    lines = F.transform(F.split(strip(head), "\n"), lambda x: strip(F.regexp_replace(x, r"^[*-]+", "")))
    lines = F.transform(
        lines,
        lambda x: F.when(F.instr(F.substring(x, 1, 3), ".") > 0, strip(F.get(F.split(x, r"\."), F.lit(1)))).otherwise(x),
    )
    lines = F.filter(lines, lambda x: F.length(x).between(2, 29) & ~x.rlike(r"[,()]"))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"^\.+|\.+$", ""))
    lines = F.filter(lines, lambda x: ~x.rlike(r"[*|\\/:.@`]"))
    lines = F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^(?:Female: |Male: )", "")))
    lines = F.transform(lines, lambda x: tx.title(F.replace(tx.to_ascii(x), F.lit("@"), F.lit("a"))))
    return F.filter(lines, lambda x: ~x.rlike("[1-5]") & (F.length(x) > 1))


def two_words(name: Column) -> Column:
    return F.substring_index(name, " ", 2)


def names_by_country(rows: DataFrame, country: str, name: str) -> DataFrame:
    """Distinct names of every country in long form: no country is collected into one row."""
    return rows.select(country, name).distinct()


def contains_all(text: Column, names: Column) -> Column:
    return F.forall(names, lambda n: F.contains(text, n))


def first_of_each_text(docs: DataFrame, text: Column, order: str = "nr") -> DataFrame:
    """Exact de-duplication: the lowest `order` of every text stays.

    Groups of copies shrink to one minimum before the shuffle, so a text that fills a third
    of the data costs no more than any other.
    """
    kept = docs.select(F.sha2(text.cast("binary"), 256).alias("_h"), order).groupBy("_h").agg(
        F.min(order).alias(order)
    )
    return docs.join(kept.select(order), order, "left_semi")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


TEXT_STEPS: dict[str, Callable[[Column], Column]] = {
    "remove_note": remove_note,
    "remove_word_count": remove_word_count,
    "remove_here_is": remove_here_is,
    "cut_tails": cut_tails,
    "normalize_links": normalize_links,
    "collapse_spaces": collapse_spaces,
}
DROP_TESTS: dict[str, Callable[[str], Column]] = {
    "url_outside_angle_brackets": lambda c: url_outside_brackets(F.col(c)),
    "no_pii": lambda c: no_pii(F.col("names"), F.col("famous_person"), F.col(c)),
    "no_placeholders": lambda c: ~has_placeholders(F.col(c)),
    "no_errors": lambda c: is_failed(F.col(c)),
}


def clean_set(rows: DataFrame, functions: Sequence[str], filters: Sequence[str], text: str = "essay") -> DataFrame:
    """Apply named text steps, then drop rows by named tests, both in the given order."""
    for name in functions:
        rows = rows.withColumn(text, TEXT_STEPS[name](F.col(text)))
    for name in filters:
        rows = rows.filter(~DROP_TESTS[name](text))
    return rows


def clean_texts(docs: DataFrame, predictions: DataFrame, text: str = "text") -> DataFrame:
    """Texts without a predicted entity, link or link placeholder."""
    plain = docs.filter(~F.col(text).contains("http") & ~F.col(text).contains("[URL"))
    return plain.join(predictions.select("document").distinct(), "document", "left_anti")
