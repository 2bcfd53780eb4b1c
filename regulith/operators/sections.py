"""Documents into sections, with their citations, cross-references and definitions.

All of it happens within a row: markers are found, sorted and cut in arrays, and one
``inline`` makes the rows, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, rx, text

MARK = "array<struct<start: int, header: string, id: string>>"


def _marked(low: Column, pattern: str) -> Column:
    """Whether a ``folded`` text has a match; the pattern is tried where a text that it needs stands."""
    some = F.lit(False)
    for word in rx.needed_any(pattern):
        some = some | F.contains(low, F.lit(word))
    return some & F.rlike(low, F.lit(rx.lowered(pattern)))


def markers(body: Column, low: Column | None = None, parts: Column | None = None) -> Column:
    """array<struct<start, header, id>> of the matches of every marker pattern, by start. Patterns are searched one by one: a match of one may begin within another's.

    ``low`` and ``parts`` are the text ``folded`` and in ``blocks``, if they are there already. An id ends its header.
    """
    if low is None:
        return rx.let(rx.folded(body), lambda x: markers(body, x, parts))
    if parts is None:
        return rx.let(rx.blocks(body), lambda x: markers(body, low, x))

    def of(m: Column, i: Column) -> Column:
        header = rx.cut(parts, m["start"], m["start"] + F.length(m["text"]))
        size = F.length(i)
        return F.struct(m["start"].alias("start"), header.alias("header"), F.substring(header, F.length(m["text"]) - size + 1, size).alias("id"))

    each = []
    for pattern in rules.SECTION_MARKERS:
        full = F.lit(rx.lowered(pattern))
        both = F.zip_with(rx.matches(low, full), F.regexp_extract_all(low, full, F.lit(1)), of)
        each.append(F.when(_marked(low, pattern), both).otherwise(F.array().cast(MARK)))
    return F.array_sort(F.flatten(F.array(*each)))


def locations(body: Column) -> Column:
    """The location of each section of a text that has a marker, in order, without cutting the sections."""
    return F.transform(markers(body), lambda m: F.concat(F.lit("§ "), m["id"]))


def section_count(body: Column) -> Column:
    """Number of sections of a text: that of ``markers``, one at least, without working out where they stand."""
    count = lambda low, p: F.when(_marked(low, p), rx.count(low, rx.lowered(p))).otherwise(0)
    return rx.let(rx.folded(body), lambda low: F.greatest(F.lit(1), sum((count(low, p) for p in rules.SECTION_MARKERS), F.lit(0))))


def _cut(marks: Column, body: Column, parts: Column) -> Column:
    """One struct a section, of a text and its blocks. Text before the first marker goes; a first line of under 200 characters becomes the title."""

    def whole(mark: Column, i: Column) -> Column:
        end = F.coalesce(F.try_element_at(marks, i + 2)["start"], F.length(body))
        return F.struct(mark.alias("mark"), rx.strip(rx.cut(parts, mark["start"], end)).alias("whole"))

    def lined(s: Column) -> Column:
        line = F.instr(s["whole"], "\n")
        return F.struct(s["mark"].alias("mark"), s["whole"].alias("whole"), F.when((line > 0) & (line - 1 < 200), line).alias("line"))

    def one(s: Column) -> Column:
        title = F.when(s["line"].isNotNull(), rx.strip(F.substring(s["whole"], F.lit(1), s["line"] - 1)))
        rest = F.when(s["line"].isNotNull(), rx.strip(F.substring(s["whole"], s["line"] + 1, F.length(s["whole"])))).otherwise(s["whole"])
        return F.struct(s["mark"]["id"].alias("section_id"), title.alias("title"), rest.alias("text"), F.concat(F.lit("§ "), s["mark"]["id"]).alias("location"), s["mark"]["header"].alias("header"))

    alone = F.array(F.struct(F.lit("1").alias("section_id"), F.lit(None).cast("string").alias("title"), rx.strip(body).alias("text"), F.lit("1").alias("location"), F.lit(None).cast("string").alias("header")))
    return F.when(F.size(marks) == 0, alone).otherwise(F.transform(F.transform(F.transform(marks, whole), lined), one))


def _with_marks(base: DataFrame) -> DataFrame:
    """``base`` with the __parts and __marks of its __body."""
    body, low, parts = map(F.col, ("__body", "__low", "__parts"))
    return base.withColumns({"__low": rx.folded(body), "__parts": rx.blocks(body)}).withColumn("__marks", markers(body, low, parts)).drop("__low")


def split_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """One row a section: id, columns ``keep``, sec_pos (from 0), section_id, title, text, location, header.

    A document without a marker is one section "1". A null text is one empty section.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), *keep, body.alias("__body"))
    cut = _with_marks(base).select(id_col, *keep, F.posexplode_outer(_cut(F.col("__marks"), F.col("__body"), F.col("__parts"))).alias("sec_pos", "s"))
    return cut.select(id_col, *keep, "sec_pos", "s.*")


def with_eligibility(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 30, most: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """``split_sections`` with words and eligible: over ``least_words`` words, and among the first ``most`` such sections of the document."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    marked = _with_marks(docs.select(F.col(id_col), *keep, body.alias("__body")))
    cut = marked.select(id_col, *keep, _cut(F.col("__marks"), F.col("__body"), F.col("__parts")).alias("s"))
    sized = cut.withColumn("w", F.transform("s.text", lambda t: text.word_count(t)))
    ranks = rx.running(F.transform("w", lambda w: (w > least_words).cast("long")))  # eligible sections before each
    each = sized.withColumn("r", ranks).select(id_col, *keep, F.posexplode_outer(F.arrays_zip("s", "w", "r")).alias("sec_pos", "z"))
    flat = each.select(id_col, *keep, "sec_pos", "z.s.*", F.col("z.w").alias("words"), F.col("z.r").alias("__rank"))
    return flat.withColumn("eligible", (F.col("words") > least_words) & (F.col("__rank") < most)).drop("__rank")


def cross_references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ref_pos, raw_text, section of every cross-reference of the whole text."""
    full = F.lit(rx.fold(rules.CROSS_REFERENCE))
    zipped = F.zip_with(F.regexp_extract_all(text_col, full, F.lit(0)), F.regexp_extract_all(text_col, full, F.lit(1)), lambda raw, s: F.struct(raw.alias("raw_text"), s.alias("section")))
    return docs.select(F.col(id_col), F.posexplode_outer(zipped).alias("ref_pos", "r")).where(F.col("ref_pos").isNotNull()).select(id_col, "ref_pos", "r.*")


def attached_references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections with the references whose raw text they contain: id, sec_pos, ref_pos, raw_text. A document's references travel with its sections, and only those that a section contains become rows."""
    refs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(rx.fold(rules.CROSS_REFERENCE)), F.lit(0))
    numbered = F.transform(refs, lambda raw, i: F.struct(i.alias("ref_pos"), raw.alias("raw_text")))
    split = split_sections(docs.withColumn("__refs", numbered), id_col, text_col, "__refs")
    own = split.select(id_col, "sec_pos", F.filter("__refs", lambda r: F.contains(F.col("text"), r["raw_text"])).alias("__own"))
    return own.select(id_col, "sec_pos", F.inline_outer("__own")).where(F.col("ref_pos").isNotNull())


def section_complexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sec_pos, section_id, words, sentences, references, complexity."""
    refs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(rx.fold(rules.CROSS_REFERENCE)), F.lit(0))
    split = split_sections(docs.withColumn("__refs", refs), id_col, text_col, "__refs")
    split = split.withColumn("references", F.size(F.filter("__refs", lambda r: F.contains(F.col("text"), r))).cast("long"))
    return split.select(id_col, "sec_pos", "section_id", text.word_count(F.col("text")).alias("words"), text.sentence_count(F.col("text")).alias("sentences"), "references", text.complexity(F.col("text"), F.col("references")).alias("complexity"))


def definitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, term (lower-cased), definition; the last definition of a term counts. Within a row: no shuffle."""
    full = F.lit(rx.fold(rules.DEFINITION))
    group = lambda g: F.regexp_extract_all(text_col, full, F.lit(g))
    pairs = F.zip_with(group(1), group(2), lambda t, d: F.struct(F.lower(t).alias("term"), rx.strip(d).alias("definition")))
    kept = docs.select(F.col(id_col), pairs.alias("p"))
    last = F.filter("p", lambda x, i: ~F.exists(F.slice("p", i + 2, F.size("p")), lambda y: y["term"] == x["term"]))
    return kept.select(id_col, F.inline_outer(last)).where(F.col("term").isNotNull())


def citations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, raw_text, title, section, subsection of citations of federal codes."""
    full = F.lit(rx.cased(rules.CITATION))
    groups = F.arrays_zip(*(F.regexp_extract_all(text_col, full, F.lit(g)).alias(n) for g, n in enumerate(("raw_text", "title", "section", "subsection"))))
    return docs.select(F.col(id_col), F.inline_outer(groups).alias("raw_text", "title", "section", "subsection")).where(F.col("raw_text").isNotNull())


def document_totals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, total_sections, total_words."""
    split = split_sections(docs, id_col, text_col)
    return split.groupBy(id_col).agg(F.count("*").alias("total_sections"), F.sum(text.word_count(F.col("text"))).alias("total_words"))
