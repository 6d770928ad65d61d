"""Lyric tables of whole pages: which of several tables is meant, and rows of tables with a header.

All are expressions over one page.  A null page or one without a table gives null; of equal headings the
first wins; letters are compared in lower case without what isn't a letter or digit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineweave.functions.text import cell_text
from lineweave.sources.tables import table

# Names of versions that say the same in several languages, without blanks.
VERSIONS = (
    ("longver", "긴버전", "롱버전"),
    ("shortver", "짧은버전", "숏버전", "쇼트버전"),
    ("fullver", "풀버전"),
    ("tvsize", "tvver", "tv사이즈", "tv버전", "티비사이즈", "티비버전"),
    ("inst", "instrumental", "인스트", "반주"),
    ("originalver", "오리지널", "원곡", "본편"),
)


def bare(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def hint_words(hint: Column) -> Column:
    """The hint's words, and each two that stand together as one."""
    words = F.transform(F.regexp_extract_all(hint, F.lit(r"[\p{L}\p{N}_]+"), 0), bare)
    return F.get(F.transform(F.array(words), lambda w: F.filter(F.array_distinct(F.concat(w, F.transform(w, lambda x, i: F.concat(x, F.coalesce(F.get(w, i + 1), F.lit("")))))), lambda x: x != "")), 0)


def same_version(label: Column, words: Column) -> Column:
    """Whether one of the words is another name of the version that the label names."""
    group = F.filter(F.array(*[F.array(*map(F.lit, g)) for g in VERSIONS]), lambda g: F.array_contains(g, label))
    return F.exists(F.flatten(group), lambda x: (x != label) & F.array_contains(words, x))


def hinted_table(page: Column, hint: Column) -> Column:
    """Inside of the table whose own heading is in the hint or names the same version, of several that
    with the longest heading; else of the first table.  A heading is the last one since the table before;
    one of a single letter counts for nothing."""
    pattern = F.lit(r"(?is)(.*?)<table\b[^>]*>(.*?)</table>")
    before, body = F.regexp_extract_all(page, pattern, 1), F.regexp_extract_all(page, pattern, 2)
    key, words = bare(hint), hint_words(hint)

    def label(text: Column) -> Column:
        headings = F.regexp_extract_all(text, F.lit(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>"), 1)
        return bare(F.regexp_replace(F.coalesce(F.get(headings, F.size(headings) - 1), F.lit("")), "<[^>]+>", ""))

    labels = F.transform(before, label)
    fit = F.transform(labels, lambda x, i: F.struct(F.when((F.length(x) >= 2) & (F.contains(key, x) | same_version(x, words)), F.length(x)).otherwise(0).alias("n"), (-i).alias("i")))
    best = F.array_max(fit)
    return F.get(body, F.when(best.n > 0, -best.i).otherwise(0))


ROW = "struct<text:string,pronunciation:string,translation:string>"


def headed_lines(page: Column) -> Column:
    """Struct of lines and whether they have translations, of the first table of class lyrics-table that
    holds the class lyrics-jp and two header cells at least.  A row of one cell is a text, one without a
    text is none.  Null where there is no such table."""
    found = F.get(F.filter(F.regexp_extract_all(page, F.lit(r'(?s)<table class="lyrics-table"[^>]*>(.*?)</table>'), 1), lambda t: F.contains(t, F.lit('class="lyrics-jp"'))), 0)
    head = F.regexp_extract(found, r'(?s)<tr class="lyrics-table-header">(.*?)</tr>', 1)
    columns = F.size(F.regexp_extract_all(head, F.lit("(<th)"), 1))
    rows = F.regexp_extract_all(F.regexp_replace(found, r'(?s)^.*?<tr class="lyrics-table-header">.*?</tr>', ""), F.lit(r"(?s)<tr(?:\s[^>]*)?>(.*?)</tr>"), 1)

    def line(row: Column) -> Column:
        cells = F.transform(F.regexp_extract_all(row, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1), cell_text)
        cell = lambda i: F.nullif(F.get(cells, F.lit(i)), F.lit(""))
        return F.struct(cell(0).alias("text"), cell(1).alias("pronunciation"), cell(2).alias("translation"))

    lines = F.filter(F.transform(rows, line), lambda x: x.text.isNotNull())
    return F.when(columns >= 2, F.struct(lines.alias("lines"), (columns >= 3).alias("translated")))


def q_hinted_table(spark, d):
    """Pages with a table for each of three names of a part; hints name a brand, a version or nothing."""
    one = lambda h, x: F.concat(F.lit("<h2>"), h, F.lit("</h2>\n<table border=1><tr><td>"), x, F.lit("</td></tr></table>"))
    page = F.concat(F.lit("<p>"), one(F.lit("원곡"), F.col("p_name")), one(F.col("p_brand"), F.col("p_type")), one(F.lit("긴 버전"), F.lit("long")))
    k = F.col("p_size") % 4
    hint = F.when(k == 0, F.concat("p_name", F.lit(" ["), "p_brand", F.lit("]"))).when(k == 1, "Song (Long ver)").when(k == 2, "Long Verse")
    return table(spark, d, "part").select("p_partkey", hinted_table(page, hint).alias("inside"))


def q_headed_lines(spark, d):
    """Pages with a table of two rows for each part, with a third column where it is large."""
    large = F.col("p_size") > 25
    th = F.when(large, '<th class="lyrics-jp">a</th><th>b</th><th>c</th>').otherwise('<th class="lyrics-jp">a</th><th>b</th>')
    td = lambda *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    third = F.when(large, F.concat(F.lit("<td>"), F.col("p_type"), F.lit("</td>"))).otherwise("")
    row = F.concat(F.lit('<tr class="x"><td>'), "p_name", F.lit("</td><td>"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""), F.lit("</td>"), third, F.lit("</tr>"))
    page = F.concat(F.lit('<table class="lyrics-table"><tr><td>no</td></tr></table><table class="lyrics-table" x><tr class="lyrics-table-header">'), th, F.lit("</tr>"), row, td(F.lit("<br />")), td(F.col("p_brand")), F.lit("</table>"))
    x = table(spark, d, "part").select("p_partkey", headed_lines(page).alias("x")).select("p_partkey", "x.translated", F.posexplode("x.lines").alias("k", "l"))
    return x.select("p_partkey", "translated", "k", "l.text", "l.pronunciation", "l.translation")


BARE = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
QUERIES = {
    "hinted_table": (
        q_hinted_table,
        f"SELECT p_partkey, '<tr><td>' || CASE WHEN p_size % 4 = 0 AND contains({BARE.format('p_name || p_brand')}, {BARE.format('p_brand')}) THEN p_type WHEN p_size % 4 = 1 THEN 'long' ELSE p_name END || '</td></tr>' AS inside FROM part",
    ),
    "headed_lines": (
        q_headed_lines,
        "SELECT p_partkey, p_size > 25 AS translated, 0 AS k, p_name AS text, CASE WHEN p_size % 2 = 0 THEN p_brand END AS pronunciation, CASE WHEN p_size > 25 THEN p_type END AS translation FROM part UNION ALL SELECT p_partkey, p_size > 25, 1, p_brand, NULL, NULL FROM part",
    ),
}
