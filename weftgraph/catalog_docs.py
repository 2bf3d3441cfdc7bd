"""Named queries over texts, layouts, segments, files, prompts, answers and tools, with SQL.

Documents stand in for sections, lines for layout, and tables for what a model answers;
files are written to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.catalog import _GRAPH, _MENTIONS, _RESOLVED, _ids, _remaps, _rules, query
from weftgraph.functions import registry
from weftgraph.functions import text as txt
from weftgraph.operators import graph, layout, reports, resolve
from weftgraph.plans import answers, prompts, provider, segment
from weftgraph.plans import tools as agent
from weftgraph.session import new_path
from weftgraph.sources import files, tables

# --- texts ---------------------------------------------------------------------------


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "documents")


@query("searchable_text", r"SELECT doc_id, translate(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), '‘’“”–—', '''''""--') AS text FROM documents")
def searchable_text(spark, d):
    return _docs(spark, d).select("doc_id", txt.searchable(F.col("text")).alias("text"))


def _near(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages beside the documents that hold their longest inner word."""
    b = tables.table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    docs = _docs(spark, d).select("doc_id", F.col("text").alias("doc"))
    own = F.split("passage", "[ \\n]")
    inner = F.when(F.size(own) > 2, F.slice(own, F.lit(2), F.size(own) - 2)).otherwise(own)
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("doc", "[ \\n]"))).alias("w"))
    return b.withColumn("w", key).join(words, "w").drop("w").join(docs, "doc_id")


@query(
    "anchor_offsets_normalized",
    r"""SELECT item_id, doc_id, strpos(regexp_replace(d.text, '\s+', ' ', 'g'), regexp_replace(b.text, '\s+', ' ', 'g')) - 1 AS "offset", 'normalized' AS kind
    FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND contains(b.text, ' ')""",
)
def anchor_offsets_normalized(spark, d):
    # every space of a passage is two, so only the second tier finds it
    near = _near(spark, d).withColumn("anchor", F.regexp_replace("passage", " ", "  ")).filter(F.contains("doc", "passage"))
    found = txt.locate(near, "anchor", "doc", fuzzy=False).filter("kind = 'normalized'")
    return found.select("item_id", "doc_id", F.col("offset").cast("long").alias("offset"), "kind")


@query("anchor_offsets_fuzzy")
def anchor_offsets_fuzzy(spark, d):
    # a letter is changed in every word of more than six, so only the third tier finds a passage
    near = _near(spark, d).filter(F.contains("doc", "passage")).withColumn("anchor", F.regexp_replace("passage", "(\\w{6})\\w\\b", "$1#"))
    return txt.locate(near, "anchor", "doc").groupBy("item_id", "kind").agg(F.count("*").alias("n"), F.min("offset").alias("first"))


@query(
    "mojibake_patterns",
    """WITH p AS (SELECT unnest(regexp_extract_all(text, '[à-ï][' || chr(128) || '-¿]{2}|[Â-ß][' || chr(128) || '-¿]')) AS p
      FROM (SELECT replace(text, 'é', 'Ã©') AS text FROM documents)) SELECT p AS pattern, count(*) AS n FROM p GROUP BY p""",
)
def mojibake_patterns(spark, d):
    bad = _docs(spark, d).select(F.replace("text", F.lit("é"), F.lit("Ã©")).alias("text"))
    return txt.mojibake_patterns(bad, "text", 0).select("pattern", "n")


# --- layout --------------------------------------------------------------------------

#: Lines of a page.
_PAGE = 40
#: What a line is made of: its kind follows from its number and its document's, and so does what operators should say of it.
_KINDS = """lines AS (SELECT doc_id::VARCHAR AS doc_id, unnest(range(len(p) + 1)) AS i, unnest(list_append(p, NULL)) AS x, doc_id AS own, len(p) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
  words AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(coalesce(x, repeat('the end ', 60))), '[^a-z]+', ' ', 'g')), ''), 'nothing') || ' and more words of the line' AS t,
    CASE WHEN x IS NULL THEN 'body' WHEN i = 0 THEN 'title' WHEN i % 40 = 39 THEN 'number' ELSE ['leader', 'bullet', 'dash', 'capitals', 'bold', 'clause', 'letter', 'body', 'body', 'term'][(i + own) % 10 + 1] END AS kind FROM lines),
  l AS (SELECT doc_id, i, i // 40 AS page, i % 40 AS line, kind, t, trim(substr(t, 1, 30)) AS short, CASE kind WHEN 'title' THEN 18.0 ELSE 10.0 END AS size,
    kind IN ('title', 'capitals', 'bold', 'clause') AS is_bold, CASE kind WHEN 'letter' THEN 80.0 ELSE 50.0 END AS x,
    CASE kind WHEN 'title' THEN trim(substr(t, 1, 30)) WHEN 'number' THEN (i // 40 + 1)::VARCHAR WHEN 'leader' THEN t || ' ...... ' || (i + 1) WHEN 'bullet' THEN '• ' || t WHEN 'dash' THEN '– ' || t
      WHEN 'capitals' THEN '1.' || upper(trim(substr(t, 1, 30))) WHEN 'bold' THEN trim(substr(t, 1, 30)) WHEN 'clause' THEN '2.' || (i + 1) || ' ' || trim(substr(t, 1, 30)) WHEN 'letter' THEN 'b) ' || t WHEN 'term' THEN 'term: ' || t ELSE t END AS text FROM words)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents, made into every kind that a page has, as spans.

    A bullet's first word is bold and its text goes on in plain spans; a term is bold up to its colon.
    """
    lines = F.split("text", "\n")
    rows = _docs(spark, d).select("doc_id", F.posexplode_outer(F.concat(lines, F.array(F.lit(None).cast("string")))).alias("i", "x"))
    # İ is one letter in SQL, two in Spark
    letters = F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce("x", F.repeat(F.lit("the end "), 60)), "İ", "i")), "[^a-z]+", " "))
    t = F.concat(F.coalesce(F.nullif(letters, F.lit("")), F.lit("nothing")), F.lit(" and more words of the line"))
    names = F.array(*map(F.lit, ("leader", "bullet", "dash", "capitals", "bold", "clause", "letter", "body", "body", "term")))
    kind = F.when(F.col("x").isNull(), "body").when(F.col("i") == 0, "title").when(F.col("i") % _PAGE == _PAGE - 1, "number").otherwise(F.get(names, ((F.col("i") + F.col("doc_id")) % 10).cast("int")))
    rows = rows.select("doc_id", "i", kind.alias("kind"), t.alias("t"))
    short, number = F.trim(F.substring("t", 1, 30)), (F.col("i") + 1).cast("string")
    word = F.substring_index("t", " ", 1)
    rest = F.substring(F.col("t"), F.length(word) + 1, F.length("t"))
    plain, bold = F.lit(False), F.lit(True)

    def made(*parts) -> F.Column:
        """Spans of text, boldness and the gap before them."""
        return F.array(*(F.struct(x.alias("text"), b.alias("is_bold"), F.lit(gap).alias("gap")) for x, b, gap in parts))

    parts = (
        F.when(F.col("kind") == "title", made((short, bold, 0.0)))
        .when(F.col("kind") == "number", made((F.floor(F.col("i") / _PAGE + 1).cast("string"), plain, 0.0)))
        .when(F.col("kind") == "leader", made((F.concat("t", F.lit(" ...... "), number), plain, 0.0)))
        .when(F.col("kind") == "bullet", made((F.lit("• "), plain, 0.0), (word, bold, 0.0), (F.lit(" "), bold, 0.0), (F.ltrim(rest), plain, 0.0)))
        .when(F.col("kind") == "dash", made((F.lit("–"), plain, 0.0), (F.col("t"), plain, 5.0)))
        .when(F.col("kind") == "capitals", made((F.concat(F.lit("1."), F.upper(short)), bold, 0.0)))
        .when(F.col("kind") == "bold", made((short, bold, 0.0)))
        .when(F.col("kind") == "clause", made((F.concat(F.lit("2."), number, F.lit(" "), short), bold, 0.0)))
        .when(F.col("kind") == "letter", made((F.concat(F.lit("b) "), "t"), plain, 0.0)))
        .when(F.col("kind") == "term", made((F.lit("term:"), bold, 0.0), (F.concat(F.lit(" "), "t"), plain, 0.0)))
        .otherwise(made((F.col("t"), plain, 0.0)))
    )
    spans = rows.select("doc_id", "i", "kind", F.posexplode(parts).alias("span", "s"))
    line = F.col("i") % _PAGE
    left = F.when(F.col("kind") == "letter", 80.0).otherwise(50.0) + 20.0 * F.col("span") + F.col("s.gap")
    top = F.when(F.col("kind") == "number", 780.0).otherwise(100.0 + 12 * line)
    return spans.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.floor(F.col("i") / _PAGE).cast("int").alias("page"), line.cast("int").alias("line"), "span", "s.text",
        F.when(F.col("kind") == "title", 18.0).otherwise(10.0).alias("font_size"), "s.is_bold", left.alias("x0"), top.alias("y0"), (left - F.col("s.gap") + 20.0).alias("x1"), (top + 10).alias("y1"),
        F.lit(800.0).alias("page_height"), F.col("i").alias("ord"),
    )


@query("layout_lines", f"WITH {_KINDS} SELECT doc_id, page::INT AS page, line::INT AS line, text, size::DOUBLE AS size, is_bold, kind = 'term' AS definition FROM l")
def layout_lines(spark, d):
    return layout.lines(_spans(spark, d)).select("doc_id", "page", "line", "text", "size", "is_bold", "definition")


# lines that half of three pages or more have alike go; numbers and leaders go as what they are
_KEPT = f"""{_KINDS}, pages AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY doc_id),
  often AS (SELECT l.doc_id, text FROM l JOIN pages USING (doc_id) WHERE length(text) < 120 GROUP BY l.doc_id, text, pages HAVING pages >= 3 AND count(DISTINCT page) >= 0.5 * pages),
  k AS (SELECT * FROM l WHERE kind NOT IN ('leader', 'number') AND (doc_id, text) NOT IN (SELECT doc_id, text FROM often))"""


@query("layout_kept", f"WITH {_KEPT} SELECT doc_id, page::INT AS page, line::INT AS line, text FROM k")
def layout_kept(spark, d):
    return layout.without_noise(layout.lines(_spans(spark, d))).select("doc_id", "page", "line", "text")


#: The documents' own lines, the first one large, so that sizes and margins follow from what the texts hold.
_OWN_LINES = f"""l AS (SELECT doc_id::VARCHAR AS doc_id, i // {_PAGE} AS page, i % {_PAGE} AS line, i, trim(x) AS text, CASE WHEN i = 0 THEN 18.0 ELSE 10.0 END AS size
  FROM (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))"""
_OWN_KEPT = f"""{_OWN_LINES}, pages AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY doc_id),
  often AS (SELECT l.doc_id, text FROM l JOIN pages USING (doc_id) WHERE text <> '' AND length(text) < 120 GROUP BY l.doc_id, text, pages HAVING pages >= 3 AND count(DISTINCT page) >= 0.5 * pages),
  k AS (SELECT * FROM l WHERE text <> '' AND NOT regexp_matches(text, '^.+?\\.{{4,}}\\s*\\d+\\s*$') AND (doc_id, text) NOT IN (SELECT doc_id, text FROM often))"""


def _own_spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as spans: the first word of each stands alone, the first line is large and bold."""
    rows = _docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("i", "t"))
    word = F.substring_index(F.trim("t"), " ", 1)
    rest = F.substring(F.trim("t"), F.length(word) + 1, F.length("t"))
    parts = rows.select("doc_id", "i", F.posexplode(F.array(word, rest)).alias("span", "text"))
    line = F.col("i") % _PAGE
    return parts.select(
        "doc_id", F.floor(F.col("i") / _PAGE).cast("int").alias("page"), line.cast("int").alias("line"), "span", "text",
        F.when(F.col("i") == 0, 18.0).otherwise(10.0).alias("font_size"), (F.col("i") == 0).alias("is_bold"), (50.0 + 20.0 * F.col("span")).alias("x0"),
        (100.0 + 12 * line).alias("y0"), (70.0 + 20.0 * F.col("span")).alias("x1"), (110.0 + 12 * line).alias("y1"), F.lit(800.0).alias("page_height"), F.col("i").alias("ord"),
    )


@query(
    "layout_style",
    f"""WITH {_OWN_KEPT}, s AS (SELECT doc_id, size, sum(length(trim(text)) - (contains(text, ' '))::INT) AS n, min(i) AS first FROM k GROUP BY doc_id, size)
    SELECT doc_id, arg_max(size, struct_pack(a := n, b := -first)) AS body, coalesce((SELECT 51.0 FROM k k2 WHERE k2.doc_id = s.doc_id AND length(text) > 20 LIMIT 1), 50.0) AS margin FROM s GROUP BY doc_id""",
)
def layout_style(spark, d):
    spans = _own_spans(spark, d)
    kept = layout.without_noise(layout.lines(spans))
    return layout.page_style(kept, spans).select("doc_id", F.col("body").cast("decimal(3,1)").alias("body"), F.col("margin").cast("decimal(3,1)").alias("margin"))


@query(
    "layout_roles",
    f"""WITH {_KEPT} SELECT doc_id, page::INT AS page, line::INT AS line, CASE kind WHEN 'title' THEN 'heading' WHEN 'capitals' THEN 'heading' WHEN 'bold' THEN 'subheading' WHEN 'bullet' THEN 'list' WHEN 'dash' THEN 'list'
      WHEN 'letter' THEN 'sublist' WHEN 'term' THEN 'definition' ELSE 'body' END AS role, CASE kind WHEN 'title' THEN 1 WHEN 'capitals' THEN 2 END AS level FROM k""",
)
def layout_roles(spark, d):
    spans = _spans(spark, d)
    kept = layout.without_noise(layout.lines(spans))
    return layout.roles(kept, layout.page_style(kept, spans)).select("doc_id", "page", "line", "role", F.col("level").cast("int").alias("level"))


# a body line goes on with the body line or clause before it; the rest of a list stands line by line
@query(
    "layout_markdown",
    f"""WITH {_KEPT}, b AS (SELECT *, lag(kind) OVER w AS before FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    g AS (SELECT *, sum(CASE WHEN kind = 'body' AND before IN ('body', 'clause') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM b),
    shown AS (SELECT doc_id, part, i, kind, CASE kind WHEN 'title' THEN '# ' || short WHEN 'capitals' THEN '## 1. ' || upper(short) WHEN 'bold' THEN '### ' || short
      WHEN 'bullet' THEN '- **' || string_split(t, ' ')[1] || ' **' || substr(t, length(string_split(t, ' ')[1]) + 2) WHEN 'dash' THEN '- ' || t WHEN 'letter' THEN '  b) ' || t WHEN 'term' THEN '**term:** ' || t ELSE text END AS s FROM g),
    parts AS (SELECT doc_id, part, string_agg(s, ' ' ORDER BY i) || CASE WHEN arg_min(kind, i) IN ('bullet', 'dash', 'letter') THEN chr(10) ELSE chr(10) || chr(10) END AS s FROM shown GROUP BY doc_id, part)
    SELECT doc_id, trim(string_agg(s, '' ORDER BY part), chr(10)) || chr(10) AS markdown FROM parts GROUP BY doc_id""",
)
def layout_markdown(spark, d):
    return layout.markdown(_spans(spark, d)).select("doc_id", "markdown")


@query("font_histogram", f"WITH {_OWN_LINES}, s AS (SELECT doc_id, size, sum(length(text) - (contains(text, ' '))::INT) AS n, min(i) AS first FROM l GROUP BY doc_id, size) SELECT doc_id, arg_max(size, struct_pack(a := n, b := -first)) AS body_size FROM s WHERE n > 0 GROUP BY doc_id")
def font_histogram(spark, d):
    return reports.font_histogram(_own_spans(spark, d)).withColumn("body_size", F.col("body_size").cast("decimal(3,1)"))


@query("layout_stats", f"WITH {_KEPT} SELECT doc_id, count(*) FILTER (kind IN ('capitals', 'bold')) AS headings, count(*) FILTER (kind IN ('bullet', 'dash')) AS items FROM k GROUP BY doc_id")
def layout_stats(spark, d):
    return layout.markdown_stats(layout.markdown(_spans(spark, d))).select("doc_id", F.col("headings").cast("long").alias("headings"), F.col("items").cast("long").alias("items"))


# --- segments ------------------------------------------------------------------------

_PLAIN = "translate(text, '#', '')"


def _mapped(docs: DataFrame, *sections) -> DataFrame:
    fields = ("section_id", "section_name", "section_order", "beginning_text")
    rows = F.array(*(F.struct(*(c.alias(n) for n, c in zip(fields, s, strict=True))) for s in sections))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.filter(rows, lambda s: s["section_id"].isNotNull()).alias("sections"))


@query(
    "segments_by_text",
    f"""WITH x AS (SELECT doc_id, {_PLAIN} AS t, string_split({_PLAIN}, chr(10)) AS p FROM documents), y AS (SELECT doc_id, t, len(p) > 1 AND p[-1] <> '' AS two, CAST(strpos(substr(t, 2), p[-1]) AS INT) AS cut FROM x)
    SELECT doc_id::VARCHAR AS doc_id, 0 AS ord, 'SEC-01' AS section_id, CASE WHEN t = '' THEN NULL ELSE '1' END AS section_number, CASE WHEN t = '' THEN NULL WHEN two THEN substr(t, 1, cut) ELSE t END AS text,
      CASE WHEN t = '' THEN NULL ELSE '0' END AS source_offset, CASE WHEN t = '' THEN 'not found' END AS error FROM y
    UNION ALL SELECT doc_id::VARCHAR, 1, 'SEC-02b', '2.2', substr(t, cut + 1), cut::VARCHAR, NULL FROM y WHERE two""",
)
def segments_by_text(spark, d):
    # the first section starts where the document does, the second at its last line
    docs = _docs(spark, d).select("doc_id", F.translate("text", "#", "").alias("text"))
    lines = F.split("text", "\n")
    last = F.element_at(lines, -1)
    second = F.when((F.size(lines) > 1) & (last != ""), "SEC-02b")
    maps = _mapped(docs, (second, F.lit("b"), F.lit(2), last), (F.lit("SEC-01"), F.lit("a"), F.lit(1), F.substring("text", 1, 40)))
    out = segment.segment_documents(maps)
    return out.select("doc_id", "ord", "section_id", "section_number", "text", F.col("source_offset").cast("string").alias("source_offset"), "error")


@query(
    "segments_by_heading",
    f"""WITH x AS (SELECT doc_id, coalesce(nullif(trim({_PLAIN}, chr(10)), ''), 'x') AS t FROM documents)
    SELECT doc_id::VARCHAR AS doc_id, 0 AS ord, 'a' AS section_id, '## Alpha Part' || chr(10) || chr(10) || t || chr(10) AS text, '0' AS source_offset FROM x
    UNION ALL SELECT doc_id::VARCHAR, 1, 'b', '### Beta / Other' || chr(10) || chr(10) || t, (length(t) + 16)::VARCHAR FROM x""",
)
def segments_by_heading(spark, d):
    t = F.coalesce(F.nullif(F.btrim(F.translate("text", "#", ""), F.lit("\n")), F.lit("")), F.lit("x"))
    docs = _docs(spark, d).select("doc_id", F.concat(F.lit("## Alpha Part\n\n"), t, F.lit("\n### Beta / Other\n\n"), t).alias("text"))
    none = F.lit("words that no document has 0190")
    out = segment.segment_documents(_mapped(docs, (F.lit("a"), F.lit("alpha part one"), F.lit(1), none), (F.lit("b"), F.lit("Beta"), F.lit(2), none)))
    return out.select("doc_id", "ord", "section_id", "text", F.col("source_offset").cast("string").alias("source_offset"))


# a heading above lines that are within reach belongs to the section, one beyond doesn't
@query(
    "heading_zones",
    """WITH x AS (SELECT doc_id, regexp_replace(translate(text, '#', ''), '[ ' || chr(9) || chr(10) || chr(13) || ']+', ' ', 'g') AS t FROM documents), y AS (SELECT doc_id, substr('x' || t, 1, doc_id % 600) AS line FROM x WHERE doc_id % 600 > 0)
    SELECT doc_id::VARCHAR AS doc_id, (CASE WHEN length(line) + 1 < 500 THEN 6 ELSE 6 + 9 + length(line) + 1 END)::VARCHAR AS source_offset FROM y""",
)
def heading_zones(spark, d):
    flat = F.regexp_replace(F.translate("text", "#", ""), "[ \t\n\r]+", " ")
    line = F.substring(F.concat(F.lit("x"), flat), F.lit(1), (F.col("doc_id") % 600).cast("int"))
    docs = _docs(spark, d).filter("doc_id % 600 > 0").select("doc_id", F.concat(F.lit("intro\n## Above\n"), line, F.lit("\nThe body 0190")).alias("text"))
    out = segment.segment_documents(_mapped(docs, (F.lit("a"), F.lit("n"), F.lit(1), F.lit("The body 0190"))))
    return out.filter("section_id = 'a'").select("doc_id", F.col("source_offset").cast("string").alias("source_offset"))


# beginnings as they are, with marks and double spaces, and right in their first words alone
@query(
    "begin_tiers",
    r"""WITH x AS (SELECT doc_id, trim(regexp_replace(translate(text, '#*_‘’“”', ''), '\s+', ' ', 'g')) AS t FROM documents), w AS (SELECT doc_id, t, string_split(t, ' ') AS w FROM x),
    h AS (SELECT doc_id, t, array_to_string(list_slice(w, len(w) // 2, len(w) // 2 + 9), ' ') AS head FROM w WHERE len(w) >= 24), o AS (SELECT doc_id, head, strpos(t, head) - 1 AS pos FROM h)
    SELECT doc_id::VARCHAR AS doc_id, (CASE WHEN doc_id % 3 = 1 OR doc_id % 3 = 2 AND length(head) >= 99 THEN greatest(pos - 1, 0) ELSE pos END)::VARCHAR AS source_offset FROM o""",
)
def begin_tiers(spark, d):
    t = F.btrim(F.regexp_replace(F.translate("text", "#*_‘’“”", ""), "\\s+", " "))
    w = F.split(t, " ")
    head = F.array_join(F.slice(w, F.floor(F.size(w) / 2).cast("int"), F.lit(10)), " ")
    begin = F.when(F.col("doc_id") % 3 == 0, head).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("**"), F.replace(head, F.lit(" "), F.lit("  ")), F.lit("**"))).otherwise(F.concat(head, F.lit(" but then it goes on otherwise 0190")))
    docs = _docs(spark, d).filter(F.size(w) >= 24).select("doc_id", t.alias("text"), begin.alias("begin"))
    fields = F.struct(F.lit("a").alias("section_id"), F.lit("n").alias("section_name"), F.lit(1).alias("section_order"), F.col("begin").alias("beginning_text"))
    out = segment.segment_documents(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.array(fields).alias("sections")))
    return out.filter("section_id = 'a'").select("doc_id", F.col("source_offset").cast("string").alias("source_offset"))


# --- files ---------------------------------------------------------------------------


def _file(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """Rows of one text column as a file of the shared folder."""
    path = f"{new_path(spark, 'files')}/{name}"
    rows.coalesce(1).write.option("lineSep", "\n").text(path)
    return path


def _files(spark: SparkSession, rows: DataFrame) -> str:
    """Rows of ``bucket`` and ``value``, one a bucket, as a file each."""
    path = new_path(spark, "files")
    rows.select("bucket", "value").write.partitionBy("bucket").option("lineSep", "\n").text(path)
    return path


def _as_list(rows: DataFrame, *columns: str):
    return F.to_json(F.array_sort(F.collect_list(F.struct(*columns))))


@query("text_scan", "SELECT count(*) AS files, sum(n)::BIGINT AS chars FROM (SELECT item_id % 16 AS b, sum(length(text) + 1) AS n FROM benchmark GROUP BY b)")
def text_scan(spark, d):
    rows = tables.table(spark, d, "benchmark").groupBy((F.col("item_id") % 16).alias("bucket")).agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("value"))
    return files.texts(spark, _files(spark, rows) + "/*").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))


@query("chunk_reader", "SELECT item_id::VARCHAR AS section_id, '' AS header, text, length(text)::INT AS char_count, -1 AS source_offset FROM benchmark")
def chunk_reader(spark, d):
    b = tables.table(spark, d, "benchmark").select((F.col("item_id") % 16).alias("bucket"), F.col("item_id").cast("string").alias("chunk_id"), "text")
    path = _files(spark, b.groupBy("bucket").agg(_as_list(b, "chunk_id", "text").alias("value")))
    return files.chunks(spark, path).select("section_id", "header", "text", "char_count", "source_offset")


def _graph_file(spark: SparkSession, d: str) -> str:
    """Regions and nations as an ontology file."""
    n = tables.nodes(spark, d).filter(F.col("type").isin("Region", "Nation"))
    e = tables.edges(spark, d).filter("type = 'PART_OF'")
    entities = n.select("ord", F.struct("id", "type", "name", "description", F.col("attrs").alias("attributes")).alias("e")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.to_json("e").alias("j")))), lambda x: x["j"]).alias("es"))
    edges = e.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", "src", "dst", "type", "description"))), lambda x: F.struct(x["src"].alias("source_id"), x["dst"].alias("target_id"), x["type"].alias("type"), x["description"].alias("description")))).alias("rs"))
    rows = entities.join(F.broadcast(edges)).select(F.concat(F.lit('{"ontology": {"graph_title": "Places", "entities": ['), F.array_join("es", ","), F.lit('], "relationships": '), "rs", F.lit("}}")).alias("value"))
    return _file(spark, rows, "places.json")


@query("graph_file_entities", f"{_GRAPH} SELECT (row_number() OVER (ORDER BY ord) - 1)::INT AS ord, id, type, name, CASE WHEN region IS NOT NULL THEN '\"' || region || '\"' END AS region FROM nodes WHERE type IN ('Region', 'Nation')")
def graph_file_entities(spark, d):
    return files.entities(spark, _graph_file(spark, d)).select("ord", "id", "type", "name", F.col("attrs")["region"].alias("region"))


@query("graph_file_edges", f"{_GRAPH} SELECT source_id, target_id, type FROM (SELECT src AS source_id, dst AS target_id, type FROM edges WHERE type = 'PART_OF')")
def graph_file_edges(spark, d):
    return files.relationships(spark, _graph_file(spark, d)).select("source_id", "target_id", "type")


@query("graph_catalog", "SELECT 'Places' AS title, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS entities")
def graph_catalog(spark, d):
    return files.catalog(spark, _graph_file(spark, d)).select("title", F.col("entities").cast("long").alias("entities"))


@query(
    "external_relationships",
    f"""{_GRAPH}, old AS (SELECT src, dst, type FROM edges WHERE type = 'PART_OF'), new AS (SELECT 'N:' || n_nationkey AS src, 'R:' || CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE 9 END AS dst, 'PART_OF' AS type FROM nation)
    SELECT src, dst, type, false AS added FROM old UNION ALL SELECT src, dst, type, true FROM new WHERE (src, dst, type) NOT IN (SELECT src, dst, type FROM old)""",
)
def external_relationships(spark, d):
    n = tables.table(spark, d, "nation")
    dst = F.concat(F.lit("R:"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).otherwise(9).cast("string"))
    rows = n.select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("source_id"), dst.alias("target_id"), F.lit("PART_OF").alias("type"))
    path = _file(spark, rows.agg(F.concat(F.lit('{"relationships": '), _as_list(rows, "source_id", "target_id", "type"), F.lit("}")).alias("value")), "more.json")
    old = tables.edges(spark, d).filter("type = 'PART_OF'")
    return files.merge_relationships(old, spark, path).select("src", "dst", "type", "added")


@query("scenario_reader", "SELECT 's' || conv_id AS scenario, CAST(turn AS INT) AS step, role AS title, text AS description FROM conversations")
def scenario_reader(spark, d):
    t = tables.table(spark, d, "conversations")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("title"), x["text"].alias("description")))
    rows = t.groupBy("conv_id").agg(steps.alias("steps")).select(F.struct(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("id"), F.lit("n").alias("name"), "steps").alias("s"))
    path = _file(spark, rows.select(F.concat(F.lit('{"scenarios": ['), F.to_json("s"), F.lit("]}")).alias("value")), "x.scenarios.json")
    # one scenario for each line, so lines are read as files of their own would be
    lines = spark.read.schema(files.SCENARIOS).json(path)
    s = lines.select(F.explode("scenarios").alias("s")).select(F.col("s.id").alias("scenario"), F.posexplode("s.steps").alias("step", "t"))
    return s.select("scenario", "step", "t.title", "t.description")


@query("run_store", f"{_MENTIONS} SELECT ord, id, type, '2024-01-02T00-00-00_b' AS run_id FROM m")
def run_store(spark, d):
    root = new_path(spark, "runs")
    m = tables.mentions(spark, d).select("ord", "id", "type")
    files.save_run({"entities": m.filter("false")}, root, files.run_id("a", "2024-01-01T00:00:00"))
    files.save_run({"entities": m}, root, files.run_id("b", "2024-01-02T00:00:00"))
    return files.load_run(spark, root, "entities").select("ord", "id", "type", F.col("run_id").cast("string").alias("run_id"))


@query("run_list", "SELECT unnest(['2024-01-02T00-00-00_b_c', '2024-01-01T00-00-00_a']) AS run_id")
def run_list(spark, d):
    root = new_path(spark, "runs")
    r = tables.table(spark, d, "region")
    for name, at in (("a", "2024-01-01T00:00:00"), ("b c", "2024-01-02T00:00:00")):
        files.save_run({"run_meta": r}, root, files.run_id(name, at))
    return files.list_runs(spark, root)


@query("graph_versions", "SELECT 'graph-v1-2' AS name, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS nodes, (SELECT count(*) FROM nation) AS edges")
def graph_versions(spark, d):
    root = new_path(spark, "versions")
    n, e = tables.nodes(spark, d).filter(F.col("type").isin("Region", "Nation")), tables.edges(spark, d).filter("type = 'PART_OF'")
    files.save_graph(n.limit(1), e.limit(1), root, "v1")
    name = files.save_graph(n, e, root, "v1")
    nodes, edges = files.load_graph(spark, root, name.removeprefix("graph-"))
    return nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(edges.agg(F.count("*").alias("edges")))).select(F.lit(name).alias("name"), "nodes", "edges")


@query(
    "scripted_steps",
    f"""{_GRAPH}, e AS (SELECT 'r' || (row_number() OVER (ORDER BY ord, src, dst, type, description) - 1) AS edge_id, src || '->' || dst AS key FROM edges)
    SELECT 's' AS scenario, n_regionkey AS step, edge_id, key FROM nation JOIN e ON edge_id = 'r' || n_nationkey""",
)
def scripted_steps(spark, d):
    steps = tables.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("step")).agg(F.collect_list(F.concat(F.lit("r"), F.col("n_nationkey").cast("string"))).alias("edge_ids"))
    return files.scripted(steps.withColumn("scenario", F.lit("s")), graph.numbered(tables.edges(spark, d)))


@query("json_writer", "SELECT doc_id, text, NULL::VARCHAR AS nothing FROM documents")
def json_writer(spark, d):
    path = new_path(spark, "json")
    files.write_json(_docs(spark, d).select("doc_id", "text", F.lit(None).cast("string").alias("nothing")), path)
    return spark.read.schema("doc_id long, text string, nothing string").json(path)


# --- the registry in prompts ----------------------------------------------------------

_ATTRIBUTES = "reg(type, attr, kind) AS (VALUES " + ", ".join(
    f"('{t}', {a and repr(a) or 'NULL'}, {k and repr(k) or 'NULL'})" for t, own in sorted(registry.ENTITY_TYPES.items()) for a, k in (own.items() or [(None, None)])
) + ")"
_JSON_KIND = """CASE kind WHEN 'int' THEN 'integer (optional)' WHEN 'boolean' THEN 'boolean (optional)' WHEN 'array<int>' THEN 'array of integer' WHEN 'array<string>' THEN 'array of string' ELSE kind END"""


@query("registry_types", f"WITH {_ATTRIBUTES} SELECT type, type || coalesce(' {{' || string_agg(attr || ': ' || {_JSON_KIND}, '; ' ORDER BY attr) || '}}', '') AS line FROM reg GROUP BY type".replace("{{", "{").replace("}}", "}"))
def registry_types(spark, d):
    return registry.type_prompt(registry.attribute_table(spark))


@query("registry_names", f"WITH {_ATTRIBUTES} SELECT string_agg(DISTINCT type, ', ' ORDER BY type) AS types FROM reg")
def registry_names(spark, d):
    return registry.type_names(registry.attribute_table(spark))


@query("registry_structure", f"WITH {_ATTRIBUTES} SELECT type, 'id: string, type: string, name: string, description: string, source_text: string' || coalesce(', ' || string_agg(attr || ': ' || {_JSON_KIND}, ', ' ORDER BY attr), '') AS fields FROM reg GROUP BY type")
def registry_structure(spark, d):
    return registry.type_structure(registry.attribute_table(spark))


_EXAMPLE = """CASE kind WHEN 'int' THEN '1' WHEN 'boolean' THEN 'true' WHEN 'array<int>' THEN '[1]' WHEN 'array<string>' THEN '["text"]' ELSE '"text"' END"""


@query(
    "registry_examples",
    f"""WITH {_ATTRIBUTES} SELECT type, '{{"id": "' || lower(type) || '_1", "type": "' || type || '", "name": "' || type || ' 1", "description": "what it is", "source_text": "words of the text"'
      || coalesce(', ' || string_agg('"' || attr || '": ' || {_EXAMPLE}, ', ' ORDER BY attr), '') || '}}' AS example FROM reg GROUP BY type""",
)
def registry_examples(spark, d):
    return registry.example_entities(registry.attribute_table(spark))


@query(
    "relation_examples",
    """SELECT type, '{"source_id": "' || s || '_1", "target_id": "' || d || '_1", "type": "' || type || '", "description": "how they relate"}' AS example
    FROM (VALUES ('PART_OF', 'nation', 'region'), ('LOCATED_IN', 'customer', 'nation'), ('PLACED_BY', 'order', 'customer'), ('CONTAINS', 'order', 'part'), ('FULFILLED_BY', 'order', 'any')) AS t(type, s, d)""",
)
def relation_examples(spark, d):
    return registry.example_relationships(_rules(spark))


# --- prompts and answers ---------------------------------------------------------------

_NL = "chr(10) || chr(10)"
_CONV = "c AS (SELECT 'c' || conv_id || '/' || turn AS section_id, role AS header, text FROM conversations)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return tables.table(spark, d, "conversations").select(key.alias("section_id"), F.col("role").alias("header"), "text")


@query(
    "entity_prompts",
    f"""WITH {_CONV}, known AS (SELECT 'c' || conv_id || '/0' AS section_id, string_agg(role || ': ' || turn, chr(10) ORDER BY role || ': ' || turn) AS known FROM conversations GROUP BY conv_id)
    SELECT section_id AS key, concat_ws({_NL}, 'List the entities of this section as JSON.', 'Types:' || chr(10) || 'A' || chr(10) || 'B', 'Known so far:' || chr(10) || known, 'Section ' || header || ':' || chr(10) || text) AS prompt
    FROM c LEFT JOIN known USING (section_id)""",
)
def entity_prompts(spark, d):
    t = tables.table(spark, d, "conversations")
    registered = t.select(F.col("role").alias("entity_name"), F.col("turn").cast("string").alias("brief_description"), F.array(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/0"))).alias("mentioned_in_sections"))
    return prompts.entity_prompts(_turns(spark, d), registered, spark.createDataFrame([("A",), ("B",)], "line string"))


@query("question_prompts", f"WITH {_CONV} SELECT section_id AS key, 'Write 3 questions that this section answers, with answers and a difficulty of easy, medium or hard, as JSON.' || {_NL} || header || chr(10) || text AS prompt FROM c")
def question_prompts(spark, d):
    return prompts.question_prompts(_turns(spark, d))


@query(
    "coverage_prompts",
    f"""WITH e AS (SELECT doc_id, string_agg('{{"id":"' || doc_id || '","type":"L","name":"' || quality || '","description":""}}', chr(10)) AS known FROM labels GROUP BY doc_id)
    SELECT d.doc_id::VARCHAR AS key, 'Compare these entities with the document. List as JSON what is missing, what the document doesn''t say, and what is incomplete.' || {_NL} || 'Entities:' || chr(10) || coalesce(known, 'none') || {_NL} || 'Document:' || chr(10) || text AS prompt
    FROM documents d LEFT JOIN e USING (doc_id)""",
)
def coverage_prompts(spark, d):
    e = tables.table(spark, d, "labels").select("doc_id", F.lit(0).alias("ord"), F.col("doc_id").cast("string").alias("id"), F.lit("L").alias("type"), F.col("quality").cast("string").alias("name"), F.lit("").alias("description"))
    return prompts.coverage_prompts(_docs(spark, d).select("doc_id", "text"), e)


@query("analysis_prompts", f"SELECT doc_id::VARCHAR AS key, 'Map this document as JSON: its title, its sections in order with their first words, names that recur, and which sections depend on others.' || {_NL} || 'Types:' || chr(10) || 'A, B' || {_NL} || 'Document:' || chr(10) || text AS prompt FROM documents")
def analysis_prompts(spark, d):
    return prompts.analysis_prompts(_docs(spark, d).select("doc_id", "text"), spark.createDataFrame([("A, B",)], "types string"))


@query("semantic_remaps", f"{_MENTIONS}, {_RESOLVED} SELECT old_id, new_id FROM resolved")
def semantic_remaps(spark, d):
    # answers of a model that name the remaps of a range of users each, in a fence, beside one that is no JSON
    r = _remaps(spark, d)
    said = r.groupBy(F.floor(F.col("ord") / 100).cast("string").alias("key")).agg(F.concat(F.lit('```json\n{"remappings": '), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", "old_id", "new_id"))), lambda x: F.struct(x["old_id"].alias("old_id"), x["new_id"].alias("new_id")))), F.lit("}\n```")).alias("response"))
    both = said.unionByName(spark.createDataFrame([("b", "sorry")], "key string, response string"))
    return resolve.resolved_remaps(tables.mentions(spark, d), answers.remaps(both).select((F.col("key").cast("long") * 1000 + F.col("ord")).alias("ord"), "old_id", "new_id"))


@query(
    "judged_answers",
    """WITH j AS (SELECT doc_id, 3 * quality + doc_id % 2 AS a, doc_id % 4 - 1 AS c, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE toxic END AS h FROM labels),
    s AS (SELECT doc_id::VARCHAR AS key, least(greatest(a, 0), 3)::INT AS accuracy, least(greatest(c, 0), 2)::INT AS completeness, least(greatest(coalesce(h, 0), 0), 1)::INT AS no_hallucination FROM j)
    SELECT *, accuracy + completeness + no_hallucination AS total, accuracy + completeness + no_hallucination >= 4 AS passed FROM s""",
)
def judged_answers(spark, d):
    c = F.col("doc_id")
    fields = F.struct((3 * F.col("quality") + c % 2).alias("accuracy"), (c % 4 - 1).alias("completeness"), F.when(c % 3 != 0, F.col("toxic")).alias("no_hallucination"))
    said = tables.table(spark, d, "labels").select(c.cast("string").alias("key"), F.to_json(fields).alias("response"))
    return answers.scores(said).drop("explanation")


@query(
    "coverage_findings",
    """SELECT doc_id::VARCHAR AS key, 'missing' AS kind, 0 AS ord, 'q' || quality AS what FROM labels WHERE doc_id % 5 > 0
    UNION ALL SELECT doc_id::VARCHAR, 'incomplete', unnest([0, 1]), unnest(['x', 'y']) FROM labels WHERE doc_id % 5 > 0""",
)
def coverage_findings(spark, d):
    fields = F.struct(F.array(F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("missing"), F.array(F.lit("x"), F.lit("y")).alias("incomplete"))
    said = tables.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("key"), F.when(F.col("doc_id") % 5 > 0, F.to_json(fields)).otherwise("none").alias("response"))
    return answers.coverage(said)


@query("question_rows", "SELECT conv_id || '/' || turn AS key, 0 AS ord, text AS question, role AS answer, CASE WHEN turn % 2 = 0 THEN 'easy' ELSE 'medium' END AS difficulty FROM conversations WHERE text <> ''")
def question_rows(spark, d):
    level = F.when(F.col("turn") % 2 == 0, "EASY").otherwise("??")
    fields = F.struct(F.array(F.struct(F.col("text").alias("question"), F.col("role").alias("answer"), level.alias("difficulty"))).alias("questions"))
    said = tables.table(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.to_json(fields).alias("response"))
    return answers.questions(said)


@query(
    "cross_section_outcomes",
    f"""{_GRAPH}, home AS (SELECT id, type, type AS home FROM nodes WHERE type <> 'Customer'), c AS (SELECT src, dst, CASE WHEN src LIKE 'N:%7' THEN 'ODD' ELSE type END AS type FROM edges
      UNION ALL SELECT 'N:1', 'N:2', 'PART_OF'),
    o AS (SELECT c.*, CASE WHEN a.id IS NULL THEN 'missing source' WHEN b.id IS NULL THEN 'missing target' WHEN a.home = b.home THEN 'same section' WHEN c.type = 'ODD' THEN 'invalid' ELSE 'kept' END AS outcome
      FROM c LEFT JOIN home a ON a.id = src LEFT JOIN home b ON b.id = dst) SELECT outcome, count(*) AS n FROM o GROUP BY outcome""",
)
def cross_section_outcomes(spark, d):
    e = tables.edges(spark, d).select("src", "dst", F.when(F.col("src").like("N:%7"), "ODD").otherwise(F.col("type")).alias("type"))
    e = e.union(spark.createDataFrame([("N:1", "N:2", "PART_OF")], "src string, dst string, type string"))
    items = F.collect_list(F.struct(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "type"))
    said = e.groupBy(F.col("src").alias("key")).agg(F.to_json(F.struct(items.alias("relationships"))).alias("response"))
    known = tables.nodes(spark, d).filter("type != 'Customer'").select("ord", "id", "type", F.col("type").alias("section"))
    return answers.cross_section(said, known, _rules(spark)).groupBy("outcome").agg(F.count("*").alias("n"))


@query("thinking_budgets", "SELECT doc_id, least(greatest(n_chars * 100, 1024), 16000) AS budget FROM documents")
def thinking_budgets(spark, d):
    return _docs(spark, d).select("doc_id", provider.thinking_budget(F.col("n_chars")).alias("budget"))


@query(
    "replayed_answers",
    """SELECT 'c' || conv_id || '/' || turn AS key, CASE WHEN turn % 2 = 0 THEN text END AS response, (length(text) // 4)::BIGINT AS input_tokens,
    CASE WHEN turn % 2 = 0 THEN length(text) // 4 ELSE 0 END::BIGINT AS output_tokens, CASE WHEN turn % 2 > 0 THEN 'no recording' END AS error FROM conversations""",
)
def replayed_answers(spark, d):
    t = _turns(spark, d).select(F.col("section_id").alias("key"), F.col("text").alias("prompt"))
    recorded = t.filter((F.regexp_extract("key", "/(\\d+)$", 1).cast("int") % 2) == 0).select("key", F.col("prompt").alias("response"))
    return provider.replay(t, recorded)


class _Counting:
    """Answers every prompt with its length, but for those of a multiple of seven."""

    def answer(self, key: str, prompt: str) -> tuple[str, int, int]:
        if len(prompt) % 7 == 0:
            raise ValueError("seven")
        return f"asked {len(prompt)}", len(prompt), 1


# an earlier run answered even turns and failed at others; this one asks what is missing, and fails at some again
@query(
    "resumed_answers",
    """SELECT 'c' || conv_id || '/' || turn AS key, CASE WHEN turn % 2 = 0 THEN 'before' WHEN length(text) % 7 > 0 THEN 'asked ' || length(text) END AS response,
    CASE WHEN turn % 2 > 0 AND length(text) % 7 = 0 THEN 'ValueError: seven' END AS error FROM conversations""",
)
def resumed_answers(spark, d):
    t = _turns(spark, d).select(F.col("section_id").alias("key"), F.col("text").alias("prompt"))
    even = F.regexp_extract("key", "/(\\d+)$", 1).cast("int") % 2 == 0
    store = provider.AnswerStore(spark, new_path(spark, "answers"))
    zero = F.lit(0).cast("long")
    store.add(t.select("key", "prompt", F.when(even, "before").alias("response"), zero.alias("input_tokens"), zero.alias("output_tokens"), F.when(~even, "broke off").alias("error")))
    return store.ask(t, _Counting(), concurrency=4, wave=2000).select("key", "response", "error")


# --- tools ---------------------------------------------------------------------------


@query(
    "tool_neighbors",
    f"""{_GRAPH}, b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), w AS (SELECT 'R:0' AS id, 0 AS hops UNION SELECT b, hops + 1 FROM w JOIN b ON a = id WHERE hops < 2)
    SELECT 'R:0' AS start, id, min(hops) AS hops, n.type, n.name FROM w JOIN nodes n USING (id) GROUP BY id, n.type, n.name""",
)
def tool_neighbors(spark, d):
    return agent.GraphTools(tables.nodes(spark, d), tables.edges(spark, d)).get_neighbors("R:0", 2)


@query(
    "tool_highlights",
    f"""{_GRAPH}, c AS (SELECT 0 AS step, 'N:3' AS id, true AS near UNION ALL SELECT 1, 'S:5', false) SELECT step, 'node' AS kind, id AS key FROM c
    UNION SELECT step, 'edge', src || '->' || dst FROM c JOIN edges ON (src = id OR dst = id) WHERE near""",
)
def tool_highlights(spark, d):
    calls = spark.createDataFrame([(0, "get_entity", ["N:3"]), (1, "search_entities", ["S:5"])], "step int, tool string, ids array<string>")
    return agent.highlights(calls, tables.edges(spark, d))


@query(
    "source_texts",
    """WITH asked AS (SELECT doc_id::VARCHAR AS id FROM labels UNION SELECT 'gone')
    SELECT id, CASE WHEN d.doc_id IS NULL THEN 'Entity not found' WHEN text = '' THEN 'No source text' ELSE text END AS source_text FROM asked LEFT JOIN documents d ON d.doc_id::VARCHAR = id""",
)
def source_texts(spark, d):
    nodes = _docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.create_map(F.lit("source_text"), "text").alias("attrs"))
    asked = tables.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id")).distinct().union(_ids(spark, "gone"))
    return graph.source_text(nodes, asked)


@query("find_by_whole_number", f"{_GRAPH} SELECT id, size AS value FROM nodes WHERE size = '1'")
def find_by_whole_number(spark, d):
    return graph.find_by_attribute(tables.nodes(spark, d), "size", "1", whole=("size",)).select("id", "value")


@query(
    "focus_by_edge_id",
    f"""{_GRAPH}, e AS (SELECT 'r' || (row_number() OVER (ORDER BY ord, src, dst, type, description) - 1) AS edge_id, * FROM edges)
    SELECT edge_id, CASE WHEN src = 'N:3' THEN dst ELSE src END AS neighbour FROM e WHERE src = 'N:3' OR dst = 'N:3'""",
)
def focus_by_edge_id(spark, d):
    e = graph.numbered(tables.edges(spark, d))
    near = e.filter("src = 'N:3' or dst = 'N:3'")
    return near.select("edge_id", F.when(F.col("src") == "N:3", F.col("dst")).otherwise(F.col("src")).alias("neighbour"))
