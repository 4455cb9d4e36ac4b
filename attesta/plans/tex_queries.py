"""LaTeX and metadata forensics and venue rules over parts, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import tex
from attesta.plans.registry import query
from attesta.store import table

#: Page limits and required sections of made-up venues; a table of rules that lint joins to.
VENUES = [("alpha", 9, "Limitations"), ("beta", 8, None), ("gamma", 12, "Broader Impact")]


def _part(spark, d, text):
    return table(spark, d, "part").select("p_partkey", text.alias("t"))


@query("tex_masking", "select p_partkey, 'a 5\\% b ' || chr(10) || '\\begin{verbatim}' || chr(10) || chr(10) || '\\end{verbatim} c' || p_partkey masked from part")
def tex_masking(spark, d):
    text = F.concat(F.lit("a 5\\% b % gone\n\\begin{verbatim}\n% TODO inside\n\\end{verbatim} c"), F.col("p_partkey").cast("string"))
    return _part(spark, d, text).select("p_partkey", tex.mask_tex("t").alias("masked"))


@query("footnote_pairs", "select p_partkey, 'n' || p_size note, case p_partkey % 3 when 0 then 'Mark ' || p_partkey || ' here.' when 1 then 'Other place.' end \"sentence\" from part")
def footnote_pairs(spark, d):
    """One note, numbered, unnumbered, or without any mark."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    marks = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Mark "), k, F.lit(" here\\footnotemark["), n, F.lit("]. Other place\\footnotemark.\n"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Mark "), k, F.lit(" here. Other place\\footnotemark.\n"))).otherwise("% \\footnotemark\n")
    text = F.concat(marks, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("\\footnotetext["), n, F.lit("]{n"))).otherwise("\\footnotetext{n"), n, F.lit("}"))
    return table(spark, d, "part").select("p_partkey", F.explode(tex.footnotes(text)).alias("x")).select("p_partkey", "x.*")


@query("statement_divergence", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag = 'R' or (l_returnflag = 'A' and l_suppkey % 10 <> l_partkey % 10) differs from lineitem")
def statement_divergence(spark, d):
    """A claim of a gain against lines that state it in other dress, of another size, or turned round."""
    n = lambda c: (F.col(c) % 10).cast("string")
    claim = F.concat(F.lit("The model improves accuracy by "), n("l_partkey"), F.lit("%"))
    said = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("The model reduces accuracy by "), n("l_partkey"), F.lit("\\%"))).when(F.col("l_returnflag") == "A", F.concat(F.lit("Model improves accuracy by "), n("l_suppkey"), F.lit(" percent"))).otherwise(F.concat(F.lit("The model \\emph{improves} accuracy by~$"), n("l_partkey"), F.lit("\\%$ \\cite{a}")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", tex.diverges(claim, said).alias("differs"))


@query("tex_author_leaks", "select p_partkey, 'Ann ' || p_partkey || ' Doe' leak from part where p_partkey % 3 = 0")
def tex_author_leaks(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("\\author[x]{\\textbf{Ann {"), k.cast("string"), F.lit("}} Doe}"))).when(k % 3 == 1, "\\author{Anonymous Authors}").otherwise("% \\author{Ann Doe}")
    return _part(spark, d, text).select("p_partkey", F.explode(tex.tex_authors("t")).alias("leak"))


@query("metadata_leaks", "select p_partkey, '/xmpmeta/RDF/creator' \"path\", 'Ann ' || p_partkey \"value\" from part where p_partkey % 2 = 0")
def metadata_leaks(spark, d):
    k = F.col("p_partkey")
    xml = F.concat(F.lit('<?xpacket begin="x"?><x:xmpmeta xmlns:x="u"><RDF tool="t"><creator>'), F.when(k % 2 == 0, F.concat(F.lit("Ann "), k.cast("string"))).otherwise(""), F.lit("</creator></RDF></x:xmpmeta>"))
    pairs = _part(spark, d, xml).select("p_partkey", F.explode(tex.xmp_pairs("t")).alias("p")).select("p_partkey", "p.*")
    return pairs.where(F.lower("path").rlike("creator|author|lastmodifiedby"))


@query("enclosing_sentences", "select p_partkey, 'We gain 3.5 points, e.g. on ' || p_partkey || '.' \"sentence\" from part")
def enclosing_sentences(spark, d):
    text = F.concat(F.lit("First one. We gain 3.5 points, e.g. on "), F.col("p_partkey").cast("string"), F.lit(". Last!"))
    return _part(spark, d, text).select("p_partkey", tex.sentence_around("t", F.lit(20)).alias("sentence"))


@query("venue_rules", "with v(venue, most, section) as (values ('alpha', 9, 'Limitations'), ('beta', 8, null), ('gamma', 12, 'Broader Impact')), p as (select p_partkey, ['alpha', 'beta', 'gamma'][(p_partkey % 3 + 1)::int] venue, p_size % 14 pages, p_partkey % 2 = 0 has from part) select p_partkey, venue, pages > most too_long, section is not null and not has lacks_section from p join v using (venue)")
def venue_rules(spark, d):
    v = spark.createDataFrame(VENUES, "venue string, most int, section string")
    p = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x[0]) for x in VENUES]), (F.col("p_partkey") % 3 + 1).cast("int")).alias("venue"), (F.col("p_size") % 14).alias("pages"), (F.col("p_partkey") % 2 == 0).alias("has"))
    return p.join(v, "venue").select("p_partkey", "venue", (F.col("pages") > F.col("most")).alias("too_long"), (F.col("section").isNotNull() & ~F.col("has")).alias("lacks_section"))
