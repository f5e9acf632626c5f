"""Reports of a rolled-up tree: CSV lines, indented text, JSON nodes and an HTML page.

Lines are made by Spark in tree order. They are text for people; a caller writes
them out with ``write_lines`` or shows a few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costgrain.functions.money import dollars
from costgrain.functions.text import csv_escape, html_escape
from costgrain.functions.vocabulary import TOKENS

# The names of the columns of the CSV report.
HEADER = (
    "project_id,project_key,project_title,work_item_id,work_item_title,parent_id,input_tokens,cache_read_tokens,cache_write_tokens,output_tokens,reasoning_tokens,"
    "total_tokens,requests,measured_requests,unavailable_requests,estimated_cost_dollars,completeness_pct"
)


def in_tree_order(nodes: DataFrame) -> DataFrame:
    """Nodes (id, path, created_at, title, maybe more) with ``place``, which sorts
    parents before children and siblings by creation, title and id."""
    own = nodes.select(F.col("id").alias("_at"), F.struct(F.coalesce("created_at", F.lit("")).alias("c"), "title", F.col("id").alias("i")).alias("_key"))
    steps = nodes.select("id", F.posexplode("path").alias("_n", "_at")).join(own, "_at")
    places = steps.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_key"))), lambda x: x["_key"]).alias("place"))  # as long as the tree is deep
    return nodes.join(places, "id")


def priced(nodes: DataFrame) -> Column:
    """A cost is told only where every request has one."""
    return (F.col("requests") > 0) & (F.col("priced") == F.col("requests"))


def csv_lines(nodes: DataFrame, project: dict[str, str]) -> DataFrame:
    """(place, line) of inclusive totals, 17 fields; strings are quoted, formulas made harmless."""
    q = lambda c: F.concat(F.lit('"'), csv_escape(F.coalesce(c, F.lit(""))), F.lit('"'))
    total = sum((F.col(t) for t in TOKENS), F.lit(0))
    whole = F.col("measured") + F.col("unavailable") + F.col("anomalous")
    percent = F.when(whole > 0, F.format_string("%.1f", F.bround(100.0 * F.col("measured") / whole, 1))).otherwise("unavailable")
    cost = F.when(priced(nodes), dollars(F.col("amount_micros"), 4)).otherwise("unavailable")
    strings = [q(F.lit(project[k])) for k in ("id", "key", "title")] + [q(F.col("id")), q(F.col("title")), q(F.col("parent_id"))]
    numbers = [F.col(c).cast("string") for c in TOKENS] + [total.cast("string")] + [F.col(c).cast("string") for c in ("requests", "measured", "unavailable")]
    return in_tree_order(nodes).select("place", F.concat_ws(",", *strings, *numbers, cost, percent).alias("line"))


def totals_text() -> Column:
    """Cost, tokens, completeness (of measured and unavailable only) and what is unavailable."""
    total = sum((F.col(t) for t in TOKENS), F.lit(0))
    cost = F.when(priced(None), F.concat(F.lit("$"), dollars(F.col("amount_micros"), 2), F.lit(" est. API-equivalent"))).otherwise("cost unavailable")
    known = F.col("measured") + F.col("unavailable")
    complete = F.when(F.col("requests") > 0, F.concat(F.format_string("%.0f", F.rint(F.try_divide(100.0 * F.col("measured"), known))), F.lit("% complete"))).otherwise("—")
    return F.concat_ws(" · ", cost, F.concat(total.cast("string"), F.lit(" tok")), complete, F.concat(F.col("unavailable").cast("string"), F.lit(" unavailable")))


def with_ends(nodes: DataFrame) -> DataFrame:
    """Nodes in tree order with ``ends``: for each step from the root down, whether it is the last of its siblings.

    Roots are siblings within their project, where there is one. The last is found by a maximum for each parent, so
    that a parent of most nodes is no task of its own.
    """
    project = F.coalesce(F.col("project_id"), F.lit("")) if "project_id" in nodes.columns else F.lit("")
    up = F.when(F.size("path") > 1, F.concat(F.lit("i"), F.element_at("path", -2))).otherwise(F.concat(F.lit("p"), project))
    ordered = in_tree_order(nodes).withColumn("_up", up)
    latest = ordered.groupBy("_up").agg(F.max("place").alias("_latest"))
    own = ordered.join(latest, "_up").select(F.col("id").alias("_at"), (F.col("place") == F.col("_latest")).alias("_end"))
    steps = ordered.select("id", F.posexplode("path").alias("_n", "_at")).join(own, "_at")
    ends = steps.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_end"))), lambda x: x["_end"]).alias("ends"))  # as long as the tree is deep
    return ordered.drop("_up").join(ends, "id")


def text_lines(nodes: DataFrame) -> DataFrame:
    """(place, line) of the tree drawn with branches; one line a node."""
    above = F.slice("ends", 1, F.size("ends") - 1)
    stem = F.array_join(F.transform(above, lambda x: F.when(x, "    ").otherwise("│   ")), "")
    branch = F.when(F.element_at("ends", -1), "└── ").otherwise("├── ")
    return with_ends(nodes).select("place", F.concat(stem, branch, "title", F.lit("  "), totals_text()).alias("line"))


def nested_lines(nodes: DataFrame) -> DataFrame:
    """(project_id, place, id, line): the pieces of a JSON array of a project's trees, each node with its ``children``.

    A piece opens its node and, where nothing stands below it, closes it and all whose last
    descendant it is. Pieces are made side by side, each from its own path, and joined by nothing: in order of
    place they are the document, however deep or large it is.
    """
    marked = with_ends(nodes if "project_id" in nodes.columns else nodes.withColumn("project_id", F.lit("")))
    above = marked.select(F.when(F.size("path") > 1, F.element_at("path", -2)).alias("_of")).where("_of is not null").distinct()
    known = marked.join(above, marked["id"] == above["_of"], "left").withColumn("_leaf", F.col("_of").isNull())
    firsts = known.groupBy("project_id").agg(F.min("place").alias("_first"))
    own = F.to_json(F.struct("id", "parent_id", "title", F.struct(*TOKENS, "requests", "measured", "unavailable", "anomalous", "priced", "amount_micros").alias("inclusive")), {"ignoreNullFields": "false"})
    opened = F.concat(F.expr("substring(_own, 1, length(_own) - 1)"), F.lit(',"children":['))
    flags = F.array_join(F.transform("ends", lambda x: F.when(x, "1").otherwise("0")), "")
    last = F.length(flags) - F.length(F.rtrim(flags, F.lit("1")))  # how many steps, from the node up, are last ones
    closed = F.when(last == F.size("path"), F.concat(F.repeat(F.lit("]}"), F.size("path")), F.lit("]"))).otherwise(F.concat(F.repeat(F.lit("]}"), last + 1), F.lit(",")))
    joined = known.join(firsts, known["project_id"].eqNullSafe(firsts["project_id"])).drop(firsts["project_id"])
    begin = F.when(F.col("place") == F.col("_first"), "[").otherwise("")
    return joined.withColumn("_own", own).select("project_id", "place", "id", F.concat(begin, opened, F.when(F.col("_leaf"), closed).otherwise("")).alias("line"))


def json_nodes(nodes: DataFrame) -> DataFrame:
    """(place, id, parent_id, json): each node with its totals; nesting is by parent_id."""
    ordered = in_tree_order(nodes)
    return ordered.select("place", "id", "parent_id", F.to_json(F.struct("id", "parent_id", "title", F.struct(*TOKENS, "requests", "measured", "unavailable", "anomalous", "priced", "amount_micros").alias("inclusive"))).alias("json"))


def html_rows(nodes: DataFrame) -> DataFrame:
    """(id, place, line): a table row a node, indented by depth, all text escaped."""
    ordered = in_tree_order(nodes)
    cells = [F.concat(F.lit("<td style=\"padding-left:"), (F.size("path") - 1).cast("string"), F.lit("em\">"), html_escape(F.col("title")), F.lit("</td>")), F.concat(F.lit("<td>"), html_escape(totals_text()), F.lit("</td>"))]
    return ordered.select("id", "place", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"))


def write_lines(lines: DataFrame, folder: str, header: str | None = None) -> None:
    """Lines in order as text files; a header goes first."""
    out = lines
    if header is not None:
        first = lines.sparkSession.createDataFrame([(header,)], "line string").select(F.lit(0).alias("_f"), F.lit(None).cast(lines.schema["place"].dataType).alias("place"), "line")
        out = first.unionByName(lines.select(F.lit(1).alias("_f"), "place", "line")).orderBy("_f", "place")
    else:
        out = lines.orderBy("place")
    out.select("line").write.mode("overwrite").text(folder)


def grand_total(nodes: DataFrame) -> DataFrame:
    """One row of totals over the roots, which hold all that is below them; a cost only where every request has one."""
    roots = nodes.where(F.size("path") == 1)
    return roots.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*TOKENS, "requests", "measured", "unavailable", "anomalous", "priced", "amount_micros"]))


def html_sections(nodes: DataFrame, projects: DataFrame) -> DataFrame:
    """(section, part, place, line) of a page: a section for each project (id, key, title) by title, with its own total and a
    table of its tree, and the grand total first. Projects without nodes have an empty table."""
    by_project = nodes.where(F.size("path") == 1).groupBy("project_id").agg(*(F.sum(c).alias(c) for c in [*TOKENS, "requests", "measured", "unavailable", "anomalous", "priced", "amount_micros"]))
    named = projects.select(F.col("id").alias("project_id"), F.concat_ws("\0", F.coalesce("title", F.lit("")), "id").alias("section"), "key", "title")
    rows = html_rows(nodes).join(nodes.select("id", "project_id"), "id").join(named.select("project_id", "section"), "project_id").select("section", F.lit(1).alias("part"), "place", "line")
    none = F.lit(None).cast(rows.schema["place"].dataType)
    badge = F.when(F.col("requests").isNull(), "no usage").when(priced(None), "priced").when(F.col("priced") > 0, "partly priced").otherwise("cost unavailable")
    told = F.when(F.col("requests").isNotNull(), html_escape(totals_text())).otherwise("")
    heads = named.join(by_project, "project_id", "left").select("section", F.lit(0).alias("part"), none.alias("place"), F.concat(F.lit("<section><h2>"), html_escape(F.coalesce("title", F.lit(""))), F.lit("</h2><p>"), html_escape(F.coalesce("key", F.lit(""))), F.lit(' <span class="badge">'), badge, F.lit("</span> "), told, F.lit("</p><table>")).alias("line"))
    ends = named.select("section", F.lit(2).alias("part"), none.alias("place"), F.lit("</table></section>").alias("line"))
    total = grand_total(nodes).select(F.lit("").alias("section"), F.lit(-1).alias("part"), none.alias("place"), F.concat(F.lit("<p>"), html_escape(totals_text()), F.lit("</p>")).alias("line"))
    return total.unionByName(heads).unionByName(rows).unionByName(ends)


def write_html(nodes: DataFrame, folder: str, title: str, disclaimer: str, projects: DataFrame | None = None) -> None:
    """The trees as a page, all text escaped: one table in tree order, or with ``projects`` (id, key, title) the grand total and a section for each."""
    from html import escape

    head = f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><p>{escape(disclaimer)}</p>"
    if projects is None:
        rows = html_rows(nodes).select(F.lit("").alias("section"), F.lit(0).alias("part"), "place", "line")
        _write_page(rows, folder, head + "<table>", "</table></body></html>")
        return
    _write_page(html_sections(nodes, projects), folder, head, "</body></html>")


def _write_page(body: DataFrame, folder: str, head: str, foot: str) -> None:
    place = body.schema["place"].dataType
    ends = body.sparkSession.createDataFrame([(0, head), (2, foot)], "f int, line string").select("f", F.lit("").alias("section"), F.lit(0).alias("part"), F.lit(None).cast(place).alias("place"), "line")
    page = ends.unionByName(body.withColumn("f", F.lit(1))).orderBy("f", "section", "part", "place")
    page.select("line").write.mode("overwrite").text(folder)
