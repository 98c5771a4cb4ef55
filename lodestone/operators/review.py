"""Checks before and after: review of versions, answers against their evidence, quality facts, structure of pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import col, line_key, listed, section_number, squeezed
from lodestone.operators.access import first_of
from lodestone.operators.documents import repeated_lines


def named_findings(*findings: tuple[str, Column]) -> Column:
    """The names of the findings that hold, in their order (RET-11); null ones don't."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in findings]), lambda x: x.isNotNull())


def recorded_calls(calls: DataFrame, most: int = 1000) -> DataFrame:
    """(call, ordinal, source, question): one row for each source of a call by its place, and one without a source for
    a call that had none, a knowledge gap, whose question is kept unless it is bound to a case (EVL-7). calls: call,
    sources, question, case."""
    question = F.when((F.size("sources") == 0) & F.col("case").isNull(), F.col("question"))
    rows = calls.select("call", question.alias("question"), F.posexplode_outer(F.slice("sources", 1, most)).alias("at", "source"))
    return rows.select("call", (F.col("at") + 1).alias("ordinal"), "source", "question")


#: The conditions of production that can be told without a question.
STATIC_CONDITIONS = ["P1", "P2", "P3", "P4", "P6", "P9"]


def availability(demo: Column, database: Column, model: Column, context: Column, problem: Column, status: Column, unmet: Column, outcome: Column, accepted: Column) -> Column:
    """struct<state, grade, reason> of retrieval (EVL-4): why it is not to be had, or of which grade its evidence is and why it is
    not of production's. demo, database, model, context, accepted: booleans, the model and the context as they could be read; problem:
    why providers can't be made, or null; status: the configuration's, null without one; unmet: names of conditions."""
    missing = first_of((demo, "demo"), (~database, "no_database"), (~model, "model_unreadable"), (~context, "context_unreadable"), (problem.isNotNull(), "provider"))
    static = F.filter(unmet, lambda x: x.isin(STATIC_CONDITIONS))
    development = F.when(F.size(static) == 0, None).otherwise(
        first_of(
            (status.isNull(), "no_configuration"), (status == "suspended", "suspended"), (F.array_contains(static, "P4"), "other_fingerprint"),
            ((outcome == "pass_with_uncertainty") & ~F.coalesce(accepted, F.lit(False)), "uncertainty_not_accepted"), (F.lit(True), "unmet"),
        )
    )
    reason = F.when(development == "unmet", F.concat(F.lit("unmet: "), F.array_join(static, ", "))).otherwise(development)
    grade = F.when(missing.isNull(), F.when(development.isNull(), "production").otherwise("development"))
    return F.struct(F.when(missing.isNull(), "available").otherwise("unavailable").alias("state"), grade.alias("grade"), F.coalesce(F.when(missing == "provider", problem), missing, reason).alias("reason"))


def without_headers(pages: DataFrame, group: str, page: str, edge: int = 2) -> DataFrame:
    """(group, page, text, removed): pages without the repeated lines at their tops and bottoms, white space single
    (DOC-1)."""
    lines = F.filter(F.transform(F.split("text", "\n"), squeezed), lambda x: x != "")
    rows = pages.select(group, page, lines.alias("lines")).groupBy(group, page).agg(F.collect_list("lines").alias("sets"))
    # At most 4 * edge lines are on half of a group's pages, each of which has 2 * edge to show.
    found = repeated_lines(pages, group, page, edge).groupBy(group).agg(F.collect_list("line").alias("again"))

    def marked(own):
        def mark(line, at):
            gone = F.when((at < edge) | (at >= F.size(own) - edge), F.array_contains("again", line_key(line)))
            return F.struct(at.alias("at"), line.alias("line"), F.coalesce(gone, F.lit(False)).alias("gone"))

        return F.transform(own, mark)

    made = rows.join(found, group, "left").select(group, page, F.size("sets").alias("n"), F.flatten(F.transform("sets", marked)).alias("lines"))
    kept = F.filter("lines", lambda x: ~x["gone"])
    kept = F.when(F.col("n") > 1, F.array_sort(kept)).otherwise(kept)
    removed = F.size(F.filter("lines", lambda x: x["gone"])).cast("bigint")
    return made.select(group, page, F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"), removed.alias("removed"))


def line_blocks(docs: DataFrame, key: str) -> DataFrame:
    """(key, block, kind, first, lines): runs of lines of one kind, empty ones parting them (DOC-2). Kinds: heading
    (numbered, or short and without an end), list, table (two or more gaps of two spaces), text."""
    rows = docs.select(key, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = F.trim("line")
    kind = first_of(
        (line == "", "empty"),
        (section_number(line).isNotNull(), "heading"),
        (listed(line), "list"),
        (F.regexp_count(line, F.lit(r"\S {2,}\S")) > 1, "table"),
        ((F.length(line) < 60) & ~line.rlike("[.!?:;,]$"), "heading"),
        otherwise="text",
    )
    order = Window.partitionBy(key).orderBy("at")
    rows = rows.select(key, "at", kind.alias("kind"))
    new = (~F.lag("kind").over(order).eqNullSafe(F.col("kind")) | (F.col("kind") == "heading")).cast("int")
    rows = rows.withColumn("block", F.sum(new).over(order))
    made = rows.filter("kind <> 'empty'").groupBy(key, "block", "kind").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    return made.select(key, F.row_number().over(Window.partitionBy(key).orderBy("first")).alias("block"), "kind", "first", "lines")


def stemmed(token: Column | str, endings: Sequence[str] = (), least: int = 3) -> Column:
    """A token less the longest of these endings that leaves `least` letters; none by default (UDF-2)."""
    out = col(token)
    for e in sorted(endings, key=len):
        out = F.when(col(token).endswith(e) & (F.length(col(token)) >= least + len(e)), F.substring(col(token), F.lit(1), F.length(col(token)) - len(e))).otherwise(out)
    return out


def markdown(rows: DataFrame, title: str) -> str:
    """A small result as a Markdown table under a title (SRC-12); for reports of a few rows."""
    head = ["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    body = ["| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in r) + " |" for r in rows.toLocalIterator()]
    return "\n".join([f"# {title}", "", *head, *body, ""])


def appended(rows: DataFrame, path: str) -> None:
    """Adds rows to an append-only table; nothing that is there changes (SRC-10)."""
    rows.write.mode("append").parquet(path)
