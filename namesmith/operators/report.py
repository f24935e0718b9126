"""HTML and JSON views of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def escaped(x: Column) -> Column:
    x = F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.coalesce(x, F.lit(""))


def html(value: Column, kind: T.DataType) -> Column:
    """A nested list of a value; absent fields and empty lists are left out."""
    if isinstance(kind, T.StructType):
        items = [F.when(value[f.name].isNotNull() & ((F.size(value[f.name]) > 0) if isinstance(f.dataType, T.ArrayType) else F.lit(True)), F.concat(F.lit(f"<li><b>{f.name}</b>: "), html(value[f.name], f.dataType), F.lit("</li>"))).otherwise("") for f in kind.fields]
        return F.concat(F.lit("<ul>"), *items, F.lit("</ul>"))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("<ol>"), F.array_join(F.transform(value, lambda x: F.concat(F.lit("<li>"), html(x, kind.elementType), F.lit("</li>"))), ""), F.lit("</ol>"))
    return escaped(value.cast("string"))


def record_html(df: DataFrame) -> DataFrame:
    """Adds ``html``, the record as nested lists."""
    return df.withColumn("html", html(F.struct(*df.columns), df.schema))


def cluster_page(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """(entity_id, html): the members of each entity."""
    rows = record_html(records).select(F.col("mentionId").alias("mention_id"), "html")
    joined = clusters.join(rows, "mention_id").groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("mention_id", "html"))).alias("m"))
    return joined.select("entity_id", F.concat(F.lit("<h2>"), escaped(F.col("entity_id")), F.lit("</h2>"), F.array_join(F.transform("m", lambda x: x["html"]), "\n")).alias("html"))


def pair_page(outcomes: DataFrame, records: DataFrame, outcome: str) -> DataFrame:
    """(a, b, html) of the pairs with one outcome."""
    rows = record_html(records).select(F.col("mentionId").alias("id"), "html")
    both = outcomes.where(F.col("outcome") == outcome).join(rows.alias("x"), F.expr("a = x.id")).join(rows.alias("y"), F.expr("b = y.id"))
    return both.select("a", "b", F.concat(F.lit("<table><tr><td>"), "x.html", F.lit("</td><td>"), "y.html", F.lit("</td></tr></table>")).alias("html"))


def json_view(df: DataFrame, style: str = "compact") -> DataFrame:
    """Records as JSON text, compact or pretty."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true" if style == "pretty" else "false"}).alias("value"))
