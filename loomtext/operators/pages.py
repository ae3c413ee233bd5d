"""Positioned text of pages: lines, running headers, paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

PAGE_NUMBER = r"(?i)^[-–— \t]*([0-9]{1,5}|[ivxlcdm]{1,7}|page[ \t]+[0-9]+([ \t]+(of|/)[ \t]+[0-9]+)?|[0-9]+[ \t]*(/|of)[ \t]*[0-9]+)[-–— \t]*$"
TERMINAL = r"[.!?:;…\"'”’»)\]]$"


def without_running_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines (key, page, text, margin) without page numbers and margin lines that repeat on half of the pages, two at least."""
    margin = lines.where("margin").withColumn("_k", X.normalize_repeat("text"))
    pages = lines.groupBy(key).agg(F.greatest(F.lit(2), F.ceil(F.countDistinct("page") / 2)).alias("_need"))
    often = margin.groupBy(key, "_k").agg(F.countDistinct("page").alias("_n")).join(pages, key).where("_n >= _need").select(key, "_k")
    kept = margin.where(~F.col("text").rlike(PAGE_NUMBER)).join(often, [key, "_k"], "left_anti").drop("_k")
    return lines.where("not margin").unionByName(kept)


def paragraphs(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, para, heading, text): lines (key, ord, page, y, x, x_end, size, text) joined at gaps, indents and short lines."""
    body = lines.groupBy(key, "size").agg(F.sum(F.length("text")).alias("_w"), F.min("ord").alias("_o")).groupBy(key).agg(F.max_by("size", F.struct("_w", -F.col("_o"))).alias("_body"))
    rows = lines.join(body, key).withColumn("_head", (F.col("size") >= F.col("_body") * 1.15) & (F.length("text") <= 200))
    text = rows.where("not _head")
    left = text.groupBy(key, (F.floor(F.col("x") / 2 + 0.5) * 2).alias("_l")).agg(F.count("*").alias("_w"), F.min("ord").alias("_o")).groupBy(key).agg(F.max_by("_l", F.struct("_w", -F.col("_o"))).alias("_left"))
    right = text.groupBy(key).agg(F.max("x_end").alias("_right"))
    along = Window.partitionBy(key).orderBy("ord")
    for c in ("page", "y", "x", "x_end", "size", "text", "_head"):
        rows = rows.withColumn(f"_p_{c}", F.lag(c).over(along))
    same = F.col("_p_page") == F.col("page")
    gap = F.col("_p_y") - F.col("y")
    gaps = rows.where(same & ~F.col("_head") & ~F.col("_p__head") & (gap > 0)).groupBy(key).agg(F.array_sort(F.collect_list(gap)).alias("_g"))
    rows = rows.join(left, key, "left").join(right, key, "left").join(gaps, key, "left")
    rows = rows.withColumn("_typical", F.coalesce(F.element_at("_g", (F.floor(F.size("_g") / 2) + 1).cast("int")), F.col("_body") * 1.3))
    both_heads = F.col("_head") & F.col("_p__head") & (F.col("_p_size") == F.col("size")) & same & (gap < F.col("_typical") * 1.5)
    indent = (F.col("x") - F.col("_left") > 0.8 * F.col("size")) & (F.col("_p_x") - F.col("_left") <= 0.3 * F.col("size"))
    short = (F.col("_p_x_end") < F.greatest("_right", "_left") - 3 * F.col("size")) & F.col("_p_text").rlike(TERMINAL)
    plain = F.when(same, (gap > F.col("_typical") * 1.45) | indent | short).otherwise(F.col("_p_text").rlike(TERMINAL) & (indent | short))
    new = F.when(F.col("_p_page").isNull(), True).when(F.col("_head") | F.col("_p__head"), ~both_heads).otherwise(plain)
    rows = rows.withColumn("_new", new.cast("int")).withColumn("para", F.sum("_new").over(along))
    joined = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s.text), F.lit(None).cast("string"), lambda a, b: F.when(a.isNull(), b).otherwise(X.join_lines(a, b)))
    return rows.groupBy(key, "para").agg(F.bool_or("_head").alias("heading"), joined.alias("text"))


def split_level(headings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, level): the highest heading level that occurs twice or more."""
    return headings.groupBy(key, "level").agg(F.count("*").alias("n")).where("n >= 2").groupBy(key).agg(F.min("level").alias("level"))


def group_lines(items: list[tuple[float, float, float, float, str]]) -> list[tuple[float, float, float, float, str]]:
    """Lines (y, x, x_end, size, text) from items (y, x, width, size, text) of one page; a line is what lies near its first item."""
    out: list[list] = []
    for it in sorted(items, key=lambda i: (-i[0], i[1])):
        if out and abs(out[-1][0][0] - it[0]) <= 0.4 * max(out[-1][0][3], it[3]):
            out[-1].append(it)
        else:
            out.append([it])
    lines = []
    for group in out:
        group.sort(key=lambda i: i[1])
        text, end, weight = "", 0.0, {}
        for _, x, w, size, s in group:
            if text and x - end > 0.15 * size and not text[-1].isspace() and not s[:1].isspace():
                text += " "
            text, end = text + s, x + w
            k = int(size * 2 + 0.5) / 2
            weight[k] = weight.get(k, 0) + len(s)
        if text := " ".join(text.split()):
            lines.append((group[0][0], group[0][1], end, max(weight, key=weight.get), text))
    return lines


def page_lines(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, ord, y, x, x_end, size, text, margin) from items (key, page, page_h, x, y, w, size, str); a page is a group."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        height = float(pdf["page_h"].iloc[0])
        rows = [r for r in zip(pdf["y"], pdf["x"], pdf["w"], pdf["size"], pdf["str"]) if r[4] and r[4].strip()]
        lines = group_lines(rows)
        return pd.DataFrame([(pdf[key].iloc[0], int(pdf["page"].iloc[0]), i, *line, line[0] > height * 0.9 or line[0] < height * 0.1) for i, line in enumerate(lines)], columns=[key, "page", "ord", "y", "x", "x_end", "size", "text", "margin"])

    kind = dict(items.dtypes)[key]
    return items.groupBy(key, "page").applyInPandas(one, f"{key} {kind}, page int, ord int, y double, x double, x_end double, size double, text string, margin boolean")


def distinct_pages(lines: DataFrame, keys: list, page: str) -> DataFrame:
    """(keys, pages): on how many pages a line stands."""
    return lines.groupBy(*keys).agg(F.countDistinct(page).alias("pages"))
