"""Recognition payloads (JSON lines) as pages, blocks and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions.geometry import box_union
from pagemill.functions.html import table_rows

_OCR = "rec_texts:array<string>,rec_scores:array<double>,rec_polys:array<array<array<double>>>,rec_boxes:array<array<double>>"
_RES = (
    f"page_index:int,{_OCR},overall_ocr_res:struct<{_OCR}>,layout_det_res:struct<boxes:array<struct<label:string,score:double,coordinate:array<double>>>>,"
    "table_res_list:array<struct<cell_box_list:array<array<double>>,pred_html:string>>"
)
PAYLOAD = f"struct<res:struct<{_RES}>,{_RES}>"


def payload(json: Column, strict: bool = False) -> Column:
    """The parsed payload, out of its optional envelope ``res``; malformed rows are null, or fail if ``strict``."""
    p = F.from_json(json, PAYLOAD, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    fields = ["page_index", "rec_texts", "rec_scores", "rec_polys", "rec_boxes", "overall_ocr_res", "layout_det_res", "table_res_list"]
    return F.struct(*[F.when(p["res"].isNotNull(), p["res"][f]).otherwise(p[f]).alias(f) for f in fields])


def blocks_of(ocr: Column) -> Column:
    """array<struct<text, score, polygon, box>>: by position, missing scores 0 and missing shapes empty; blank texts go with all of theirs."""
    texts = F.coalesce(ocr["rec_texts"], F.array().cast("array<string>"))
    none = F.array().cast("array<double>")
    made = F.transform(
        texts,
        lambda t, i: F.struct(
            X.trimmed(t).alias("text"),
            F.coalesce(F.get(ocr["rec_scores"], i), F.lit(0.0)).alias("score"),
            F.coalesce(F.get(ocr["rec_polys"], i), F.array().cast("array<array<double>>")).alias("polygon"),
            F.coalesce(F.get(ocr["rec_boxes"], i), none).alias("box"),
        ),
    )
    return F.filter(made, lambda b: b["text"] != "")


def pages(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """payloads with page_index, text and blocks; table payloads take the text of their overall result."""
    p = F.col("_p")
    ocr = F.when(p["overall_ocr_res"].isNotNull(), p["overall_ocr_res"]).otherwise(F.struct(*[p[f].alias(f) for f in ("rec_texts", "rec_scores", "rec_polys", "rec_boxes")]))
    out = payloads.withColumn("_p", payload(F.col(column))).withColumn("blocks", blocks_of(ocr)).withColumn("page_index", p["page_index"])
    return out.withColumn("text", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")).drop("_p")


def tables(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row a table: table_index, score (nullable), box, rows; its layout box is the one at its position among those labelled table."""
    p = F.col("_p")
    found = payloads.withColumn("_p", payload(F.col(column))).withColumn("page_index", p["page_index"])
    layout = F.filter(p["layout_det_res"]["boxes"], lambda b: F.lower(b["label"]) == "table")
    rows = found.select(*[c for c in payloads.columns if c != column], "page_index", layout.alias("_layout"), F.posexplode(p["table_res_list"]).alias("table_index", "_t"))
    at = F.get("_layout", F.col("table_index"))
    own = box_union(F.flatten("_t.cell_box_list"))
    box = F.when(F.size(own) > 0, own).otherwise(F.coalesce(at["coordinate"], F.array().cast("array<double>")))
    return rows.select("*", at["score"].alias("score"), box.alias("box"), table_rows(F.col("_t.pred_html"), F.col("_t.cell_box_list")).alias("rows")).drop("_layout", "_t")


def cells(tables_: DataFrame) -> DataFrame:
    """The flat relation of a tables frame's nested rows."""
    keep = [c for c in tables_.columns if c not in ("rows", "box", "score")]
    flat = tables_.select(*keep, F.posexplode("rows").alias("row_ord", "_row")).select(*keep, "row_ord", F.posexplode("_row").alias("cell_ord", "_c"))
    return flat.select(*keep, "row_ord", "cell_ord", "_c.row", "_c.column", F.col("_c.rowSpan").alias("row_span"), F.col("_c.colSpan").alias("col_span"), "_c.text", "_c.box")
