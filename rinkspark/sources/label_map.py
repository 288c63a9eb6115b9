"""Label maps in the text form ``item { id: 1 name: 'player' }``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.operators.detections import MAX_CLASSES


QUOTED = r"(?:'[^']*'|\"[^\"]*\")"
COMMENT = rf"({QUOTED})|#[^\n]*"
#: An item, its quoted texts and one level of nested blocks taken whole.
ITEM = rf"\bitem\s*\{{(?:{QUOTED}|\{{(?:{QUOTED}|[^{{}}'\"])*\}}|[^{{}}'\"])*\}}"
NESTED = rf"({QUOTED})|\w+\s*:?\s*\{{(?:{QUOTED}|[^{{}}'\"])*\}}"
#: Keys are found from left to right with their values, so that no key is read inside a quoted text.
FIELD = rf"\w+\s*:\s*(?:{QUOTED}|[^\s,;{{}}'\"]+)"


def _value(fields: Column, key: str, form: str) -> Column:
    """The first field ``key`` of the wanted form, without quotes; NULL if it is missing or empty."""
    own = F.filter(fields, lambda f: f.rlike(rf"^{key}\s*:\s*{form}$"))
    text = F.regexp_replace(F.get(own, F.lit(0)), rf"^{key}\s*:\s*['\"]?|['\"]$", "")
    return F.when(text != "", text)


def parse_label_maps(
    texts: DataFrame, text_col: str = "value", keys: tuple[str, ...] = (), max_num_classes: int = MAX_CLASSES
) -> DataFrame:
    """Items of each text: ``(*keys, id, name)``.

    Ids outside 1..``max_num_classes`` are dropped, the first item of a repeated id wins,
    and ``display_name`` goes before ``name``. Comments (``#`` to the end of the line) and blocks
    inside an item are skipped; braces, keys and ``#`` inside quotes are text. ``keys`` identify a text; without them all
    texts form one map, read in no particular order between texts.
    """
    plain = F.regexp_replace(F.col(text_col), COMMENT, "$1")
    items = texts.select(*keys, F.posexplode(F.regexp_extract_all(plain, F.lit(ITEM), F.lit(0))).alias("pos", "item"))
    body = F.regexp_replace(F.regexp_replace("item", r"^item\s*\{|\}$", ""), NESTED, "$1")
    parsed = items.withColumn("fields", F.regexp_extract_all(body, F.lit(FIELD), F.lit(0))).select(
        *keys,
        "pos",
        _value(F.col("fields"), "id", r"\d+").try_cast("int").alias("id"),
        F.coalesce(_value(F.col("fields"), "display_name", QUOTED), _value(F.col("fields"), "name", QUOTED)).alias("name"),
    ).filter(F.col("id").between(1, max_num_classes))
    return (
        parsed.groupBy(*keys, "id").agg(F.min(F.struct("pos", "name")).alias("first")).select(*keys, "id", "first.name")
    )


def read_label_map(spark: SparkSession, path: str, max_num_classes: int = MAX_CLASSES) -> DataFrame:
    return parse_label_maps(spark.read.text(path, wholetext=True), max_num_classes=max_num_classes)
