"""Difference by path in JSON text: every value at its path, whatever the order of members or the white space.

Texts are taken apart level by level: members of objects and elements of arrays become rows of their own, with the path that leads there, until only
values are left. The rounds are as many as the deepest text has levels; each handles all texts at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.session import written
from verdigris.functions.values import free_name, named


def json_paths(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """k0, k1 ..., path, kind and value of every value in the JSON texts of a column.

    kind is string, number, boolean, null, object or array (empty ones only) or malformed, which has the text as it is at the root. Members whose
    names are not plain words stand in brackets. A null text has no paths. value is the text of the value, of numbers without needless zeros.
    """
    spark, names = df.sparkSession, [f"k{i}" for i in range(len(keys))]
    rows = df.where(named(col).isNotNull()).select(*(named(k).alias(n) for k, n in zip(keys, names)), F.lit("$").alias("path"), named(col).cast("string").alias("text"))
    parsed = F.try_parse_json("text")
    bad = rows.where(parsed.isNull()).select(*names, "path", F.lit("malformed").alias("kind"), F.col("text").alias("value"))
    found, level = [bad], rows.where(parsed.isNotNull())
    while True:
        level = level.withColumn("v", F.parse_json("text")).withColumn("schema", F.schema_of_variant("v"))
        inner = F.col("schema").rlike("^(OBJECT|ARRAY)<") & ~F.to_json("v").isin("{}", "[]")
        is_text, schema = F.col("schema") == "STRING", F.col("schema")
        kind = F.when(is_text, "string").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").otherwise("number")
        plain = F.regexp_replace(F.regexp_replace(F.to_json("v"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        value = F.when(is_text, F.variant_get("v", "$", "string")).when(kind == "null", F.lit(None)).when(kind == "number", plain).otherwise(F.to_json("v"))
        found.append(level.where(~inner).select(*names, "path", kind.alias("kind"), value.alias("value")))
        picked = ", ".join([*names, "path"])
        parts = spark.sql(f"select {picked}, t.key as member, t.pos as place, to_json(t.value) as text from {{level}}, lateral variant_explode(v) as t", level=level.where(inner))
        step = F.when(F.col("member").isNull(), F.concat(F.lit("["), F.col("place").cast("string"), F.lit("]"))).when(F.col("member").rlike(r"^\w+$"), F.concat(F.lit("."), "member"))
        parts = parts.select(*names, F.concat("path", F.coalesce(step, F.concat(F.lit("['"), "member", F.lit("']")))).alias("path"), "text")
        level = written(parts)
        if not level.take(1):
            break
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def json_diff(src: DataFrame, tgt: DataFrame, keys: list[str], col: str) -> DataFrame:
    """keys, path, status, source_kind, source_value, target_kind and target_value of every path that differs.

    status is missing, extra, retyped (the same text as another kind: 5 and "5") or changed. Null keys equal null keys. Rows of one key are compared
    in the order of their values at each path. Results named like a key get an underscore.
    """
    names = [f"k{i}" for i in range(len(keys))]

    def side(df: DataFrame, letter: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*names, "path").orderBy("kind", "value"))
        rows = json_paths(df, keys, col).withColumn("nth", nth)
        return rows.select(*(F.col(n).alias(f"{letter}{n}") for n in names), F.col("path").alias(f"{letter}path"), F.col("nth").alias(f"{letter}nth"), F.col("kind").alias(f"{letter}kind"), F.col("value").alias(f"{letter}value"))

    on = [F.col(f"s{n}").eqNullSafe(F.col(f"t{n}")) for n in names] + [F.col("spath") == F.col("tpath"), F.col("snth") == F.col("tnth")]
    both = side(src, "s").join(side(tgt, "t"), on, "full_outer")
    same_text = F.col("svalue").eqNullSafe(F.col("tvalue"))
    status = F.when(F.col("tpath").isNull(), "missing").when(F.col("spath").isNull(), "extra").when(same_text & (F.col("skind") != F.col("tkind")), "retyped").when(~same_text | (F.col("skind") != F.col("tkind")), "changed")
    rows = both.withColumn("status", status).where("status is not null")
    taken = list(keys)
    for name in ("path", "status", "source_kind", "source_value", "target_kind", "target_value"):
        taken.append(free_name(name, taken))
    return rows.select(*(F.coalesce(f"s{n}", f"t{n}") for n in names), F.coalesce("spath", "tpath"), "status", "skind", "svalue", "tkind", "tvalue").toDF(*taken)
