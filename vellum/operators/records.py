"""Notes as records: predicates over dynamic frontmatter, sorting, paging, validation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains")
NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


class ValidationError(ValueError):
    """A request that can't be answered as asked."""


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    value: str

    @staticmethod
    def parse(text: str) -> Predicate:
        """Field:op:value, the value may hold colons."""
        parts = text.split(":", 2)
        if len(parts) != 3:
            raise ValidationError(f"predicate {text!r} is not field:op:value")
        return Predicate(*parts)


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    required: bool = False
    enum: tuple[str, ...] = field(default=())


def value_of(json: Column, name: str) -> Column:
    """The field's text by JSON path; dots go into nested maps. Booleans read as 1 and 0."""
    raw = F.get_json_object(json, f"$.{name}")
    return F.when(_is_bool(json, name), F.when(raw == "true", "1").otherwise("0")).otherwise(raw)


def _variant(json: Column, name: str) -> Column:
    return F.try_variant_get(F.try_parse_json(json), f"$.{name}", "variant")


def kind_of(json: Column, name: str) -> Column:
    """The field's JSON type, null if it is missing."""
    return F.schema_of_variant(_variant(json, name))


def _is_bool(json: Column, name: str) -> Column:
    return F.coalesce(kind_of(json, name) == "BOOLEAN", F.lit(False))


def _is_number(json: Column, name: str) -> Column:
    return F.coalesce(kind_of(json, name).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|BOOLEAN)"), F.lit(False))


def real(text: Column) -> Column:
    """T5: the numeric prefix, 0 without one, null for null."""
    return F.when(text.isNotNull(), F.coalesce(F.regexp_extract(text, NUMBER, 1).try_cast("double"), F.lit(0.0)))


def _operand(value: str) -> float | None:
    try:
        x = float(value) if not re.search(r"(?i)nan|inf|_", value) else None
    except ValueError:
        return None
    return x


def predicate(json: Column, p: Predicate) -> Column:
    """A filter. A missing field fails every operation; a numeric operand compares as numbers; numbers sort before texts."""
    if not p.field:
        raise ValidationError("predicate with empty field")
    if p.op not in OPS:
        raise ValidationError(f"unknown operation {p.op!r}")
    text = value_of(json, p.field)
    if p.op == "contains":
        return F.lower(text).contains(p.value.lower())
    compare = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}[p.op]
    number = _operand(p.value)
    if number is not None:
        return compare(real(text), F.lit(number))
    below = p.op in ("lt", "lte", "ne")  # any number stands before any text
    return F.when(text.isNull(), F.lit(None).cast("boolean")).when(_is_number(json, p.field), F.lit(below)).otherwise(compare(text, F.lit(p.value)))


def in_folder(path: Column, folder: str) -> Column:
    """Below the folder at any depth; the root folder holds all."""
    folder = folder.strip("/")
    return F.lit(True) if folder in ("", ".") else path.startswith(folder + "/")


def order(json: Column, sort: str) -> list[Column]:
    """Sort keys: path, updated_at or a field (null, then numbers, then texts), '-' turns it round; path settles ties."""
    down = sort.startswith("-")
    name = sort.lstrip("-")
    if name in ("", "path"):
        return [F.col("path").desc() if down else F.col("path").asc()]
    if name == "updated_at":
        keys = [F.col("updated_at")]
    else:
        text, number = value_of(json, name), _is_number(json, name)
        rank = F.when(text.isNull(), 0).when(number, 1).otherwise(2)
        keys = [rank, F.when(number, real(text)), F.when(~number, text)]
    return [*(k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys), F.col("path").asc()]


def list_records(notes: DataFrame, folder: str = "", where: list[Predicate] = (), sort: str = "", limit: int = 0, offset: int = 0) -> DataFrame:
    """Folder, then predicates, sort, offset, limit (0: all)."""
    json = F.col("frontmatter")
    out = notes.where(in_folder(F.col("path"), folder))
    for p in where:
        out = out.where(predicate(json, p))
    out = out.orderBy(*order(json, sort))
    if offset > 0:
        out = out.offset(offset)
    return out.limit(limit) if limit > 0 else out


def collection_counts(notes: DataFrame, folders: dict[str, str]) -> DataFrame:
    """Records of each collection, those without records too."""
    spark = notes.sparkSession
    names = spark.createDataFrame([(n, f.strip("/")) for n, f in folders.items()], "collection string, folder string")
    owned = [notes.where(in_folder(F.col("path"), f)).select(F.lit(n).alias("collection")) for n, f in folders.items()]
    union = owned[0]
    for o in owned[1:]:
        union = union.unionByName(o)
    return names.join(union.groupBy("collection").agg(F.count("*").alias("n")), "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("n"))


DATE = r"^\d{4}-\d{2}-\d{2}$"


def problems(json: Column, f: Field) -> Column:
    """struct(field, problem) where the field is missing or of another type or value, else null."""
    kind, text = kind_of(json, f.name), F.get_json_object(json, f"$.{f.name}")
    missing = kind.isNull() | (kind == "VOID") | ((kind == "STRING") & (F.trim(text) == ""))
    is_text = kind == "STRING"
    listed = (kind == "ARRAY<STRING>") | (text == "[]")
    good = {
        "string": is_text,
        "number": kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"),
        "bool": kind == "BOOLEAN",
        "date": is_text & text.rlike(DATE) & F.try_to_date(text, "yyyy-MM-dd").isNotNull(),
        "enum": is_text & text.isin(*f.enum) if f.enum else is_text,
        "tags": is_text | listed,
        "ref": is_text | listed,
    }
    if f.type not in good:
        raise ValidationError(f"unknown field type {f.type!r}")
    issue = F.when(missing, F.lit("required") if f.required else F.lit(None).cast("string")).when(~F.coalesce(good[f.type], F.lit(False)), F.lit("value not in enum") if f.type == "enum" else F.lit(f"not a {f.type}"))
    return F.when(issue.isNotNull(), F.struct(F.lit(f.name).alias("field"), issue.alias("problem")))


def validate(notes: DataFrame, schema: list[Field]) -> DataFrame:
    """(path, field, problem), a row for each violation."""
    found = F.array_compact(F.array(*[problems(F.col("frontmatter"), f) for f in schema]))
    return notes.select("path", F.explode(found).alias("x")).select("path", "x.field", "x.problem")


def patched(frontmatter: Column, patch: Column) -> Column:
    """Fields of the patch (JSON) replace those of the frontmatter; a null value deletes its field. Values stay JSON texts."""
    kind = "map<string,string>"
    old, new = F.from_json(frontmatter, kind), F.from_json(patch, kind)
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), F.map_filter(new, lambda k, v: v.isNotNull()))
    return F.to_json(merged)
