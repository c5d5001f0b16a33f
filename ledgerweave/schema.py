"""Declared table contracts: columns, keys, references and value rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG = T.LongType()
INT = T.IntegerType()
SHORT = T.ShortType()
TEXT = T.StringType()
FLAG = T.BooleanType()
DAY = T.DateType()
INSTANT = T.TimestampType()
MONEY = T.DecimalType(18, 2)
AREA = T.DecimalType(12, 2)
RATE = T.DecimalType(10, 4)

# Columns that describe the load, not the business object.
AUDIT_COLUMNS = ("created_at", "updated_at", "linked_at")


@dataclass(frozen=True)
class ForeignKey:
    column: str
    table: str
    target: str


@dataclass(frozen=True)
class Field:
    """One declared column and the rules that concern it alone."""

    name: str
    type: T.DataType
    required: bool = False
    key: bool = False
    unique: bool = False
    references: tuple[str, str] | None = None
    one_of: tuple[str, ...] = ()
    non_negative: bool = False
    default: Any = None


@dataclass(frozen=True)
class TableContract:
    """What a table promises.

    ``ordered`` holds (earlier, later) column pairs; ``any_of`` holds groups of
    columns of which at least one must be set. A rule on a NULL holds.
    """

    name: str
    fields: tuple[Field, ...]
    ordered: tuple[tuple[str, str], ...] = ()
    any_of: tuple[tuple[str, ...], ...] = ()
    tags: Mapping[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def primary_key(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields if f.key)

    @property
    def foreign_keys(self) -> tuple[ForeignKey, ...]:
        return tuple(ForeignKey(f.name, *f.references) for f in self.fields if f.references)

    @property
    def properties(self) -> list[str]:
        """Business columns: everything but the audit columns."""
        return [c for c in self.columns if c not in AUDIT_COLUMNS]

    @property
    def defaults(self) -> dict[str, Any]:
        return {f.name: f.default for f in self.fields if f.default is not None}

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def struct(self) -> T.StructType:
        """The Spark schema; keys and references travel as column metadata."""
        return T.StructType(
            [
                T.StructField(
                    f.name,
                    f.type,
                    not (f.required or f.key),
                    {"pk": f.key, "fk": ".".join(f.references) if f.references else ""},
                )
                for f in self.fields
            ]
        )


# The type names of the source systems and what they become.
SQL_TO_VALUE_TYPE = {
    "bigint": "BigInt",
    "integer": "BigInt",
    "int": "BigInt",
    "smallint": "BigInt",
    "serial": "BigInt",
    "bigserial": "BigInt",
    "numeric": "Double",
    "decimal": "Double",
    "real": "Double",
    "float": "Double",
    "double": "Double",
    "timestamptz": "DateTime",
    "timestamp": "DateTime",
    "datetime": "DateTime",
    "date": "DateTime",
    "boolean": "Boolean",
    "bool": "Boolean",
}
VALUE_TYPE_TO_SPARK = {
    "String": "STRING",
    "DateTime": "TIMESTAMP",
    "BigInt": "BIGINT",
    "Double": "DOUBLE",
    "Boolean": "BOOLEAN",
    "Object": "STRING",
}
VALUE_TYPE_TO_ENDPOINT_SQL = {
    "String": "varchar",
    "BigInt": "bigint",
    "Double": "float",
    "Boolean": "bit",
    "DateTime": "datetime2",
}
SQL_TO_LINK_TABLE_SPARK = {
    "bigint": "BIGINT",
    "integer": "INT",
    "int": "INT",
    "smallint": "SMALLINT",
    "numeric": "DOUBLE",
    "decimal": "DOUBLE",
    "float": "DOUBLE",
    "double": "DOUBLE",
    "real": "DOUBLE",
    "timestamp": "TIMESTAMP",
    "timestamptz": "TIMESTAMP",
    "datetime": "TIMESTAMP",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "bool": "BOOLEAN",
}
XSD_TO_VALUE_TYPE = {
    "xsd:decimal": "Double",
    "xsd:float": "Double",
    "xsd:double": "Double",
    "xsd:integer": "BigInt",
    "xsd:int": "BigInt",
    "xsd:long": "BigInt",
    "xsd:nonNegativeInteger": "BigInt",
    "xsd:positiveInteger": "BigInt",
    "xsd:dateTime": "DateTime",
    "xsd:date": "DateTime",
    "xsd:boolean": "Boolean",
    "xsd:string": "String",
    "xsd:anyURI": "String",
}


def looked_up(names: Mapping[str, str], name: Column, otherwise: str) -> Column:
    """A column's names looked up in one of these maps."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, name), F.lit(otherwise))


def _base_name(sql_type: str) -> str:
    head = sql_type.strip().lower().split("(")[0].split()
    return head[0] if head else ""


def value_type(sql_type: str) -> str:
    """Abstract value type of an SQL column type; anything unknown is text."""
    return SQL_TO_VALUE_TYPE.get(_base_name(sql_type), "String")


def link_column_type(sql_type: str) -> str:
    """Column type a link table gives to an SQL type."""
    return SQL_TO_LINK_TABLE_SPARK.get(_base_name(sql_type), "STRING")


def exact_type(sql_type: str) -> T.DataType:
    """The lossless Spark type this package stores for an SQL column type."""
    base = _base_name(sql_type)
    if base in ("numeric", "decimal"):
        if "(" not in sql_type:
            return T.DecimalType(38, 18)
        digits = sql_type.split("(")[1].split(")")[0].split(",")
        return T.DecimalType(int(digits[0]), int(digits[1]) if len(digits) > 1 else 0)
    exact = {
        "BIGINT": LONG,
        "INT": INT,
        "SMALLINT": SHORT,
        "DOUBLE": T.DoubleType(),
        "TIMESTAMP": INSTANT,
        "DATE": DAY,
        "BOOLEAN": FLAG,
    }
    return exact.get(link_column_type(sql_type), TEXT)


def contracts_of(declared: Iterable[tuple[str, str, str]], keys: Mapping[str, Sequence[str]] | None = None) -> dict[str, TableContract]:
    """Contracts out of (table, column, declared SQL type) rows, columns in the order they come.

    ``keys`` gives tables their key columns. Rows are those of a catalog, one per column.
    """
    fields: dict[str, list[Field]] = {}
    for table, column, sql_type in declared:
        key = column in (keys or {}).get(table, ())
        fields.setdefault(table, []).append(Field(column, exact_type(sql_type), key=key))
    return {table: TableContract(table, tuple(own)) for table, own in fields.items()}


def type_report(declared: DataFrame) -> DataFrame:
    """``declared`` (with ``sql_type``) and the names its types go by: ``value_type``,
    ``entity_type`` in an entity table, ``link_type`` in a link table, ``endpoint_type``."""
    base = F.split(F.trim(F.regexp_extract(F.lower("sql_type"), r"^([^(]*)", 1)), r"\s+")[0]
    value = looked_up(SQL_TO_VALUE_TYPE, base, "String")
    return declared.withColumns(
        {
            "value_type": value,
            "entity_type": looked_up(VALUE_TYPE_TO_SPARK, value, "STRING"),
            "link_type": looked_up(SQL_TO_LINK_TABLE_SPARK, base, "STRING"),
            "endpoint_type": looked_up(VALUE_TYPE_TO_ENDPOINT_SQL, value, "varchar"),
        }
    )
