"""Lines of a CREATE TABLE statement."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted_names(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", ")


def column_line(c: Column, single_pk: Column) -> Column:
    """Name, format, default, nullability, and the key mark if the key has just one column."""
    default = F.coalesce(F.concat(F.lit("  default "), c["default_value"]), F.lit(""))
    null = F.when(c["is_not_null"], F.lit("  not null")).otherwise(F.lit("  null"))
    pk = F.when(c["is_primary_key"] & single_pk, F.lit("  PRIMARY KEY")).otherwise(F.lit(""))
    return F.concat(F.lit("`"), c["column_name"], F.lit("` "), F.upper(c["data_format"]), default, null, pk)


def foreign_key_line(fk: Column) -> Column:
    return F.concat(
        F.lit("FOREIGN KEY ("), quoted_names(fk["local"]), F.lit(") REFERENCES `"), fk["ref_table"], F.lit("` ("),
        quoted_names(fk["ref"]), F.lit(")"),
    )
