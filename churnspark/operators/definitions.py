"""Many segment definitions at once.

A definition is a set of conditions ``column = value``; its customers meet all of them.  Definitions are rows
(definition, column_name, value), so a thousand are one job: an inverted join.

1. Conditions and customers' values become tokens ``column=value``; each customer also has the token of no condition.
2. A definition is posted under its rarest token alone (counted over the customers), so a customer meets only
   definitions that it has the rarest condition of, and an empty definition is posted under the token of all.
3. The other conditions are counted in the customer's own tokens: as many must be there as the definition has.

Before the join customers may be counted by :func:`profiles`, their values in the columns that the definitions use: a
report over definitions then joins and multiplies profiles, not customers, however many definitions a customer meets.

Conditions on unknown columns are ignored; a condition that is given twice counts once; two values for one column
are never met; a null value is met by nobody.  A tenure-group label stands for its numeric code, as in
:func:`~churnspark.operators.clean.segment_filter`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bins import TENURE_YEAR_LABELS
from ..plans.broadcast import checked_broadcast
from .retention import partial_sums, roi_of_sums, summed

ALL = ""  # the token that every customer has


def _token(column: str, value: Column) -> Column:
    return F.concat(F.lit(f"{column}="), value.cast("string"))


def _value(df: DataFrame, column: str) -> Column:
    """A condition's value as the column's own text, null if it is none of its values."""
    kind = df.schema[column].dataType
    value = F.col("value").try_cast(kind)
    if column == "tenure_group" and isinstance(kind, T.NumericType):
        codes = F.create_map(*[F.lit(x) for i, label in enumerate(TENURE_YEAR_LABELS) for x in (label, str(i))])
        value = F.coalesce(F.try_element_at(codes, F.col("value")).cast(kind), value)
    return value


def conditions(df: DataFrame, definitions: DataFrame) -> tuple[DataFrame, list[str]]:
    """(rows (definition, tokens, needed), the columns that the definitions use).

    ``needed`` counts the conditions, also those that no customer can meet."""
    used = [r["column_name"] for r in definitions.where(F.col("column_name").isin(df.columns)).select("column_name").distinct().collect()]
    used = [c for c in df.columns if c in used]  # at most the columns of the table
    token: Column = F.lit(None).cast("string")
    for c in used:
        token = F.when(F.col("column_name") == c, _token(c, _value(df, c))).otherwise(token)
    known = definitions.withColumn("token", token).withColumn("known", F.col("column_name").isin(used) if used else F.lit(False))
    per = known.groupBy("definition").agg(
        F.collect_set(F.when(F.coalesce("known", F.lit(False)), F.struct("column_name", "value"))).alias("_c"),
        F.collect_set(F.when(F.coalesce("known", F.lit(False)), F.col("token"))).alias("tokens"))
    impossible = F.exists("_c", lambda c: c["value"].isNull())
    needed = F.when(impossible, F.lit(None).cast("int")).otherwise(F.greatest(F.size("tokens"), F.size(F.array_distinct(
        F.transform("_c", lambda c: c["column_name"])))))
    return per.select("definition", "tokens", needed.alias("needed")), used


def segment_members(df: DataFrame, definitions: DataFrame) -> DataFrame:
    """Rows (definition, columns of ``df``…): each customer under each definition that it meets."""
    asked, used = conditions(df, definitions)
    mine = F.array_compact(F.array(F.lit(ALL), *[_token(c, F.col(f"`{c}`")) for c in used]))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    held = df.select(row, mine.alias("mine"))
    frequency = (held.select(F.explode("mine").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))  # a row a value
    wanted = (asked.where(F.col("needed").isNotNull())
              .select("definition", "tokens", "needed", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(ALL)))).alias("token"))
              .join(frequency, "token", "left")
              .groupBy("definition").agg(F.first("tokens").alias("tokens"), F.first("needed").alias("needed"),
                                         F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token").alias("t"))).alias("posted")))
    met = F.size(F.array_intersect("tokens", "mine")) == F.col("needed")
    return (held.withColumn("posted", F.explode("mine")).join(checked_broadcast(wanted), "posted").where(met)
            .select("definition", "row.*"))


def profiles(df: DataFrame, definitions: DataFrame, sums: Sequence[Column]) -> DataFrame:
    """Rows (columns that the definitions use…, sums…): the aggregates ``sums`` of the customers that are alike in these.

    Customers of one profile meet the same definitions.  A definition's figures come from adding up its profiles'."""
    used = {r["column_name"] for r in definitions.select("column_name").distinct().where(F.col("column_name").isin(df.columns)).collect()}
    # by a literal as well: no column and no customer is no profile
    return df.groupBy(F.lit(0).alias("_alike"), *[F.col(f"`{c}`") for c in df.columns if c in used]).agg(*sums)


def segment_roi(df: DataFrame, definitions: DataFrame, params: DataFrame) -> DataFrame:
    """The retention ROI of each row (definition, cost_per_customer, retention_rate) of ``params``, also without customers."""
    alike = profiles(df, definitions, partial_sums(df))
    members = segment_members(alike, definitions).groupBy("definition").agg(*summed(alike))
    return roi_of_sums(members, ["definition"], params)
