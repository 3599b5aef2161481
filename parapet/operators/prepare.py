"""From any labelled table to the message schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parapet import fixed_values as fv
from parapet.functions.picks import pick_number
from parapet.functions.text import trimmed


def label_value(label: Column) -> Column:
    """0 for a benign word or a zero, else 1 for words and the number itself.

    Decided per value: a distributed table has no first row to look at.
    """
    word = F.lower(label.cast("string"))
    number = label.cast("string").try_cast("int")
    return (
        F.when(word.isin(*fv.BENIGN_LABELS), F.lit(0))
        .when(number.isNotNull(), number)
        .otherwise(F.lit(1))
    )


def normalise_labels(df: DataFrame, label_column: str | None = "label") -> DataFrame:
    """Bring ``label`` to 0/1; a table without labels holds attacks only."""
    if label_column is None or label_column not in df.columns:
        return df.withColumn("label", F.lit(1))
    return df.withColumn("label", label_value(F.col(label_column)))


def normalise_source(
    df: DataFrame,
    text_column: str | None,
    id_column: str,
    source: str,
    attack_type: str = fv.REAL_INJECTION,
    label_column: str | None = "label",
    seed: str = "42",
) -> DataFrame:
    """Trim texts, drop blank ones, set label, attack type, agents and source.

    Without a named text column it is "goal", or else the table's first column.
    """
    if text_column is None:
        text_column = fv.TEXT_COLUMN if fv.TEXT_COLUMN in df.columns else df.columns[0]
    text = trimmed(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    labelled = normalise_labels(df, label_column)
    row_id = F.concat(F.lit(f"{source}:"), F.col(id_column).cast("string"))
    pair = F.element_at(
        F.array(*[
            F.struct(F.lit(a).alias("from_agent"), F.lit(b).alias("to_agent"))
            for a, b in fv.SOURCE_AGENT_PAIRS
        ]),
        (pick_number(row_id, f"{seed}-pair", len(fv.SOURCE_AGENT_PAIRS)) + 1).cast("int"),
    )
    return (
        labelled.select(
            row_id.alias("message_id"), text.alias("content"), pair.alias("pair"), "label"
        )
        .where(F.length("content") > 0)
        .select(
            "message_id", "content", "pair.from_agent", "pair.to_agent", "label",
            F.when(F.col("label") == 1, F.lit(attack_type)).otherwise(F.lit(fv.BENIGN))
            .alias("attack_type"),
            F.lit(source).alias("source"),
        )
    )


@dataclass
class Union:
    """rows: all sources that could be read, None if there is none.
    skipped: for each other source its name and the reason."""

    rows: DataFrame | None
    skipped: dict[str, str]

    def report(self, spark: SparkSession) -> DataFrame:
        """source, rows, attacks, skipped (the reason); with the rows of each source."""
        schema = "source string, rows bigint, attacks bigint, skipped string"
        left_out = spark.createDataFrame(
            [(name, 0, 0, reason) for name, reason in self.skipped.items()], schema
        )
        if self.rows is None:
            return left_out
        counts = self.rows.groupBy("source").agg(
            F.count("*").alias("rows"), F.count_if(F.col("label") == 1).alias("attacks"),
            F.lit(None).cast("string").alias("skipped"),
        )
        return counts.unionByName(left_out)


def union_sources(loaders: dict[str, Callable[[], DataFrame]]) -> Union:
    """All sources that can be read, one after the other.

    A source whose files are missing or do not have the columns is left out, and
    told of in ``skipped``.  Any other error is raised.
    """
    frames, skipped = [], {}
    for name, load in loaders.items():
        try:
            frame = load()
            frame.schema  # forces the analysis, reads no rows
        except FileNotFoundError as error:
            skipped[name] = str(error)
        except AnalysisException as error:
            condition = error.getCondition() or ""
            if not condition.startswith(("PATH_NOT_FOUND", "UNRESOLVED_COLUMN")):
                raise
            skipped[name] = str(error).splitlines()[0]
        else:
            frames.append(frame)
    rows = frames[0] if frames else None
    for frame in frames[1:]:
        rows = rows.unionByName(frame, allowMissingColumns=True)
    return Union(rows, skipped)


def fill_missing_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add columns the table lacks: texts as "unknown", the label as 1, since a
    table without labels holds attacks only."""
    return df.withColumns({
        c: F.lit(1) if c == "label" else F.lit(fv.UNKNOWN) for c in columns if c not in df.columns
    })


def dataset_statistics(df: DataFrame) -> DataFrame:
    """Counts and shares for all rows, per label, attack type and source.

    One pass over the rows, grouping sets over its counts.  ``bar`` is the
    length of a count bar.
    """
    if "source" not in df.columns:
        df = df.withColumn("source", F.lit(None).cast("string"))
    keys = ["label", "attack_type", "source"]
    counts = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    counted = counts.groupingSets(
        [[], [F.col("label")], [F.col("attack_type")], [F.col("source")]],
        *[F.col(k) for k in keys],
    ).agg(F.grouping_id(*[F.col(k) for k in keys]).alias("level"), F.sum("rows").alias("n"))
    # grouping_id has a bit for every column that is summed over
    level = F.col("level")
    return counted.select(
        F.when(level == 7, "total").when(level == 3, "label").when(level == 5, "attack_type")
        .otherwise("source").alias("kind"),
        F.when(level == 7, "all").when(level == 3, F.col("label").cast("string"))
        .when(level == 5, F.col("attack_type")).otherwise(F.col("source")).alias("value"),
        F.col("n"),
        (F.col("n") * 100.0 / total).alias("percent"),
        F.floor(F.col("n") * fv.BAR_LENGTH / total).alias("bar"),
    )


def type_histogram(df: DataFrame, column: str = "attack_type") -> DataFrame:
    """Counts per value, largest first, ties by name."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
