"""Runs, conversations and events over time: latest, n-th, previous, history windows, severity roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nth(rows: DataFrame, by: str, n: int, *order: Column, newest: bool = False) -> DataFrame:
    """The n-th row of each group in the given order (from 1)."""
    window = Window.partitionBy(by).orderBy(*[o.desc() if newest else o.asc() for o in order])
    return rows.withColumn("place", F.row_number().over(window)).where(F.col("place") == n)


def latest(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    return nth(rows, by, 1, *order, newest=True)


def with_previous(rows: DataFrame, by: str, value: str, *order: Column) -> DataFrame:
    window = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn(f"previous_{value}", F.lag(value).over(window))


def last_turns(messages: DataFrame, n: int = 12, by: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``n`` messages of each conversation."""
    window = Window.partitionBy(by).orderBy(F.col(turn).desc())
    return messages.withColumn("from_end", F.row_number().over(window)).where(F.col("from_end") <= n)


def parse_time(value: Column) -> Column:
    """ISO text as a UTC timestamp; without zone it is UTC; NULL if it is no time."""
    return F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00"))


#: How questions name days and runs.
FULL_DATE = r"(20\d{2})[年\-/](\d{1,2})[月\-/](\d{1,2})"
SHORT_DATE = r"(?<!\d)(\d{1,2})月(\d{1,2})日"
RUN_DIGITS = r"第\s*(\d+)\s*次"
RUN_WORD = r"(?:第)?(一|二|三|四|五|六|七|八|九|十)次"
NUMERALS = "一二三四五六七八九十"
YESTERDAY, TODAY, PREVIOUS = "昨天", "今天", "上一次"


def day_of_question(question: Column, today: Column) -> Column:
    """Day that a question names (yesterday, today, a full date, or a month and day of this year), or NULL."""
    full = lambda i: F.regexp_extract(question, FULL_DATE, i)
    short = lambda i: F.regexp_extract(question, SHORT_DATE, i)
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return (
        F.when(F.contains(question, F.lit(YESTERDAY)), F.date_sub(today, 1)).when(F.contains(question, F.lit(TODAY)), today)
        .when(full(1) != "", day(full(1), full(2), full(3))).when(short(1) != "", day(F.year(today).cast("string"), short(1), short(2)))
    )


def ordinal_of_question(question: Column) -> Column:
    """Number of the run that a question asks for, or NULL."""
    digits = F.regexp_extract(question, RUN_DIGITS, 1)
    word = F.regexp_extract(question, RUN_WORD, 1)
    names = F.array(*[F.lit(c) for c in NUMERALS])
    return F.when(digits != "", F.try_to_number(digits, F.lit("999999999")).cast("int")).when(word != "", F.array_position(names, word).cast("int"))


def select_runs(runs: DataFrame, questions: DataFrame, today: Column) -> DataFrame:
    """Runs that each question means: its day (half-open local day), else its ordinal per source, else the newest.

    ``runs``: run_id, source, created_at; ``questions``: question_id, question.
    """
    asked = questions.select("question_id", day_of_question(F.col("question"), today).alias("day"), ordinal_of_question(F.col("question")).alias("ordinal"), F.contains("question", F.lit(PREVIOUS)).alias("previous"))
    by = Window.partitionBy("source")
    placed = runs.withColumns({"from_start": F.row_number().over(by.orderBy("created_at", "run_id")), "from_end": F.row_number().over(by.orderBy(F.col("created_at").desc(), "run_id"))})
    wanted = (
        F.when(F.col("day").isNotNull(), (F.col("created_at") >= F.col("day")) & (F.col("created_at") < F.date_add("day", 1)))
        .when(F.col("previous"), F.col("from_end") == 2)
        .when(F.col("ordinal").isNotNull(), F.col("from_start") == F.col("ordinal"))
        .otherwise(F.col("from_end") == 1)
    )
    return placed.join(asked, wanted).select("question_id", "run_id", "source", "created_at")


def severity_rollup(rows: DataFrame, by: list[str], rank: Column, level: str, order: str) -> DataFrame:
    """Highest level of each group by rank, with counts; of equal ranks the first by ``order``."""
    return rows.withColumn("_rank", rank).groupBy(*by).agg(F.count("*").alias("n"), F.max("_rank").alias("highest_rank"), F.max_by(level, F.struct(F.col("_rank"), -F.col(order))).alias("highest"))


def tumbling(events: DataFrame, width: str = "1 day", ts: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    w = F.window(ts, width)
    return events.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")
