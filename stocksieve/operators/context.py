"""Prompt-ready context: screen results rendered as text sections in pages,
assembled into named prompts, report texts carried on to later prompts, and
ticker mentions read back from report text.

A section has as many pages as its rows need.  Its rows are put in one global
order and numbered by range partition (``functions.ranks.numbered``); a page is
a range of those numbers, so every row is on one page, a text has at most
``ROWS_PER_PAGE`` rows, and no task holds more of a section than its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import as_date
from ..functions.ranks import numbered
from ..functions.text import strip_ws
from ..sources.snapshots import stage

ROWS_PER_PAGE = 60


def _cell(df: DataFrame, c: str) -> Column:
    """Text of one cell: doubles with 4 decimals, null as empty."""
    dtype = df.schema[c].dataType
    col = F.col(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        col = col.cast("decimal(20,4)")
    return F.coalesce(col.cast("string"), F.lit(""))


def render_line(df: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws(" | ", *[_cell(df, c) for c in columns])


OrderSpec = list[tuple[str, bool]]  # (column, descending); nulls always last
Section = tuple[str, DataFrame, list[str], OrderSpec]  # name, rows, columns, order


def _sort_keys(df: DataFrame, order: OrderSpec, width: int) -> list[Column]:
    """``order`` as ``width`` keys of one type for all sections: whether the
    value is missing, its text or its number (negated where it falls)."""
    out = []
    for i in range(width):
        text, number, missing = F.lit(None).cast("string"), F.lit(None).cast("decimal(38,6)"), F.lit(True)
        if i < len(order):
            name, falls = order[i]
            dtype, value = df.schema[name].dataType, F.col(name)
            missing = value.isNull()
            if isinstance(dtype, T.StringType):
                if falls:
                    raise ValueError(f"text column {name!r} can only rise")
                text = value
            else:
                number = (F.unix_date(value) if isinstance(dtype, T.DateType) else value).cast("decimal(38,6)") * (-1 if falls else 1)
        out += [missing.alias(f"m{i}"), text.alias(f"t{i}"), number.cast("decimal(38,6)").alias(f"n{i}")]
    return out


def render_sections(sections: list[Section], rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """``(section, page, n_rows, n_shown, text)``: on each page of a section a
    header line and the rows that follow those of the page before, in its order
    (the rendered line breaks ties).  ``n_rows`` counts the whole section,
    ``n_shown`` the page.  A section without rows has one page with its header.

    All sections are sorted in one pass."""
    spark = sections[0][1].sparkSession
    width = max(len(order) for _, _, _, order in sections)
    keys = [f"{k}{i}" for i in range(width) for k in "mtn"]
    lines = [df.select(F.lit(name).alias("section"), *_sort_keys(df, order, width), render_line(df, columns).alias("line"))
             for name, df, columns, order in sections]
    every = lines[0]
    for part in lines[1:]:
        every = every.unionByName(part)
    placed = numbered(every, [F.col(c).asc() for c in ("section", *keys, "line")], "place")
    starts = placed.groupBy("section").agg(F.min("place").alias("start"), F.count("*").alias("n_rows"))
    heads = spark.createDataFrame([(name, " | ".join(columns) + "\n") for name, _, columns, _ in sections], "section string, header string")
    heads = heads.join(starts, "section", "left")
    pages = (placed.join(F.broadcast(starts), "section")  # one row a section
             .select("section", F.floor((F.col("place") - F.col("start")) / rows_per_page).cast("int").alias("page"), F.struct("place", "line").alias("row"))
             .groupBy("section", "page").agg(F.count("*").alias("n_shown"), F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["line"]), "\n").alias("rows")))
    # the few heads go to the pages: a join on the section would send all pages
    # of one to one task
    filled = pages.join(F.broadcast(heads), "section")
    empty = heads.where(F.col("n_rows").isNull()).select("*", F.lit(0).alias("page"), F.lit(0).cast("long").alias("n_shown"), F.lit("").alias("rows"))
    return (filled.unionByName(empty)
            .select("section", "page", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_shown", F.concat("header", "rows").alias("text")))


# Fixed prompt layouts, in the order the prompts are answered: the sections each
# carries, then the earlier reports it builds on.
PROMPTS: dict[str, tuple[list[str], list[str]]] = {
    "insider_report": (["insider", "superinvestor", "custom_insider"], []),
    "week_low_report": (["week_low", "13f", "funds"], ["insider_report"]),
    "custom_report": (["custom_screen", "insider", "superinvestor", "magic"], []),
    "combined_report": (["custom_screen", "13f"], ["custom_report"]),
    "senior_report": ([], ["insider_report", "week_low_report", "custom_report", "combined_report"]),
    "ticker_list": ([], ["senior_report"]),
}


def prompt_layout(spark: SparkSession, prompt: str) -> DataFrame:
    sections, reports = PROMPTS[prompt]
    rows = [(prompt, i, "section", s) for i, s in enumerate(sections)]
    rows += [(prompt, len(sections) + i, "report", r) for i, r in enumerate(reports)]
    return spark.createDataFrame(rows, "prompt_name string, pos int, kind string, name string")


def assemble_prompt(sections: DataFrame, reports: DataFrame, layout: DataFrame, as_of) -> DataFrame:
    """``(prompt_name, page, as_of, prompt_text)``: on every page a dated
    header and that page of each section that has one, labelled, in layout
    order; earlier reports stand on the first page.  ``layout`` has one row a
    slot."""
    texts = (sections.select(F.lit("section").alias("kind"), F.col("section").alias("name"), "page", "text")
             .unionByName(reports.select(F.lit("report").alias("kind"), F.col("prompt_name").alias("name"), F.lit(0).alias("page"), F.col("report_text").alias("text"))))
    title = F.concat(F.when(F.col("kind") == "report", "### report ").otherwise("### "), F.col("name"), F.lit("\n"))
    blocks = texts.join(F.broadcast(layout), ["kind", "name"]).select("prompt_name", "page", "pos", F.concat(title, "text").alias("block"))
    day = F.date_format(as_date(as_of), "yyyy-MM-dd")
    # at most one block a slot
    return (blocks.groupBy("prompt_name", "page")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n\n").alias("body"))
            .select("prompt_name", "page", day.alias("as_of"), F.concat(F.lit("Data as of "), day, F.lit("\n\n"), F.col("body")).alias("prompt_text")))


def report_chain(sections: DataFrame, answer, as_of, path: str) -> tuple[DataFrame, DataFrame]:
    """All prompts in order and their reports: ``(prompts, reports)``.

    Each prompt is written under ``path`` and handed to ``answer(prompt,
    prompts, reports)``, the stage outside this library that turns a prompt
    into a ``(prompt_name, report_text)`` row; its text is written and read
    back, and later prompts carry it."""
    spark = sections.sparkSession
    sections = stage(spark, sections, f"{path}/sections")  # several prompts carry a section
    reports = spark.createDataFrame([], "prompt_name string, report_text string")
    for nth, prompt in enumerate(PROMPTS):
        assemble_prompt(sections, reports, prompt_layout(spark, prompt), as_of).write.mode("append").parquet(f"{path}/prompts")
        written = spark.read.parquet(f"{path}/prompts")
        write_texts(answer(prompt, written.where(F.col("prompt_name") == prompt), reports), f"{path}/reports/nth={nth}", "prompt_name", "report_text")
        reports = spark.read.parquet(f"{path}/reports").select("prompt_name", "report_text")
    return spark.read.parquet(f"{path}/prompts"), reports


def write_texts(df: DataFrame, path: str, name_col: str, text_col: str) -> None:
    """Store report/prompt texts as a table (one row per name)."""
    df.select(name_col, text_col).write.mode("overwrite").parquet(path)


TICKER_TOKEN = r"^[A-Z]{1,5}$"


def ticker_mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Upper-case 1-5 letter tokens per document with their counts, over
    the whole text."""
    # keep only ticker-shaped tokens inside the array, then explode: the
    # intermediate rows are the mentions, not every word of every text
    hits = F.filter(F.split(F.col(text_col), "[^A-Za-z]+"), lambda t: t.rlike(TICKER_TOKEN))
    tokens = docs.select(id_col, F.explode(hits).alias("ticker"))
    return tokens.groupBy(id_col, "ticker").agg(F.count("*").alias("n_mentions"))


def known_mentions(docs: DataFrame, tickers: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ticker_mentions`` of the tickers that a dimension lists (a semi-join;
    the dimension may grow, Spark picks the join by its size)."""
    return ticker_mentions(docs, id_col, text_col).join(tickers.select("ticker").distinct(), "ticker", "left_semi").select(id_col, "ticker", "n_mentions")


def ticker_list(response: DataFrame, text_col: str = "text") -> DataFrame:
    """A comma list answer (``'AAA, BBB,CCC'``) -> one ticker per row."""
    return (response.select(F.explode(F.split(F.col(text_col), ",")).alias("t"))
            .select(strip_ws("t").alias("ticker")).where(F.col("ticker") != "").distinct())
