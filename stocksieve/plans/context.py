"""Prompt context sections, prompts, ticker mentions and the ad-hoc JSON
answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adhoc as A
from ..operators import consensus as C
from ..operators import context as X
from ..operators import fundamentals as FU
from ..session import shared_path
from ..sources.fixtures import AS_OF_EVENTS, AS_OF_ORDERS, fixture, with_fixtures
from ..sources.tables import Tables
from .catalog import query
from .consensus import FIXTURES, MAPPING_CTE, SCREENS_CTE, screens

D = f"date '{AS_OF_ORDERS}'"
N = X.ROWS_PER_PAGE

# name -> (source CTE / DataFrame key, columns, order: list of (column, desc))
SECTIONS = {
    "insider": ("q1", ["ticker", "relationship", "amount", "count", "trans_date"], [("ticker", 0), ("amount", 0)]),
    "superinvestor": ("q2", ["ticker", "count", "total_amount"], [("ticker", 0)]),
    "custom_insider": ("q3", ["ticker", "date_filling", "total_value"], [("ticker", 0), ("date_filling", 0)]),
    "week_low": ("q5", ["ticker", "percent_owned"], [("ticker", 0)]),
    "13f": ("q6", ["ticker", "fund_id", "weight"], [("fund_id", 0), ("weight", 1)]),
    "funds": ("mapping", ["fund_id", "fund_name"], [("fund_id", 0)]),
    "custom_screen": ("q7", ["ticker", "sector", "industry", "market_cap", "pe"], [("ticker", 0)]),
    "magic": ("q8", ["ticker", "market_cap"], [("ticker", 0)]),
}
DOUBLE_COLS = {"weight"}


def frames_of(sc: dict) -> dict:
    mapping = C.fund_mapping(sc["13f"])
    return {"q1": sc["insider"], "q2": sc["superinvestor"], "q3": sc["custom_insider"], "q5": sc["week_low"],
            "q6": C.encode_funds(sc["13f"], mapping), "mapping": mapping, "q7": sc["custom_screen"], "q8": sc["magic"]}


def sections_of(frames: dict) -> DataFrame:
    return X.render_sections([(name, frames[s], cols, [(c, bool(d)) for c, d in order]) for name, (s, cols, order) in SECTIONS.items()])


def _duck_cell(c: str) -> str:
    if c in DOUBLE_COLS:
        return f"coalesce(cast(cast({c} as decimal(20,4)) as varchar), '')"
    return f"coalesce(cast({c} as varchar), '')"


def _sections_sql() -> str:
    ctes, selects = [], []
    for name, (src, cols, order) in SECTIONS.items():
        key = "s_" + name.replace("13f", "thirteen_f")
        line = "concat_ws(' | ', " + ", ".join(_duck_cell(c) for c in cols) + ")"
        ob = ", ".join(f"{c} {'desc' if d else 'asc'} nulls last" for c, d in order) + ", line asc"
        ctes.append(f", {key} as (select line, row_number() over (order by {ob}) - 1 as place from (select *, {line} as line from {src}))")
        header = " | ".join(cols)
        selects.append(
            f"select '{name}' as section, cast(place // {N} as integer) as page, (select count(*) from {key}) as n_rows, count(*) as n_shown, "
            f"'{header}' || chr(10) || string_agg(line, chr(10) order by place) as text from {key} group by place // {N}")
    return "\n".join(ctes) + "\n, sections as (\n" + "\nunion all\n".join(selects) + ")\n"


SECTIONS_CTE = SCREENS_CTE + MAPPING_CTE + f"""
, q2 as (select distinct ticker, count, total_amount from fx_super where date_insert = {D})
, q3 as (select ticker, date_filling, cast(sum(total_value) as bigint) as total_value
         from home where date_insert = {D} group by ticker, date_filling)
, q5 as (select distinct ticker, percent_owned from fx_lows where date_insert = {D})
, q6 as (select w.ticker, m.fund_id, w.weight from weights w left join mapping m on w.fund_name = m.fund_name)
, q8 as (select distinct ticker, market_cap from fx_magic where date_insert = {D})
""" + _sections_sql()


@query("q_context_sections", with_fixtures(FIXTURES, SECTIONS_CTE + "select * from sections"))
def q_context_sections(spark, sf_dir):
    return sections_of(staged_frames(spark, sf_dir, shared_path(spark, "sections", unique=True)))


# what the stage outside answers in the tests: the tickers that a prompt's rows, or
# the reports it carries, hold most often (the shortest first of equals)
TOP = 15


def _ranked(rows: DataFrame) -> DataFrame:
    """The ``TOP`` most frequent tickers of ``rows``, as one comma text."""
    top = rows.where(F.col("ticker").isNotNull()).groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.length("ticker"), "ticker").limit(TOP)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.length("ticker").alias("size"), "ticker")))
    return top.agg(F.array_join(F.transform(ranked, lambda r: r["ticker"]), ", ").alias("report_text"))


def stand_in(frames: dict):
    def answer(prompt: str, prompts: DataFrame, reports: DataFrame) -> DataFrame:
        sections, earlier = X.PROMPTS[prompt]
        parts = [frames[SECTIONS[s][0]].select("ticker") for s in sections if "ticker" in SECTIONS[s][1]]
        if not parts:
            listed = reports.where(F.col("prompt_name").isin(earlier))
            parts = [listed.select(F.explode(F.split("report_text", ", ")).alias("ticker"))]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return _ranked(rows).select(F.lit(prompt).alias("prompt_name"), "report_text")
    return answer


def _reports_sql() -> str:
    """CTEs ``r_<prompt>(report_text)`` and, over all, ``reports``."""
    ctes = []
    for p, (secs, earlier) in X.PROMPTS.items():
        rows = [f"select ticker from {SECTIONS[s][0]}" for s in secs if "ticker" in SECTIONS[s][1]]
        rows = rows or [f"select unnest(string_split(report_text, ', ')) as ticker from r_{r}" for r in earlier]
        ctes.append(f""", r_{p} as (select coalesce(string_agg(ticker, ', ' order by n desc, length(ticker), ticker), '') as report_text from (
  select ticker, count(*) as n from ({' union all '.join(rows)}) where ticker is not null group by ticker order by n desc, length(ticker), ticker limit {TOP}))""")
    return "\n".join(ctes) + "\n, reports as (" + " union all ".join(f"select '{p}' as prompt_name, report_text from r_{p}" for p in X.PROMPTS) + ")\n"


def _layout_sql() -> str:
    rows = [(p, i, k, n) for p, (secs, reps) in X.PROMPTS.items() for i, (k, n) in enumerate([*(("section", s) for s in secs), *(("report", r) for r in reps)])]
    values = ", ".join(f"('{p}', {i}, '{k}', '{n}')" for p, i, k, n in rows)
    return f", layout(prompt_name, pos, kind, name) as (values {values})\n"


PROMPTS_SQL = _reports_sql() + _layout_sql() + f"""
, texts as (select 'section' as kind, section as name, page, text from sections
            union all select 'report', prompt_name, 0, report_text from reports)
select l.prompt_name, cast(t.page as integer) as page, '{AS_OF_ORDERS}' as as_of,
       'Data as of {AS_OF_ORDERS}' || chr(10) || chr(10) ||
       string_agg('### ' || case when l.kind = 'report' then 'report ' else '' end || l.name || chr(10) || t.text, chr(10) || chr(10) order by l.pos) as prompt_text
from layout l join texts t on l.kind = t.kind and l.name = t.name
group by l.prompt_name, t.page"""


def staged_frames(spark, sf_dir, base: str) -> dict:
    """The frames of all sections, computed once and staged."""
    from ..sources.snapshots import stage
    sc = {k: stage(spark, df, f"{base}/screens/{k}") for k, df in screens(spark, sf_dir).items()}
    return frames_of(sc)


def chain(spark, sf_dir):
    base = shared_path(spark, "reports", unique=True)
    frames = staged_frames(spark, sf_dir, base)
    return X.report_chain(sections_of(frames), stand_in(frames), AS_OF_ORDERS, base)


@query("q_prompts", with_fixtures(FIXTURES, SECTIONS_CTE + PROMPTS_SQL))
def q_prompts(spark, sf_dir):
    """All six prompts, page by page, the later ones with earlier reports."""
    return chain(spark, sf_dir)[0]


@query("q_reports", with_fixtures(FIXTURES, SECTIONS_CTE + _reports_sql() + "select * from reports"))
def q_reports(spark, sf_dir):
    """The reports as they were written and read back."""
    return chain(spark, sf_dir)[1]


@query("q_ticker_mentions", """
select doc_id, t as ticker, count(*) as n_mentions
from (select doc_id, unnest(string_split_regex(text, '[^A-Za-z]+')) as t from documents)
where regexp_full_match(t, '[A-Z]{1,5}')
group by doc_id, t""")
def q_ticker_mentions(spark, sf_dir):
    return X.ticker_mentions(Tables(spark, sf_dir).documents)


KNOWN_SQL = """
, mentions as (
  select doc_id, t as ticker, count(*) as n_mentions
  from (select doc_id, unnest(string_split_regex(text, '[^A-Za-z]+')) as t from documents)
  where t in (select ticker from fx_cusip_map) and regexp_full_match(t, '[A-Z]{1,5}')
  group by doc_id, t)
"""


@query("q_known_mentions", with_fixtures(["fx_cusip_map"], KNOWN_SQL + "select * from mentions"))
def q_known_mentions(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return X.known_mentions(t.documents, fixture(spark, t, "fx_cusip_map"))


HISTORY_SQL = f"""
select distinct symbol, date, cast(round(cast(open as decimal(38,10)), 2) as double) as open,
       cast(round(cast(close as decimal(38,10)), 2) as double) as close, volume,
       cast(null as double) as dividends, cast(null as double) as stock_splits
from fx_history
where date_insert = date '{AS_OF_EVENTS}' and date > date '{AS_OF_EVENTS}' - 1000
"""


@query("q_mentions_history", with_fixtures(["fx_cusip_map", "fx_history"], KNOWN_SQL + HISTORY_SQL + "and symbol in (select ticker from mentions)"))
def q_mentions_history(spark, sf_dir):
    """Price history of the known tickers that the documents mention."""
    history = FU.price_history(fixture(spark, sf_dir, "fx_history"), AS_OF_EVENTS)
    return history.join(q_known_mentions(spark, sf_dir), history["symbol"] == F.col("ticker"), "left_semi")


@query("q_mentioned_fundamentals", with_fixtures(FIXTURES + ["fx_history"], SECTIONS_CTE + _reports_sql()
       + HISTORY_SQL + "and symbol in (select unnest(string_split(report_text, ', ')) from reports where prompt_name = 'ticker_list')"))
def q_mentioned_fundamentals(spark, sf_dir):
    """The last report (a comma list of tickers) selects the fundamentals."""
    last = q_reports(spark, sf_dir).where(F.col("prompt_name") == "ticker_list")
    tickers = X.ticker_list(last, "report_text")
    history = FU.price_history(fixture(spark, sf_dir, "fx_history"), AS_OF_EVENTS)
    return history.join(tickers, history["symbol"] == tickers["ticker"], "left_semi")


ADHOC_SQL = "SELECT ticker, percent_owned FROM dataroma_low ORDER BY ticker, percent_owned"


@query("q_adhoc_json", with_fixtures(["fx_lows"], f"""
select cast(to_json({{'result': coalesce(list({{'ticker': ticker, 'percent_owned': percent_owned}}
                                              order by ticker, percent_owned), []),
                     'total': (select count(*) from fx_lows where date_insert = {D}),
                     'truncated': (select count(*) > 100 from fx_lows where date_insert = {D})}}) as varchar) as answer
from (select ticker, percent_owned from fx_lows where date_insert = {D}
      order by ticker, percent_owned limit 100)"""))
def q_adhoc_json(spark, sf_dir):
    A.register_snapshot_views(spark, {"dataroma_low": fixture(spark, sf_dir, "fx_lows")}, AS_OF_ORDERS)
    return A.answer(spark, ADHOC_SQL)
