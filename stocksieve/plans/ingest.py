"""Ingest queries: landed bodies -> typed tables, checked by round trip
against the typed fixture the bodies were rendered from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import screens as S
from ..session import shared_path
from ..sources import ingest as I
from ..sources import landing as L
from ..sources.fixtures import AS_OF_ORDERS, fixture, with_fixtures
from ..sources.tables import Tables
from . import duck
from .catalog import query

D = f"date '{AS_OF_ORDERS}'"

_REL = duck.title("relationship")
for _old, _new in I.RELATIONSHIP_REPLACEMENTS:
    _REL = f"replace({_REL}, '{_old}', '{_new}')"

INSIDER_CLEAN_SQL = f"""
select symbol, security, reporting_name, {_REL} as relationship, trans_date,
       replace(purchase_sale, 'Purchase', 'Buy') as purchase_sale, price, amount, shares, di,
       1 as count, date_insert
from fx_insider where symbol <> ''"""

INSIDER_ROLLUP_SQL = """
select date_insert, symbol, relationship, trans_date, purchase_sale, price, security, reporting_name, di,
       cast(sum(amount) as bigint) as amount, cast(sum(shares) as bigint) as shares,
       cast(count(*) as integer) as count
from insider_clean
group by date_insert, symbol, relationship, trans_date, purchase_sale, price, security, reporting_name, di"""

HOME_INSIDER_SQL = """
select date_insert, trim(split_part(company, '-', 1)) as ticker, cast(date_filling as date) as date_filling,
       trim(split_part(company, '-', 2)) as company, price,
       cast(sum(cast(total_value as bigint)) as bigint) as total_value
from fx_home_insider
group by all"""


def insider_clean(spark, sf_dir):
    pages = L.insider_pages(fixture(spark, sf_dir, "fx_insider"))
    return I.clean_insider(I.parse_insider_pages(pages))


def home_pages(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return L.home_pages(fixture(spark, t, "fx_home_insider"), fixture(spark, t, "fx_bigbets"),
                        fixture(spark, t, "fx_lows"), fixture(spark, t, "fx_super"))


@query("q_insider_clean", with_fixtures(["fx_insider"], INSIDER_CLEAN_SQL))
def q_insider_clean(spark, sf_dir):
    return insider_clean(spark, sf_dir)


@query("q_insider_rollup", with_fixtures(["fx_insider"], f", insider_clean as ({INSIDER_CLEAN_SQL})\n{INSIDER_ROLLUP_SQL}"))
def q_insider_rollup(spark, sf_dir):
    return I.rollup_insider(insider_clean(spark, sf_dir))


@query("q_insider_activity", with_fixtures(["fx_insider"], f"""
, insider_clean as ({INSIDER_CLEAN_SQL})
, rollup as ({INSIDER_ROLLUP_SQL})
select distinct symbol as ticker, relationship, amount, count, trans_date from rollup where date_insert = {D}"""))
def q_insider_activity(spark, sf_dir):
    return S.insider_buying_activity(I.rollup_insider(insider_clean(spark, sf_dir)), AS_OF_ORDERS)


@query("q_home_insider", with_fixtures(["fx_home_insider"], HOME_INSIDER_SQL))
def q_home_insider(spark, sf_dir):
    return I.parse_home_insider(home_pages(spark, sf_dir))


@query("q_custom_insider", with_fixtures(["fx_home_insider"], f"""
, home as ({HOME_INSIDER_SQL})
select ticker, date_filling, cast(sum(total_value) as bigint) as total_value
from home where date_insert = {D} group by ticker, date_filling"""))
def q_custom_insider(spark, sf_dir):
    return S.custom_insider(I.parse_home_insider(home_pages(spark, sf_dir)), AS_OF_ORDERS)


@query("q_ingest_bigbets", with_fixtures(["fx_bigbets"], """
select date_insert, ticker, company, percent_owned, count from fx_bigbets"""))
def q_ingest_bigbets(spark, sf_dir):
    return I.parse_bigbets(home_pages(spark, sf_dir))


@query("q_ingest_lows", with_fixtures(["fx_lows"], """
select date_insert, ticker, company, percent_owned from fx_lows"""))
def q_ingest_lows(spark, sf_dir):
    return I.parse_lows(home_pages(spark, sf_dir))


@query("q_ingest_super", with_fixtures(["fx_super"], """
select date_insert, ticker, trim(split_part(company, '-', 2)) as company, count, total_amount from fx_super"""))
def q_ingest_super(spark, sf_dir):
    return I.parse_super(home_pages(spark, sf_dir))


@query("q_ingest_screener", with_fixtures(["fx_finviz"], """
select date_insert, ticker, company, sector, industry, country, market_cap, pe,
       '-' as volume, '-' as price, '-' as change
from fx_finviz"""))
def q_ingest_screener(spark, sf_dir):
    pages = L.screener_pages(fixture(spark, sf_dir, "fx_finviz"))
    good, _bad = I.quarantine(I.parse_screener(pages))
    return good


@query("q_ingest_magic", with_fixtures(["fx_magic"], """
select date_insert, company, ticker, market_cap from fx_magic"""))
def q_ingest_magic(spark, sf_dir):
    return I.parse_magic(L.magic_pages(fixture(spark, sf_dir, "fx_magic")))


@query("q_13f_clean", with_fixtures(["fx_sec_13f"], """
select distinct name_of_issuer, 'COM' as title_of_class, cusip,
       case when prn_amt % 2 = 1 then 'BBG' || cusip end as figi,
       case when value % 10 = 0 then null else value end as value, prn_amt, 'SH' as prn,
       cast(null as varchar) as put_call, 'SOLE' as discretion, cast(null as varchar) as manager,
       prn_amt as voting_sole, cast(0 as bigint) as voting_shared, cast(null as bigint) as voting_none,
       trans_date, date_insert, fund_name
from fx_sec_13f"""))
def q_13f_clean(spark, sf_dir):
    good, _bad = I.clean_holdings(L.holdings_cells(fixture(spark, sf_dir, "fx_sec_13f")))
    return good


LATEST_SQL = """
select cik, accession_number, filing_date from (
  select *, row_number() over (partition by cik order by filing_date desc, accession_number desc) as rn
  from fx_filings
  where form = '13F-HR'
    and cik in (select lpad(cast(c_custkey as varchar), 10, '0') from customer where c_mktsegment = 'BUILDING'))
where rn = 1"""

INFO_URL_SQL = """
select cik, accession_number,
       case when cast(accession_number as bigint) % 3 <> 0
            then 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || accession_number || '/infotable.xml' end as url
from fx_filings"""


def latest_filings(spark, t):
    filings = I.parse_filing_index(L.filing_index_json(fixture(spark, t, "fx_filings")))
    funds = I.parse_cik_lists(L.cik_lists(t.customer))
    return I.latest_filing(filings.join(funds, "cik", "left_semi"))


@query("q_13f_latest_filing", with_fixtures(["fx_filings"], LATEST_SQL))
def q_13f_latest_filing(spark, sf_dir):
    return latest_filings(spark, Tables(spark, sf_dir))


@query("q_13f_info_url", with_fixtures(["fx_filings"], INFO_URL_SQL))
def q_13f_info_url(spark, sf_dir):
    return I.info_table_url(L.filing_index_pages(fixture(spark, sf_dir, "fx_filings")))


@query("q_13f_filing_details", with_fixtures(["fx_filings"], f"""
, latest as ({LATEST_SQL})
, urls as ({INFO_URL_SQL})
select l.cik, l.accession_number, l.filing_date as trans_date, u.url
from latest l join urls u on l.cik = u.cik and l.accession_number = u.accession_number"""))
def q_13f_filing_details(spark, sf_dir):
    t = Tables(spark, sf_dir)
    # pages are joined by key before any of them is parsed
    pages = L.filing_index_pages(fixture(spark, t, "fx_filings")).join(latest_filings(spark, t), ["cik", "accession_number"])
    return pages.select("cik", "accession_number", F.col("filing_date").alias("trans_date"), I.info_table_link(F.col("html")).alias("url"))


SITE_HOLDINGS_SQL = """
, newest as (
  select cik, accession_number, filing_date, filing_key from (
    select *, row_number() over (partition by cik order by filing_date desc, accession_number desc) as rn
    from fx_edgar_filings
    where form = '13F-HR'
      and cik in (select lpad(cast(c_custkey as varchar), 10, '0') from customer where c_mktsegment = 'BUILDING'))
  where rn = 1)
select distinct n.cik, n.accession_number, h.name_of_issuer || ' & Co <A>' as name_of_issuer, 'COM' as title_of_class, h.cusip,
       case when h.prn_amt % 2 = 1 then 'BBG' || h.cusip end as figi, h.value, h.prn_amt, 'SH' as prn,
       cast(null as varchar) as put_call, 'SOLE' as discretion, cast(null as varchar) as manager,
       h.prn_amt as voting_sole, cast(0 as bigint) as voting_shared, cast(0 as bigint) as voting_none, n.filing_date as trans_date
from newest n join fx_edgar_holdings h on n.filing_key = h.filing_key
where n.filing_key % 3 <> 0"""


@query("q_13f_holdings_chain", with_fixtures(["fx_edgar_filings", "fx_edgar_holdings"], SITE_HOLDINGS_SQL))
def q_13f_holdings_chain(spark, sf_dir):
    """Filing indexes of the listed funds -> newest filing of each -> its index
    page -> its information table -> holdings, over a landed copy of the site."""
    t = Tables(spark, sf_dir)
    filings = fixture(spark, t, "fx_edgar_filings")
    site = landed(spark, L.edgar_site(filings, fixture(spark, t, "fx_edgar_holdings")))
    indexed = I.parse_filing_index(L.filing_index_json(filings))
    latest = I.latest_filing(indexed.join(I.parse_cik_lists(L.cik_lists(t.customer)), "cik", "left_semi"))
    good, _bad = I.filing_holdings(latest, site)
    return good


SITE_KINDS = ("index", "table")


def landed(spark, site):
    """The site's bodies as the fetchers leave them: files in the landing
    folder, one directory a kind."""
    path = shared_path(spark, "landing", "site", unique=True)
    for kind in SITE_KINDS:  # a write each: one partitioned write sorts all bodies by kind
        site.where(F.col("kind") == kind).drop("kind").write.parquet(f"{path}/kind={kind}")
    return spark.read.parquet(path)


@query("q_page_links", with_fixtures(["fx_insider"], """
select date_insert, page, '/m/ins/ins.php?L=' || lpad(cast(page + 2 as varchar), 6, '0') as href
from (select distinct date_insert, cast(floor(row_key / 100) as bigint) as page from fx_insider)"""))
def q_page_links(spark, sf_dir):
    """Links to follow from each listing page."""
    pages = L.insider_pages(fixture(spark, sf_dir, "fx_insider"))
    return pages.select("date_insert", "page", F.explode(H.page_links("html")).alias("href"))


@query("q_html_links", """
select page_id, href from (
  select page_id, unnest(links[2:]) as href
  from (select page_id, list_sort(list_distinct(regexp_extract_all(html, '<a\\s+href="([^"]*)"', 1))) as links
        from pages))""")
def q_html_links(spark, sf_dir):
    pages = Tables(spark, sf_dir).pages
    hrefs = F.array_sort(F.array_distinct(H.links("html")))
    return pages.select("page_id", F.explode(F.slice(hrefs, 2, F.greatest(F.size(hrefs) - 1, F.lit(1))))
                        .alias("href"))
