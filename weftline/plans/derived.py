"""Messy sources made from `customer` by SQL that Spark and DuckDB both run.

The given tables hold no messy person records, so three extracts are derived from the
customers by arithmetic on their keys: aliases, casings, shapes, junk, blank rows,
repeated headers, rotated rows and copies, all deterministic. Row numbers are ten
times the key plus the kind of row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.runtime import table

FIRST = "Aarav Vivaan Aditya Rohit Kavya Sneha Isha Arjun Nikhil Rahul Tanvi Amit Deepak Priya Neha Karan Meera Sanjay Pooja Varun Anita Ravi Divya"
LAST = "Sharma Verma Gupta Mehta Nair Iyer Reddy Rao Singh Kumar Joshi Patel Shah Chopra Malhotra Agarwal Bose Sen Das Pillai Menon Kapoor Khanna Bhatt Desai Kulkarni Naidu Jain Roy"
TAIL = "a an ar i ish ka ko la li ma mi na ni ra ri sa si ta ti u va vi wal ya yan ze zi o on ul e"


def _pick(words: str, index: str) -> str:
    return f"split_part('{words}', ' ', cast({index} as int) + 1)"


_FIRST, _LAST = _pick(FIRST, "k % 23"), f"{_pick(LAST, '(k * 7) % 29')} || {_pick(TAIL, '(k * 11) % 31')}"


def _cased(shift: int) -> str:
    base = "case when k % 19 = 0 then 'Dr. ' || full_name when k % 17 = 0 then substr(first_name, 1, 1) || '. ' || last_name else full_name end"
    return f"case when (k + {shift}) % 4 = 1 then upper({base}) when (k + {shift}) % 4 = 2 then lower({base}) when (k + {shift}) % 4 = 3 then '  ' || {base} || ' ' else {base} end"


def _city(shift: int) -> str:
    alias = {0: ("Bengaluru", "bangalore", "BLR", "Bengaluru "), 1: ("Gurugram", "GURGAON", "gurugram ", "Gurgaon"), 2: ("Delhi", "New  Delhi", "delhi ncr", "NCR"), 3: ("Noida", "NOIDA", "noida ", "Noida"), 4: ("Pune", "PUNE", " pune", "Pune")}
    rows = " ".join(f"when nation % 5 = {n} and (k + {shift}) % 4 = {i} then '{c}'" for n, names in alias.items() for i, c in enumerate(names))
    return f"case when k % 53 = 0 then 'navi-mumbai' when k % 97 = 0 then '' {rows} else 'Pune' end"


#: Common base; the columns of each source; the structural noise of each source.
BASE = f"""
base0 as (
  select cast(c_custkey as bigint) as k, cast(c_nationkey as bigint) as nation, cast(floor(abs(c_acctbal)) as bigint) as bal from customer
), base1 as (
  select *, {_FIRST} as first_name, {_LAST} as last_name, cast(9000000000 + k as varchar(20)) as ten from base0
), base as (
  select *, first_name || ' ' || last_name as full_name,
    lower(first_name) || '.' || lower(last_name) || cast(k as varchar(20)) || case when k % 41 = 0 then ' at ' else '@' end || 'example.com' as mail,
    case when k % 37 = 0 then '12345' when k % 47 = 0 then '1' || substr(ten, 2, 9) when k % 5 = 0 then '+91' || ten when k % 5 = 1 then ten when k % 5 = 2 then '0' || ten
      when k % 5 = 3 then '91' || ten else '+91-' || ten end as tel,
    1 + k % 28 as d, 1 + (k * 5) % 12 as m, 2026 - k % 2 as y from base1
), s1base as (
  select k, {_cased(0)} as c0, case when k % 43 = 0 then '' when k % 5 = 0 then upper(mail) else mail end as c1, case when k % 49 = 0 then '' else tel end as c2, {_city(0)} as c3,
    case when k % 57 = 0 then 'n/a' when k % 63 = 0 then '77.5' else cast(k % 40 as varchar(20)) || '.' || cast(bal % 10 as varchar(20)) end as c4,
    case when k % 59 = 0 then '-5' when k % 61 = 0 then 'n/a' when k % 67 = 0 then '99,000,000' when k % 4 = 0 then cast(2 + bal % 9 as varchar(20)) || '.' || cast(bal % 10 as varchar(20))
      else cast(100000 + (bal * 97) % 900000 as varchar(20)) end as c5,
    case when k % 71 = 0 then '31-02-2026' when k % 73 = 0 then 'soon' when k % 10 = 0 then cast(y as varchar(20)) || '-' || lpad(cast(m as varchar(20)), 2, '0') || '-' || lpad(cast(d as varchar(20)), 2, '0')
      when k % 10 = 2 then cast(d as varchar(20)) || '-' || cast(m as varchar(20)) || '-' || cast(y as varchar(20))
      when k % 10 = 4 then cast(m as varchar(20)) || '/' || cast(d as varchar(20)) || '/' || cast(y as varchar(20))
      when k % 10 = 6 then lpad(cast(d as varchar(20)), 2, '0') || '/' || lpad(cast(m as varchar(20)), 2, '0') || '/' || cast(y as varchar(20))
      else cast(d as varchar(20)) || ' ' || {_pick('Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec', 'm - 1')} || ' ' || cast(y as varchar(20)) end as c6,
    replace({_pick('n8n LangChain REST~APIs MongoDB SQL MySQL Docker Zapier', 'k % 8')} || ', ' || {_pick('JavaScript React Python Selenium Web~Scraping FastAPI Pandas Rust', '(k * 3) % 8')} || ',  '
      || case when k % 13 = 0 then lower({_pick('n8n LangChain REST~APIs MongoDB SQL MySQL Docker Zapier', 'k % 8')}) else {_pick('Docker sql react REST~API zapier', '(k * 7) % 5')} end, '~', ' ') as c7
  from base where k % 2 = 0
), s2base as (
  select k, case when k % 43 = 0 then '' when k % 3 = 0 and k % 2 = 1 then upper(mail) else mail end as c0, case when k % 79 = 0 then ' ' else {_cased(1)} end as c1,
    case when k % 61 = 0 then '?' when k % 2 = 0 then cast(500 + bal % 1500 as varchar(20)) || '/hr' when k % 7 = 0 then cast(10 + bal % 60 as varchar(20)) || 'K / Month' else cast(10 + bal % 60 as varchar(20)) || '.5k/month' end as c2,
    {_city(1)} as c3, {_pick('Active active ACTIVE Inactive paused retired', 'k % 6')} as c4,
    replace({_pick('n8n langchain rest~apis mongodb sql mysql docker zapier', 'k % 8')} || ', ' || {_pick('javascript react python selenium web~scraping fastapi pandas', '(k * 3) % 7')}, '~', ' ') as c5
  from base where k % 3 = 0
), s3base as (
  select k, {_cased(2)} as c0, tel as c1, {_city(2)} as c2, case when k % 7 = 6 then '' else {_pick('Y Yes yes N No maybe', 'k % 7')} end as c3,
    case when k % 29 = 0 then 'x' when k % 23 = 0 then '3.7' else cast(k % 16 as varchar(20)) end as c4
  from base where k % 5 = 0
), raw1 as (
  select k * 10 as row_no, c0, c1, c2, c3, c4, c5, c6, c7, 8 as width from s1base
  union all select k * 10 + 1, '', ' ', '', '', '', '', '', '', 8 from s1base where k % 200 = 0
  union all select k * 10 + 2, c0, c1, c2, c3, c4, c5, c6, c7, 8 from s1base where k % 110 = 0
  union all select k * 10 + 3, c0, 'alt.' || c1, c2, c3, c4, c5, c6, c7, 8 from s1base where k % 34 = 0 and c1 <> ''
  union all select k * 10 + 4, c0, c1, c2, c3, c4, c5, null, null, 6 from s1base where k % 330 = 0
), raw2 as (
  select k * 10 as row_no, c0, c1, c2, c3, c4, c5, 6 as width from s2base
  union all select k * 10 + 1, 'Email_ID', 'worker_name ', 'rate', 'location', 'status', 'skill_tags', 6 from s2base where k % 300 = 0
  union all select k * 10 + 2, c5, c0, c1, c2, c3, c4, 6 from s2base where k % 90 = 0
  union all select k * 10 + 3, upper(c0), c1, c2, c3, c4, c5, 6 from s2base where k % 210 = 0
), raw3 as (
  select k * 10 as row_no, c0, c1, c2, c3, c4, 5 as width from s3base
  union all select k * 10 + 1, 'NAME', ' Phone Number', 'City', 'Verified', 'Projects Completed', 5 from s3base where k % 250 = 0
  union all select k * 10 + 2, c0, '9' || substr(c1, 2, 30), c2, c3, c4, 5 from s3base where k % 275 = 0
)"""

WIDTH = {"source1": 8, "source2": 6, "source3": 5}


def raw_sql(source: str) -> str:
    n = WIDTH[source]
    return f"with {BASE} select row_no, width, {', '.join(f'c{i}' for i in range(n))} from raw{source[-1]}"


def raw(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """(source, row_no, cells) of one derived source."""
    customer = table(spark, sf_dir, "customer")
    rows = spark.sql(raw_sql(source).replace("from customer", "from {customer}"), customer=customer)
    cells = F.slice(F.array(*[f"c{i}" for i in range(WIDTH[source])]), 1, F.col("width"))
    return rows.select(F.lit(source).alias("source"), "row_no", cells.alias("cells"))


def raw_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {s: raw(spark, sf_dir, s) for s in WIDTH}
