"""The driver's tables seen as domain tables, in Spark, and as SQL for the oracle.

Each function gives one domain table; SQL holds the same definition as a common table
expression.  ``AS_OF`` is the day from which ages count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadloom.functions import text as X

AS_OF = "2024-01-31"
BANDS = ("110", "120", "130", "210", "220", "230", "240", "310", "320", "330")
FORMS = ("112", "121", "331", "112", "121")
#: Days by which dates of the tables are moved, so that each feed has its usual lag.
VACANCY_SHIFT, SUBSIDY_SHIFT, TENDER_SHIFT = 8208, 8088, 8238
KINDS = {"signup": "director_joined", "error": "director_departed", "purchase": "owner_joined", "view": "owner_departed", "click": "director_departed"}
GROUPS = ("1311", "1321")
RULES = (
    ("already_buying", r"\bred\b"), ("research", r"\bold\b"), ("marketing", r"\bblue\b"),
    ("production_digitalisation", r"\bnew\b"), ("energy", r"\bhot\b"), ("capacity", r"\blarge\b"),
)
SIGNAL = ("production_digitalisation", "capacity")
LIVE = ("A", "N")


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A driver's table; its schema is read from the files once a process."""
    path = f"{d}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def company(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    code = F.lpad((k * 7919 % 100000).cast("string"), 5, "0")
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    some = k % 13 != 0
    return rows.select(
        F.lpad(k.cast("string"), 8, "0").alias("ico"),
        F.when(k % 41 == 0, F.concat("c_name", F.lit(" v likvidaci"))).otherwise(F.col("c_name")).alias("name"),
        F.col("r_name").alias("region"),
        F.concat(F.lit("CZ0"), F.lpad((k % 14).cast("string"), 2, "0"), (k % 7).cast("string")).alias("district"),
        F.when(k % 29 == 0, "").when(k % 17 == 0, F.substring(code, 1, 2)).otherwise(code).alias("nace"),
        F.when(k % 11 == 0, "").otherwise(F.get(F.array(*map(F.lit, BANDS)), (k % 11 - 1).cast("int"))).alias("band"),
        F.get(F.array(*map(F.lit, FORMS)), (k % 5).cast("int")).alias("form"),
        F.when(some, 48.6 + (k * 37 % 250) / 100).alias("lat"),
        F.when(some, 12.1 + (k * 53 % 670) / 100).alias("lon"),
        F.when(k % 23 == 0, F.lit("2023-01-01").cast("date")).alias("ended"),
        (k % 37 == 0).alias("insolvent"),
        F.date_sub(F.lit("2024-01-10").cast("date"), (k * 13 % 900).cast("int")).alias("founded"),
        F.when(k % 3 == 0, "proven").when(k % 3 == 1, "probable").otherwise("not_found").alias("site_status"),
        (k % 4 != 0).alias("has_channel"),
    )


def site(spark: SparkSession, d: str) -> DataFrame:
    """Establishments, one to a supplier, two to a company."""
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.lpad((F.floor(s / 2) * 7).cast("string"), 8, "0").alias("ico"), s.alias("pos"), (48.6 + (s * 37 % 250) / 100).alias("lat"), (12.1 + (s * 53 % 670) / 100).alias("lon"), (s % 3 != 0).alias("active")
    )


def movement(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    rows = table(spark, d, "events")
    return rows.select(
        "event_id", F.lpad((F.col("user_id") * 10 + F.col("event_id") % 10).cast("string"), 8, "0").alias("ico"), kinds[F.col("event_type")].alias("kind"),
        F.concat(F.lit("P"), (F.regexp_extract("props", r'"k": (\d+)', 1).cast("int") % 4).cast("string")).alias("name"),
        F.col("ts").cast("date").alias("date"), (F.col("event_id") % 3 == 0).alias("legal_entity"),
    )


def listed(spark: SparkSession, d: str) -> DataFrame:
    """People still in the register, by role."""
    return table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("ico"), F.lit("director").alias("role"), F.concat(F.lit("p"), (F.col("c_custkey") % 9).cast("string")).alias("name"))


def _vacancies(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("ico"), F.date_add(F.col("o_orderdate").cast("date"), VACANCY_SHIFT).alias("date"),
        F.concat(F.lit("CzIsco/13"), F.substring("o_orderpriority", 1, 1), F.lit("10")).alias("isco"), F.concat(F.lit("job "), F.col("o_orderkey").cast("string")).alias("title"),
    )


def vacancies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "orders")
    return _vacancies(rows.where("o_orderkey % 2 = 0")), _vacancies(rows)


def subsidy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("ico"), F.date_add(F.col("l_shipdate").cast("date"), SUBSIDY_SHIFT).alias("signed"),
        F.col("l_returnflag").alias("state"), F.col("p_name").alias("project"), F.col("p_type").alias("description"), F.col("l_extendedprice").alias("total"),
    )


def tender(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("ico"), F.col("o_orderkey").alias("number"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"),
        F.date_add(F.col("o_orderdate").cast("date"), TENDER_SHIFT).alias("deadline"), F.substring("o_orderpriority", 1, 1).isin("1", "2").alias("relevant"),
    )


def delivered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    return rows.select(
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("ico"), F.col("o_orderkey").alias("run_id"), F.date_add(F.col("o_orderdate").cast("date"), VACANCY_SHIFT).alias("delivered_on")
    )


def change(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "INS").when(F.col("event_type") == "error", "DEL").otherwise("UPD")
    rows = table(spark, d, "events")
    return rows.select(F.lpad((F.col("user_id") * 20 + F.col("event_id") % 10 * 2).cast("string"), 8, "0").alias("ico"), kind.alias("kind"), F.dayofmonth("ts").alias("batch"), F.col("event_id").alias("pos"), "ts")


def snapshot(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    url = F.when(i % 19 != 0, F.concat_ws("/", F.col("source"), (i % 7).cast("string")))
    return table(spark, d, "documents").select(
        i.alias("id"), F.col("source").alias("ico"), F.col("lang").alias("source"), url.alias("url"),
        F.date_add(F.lit("2023-01-01").cast("date"), (i % 300).cast("int")).alias("fetched_at"), "text",
    )


def finding(spark: SparkSession, d: str) -> DataFrame:
    """Quotes to verify: as they are, wrapped, with an ellipsis, in small letters, without a quote."""
    i, q = F.col("item_id"), F.col("text")
    form = F.when(i % 5 == 0, q).when(i % 5 == 1, F.concat(F.lit("„"), q, F.lit("“"))).when(i % 5 == 2, F.concat(q, F.lit("..."))).when(i % 5 == 3, F.lower(q))
    return table(spark, d, "benchmark").select(i.alias("finding_id"), form.alias("quote"))


def claim(spark: SparkSession, d: str) -> DataFrame:
    """Claims from labelled documents: relevance by label, three runs, quotes that recur."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    quote = F.when(i % 4 != 0, F.concat(F.regexp_replace("text", "[\n]", " "), F.when(i % 3 == 0, ".").otherwise("")))
    return rows.select(
        i.alias("claim_id"), F.col("source").alias("ico"),
        F.when(i % 6 == 0, "pain").when(i % 6 == 1, "pain:scale").when(i % 6 == 2, "production_mode:serial").when(i % 6 == 3, "production_mode:made_to_order").when(i % 6 == 4, "now:x").otherwise("pain:other").alias("kind"),
        F.when(i % 8 == 0, "údaj není uveden").otherwise(F.concat(F.lit("value "), (i % 50).cast("string"))).alias("value"),
        quote.alias("quote"), F.when(quote.isNull(), "inference").otherwise("fact").alias("state"), (i % 3).alias("run_id"),
        F.when(F.col("toxic") == 1, "unrelated").when(F.col("quality") == 1, "supports").alias("relevance"),
    )


def website(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.operators.pages import host

    i = F.col("page_id")
    evidence = F.get(F.array(*map(F.lit, ("ico", "person", "address", "name_city", "name"))), (i % 5).cast("int"))
    return table(spark, d, "pages").select(F.lpad(i.cast("string"), 8, "0").alias("ico"), host(F.col("url")).alias("domain"), evidence.alias("evidence"), F.when(i % 6 == 5, "no_lead").otherwise("proven").alias("status"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _kinds() -> str:
    return "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"


_PAD = "lpad(CAST({} AS VARCHAR), 8, '0')"
SQL = {
    "company": f"""SELECT {_PAD.format('c_custkey')} AS ico, CASE WHEN c_custkey % 41 = 0 THEN c_name || ' v likvidaci' ELSE c_name END AS name, r_name AS region,
        'CZ0' || lpad(CAST(c_custkey % 14 AS VARCHAR), 2, '0') || CAST(c_custkey % 7 AS VARCHAR) AS district,
        CASE WHEN c_custkey % 29 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN substr(lpad(CAST(c_custkey * 7919 % 100000 AS VARCHAR), 5, '0'), 1, 2) ELSE lpad(CAST(c_custkey * 7919 % 100000 AS VARCHAR), 5, '0') END AS nace,
        CASE WHEN c_custkey % 11 = 0 THEN '' ELSE ({_list(BANDS)})[CAST(c_custkey % 11 AS INTEGER)] END AS band, ({_list(FORMS)})[CAST(c_custkey % 5 + 1 AS INTEGER)] AS form,
        CASE WHEN c_custkey % 13 <> 0 THEN CAST(48.6 AS DOUBLE) + CAST(c_custkey * 37 % 250 AS DOUBLE) / 100 END AS lat, CASE WHEN c_custkey % 13 <> 0 THEN CAST(12.1 AS DOUBLE) + CAST(c_custkey * 53 % 670 AS DOUBLE) / 100 END AS lon,
        CASE WHEN c_custkey % 23 = 0 THEN DATE '2023-01-01' END AS ended, c_custkey % 37 = 0 AS insolvent, DATE '2024-01-10' - CAST(c_custkey * 13 % 900 AS INTEGER) AS founded,
        CASE c_custkey % 3 WHEN 0 THEN 'proven' WHEN 1 THEN 'probable' ELSE 'not_found' END AS site_status, c_custkey % 4 <> 0 AS has_channel
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "site": f"""SELECT {_PAD.format('s_suppkey // 2 * 7')} AS ico, s_suppkey AS pos, CAST(48.6 AS DOUBLE) + CAST(s_suppkey * 37 % 250 AS DOUBLE) / 100 AS lat,
        CAST(12.1 AS DOUBLE) + CAST(s_suppkey * 53 % 670 AS DOUBLE) / 100 AS lon, s_suppkey % 3 <> 0 AS active FROM supplier""",
    "movement": f"""SELECT event_id, {_PAD.format('user_id * 10 + event_id % 10')} AS ico, {_kinds()} AS kind, 'P' || CAST(CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) % 4 AS VARCHAR) AS name,
        CAST(ts AS DATE) AS date, event_id % 3 = 0 AS legal_entity FROM events""",
    "listed": f"SELECT {_PAD.format('c_custkey')} AS ico, 'director' AS role, 'p' || CAST(c_custkey % 9 AS VARCHAR) AS name FROM customer",
    "vacancy": f"""SELECT {_PAD.format('o_custkey')} AS ico, CAST(o_orderdate AS DATE) + {VACANCY_SHIFT} AS date, '13' || substr(o_orderpriority, 1, 1) || '1' AS occupation, 'job ' || CAST(o_orderkey AS VARCHAR) AS title, o_orderkey FROM orders""",
    "subsidy": f"""SELECT {_PAD.format('o_custkey')} AS ico, CAST(l_shipdate AS DATE) + {SUBSIDY_SHIFT} AS signed, l_returnflag AS state, p_name AS project, p_type AS description, l_extendedprice AS total
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "tender": f"""SELECT {_PAD.format('o_custkey')} AS ico, o_orderkey AS number, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS status,
        CAST(o_orderdate AS DATE) + {TENDER_SHIFT} AS deadline, substr(o_orderpriority, 1, 1) IN ('1', '2') AS relevant FROM orders""",
    "delivered": f"SELECT {_PAD.format('o_custkey')} AS ico, o_orderkey AS run_id, CAST(o_orderdate AS DATE) + {VACANCY_SHIFT} AS delivered_on FROM orders",
    "change": f"""SELECT {_PAD.format('user_id * 20 + event_id % 10 * 2')} AS ico, CASE event_type WHEN 'signup' THEN 'INS' WHEN 'error' THEN 'DEL' ELSE 'UPD' END AS kind, CAST(day(ts) AS INTEGER) AS batch, event_id AS pos, ts FROM events""",
    "snapshot": """SELECT doc_id AS id, source AS ico, lang AS source, CASE WHEN doc_id % 19 <> 0 THEN source || '/' || CAST(doc_id % 7 AS VARCHAR) END AS url, DATE '2023-01-01' + CAST(doc_id % 300 AS INTEGER) AS fetched_at, text FROM documents""",
    "finding": """SELECT item_id AS finding_id, CASE item_id % 5 WHEN 0 THEN text WHEN 1 THEN '„' || text || '“' WHEN 2 THEN text || '...' WHEN 3 THEN lower(text) END AS quote, text AS plain FROM benchmark""",
    "claim": """SELECT doc_id AS claim_id, source AS ico, CASE doc_id % 6 WHEN 0 THEN 'pain' WHEN 1 THEN 'pain:scale' WHEN 2 THEN 'production_mode:serial' WHEN 3 THEN 'production_mode:made_to_order' WHEN 4 THEN 'now:x' ELSE 'pain:other' END AS kind,
        CASE WHEN doc_id % 8 = 0 THEN 'údaj není uveden' ELSE 'value ' || CAST(doc_id % 50 AS VARCHAR) END AS value,
        CASE WHEN doc_id % 4 <> 0 THEN replace(text, chr(10), ' ') || CASE WHEN doc_id % 3 = 0 THEN '.' ELSE '' END END AS quote, CASE WHEN doc_id % 4 = 0 THEN 'inference' ELSE 'fact' END AS state,
        doc_id % 3 AS run_id, CASE WHEN toxic = 1 THEN 'unrelated' WHEN quality = 1 THEN 'supports' END AS relevance FROM documents JOIN labels USING (doc_id)""",
    "website": f"""SELECT {_PAD.format('page_id')} AS ico, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS domain,
        (['ico', 'person', 'address', 'name_city', 'name'])[CAST(page_id % 5 + 1 AS INTEGER)] AS evidence, CASE WHEN page_id % 6 = 5 THEN 'no_lead' ELSE 'proven' END AS status FROM pages""",
}


def with_sql(body: str, *names: str, **more: str) -> str:
    """A query over domain tables and further named steps."""
    steps = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(steps)} {body}"
