"""Contacts read off stored pages: a company's own addresses and numbers, its people, and the one to name first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import text as X
from leadloom.operators.pages import EMAIL, FREE_HOSTS, business_box, contact_order, personal_address, person_occurrences
from leadloom.operators.people import page_people

# Numbers as they are printed, desks that sell and desks that don't, and what is said of contacts that
# aren't in the register.
PHONE_SHAPE = r"(?:(?:\+|00)420[\s -]?)?(?<!\d)(\d{3}[\s -]?\d{3}[\s -]?\d{3})(?!\d)"
SELLING = ("info", "obchod", "office", "kontakt", "contact", "firma", "sekretariat", "kancelar", "prodej", "sales", "poptavka", "objednavky", "export")
BACK_OFFICE = (
    "efaktury", "faktury", "fakturace", "ucetni", "uctarna", "podatelna", "epodatelna", "gdpr", "kariera", "hr", "praca", "prace", "job", "jobs",
    "webmaster", "admin", "no-reply", "noreply", "newsletter", "spam", "reklamace", "helpdesk", "support", "it",
)
BY_THE_PAGE, ON_THE_PAGE, OF_THE_COMPANY = " — dle webu", "kontakt z webu firmy", "obecný kontakt firmy"


def _first_label(host: Column) -> Column:
    return F.substring_index(host, ".", 1)


def owns(host: Column, good: Column) -> Column:
    """Whether a mail host is a company's: the host itself, one below it, or the same first label under another ending."""
    return F.coalesce((host == good) | F.endswith(host, F.concat(F.lit("."), good)) | (_first_label(host) == _first_label(good)), F.lit(False))


def desk_order(address: Column, domain: Column) -> Column:
    """0 the company's own name, 1 desks that sell, 2 others, 3 back offices."""
    local = F.substring_index(address, "@", 1)
    stem = F.get(F.split(local, "[._-]"), 0)
    plain = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    own = plain(_first_label(F.coalesce(domain, F.lit(""))))
    return F.when((own != "") & (plain(local) == own), 0).when(local.isin(*SELLING) | stem.isin(*SELLING), 1).when(local.isin(*BACK_OFFICE) | stem.isin(*BACK_OFFICE), 3).otherwise(2)


def phone_numbers(text: Column) -> Column:
    """Distinct numbers of a text in one form, in their order."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(PHONE_SHAPE), F.lit(1)), lambda x: F.regexp_replace(x, r"\D", ""))
    formed = F.transform(digits, lambda n: F.concat_ws(" ", F.lit("+420"), F.substring(n, 1, 3), F.substring(n, 4, 3), F.substring(n, 7, 3)))
    return F.array_distinct(formed)


def page_addresses(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """ico, page_ord, pos, address, desk, personal: the company's addresses on each page, each once, at its first place.

    ``pages``: ico, page_ord, text; ``sites``: ico, domain, name.  An address is the company's on its
    domain, on the host that most addresses of the page share (two at least, no free host; of equal
    ones the first on the page), or as its own box at a free host.  Only addresses are shuffled.
    """
    found = pages.select("ico", "page_ord", F.posexplode(F.regexp_extract_all("text", F.lit(f"({EMAIL})"), F.lit(1))).alias("pos", "address"))
    found = found.withColumn("address", F.lower("address")).withColumn("host", F.substring_index("address", "@", -1))
    once = found.groupBy("ico", "page_ord", "host", "address").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    hosts = once.groupBy("ico", "page_ord", "host").agg(F.sum("n").alias("n"), F.min("pos").alias("p"))
    most = hosts.groupBy("ico", "page_ord").agg(F.max(F.struct("n", (-F.col("p")).alias("o"), "host")).alias("m"))
    shared = most.where((F.col("m.n") >= 2) & ~F.col("m.host").isin(*FREE_HOSTS)).select("ico", "page_ord", F.col("m.host").alias("__shared"))
    rows = once.join(sites.select("ico", F.regexp_replace(F.lower("domain"), r"www\.", "").alias("domain"), "name"), "ico").join(shared, ["ico", "page_ord"], "left")
    ours = owns(F.col("host"), F.col("domain")) | owns(F.col("host"), F.col("__shared")) | business_box(F.col("address"), F.col("name"))
    return rows.where(ours).select("ico", "page_ord", "pos", "address", desk_order(F.col("address"), F.col("domain")).alias("desk"), personal_address(F.col("address"), F.col("domain")).alias("personal"))


def page_channels(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """ico, page_ord, emails (by desk, then as printed), personal_emails, phones (as printed) of each page of ``sites``' companies."""
    listed = page_addresses(pages, sites).groupBy("ico", "page_ord").agg(
        F.array_sort(F.collect_list(F.when(~F.col("personal"), F.struct("desk", "pos", "address")))).alias("__general"),
        F.array_sort(F.collect_list(F.when(F.col("personal"), F.struct("pos", "address")))).alias("__own"),
    )
    none = F.array().cast("array<string>")
    addresses = lambda c: F.coalesce(F.transform(c, lambda x: x["address"]), none).alias({"__general": "emails", "__own": "personal_emails"}[c])
    rows = pages.select("ico", "page_ord", phone_numbers(F.col("text")).alias("phones")).join(sites.select("ico"), "ico", "left_semi")
    return rows.join(listed, ["ico", "page_ord"], "left").select("ico", "page_ord", addresses("__general"), addresses("__own"), "phones")


def _by_page() -> Column:
    """A page as the unit to which names and texts belong."""
    return F.concat_ws("/", "ico", F.col("page_ord").cast("string"))


def reachable_people(pages: DataFrame, sites: DataFrame, register: DataFrame) -> DataFrame:
    """ico, page_ord, name, role, email, phone, source: people with a channel of their own on each page.

    ``register``: ico, name, role, born.  Those of the register (``register``) are sought by name;
    nothing is given to two people of one name (unlike days of birth), nor to one whose surname is
    part of the company's name.  Others are printed beside a role word (``page``, ``page_weak``).
    """
    surname = F.element_at(F.filter(F.split(F.trim(X.fold("name")), r"\s+"), lambda w: w != ""), -1)
    twins = register.groupBy("ico", X.fold("name").alias("__name")).agg(F.count_distinct("born").alias("__born")).where("__born > 1")
    firm = sites.select("ico", F.regexp_replace(X.fold(F.coalesce("name", F.lit(""))), "[^a-z]", "").alias("__firm"))
    told = register.where("trim(name) <> ''").withColumn("__name", X.fold("name")).join(twins.select("ico", "__name"), ["ico", "__name"], "left_anti")
    told = told.join(firm, "ico").where(~F.contains("__firm", surname)).groupBy("ico", "name").agg(F.min("role").alias("role"))
    where = pages.select("ico", "page_ord").withColumn("page", _by_page())
    sought = told.join(where, "ico").select(F.col("page").alias("ico"), "name")
    keyed = pages.join(sites.select("ico", F.lower("domain").alias("domain"), F.col("name").alias("company"), "city"), "ico").select(_by_page().alias("ico"), "page_ord", "text", "domain", "company", "city")
    named = person_occurrences(keyed, sought).where("email is not null or phone is not null").select(F.col("ico").alias("page"), "name", "email", "phone", F.lit("register").alias("source"))
    known = register.select("ico", "name").join(where, "ico").select(F.col("page").alias("ico"), "name")
    others = page_people(keyed, known, free=FREE_HOSTS).withColumnRenamed("ico", "page")
    rows = named.join(where, "page").join(told, ["ico", "name"], "left").select("ico", "page_ord", "name", "role", "email", "phone", "source")
    return rows.unionByName(others.join(where, "page").select("ico", "page_ord", "name", "role", "email", "phone", "source"))


def company_contacts(pages: DataFrame, sites: DataFrame, register: DataFrame) -> DataFrame:
    """One row for each row of ``sites`` (one a company): ico, status, page_ord, emails, personal_emails, phones, people.

    ``pages``: ico, page_ord, kind, text; ``sites``: ico, name, city, domain, status.  Only pages of
    proven domains are read; without one the status is ``no_site``, without a page that has text
    ``unreachable``.  All is of one page, the one with most people reached (ten each), addresses and
    numbers; of equal ones that whose kind comes first, then the first.  People of the register
    come first, then by name; those without a channel aren't listed.
    """
    proven = sites.where("status = 'proven' and coalesce(domain, '') <> ''").select("ico", "name", "city", "domain")
    read = pages.where("coalesce(text, '') <> ''").join(proven.select("ico"), "ico", "left_semi")
    person = F.struct((F.col("source") != "register").alias("other"), "name", "role", "email", "phone", "source")
    people = reachable_people(read, proven, register).groupBy("ico", "page_ord").agg(F.array_sort(F.collect_list(person)).alias("people"))
    rows = page_channels(read, proven).join(people, ["ico", "page_ord"], "left").join(read.select("ico", "page_ord", "kind"), ["ico", "page_ord"])
    reached = F.coalesce(F.size("people"), F.lit(0)) * 10 + F.size("emails") + F.size("phones")
    order = F.struct(reached.alias("score"), (-contact_order(F.col("kind"))).alias("k"), (-F.col("page_ord")).alias("o"))
    best = rows.groupBy("ico").agg(F.max_by(F.struct("page_ord", "emails", "personal_emails", "phones", "people"), order).alias("b")).select("ico", "b.*")
    status = F.when((F.col("status") != "proven") | F.col("status").isNull() | (F.coalesce("domain", F.lit("")) == ""), "no_site").when(F.col("page_ord").isNull(), "unreachable").otherwise("ok")
    joined = sites.select("ico", "status", "domain").join(best, "ico", "left")
    listed = lambda c: F.coalesce(F.col(c), F.array().cast(best.schema[c].dataType)).alias(c)
    return joined.select("ico", status.alias("status"), "page_ord", *[listed(c) for c in ("emails", "personal_emails", "phones", "people")])


def best_contact() -> Column:
    """The contact to name: a register person with a channel, else one of the page, else the company's own channel; or null."""
    told = lambda name, role, email, phone: F.struct(name.alias("name"), role.alias("role"), email.alias("email"), phone.alias("phone"))
    nobody = F.lit(None).cast("string")
    p = F.get(F.filter("people", lambda x: x["source"] == "register"), 0)
    w = F.get(F.filter("people", lambda x: x["source"] != "register"), 0)
    email, phone = F.coalesce(F.get("emails", 0), F.get("personal_emails", 0)), F.get("phones", 0)
    role = F.when(F.coalesce(w["role"], F.lit("")) != "", F.concat(w["role"], F.lit(BY_THE_PAGE))).otherwise(ON_THE_PAGE)
    return (
        F.when(p.isNotNull(), told(p["name"], F.coalesce(p["role"], F.lit("")), p["email"], p["phone"]))
        .when(w.isNotNull(), told(w["name"], role, w["email"], w["phone"]))
        .when(email.isNotNull() | phone.isNotNull(), told(nobody, F.lit(OF_THE_COMPANY), email, phone))
    )
