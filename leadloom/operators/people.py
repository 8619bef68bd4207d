"""People and addresses printed on pages: person-like names, rows of contact tables, street and number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import text as X
from leadloom.operators.identity import name_words
from leadloom.operators.pages import EMAIL, FREEMAIL, PHONE, business_box, places

# A printed name, a role word, a name before a legal form, and the stems of words that are no names.
PAGE_NAME = (
    r"(?:(?:Ing|Bc|Mgr|MUDr|JUDr|Dr|PhDr|Ph\.D|MBA|DiS)\.\s*){0,2}"
    r"([A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ][a-záčďéěíňóřšťúůýž]{2,})\s+"
    r"([A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ][A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽa-záčďéěíňóřšťúůýž]{2,})"
)
PAGE_ROLE = (
    r"(?iu)jednatel(?:ka)?|majitel(?:ka)?|spolumajitel|prokurist|[řr]editel(?:ka)?|CEO|CTO|CFO|vedouc[ií]|"
    r"manaž?er(?:ka)?|obchodn[ií]|v[ýy]robn[ií]|technick|mistr|dispe[čc]er|pl[áa]nova[čc]|p[řr]edseda|[čc]len p[řr]edstavenstva"
)
BEFORE_FORM = r"(?iu)([^.,;:|•\n]{2,60}?)\s*(?:spol\.\s*s\s*r\.\s*o|s\.\s*r\.\s*o|a\.\s*s|v\.\s*o\.\s*s|k\.\s*s|z\.\s*s|s\.p)\.?"
NOT_A_NAME = (
    "velka", "stara", "nova", "nove", "novy", "mesto", "mesta", "obec",
    "praha", "brno", "ostrava", "plzen", "olomouc", "liberec", "tabor",
    "slovensko", "cesko", "ceska", "ceske", "republika", "vyroba",
    "vyrobni", "obchod", "obchodni", "servis", "sklad", "provoz",
    "kancelar", "sidlo", "adresa", "ulice", "namesti", "divize",
    "pobocka", "centrala", "zavod", "stredisko", "oddeleni", "kontakt",
    "telefon", "mobil", "email", "fakturace", "ico", "dic", "spolecnost",
)
LEAD, ROW = 70, 130


def looks_like_person(given: Column, surname: Column, city: Column | None = None) -> Column:
    """Whether two capitalised words can be a person: no word begins with a stem of ``NOT_A_NAME``, and they don't hold the town."""
    g, s = X.fold(given), X.fold(surname)
    fits = ~F.concat_ws(" ", g, s).rlike(r"\b(?:" + "|".join(NOT_A_NAME) + ")")
    if city is None:
        return fits
    town = F.nullif(X.fold(city), F.lit(""))
    return fits & ~F.coalesce(F.contains(F.concat_ws(" ", g, s), town), F.lit(False))


def spots(text: Column, pattern: str) -> Column:
    """All matches of a pattern in a text as structs of ``at`` (from 1) and ``said``, in their order."""
    said = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), 1, F.size(said))
    start = F.array().cast("array<struct<at:int,said:string>>")

    def add(found: Column, pair: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        after = F.coalesce(last["at"] + F.length(last["said"]), F.lit(1))
        return F.array_append(found, F.struct((after + F.length(pair["gap"])).alias("at"), pair["said"].alias("said")))

    return F.aggregate(F.arrays_zip(between.alias("gap"), said.alias("said")), start, add)


def _part(name: Column, group: int) -> Column:
    return F.regexp_extract(name, PAGE_NAME, group)


def person_row(text: Column, at: Column, width: int = ROW) -> Column:
    """The text from ``at`` to the next printed person, ``width`` characters at most: one row of a contact table."""
    window = F.substring(text, at, F.lit(width))
    rest = F.substring(window, F.lit(2), F.lit(width))
    people = F.filter(spots(rest, PAGE_NAME), lambda m: looks_like_person(_part(m["said"], 1), _part(m["said"], 2)))
    return F.coalesce(F.substring(window, F.lit(1), F.get(people, 0)["at"]), window)


def page_people(pages: DataFrame, known: DataFrame, free: Sequence[str] = FREEMAIL) -> DataFrame:
    """People printed beside a role word who are not in the register, with a channel of their own row.

    ``pages``: ico, page_ord, text, domain, city (the last two may be null); ``known``: ico, name.
    Where ``pages`` has the company's name (``company``), a free host's address must be the company's own box.
    The name is the last one in the 70 characters before the role word; the row runs forward from
    the role word to the next person.  An address counts on the company's domain or a free mail
    host if its local part holds the surname (``page``); with a phone number only, the person is
    ``page_weak``; with neither they are left out.  A person's first row in page order stands.
    Null texts have no people.
    """
    folded = F.concat_ws(" ", F.array_sort(F.filter(F.split(X.fold("name"), r"\s+"), lambda w: w != "")))
    register = known.select("ico", folded.alias("person")).distinct()
    company = ["company"] if "company" in pages.columns else []
    found = pages.select("ico", "page_ord", "text", "domain", "city", *company, F.explode(spots(F.col("text"), PAGE_ROLE)).alias("m"))
    found = found.withColumn("at", F.col("m.at")).withColumn("role", F.col("m.said"))
    begin = F.greatest(F.lit(1), F.col("at") - LEAD)
    names = F.regexp_extract_all(F.substring("text", begin, F.col("at") - begin), F.lit(PAGE_NAME), F.lit(0))
    found = found.withColumn("printed", F.try_element_at(names, F.lit(-1))).where("printed is not null")
    found = found.withColumn("given", _part(F.col("printed"), 1)).withColumn("surname", _part(F.col("printed"), 2))
    found = found.where(looks_like_person(F.col("given"), F.col("surname"), F.col("city"))).withColumn("row", person_row(F.col("text"), F.col("at")))
    host = lambda m: F.lower(F.element_at(F.split(m, "@"), -1))
    box = (lambda m: business_box(F.lower(m), F.col("company"))) if "company" in pages.columns else (lambda m: F.lit(True))
    ours = lambda m: F.coalesce(host(m) == F.lower("domain"), F.lit(False)) | (host(m).isin(*free) & box(m))
    mails = F.filter(F.regexp_extract_all("row", F.lit(f"({EMAIL})"), F.lit(1)), lambda m: ours(m) & F.contains(X.fold(F.get(F.split(m, "@"), 0)), X.fold("surname")))
    found = found.withColumn("email", F.get(mails, 0)).withColumn("phone", F.get(F.regexp_extract_all("row", F.lit(f"({PHONE})"), F.lit(1)), 0)).where("email is not null or phone is not null")
    quote = F.trim(F.substring("text", begin, F.col("at") - begin + ROW))
    pair = F.concat_ws(" ", F.array_sort(F.array(X.fold("given"), X.fold("surname"))))
    rows = found.withColumn("person", pair).join(register, ["ico", "person"], "left_anti")
    first = F.min_by(F.struct(F.concat_ws(" ", "given", "surname").alias("name"), "role", "email", "phone", F.when(F.col("email").isNotNull(), "page").otherwise("page_weak").alias("source"), quote.alias("quote")), F.struct("page_ord", "at"))
    return rows.groupBy("ico", "person").agg(first.alias("p")).select("ico", "p.*")


def street_number(pages: DataFrame, companies: DataFrame, reach: int = 40) -> DataFrame:
    """The registered address where a page prints it: street (or, without one, town) and then the number within ``reach`` characters.

    ``pages``: ico, page_ord, text; ``companies``: ico, name, street, number, town.  A place whose
    preceding 80 characters end in another company's name with its legal form is that company's
    address and doesn't count.  The first place of each page is returned with its quote.
    """
    anchor = X.fold(F.coalesce(F.nullif("street", F.lit("")), F.col("town"), F.lit("")))
    wanted = companies.select("ico", "name", F.col("number").cast("string").alias("number"), anchor.alias("anchor")).where("length(anchor) >= 3 and number <> ''")
    rows = pages.join(wanted, "ico").withColumn("low", X.fold("text")).where(F.contains("low", "anchor"))
    rows = rows.withColumn("at", F.explode(places(F.col("anchor"), F.col("low"))))
    end, size = F.col("at") + F.length("anchor"), F.length("anchor")
    near = F.substring("low", end, F.lit(reach))
    rows = rows.where(F.regexp_like(near, F.concat(F.lit(r"\b\Q"), "number", F.lit(r"\E\b"))))
    begin, back = F.greatest(F.lit(1), F.col("at") - 80), F.greatest(F.lit(1), F.col("at") - 20)
    label = F.try_element_at(F.regexp_extract_all(F.substring("text", begin, F.col("at") - begin), F.lit(BEFORE_FORM), F.lit(1)), F.lit(-1))
    joined = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    ours = F.col("name").isNull() | label.isNull() | F.contains(joined(name_words(label)), joined(name_words(F.col("name"))))
    quote = F.trim(F.substring("text", back, F.col("at") - back + size + reach))
    return rows.where(ours).groupBy("ico", "page_ord").agg(F.min_by(quote, "at").alias("quote"))
