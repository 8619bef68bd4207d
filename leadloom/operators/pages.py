"""Stored web pages: text, links and their kinds, contacts, and graded proof of identity."""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leadloom.functions import text as X

#: Kinds of pages by words in address or label, in this order, and links kept of each (fixed values).
KINDS = (
    ("contact", r"(?i)kontakt|contact"), ("about", r"(?i)o-nas|about|spolecnost|company"), ("career", r"(?i)karier|career|prace|jobs?\b"),
    ("production", r"(?i)vyrob|product"), ("quality", r"(?i)kvalit|certifik|quality|iso"), ("news", r"(?i)aktualit|news|blog"),
)
BUDGET = {"contact": 5, "about": 2, "career": 2, "production": 3, "quality": 2, "news": 1, "other": 3}
#: Addresses in texts (a fixed value), and numbers.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d \-/]{7,14}\d"
FREEMAIL = ("seznam.cz", "gmail.com", "email.cz", "centrum.cz", "volny.cz", "post.cz", "outlook.com", "hotmail.com")


def page_text(html: Column) -> Column:
    """Readable text: scripts, styles and tags out, common entities decoded, blanks squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return X.normalise(bare)


# Markup that isn't shown, the declaration of a charset and how far it is looked for, encodings tried where
# none is declared, and the attribute that hides an address.
_UNSHOWN = re.compile(r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->")
_DECLARED = re.compile(rb"(?is)<meta[^>]+charset=[\"']?\s*([\w-]+)")
DECLARED_WITHIN = 4096
ENCODINGS = ("utf-8", "windows-1250", "iso-8859-2")
_HIDDEN_ADDRESS = re.compile(r'<[^>]*\bdata-cfemail="([0-9a-fA-F]{6,})"[^>]*>')


def decoded(body: bytes) -> str:
    """A page's letters: by the charset that it declares, if it is known, else the first encoding that fits."""
    told = _DECLARED.search(body[:DECLARED_WITHIN])
    if told:
        try:
            return body.decode(told[1].decode("ascii"), "replace")
        except LookupError:
            pass
    for encoding in ENCODINGS:
        try:
            return body.decode(encoding)
        except UnicodeDecodeError:
            continue
    return body.decode("utf-8", "replace")


def shown_address(blob: str) -> str:
    """An address that is hidden as hexadecimal bytes, each combined with the first."""
    key, *rest = bytes.fromhex(blob[: len(blob) // 2 * 2])
    return "".join(chr(x ^ key) for x in rest)


def readable(markup: str) -> str:
    """Visible text with hidden addresses and all entities restored before the markup goes, blanks squeezed."""
    restored = _HIDDEN_ADDRESS.sub(lambda m: f" {shown_address(m[1])} ", markup)
    plain = re.sub(r"(?s)<[^>]+>", " ", _UNSHOWN.sub(" ", html_entities.unescape(restored)))
    return " ".join(plain.split())


def page_texts(pages: DataFrame, body_col: str = "html", out: str = "page_text") -> DataFrame:
    """All columns of ``pages`` and ``out``, the readable text of stored page bodies (bytes, or text already decoded).

    A null body gives a null text.  A column that is named ``out`` is replaced.
    """
    others = pages.drop(out) if out != body_col else pages
    is_text = isinstance(others.schema[body_col].dataType, StringType)
    at = others.columns.index(body_col)
    schema = StructType([*others.schema.fields, StructField("__text", StringType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                bodies = part.column(at).to_pylist()
                texts = [None if b is None else readable(b if is_text else decoded(b)) for b in bodies]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "__text"])

    made = others.mapInArrow(add, schema)
    return made.select(*[c for c in others.columns if c != out], F.col("__text").alias(out))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, label of the links of each page, first of each address, in order."""
    pattern = F.lit(r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>")
    pairs = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("href"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("label"))
    rows = pages.select("page_id", F.posexplode(pairs).alias("pos", "link"))
    rows = rows.select("page_id", "pos", F.col("link.href").alias("href"), X.normalise(F.regexp_replace(F.col("link.label"), r"(?s)<[^>]*>", " ")).alias("label"))
    first = rows.groupBy("page_id", "href").agg(F.min(F.struct("pos", "label")).alias("b"))
    return first.select("page_id", F.col("b.pos").alias("pos"), "href", F.col("b.label").alias("label"))


def link_kind(href: Column, label: Column) -> Column:
    return X.classify(F.concat_ws(" ", href, label), KINDS)


def link_budget(found: DataFrame) -> DataFrame:
    """The links worth fetching: per page and kind the first few in page order."""
    rows = found.withColumn("kind", link_kind(F.col("href"), F.col("label")))
    most = F.create_map(*[F.lit(x) for p in BUDGET.items() for x in p])[F.col("kind")]
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("pos")))
    return ranked.where(F.col("n") <= most)


def emails(documents: DataFrame) -> DataFrame:
    """id, address, host of the distinct addresses of each text."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"({EMAIL})"), F.lit(1)), F.lower))
    return documents.select("id", F.explode(found).alias("address")).withColumn("mail_host", F.element_at(F.split("address", "@"), -1))


def phones(documents: DataFrame) -> DataFrame:
    """id, phone: digits of the numbers of each text; too short, and one digit repeated, are out."""
    digits = F.transform(F.regexp_extract_all("text", F.lit(f"({PHONE})"), F.lit(1)), lambda x: F.regexp_replace(x, r"[^\d]", ""))
    rows = documents.select("id", F.explode(F.array_distinct(digits)).alias("phone"))
    return rows.where((F.length("phone") >= 9) & ~F.col("phone").rlike(r"^(\d)\1*$"))


def dominant_mail_host(found: DataFrame, key: str) -> DataFrame:
    """The host that most addresses of a key share: two at least, no free mail; ties by name."""
    counts = found.where(~F.col("mail_host").isin(*FREEMAIL)).groupBy(key, "mail_host").agg(F.count_distinct("address").alias("n")).where("n >= 2")
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "mail_host")).alias("b"))
    return best.select(key, F.col("b.mail_host").alias("mail_host"), (-F.col("b.m")).alias("n"))


def desk_rank(address: Column) -> Column:
    """0 selling desks, 1 general ones, 2 others, 3 back offices."""
    local = F.split(address, "@")[0]
    return F.when(local.rlike(r"^(obchod|sales|prodej)"), 0).when(local.rlike(r"^(info|office|kontakt|mail)"), 1).when(local.rlike(r"^(faktur|efaktur|ucto|billing|gdpr|hr)"), 3).otherwise(2)


#: Runs of digits that may be a company's number, plain and as a VAT number.
NUMBER_RUN, VAT_RUN = r"(?U)(\d[\d\s.]{6,12}\d)", r"(?Ui)CZ\s?(\d[\d\s]{6,11})"


def shows_number(text: Column, ico: Column) -> Column:
    """Whether one run of digits of a text is the company's number, with or without its leading zeros, or its VAT number."""
    runs = F.concat(F.regexp_extract_all(text, F.lit(NUMBER_RUN), F.lit(1)), F.regexp_extract_all(text, F.lit(VAT_RUN), F.lit(1)))
    return F.exists(F.transform(runs, lambda r: F.regexp_replace(r, r"(?U)\D", "")), lambda r: (r == ico) | (r == F.ltrim(ico, F.lit("0"))))


def page_proof(pages: DataFrame, companies: DataFrame) -> DataFrame:
    """Per company and site the best proof that the site is the company's.

    ``pages``: ico (claimed), page_ord, text.  Its number on any page wins outright, on
    the earliest such page; else a person (if the town is on the site), else the address,
    else name and town or the name alone on the first page that has it.
    """
    body = X.fold("text")
    rows = pages.join(companies.select("ico", "name", "city", "person", "street"), "ico")
    has = lambda col, least=3: (F.length(col) >= least) & F.contains(body, X.fold(col))
    rows = rows.select(
        "ico", "page_ord", shows_number(F.col("text"), F.col("ico")).alias("number"), has("person").alias("person"), has("street").alias("street"), has("name", 4).alias("name"), has("city").alias("city")
    )
    town = F.bool_or("city").over(Window.partitionBy("ico")).alias("town")
    graded = rows.select("*", town).select("ico", "page_ord", F.inline(F.filter(F.array(
        F.when(F.col("number"), F.struct(F.lit(0).alias("grade"), F.lit("ico").alias("evidence"))),
        F.when(F.col("person") & F.col("town"), F.struct(F.lit(1).alias("grade"), F.lit("person").alias("evidence"))),
        F.when(F.col("street"), F.struct(F.lit(2).alias("grade"), F.lit("address").alias("evidence"))),
        F.when(F.col("name"), F.struct(F.lit(3).alias("grade"), F.when(F.col("city"), "name_city").otherwise("name").alias("evidence"))),
    ), lambda x: x.isNotNull())))
    best = graded.groupBy("ico").agg(F.min(F.struct("grade", "page_ord", "evidence")).alias("b"))
    return best.select("ico", F.col("b.evidence").alias("evidence"), F.col("b.page_ord").alias("page_ord"))


def standards(documents: DataFrame) -> DataFrame:
    """id, standard, quote: named standards, the first mention of each."""
    found = F.regexp_extract_all("text", F.lit(r"((?:ISO|EN|IATF)\s?\d{4,5}(?::\d{4})?)"), F.lit(1))
    rows = documents.select("id", "text", F.posexplode(found).alias("pos", "standard"))
    rows = rows.withColumn("standard", F.regexp_replace(F.upper("standard"), r"\s", ""))
    first = rows.groupBy("id", "standard").agg(F.min(F.struct("pos", "text")).alias("b"))
    return first.select("id", "standard", F.col("b.pos").alias("pos"))


def mode_findings(documents: DataFrame, patterns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """id, side, kind, hits: matches of each (side, kind, pattern) in each text; kinds are direct and structural."""
    counts = [F.struct(F.lit(side).alias("side"), F.lit(kind).alias("kind"), F.regexp_count("text", F.lit(p)).alias("hits")) for side, kind, p in patterns]
    return documents.select("id", F.inline(F.array(*counts))).where("hits > 0")


#: Labels of revenue rows, the older wording last (fixed values).
REVENUE_LABELS = (("trzby", r"(?iU)tržby(?: z prodeje)?"), ("obrat", r"(?iU)obrat"), ("vykony", r"(?iU)výkony"))
NUMBER = r"(\d{1,3}(?: \d{3})+|\d{2,})"


def revenue_windows(documents: DataFrame, width: int = 60) -> DataFrame:
    """id, label, pos, quote, numbers: text after each revenue label and the numbers in it."""

    def windows(name: str, pattern: str) -> Column:
        quotes = F.regexp_extract_all("text", F.lit(f"((?:{pattern}).{{0,{width}}})"), F.lit(1))
        return F.transform(quotes, lambda q: F.struct(F.lit(name).alias("label"), q.alias("quote")))

    labelled = [windows(name, pattern) for name, pattern in REVENUE_LABELS]
    rows = documents.select("id", F.posexplode(F.concat(*labelled)).alias("pos", "w"))
    numbers = F.transform(F.regexp_extract_all("w.quote", F.lit(NUMBER), F.lit(1)), lambda x: F.replace(x, F.lit(" "), F.lit("")).try_cast("long"))
    return rows.select("id", F.col("w.label").alias("label"), "pos", F.col("w.quote").alias("quote"), numbers.alias("numbers")).where(F.size("numbers") > 0)


def places(name: Column, text: Column) -> Column:
    """Positions, from 1, of all places of a name in a text; an empty name has the first one."""
    between = F.split(text, F.concat(F.lit(r"\Q"), name, F.lit(r"\E")), -1)
    start = F.array().cast("array<int>")
    after = lambda found: F.coalesce(F.try_element_at(found, F.lit(-1)) + F.length(name), F.lit(1))
    found = F.aggregate(F.slice(between, 1, F.size(between) - 1), start, lambda found, part: F.array_append(found, after(found) + F.length(part)))
    return F.when(name == "", F.array(F.lit(1))).otherwise(found)


#: Words that name a role on the board or in management.
ROLE = r"(?iU)jednatel|ředitel|majitel|vedoucí|manager|director|ceo"


def person_occurrences(pages: DataFrame, people: DataFrame, width: int = 120) -> DataFrame:
    """Each person's best place on the company's pages, with the address and phone beside the name.

    ``pages``: ico, page_ord, text; ``people``: ico, name.  A place is one of the surname;
    what belongs to it is read forward from there.  It scores 4 if the given name stands
    before it, 3 for an address that names the person, 2 for a role word, 1 for a phone
    number; a place with neither address, role nor phone doesn't count, of equal ones the
    first wins.  An address of the bare surname is ``ambiguous`` where colleagues share
    the surname, and scores nothing; of two people with one name (``born`` tells them
    apart) only places with the given name count.
    """
    words = F.filter(F.split(F.trim(X.fold("name")), r"\s+"), lambda w: w != "")
    several = F.count_distinct("born") if "born" in people.columns else F.lit(1)
    named = people.groupBy("ico", "name").agg(several.alias("persons")).select("ico", "name", "persons", F.get(words, 0).alias("given"), F.element_at(words, -1).alias("surname")).where("surname <> ''")
    shared = F.count("*").over(Window.partitionBy("ico", "surname")) > 1
    board = named.select("*", shared.alias("shared"))
    found = pages.join(board, "ico").where(F.contains(X.fold("text"), F.col("surname")))
    found = found.withColumn("at", F.explode(places(F.col("surname"), X.fold("text"))))
    before = F.substring(X.fold("text"), F.greatest(F.lit(1), F.col("at") - 40), F.least(F.col("at") - 1, F.lit(40)))
    segment = F.substring("text", F.col("at"), F.length("surname") + width)
    rows = found.select("ico", "name", "given", "surname", "persons", "shared", "page_ord", "at", F.endswith(F.rtrim(before), F.col("given")).alias("named"), segment.alias("near"))
    mail = F.filter(F.regexp_extract_all("near", F.lit(f"({EMAIL})"), F.lit(1)), lambda m: F.contains(X.fold(m), F.col("surname")))
    rows = rows.where("named or persons <= 1").withColumn("email", F.get(mail, 0)).withColumn("phone", F.get(F.regexp_extract_all("near", F.lit(f"({PHONE})"), F.lit(1)), 0)).withColumn("role", F.col("near").rlike(ROLE))
    ambiguous = F.col("shared") & F.coalesce(~F.contains(F.split("email", "@")[0], F.lit(".")), F.lit(False))
    one = lambda test, n: F.when(test, n).otherwise(0)
    score = one(F.col("named"), 4) + one(F.col("email").isNotNull() & ~ambiguous, 3) + one(F.col("role"), 2) + one(F.col("phone").isNotNull(), 1)
    told = rows.where("email is not null or phone is not null or role")
    best = told.groupBy("ico", "name").agg(F.max(F.struct(score.alias("score"), (-F.col("page_ord")).alias("o"), (-F.col("at")).alias("a"), "email", "phone", ambiguous.alias("ambiguous"))).alias("b"))
    return best.select("ico", "name", F.col("b.score").alias("score"), (-F.col("b.o")).alias("page_ord"), "b.email", "b.phone", "b.ambiguous")


#: Signs of a page that nobody has filled, names of desks, and the order of pages that hold contacts.
PARKED = (
    r"(?iU)doména\s+je\s+na\s+prodej|tato\s+doména|domain\s+(?:is\s+)?for\s+sale|připravujeme|stránky\s+se\s+připravují|under\s+construction|"
    r"default\s+web\s+page|it\s+works!|welcome\s+to\s+nginx|apache2?\s+default"
)
DESKS = (
    "info", "obchod", "office", "sekretariat", "podatelna", "firma", "kancelar", "prodej", "servis", "mail", "post", "sales",
    "export", "import", "fakturace", "faktury", "ucetni", "uctarna", "expedice", "logistika", "doprava", "vyroba", "sklad",
    "reklamace", "poptavka", "objednavky", "nakup", "personalni", "kariera", "hr", "praca", "prace", "job", "jobs", "marketing",
    "it", "helpdesk", "support", "dispecink", "dispecer", "recepce", "spravce", "admin", "webmaster", "gdpr", "kontakt",
    "contact", "zakaznik", "eshop", "shop", "no-reply", "noreply", "newsletter", "studio", "atelier", "provoz", "technik",
)
PAGE_ORDER = {"contact": 0, "about": 1, "home": 2, "career": 3}


def parked(text: Column, head: int = 2000, least: int = 200) -> Column:
    """Whether a page's text says in its beginning that nothing is there, or is too short to say anything."""
    return (F.length(text) < least) | F.substring(text, 1, head).rlike(PARKED)


def personal_address(address: Column, domain: Column) -> Column:
    """Whether an address is a person's: not a desk's, not one with an ``e`` before a desk, not the company's own name."""
    local = F.lower(F.split(address, "@")[0])
    stem = F.split(local, "[._-]")[0]
    trimmed = F.when(F.startswith(local, F.lit("e")), F.substring(local, 2, 200)).otherwise("")
    squeezed = lambda x: F.regexp_replace(x, "[^a-z0-9]", "")
    own = squeezed(F.split(F.lower(F.coalesce(domain, F.lit(""))), r"\.")[0])
    return ~(local.isin(*DESKS) | stem.isin(*DESKS) | trimmed.isin(*DESKS) | ((own != "") & (squeezed(local) == own)))


# Hosts of free mail, and what is cut from a company's name.
FREE_HOSTS = (
    "gmail.com", "seznam.cz", "email.cz", "centrum.cz", "volny.cz", "post.cz", "atlas.cz", "tiscali.cz", "quick.cz", "outlook.com",
    "hotmail.com", "yahoo.com", "icloud.com", "protonmail.com", "iol.cz",
)
NAME_END = r"(?i)[\s,]*(a\.?\s?s\.?|s\.?\s?r\.?\s?o\.?|spol\.?)[\s.,]*$"


def _squeezed(x: Column) -> Column:
    return F.regexp_replace(X.fold(x), "[^a-z0-9]", "")


def business_box(address: Column, name: Column) -> Column:
    """Whether an address at a free host is the company's own box: its local part and the name hold one another."""
    local, stem = _squeezed(F.substring_index(address, "@", 1)), _squeezed(F.regexp_replace(F.coalesce(name, F.lit("")), NAME_END, ""))
    return F.substring_index(address, "@", -1).isin(*FREE_HOSTS) & (local != "") & (stem != "") & (F.contains(stem, local) | F.contains(local, stem))


# Addresses and labels that may lead to contacts, words of contact pages, their names as a whole, and languages a path begins with.
CONTACT_HINT = r"(?iU)kontakt|contact|o-?n[aá]s|o[-_]?firme|o[-_]?spole[cč]nosti|about|impressum|imprint|firemn[ií]|[uú]daje|z[aá]pat[ií]|footer"
CONTACT_WORD = r"(?i)kontakt|contact|impressum|imprint"
CONTACT_NAME = r"(?i)^(kontakt|kontakty|contact|contacts|impressum|imprint)$"
LANGUAGE = r"(?i)^(cs|cz|en|de|sk|pl|ru|fr|it|es)$"


def contact_links(found: DataFrame, word: str = CONTACT_WORD, strong: str = CONTACT_NAME, most: int = 5, hint: str | None = None) -> DataFrame:
    """page_id, url, rank, place: same-site links that may lead to contacts, best first.

    ``found``: page_id, base (the page's own address), pos, href, label.  Only links whose
    address or label has ``hint`` (``word`` if there is none) count.  Those with ``word`` rank 2 by their last part or label, 3 where the last part is
    ``strong`` as a whole, else 1; then shorter paths, then the later address.  A path
    counts once, whatever language it begins with.
    """
    rows = found.withColumn("url", F.when(F.col("href").rlike("^[a-zA-Z]+:"), F.col("href")).otherwise(F.concat(F.regexp_extract("base", r"^([a-zA-Z]+://[^/?#]+)", 1), F.when(F.startswith("href", F.lit("/")), "").otherwise("/"), "href")))
    rows = rows.where(F.col("url").rlike("^https?://") & (host(F.col("url")) == host(F.col("base"))) & (F.col("href").rlike(hint or word) | F.col("label").rlike(hint or word)))
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"\.[^.]*$", "")
    bare = F.when(F.get(parts, 0).rlike(LANGUAGE), F.slice(parts, 2, 1000)).otherwise(parts)
    rank = F.when(last.rlike(f"{strong}"), 3).when(last.rlike(word) | F.col("label").rlike(word), 2).otherwise(1)
    rows = rows.select("page_id", "url", rank.alias("rank"), F.length(path).alias("n"), X.fold(F.array_join(bare, "/")).alias("key"), "pos")
    once = rows.groupBy("page_id", "key").agg(F.min(F.struct("pos", "url", "rank", "n")).alias("b")).select("page_id", "b.url", "b.rank", "b.n")
    order = Window.partitionBy("page_id").orderBy(F.desc("rank"), "n", F.desc("url"))
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("n")


def contact_order(kind: Column) -> Column:
    """Place of a page's kind among those that may hold contacts."""
    return F.coalesce(F.create_map(*[F.lit(x) for p in PAGE_ORDER.items() for x in p])[kind], F.lit(9))


def best_contact_page(pages: DataFrame) -> DataFrame:
    """ico, page_ord, score: the page with most people reached (ten each) and addresses and numbers; the first of equal ones.

    ``pages``: ico, page_ord, reachable, channels.
    """
    score = (F.col("reachable") * 10 + F.col("channels")).alias("score")
    best = pages.groupBy("ico").agg(F.max(F.struct(score, (-F.col("page_ord")).alias("o"))).alias("b"))
    return best.select("ico", (-F.col("b.o")).alias("page_ord"), F.col("b.score").alias("score"))
