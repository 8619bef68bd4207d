"""Identity: people, registrants, domains and registry records matched to companies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import text as X

#: Legal-form words that say nothing about which company it is (fixed values).
LEGAL_WORDS = ("a", "s", "as", "sro", "spol", "r", "o", "ks", "vos", "statni", "podnik", "druzstvo", "v", "likvidaci")
TITLES = r"(?iU)\b(?:ing|mgr|bc|mudr|judr|phdr|rndr|doc|prof|dr|csc|mba|ph\s?d|llm|dis)\b\.?"


def name_words(name: Column) -> Column:
    """The words of a company name without marks, signs and legal words."""
    words = F.split(F.trim(F.regexp_replace(X.fold_marks(name), r"[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*LEGAL_WORDS))


def registry_key(name: Column) -> Column:
    """What two registries' spellings of a company name have in common: its words, joined."""
    return F.array_join(name_words(name), "")


# A legal form at the end of a name, words of legal forms anywhere in it, and words that companies share.
FORM_END = (
    r"[\s,]*(akciov[aá]\s+spole[cč]nost|spole[cč]nost\s+s\s+ru[cč]en[ií]m\s+omezen[yý]m|a\.?\s?s\.?|s\.?\s?r\.?\s?o\.?|spol\.?|v\.?\s?o\.?\s?s\.?|"
    r"k\.?\s?s\.?|z\.?\s?[su]\.?|o\.?\s?p\.?\s?s\.?|s\.?\s?e\.?|gmbh|ltd\.?|s\.?a\.?)[\s.,]*$"
)
FORM_WORDS = (
    "s", "r", "o", "sro", "spol", "as", "a.s", "vos", "ks", "zs", "ops", "se", "spolecnost", "spolecnosti", "akciova", "gmbh", "ltd", "sa",
    "kg", "ag", "bv", "nv", "plc", "inc", "llc",
)
FILLER = (
    "cz", "czech", "czechia", "bohemia", "moravia", "morava", "group", "holding", "company", "int", "international", "trade", "trading",
    "industry", "industries", "invest", "praha", "brno", "prague", "and", "the", "republic",
)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def domain_stems(name: Column) -> Column:
    """What may stand before the dot of a company's domain, the likeliest first.

    The words of the name without its legal form (all words if nothing else is left), joined
    and with dashes; the same without words that many companies share; of three telling words
    the first two, of two the first, and the initials of three.  Stems have 2 to 63 letters.
    """
    bare = F.trim(F.regexp_replace(X.fold_marks(F.regexp_replace(F.coalesce(name, F.lit("")), f"(?iU){FORM_END}", "")), "[^a-z0-9]+", " "))

    def made(words: Column, telling: Column) -> Column:
        n, two = F.size(telling), F.slice(telling, 1, 2)
        initials = F.array_join(F.transform(telling, lambda w: F.substring(w, 1, 1)), "")
        stems = [F.array_join(ws, by) for ws in (words, telling) for by in ("", "-")]
        stems += [F.when(n > 2, F.array_join(two, by)) for by in ("", "-")]
        stems += [F.when(n > 1, F.get(telling, 0)), F.when(n > 2, initials)]
        return F.array_distinct(F.filter(F.array(*stems), lambda x: F.length(x).between(2, 63)))

    return _with(
        F.filter(F.split(bare, " "), lambda w: w != ""),
        lambda every: _with(
            F.filter(every, lambda w: ~w.isin(*FORM_WORDS)),
            lambda some: _with(
                F.when(F.size(some) > 0, some).otherwise(every),
                lambda words: _with(F.filter(words, lambda w: ~w.isin(*FILLER)), lambda own: made(words, F.when(F.size(own) > 0, own).otherwise(words))),
            ),
        ),
    )


def domain_candidates(seeds: Column, name: Column, endings: Sequence[str] = ("cz",), foreign: Sequence[str] = ("com", "eu"), strong: int = 3, most: int = 24) -> Column:
    """Seed domains first, then every stem with ``endings``, then the ``strong`` likeliest with ``foreign`` ones too.

    Each is named once, at most ``most``; seeds lose case, blanks, leading dots and www.
    """
    given = F.transform(F.coalesce(seeds, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.ltrim(F.lower(F.trim(x)), F.lit(".")), r"^www\.", ""))
    dotted = lambda stems, ends: F.flatten(F.transform(stems, lambda s: F.array(*[F.concat(s, F.lit(f".{e}")) for e in ends])))
    made = _with(domain_stems(name), lambda stems: F.concat(dotted(stems, endings), dotted(F.slice(stems, 1, strong), foreign)))
    return F.slice(F.array_distinct(F.concat(F.filter(given, lambda x: F.contains(x, F.lit("."))), made)), 1, most)


def seed_domains(rows: DataFrame, blocked: DataFrame) -> DataFrame:
    """ico, domain, pos: landed domains without www and the blocked ones, first of each."""
    host = F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "")
    clean = rows.withColumn("domain", host).where(F.contains("domain", F.lit(".")))
    return clean.join(blocked.select("domain").distinct(), "domain", "left_anti").groupBy("ico", "domain").agg(F.min("pos").alias("pos"))


def split_person(name: Column) -> Column:
    """given and surname of a person, titles and initials dropped; null with fewer than two words."""
    plain = F.regexp_replace(name, TITLES, " ")
    words = F.filter(F.split(F.trim(F.regexp_replace(X.fold(plain), r"[^a-z]+", " ")), " "), lambda w: F.length(w) > 1)
    return F.when(F.size(words) >= 2, F.struct(words[0].alias("given"), F.element_at(words, -1).alias("surname")))


def address_is_of(address: Column, given: Column, surname: Column) -> Column:
    """Whether a printed address's local part names a person: the surname, or the initial with it."""
    local = F.regexp_replace(F.split(F.lower(address), "@")[0], r"[^a-z]", "")
    return F.coalesce((F.length(surname) >= 3) & F.contains(local, surname) | (local == F.concat(F.substring(given, 1, 1), surname)), F.lit(False))


def own_mail_host(host: Column, domain: Column, free: Sequence[str]) -> Column:
    """Whether a mail host is the company's domain or a part of it; free mail never is."""
    same = (host == domain) | F.endswith(host, F.concat(F.lit("."), domain)) | F.endswith(domain, F.concat(F.lit("."), host))
    return ~host.isin(*free) & F.coalesce(same, F.lit(False))


def namesakes(people: DataFrame) -> DataFrame:
    """Names that two people of different birth dates share in a company: no channel goes to them.

    Birth dates are only counted and never leave this operator.
    """
    return people.groupBy("ico", "name").agg(F.count_distinct("born").alias("n")).where("n > 1").select("ico", "name")


def shared_surnames(people: DataFrame) -> DataFrame:
    """ico, surname, people: surnames that several people of a board have."""
    named = people.withColumn("surname", split_person(F.col("name"))["surname"]).where("surname is not null")
    return named.groupBy("ico", "surname").agg(F.count_distinct("name").alias("people")).where("people > 1")


def contact_tier(contacts: DataFrame, people: DataFrame, domains: DataFrame) -> DataFrame:
    """Tender contacts graded: a register person, the company's own domain, else external."""
    last = lambda c: F.element_at(F.split(X.fold(c), r"\s+"), -1)
    known = people.select("ico", last("name").alias("last")).distinct().withColumn("listed", F.lit(True))
    rows = contacts.withColumn("last", last("name")).join(known, ["ico", "last"], "left").join(domains.select("ico", "domain"), "ico", "left")
    own = F.endswith(F.lower("email"), F.concat(F.lit("@"), F.col("domain")))
    tier = F.when(F.col("listed"), "register").when(F.coalesce(own, F.lit(False)), "own_domain").otherwise("external")
    return rows.select(*contacts.columns, tier.alias("tier"))


def tender_contacts(graded: DataFrame) -> DataFrame:
    """Each (name, email) of a company once, by its best tier."""
    rank = F.when(F.col("tier") == "register", 0).when(F.col("tier") == "own_domain", 1).otherwise(2)
    return graded.groupBy("ico", "name", "email").agg(F.min(F.struct(rank.alias("rank"), "tier")).alias("b")).select("ico", "name", "email", "b.rank", "b.tier")


def listed_on_page(directors: DataFrame, found: DataFrame) -> DataFrame:
    """Directors with what a page says of them, and people of the page who aren't directors.

    ``source``: register for the former, page for the latter; weak page finds are left out.
    """
    key = X.fold("name")
    left = directors.withColumn("key", key)
    right = found.withColumn("key", key).groupBy("ico", "key").agg(F.max("email").alias("email"), F.max("phone").alias("phone"), F.min("name").alias("page_name"), F.min("tier").alias("tier"))
    both = left.join(right, ["ico", "key"], "left").select("ico", "name", "email", "phone", F.lit("register").alias("source"))
    rest = right.where("tier <> 'page_weak'").join(left.select("ico", "key"), ["ico", "key"], "left_anti")
    return both.unionByName(rest.select("ico", F.col("page_name").alias("name"), "email", "phone", F.lit("page").alias("source")))


def registrant_block(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """name, address, created of the first contact block of a registrant answer, one row each."""
    lines = rows.select("domain", F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    cut = lines.select("domain", "pos", F.lower(F.trim(F.split("line", ":", 2)[0])).alias("label"), F.trim(F.get(F.split("line", ":", 2), 1)).alias("value")).where("value is not null")
    start = cut.where("label = 'contact'").groupBy("domain").agg(F.min("pos").alias("start"))
    headers = cut.join(start, "domain").where("pos > start and label in ('contact', 'nsset', 'keyset', 'domain')").groupBy("domain").agg(F.min("pos").alias("stop"))
    inside = cut.join(start, "domain").join(headers, "domain", "left").where("pos >= start and (stop is null or pos < stop)")
    first = lambda label: F.min(F.when(F.col("label") == label, F.struct("pos", "value")))["value"]
    address = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == "address", F.struct("pos", "value")))), lambda x: x["value"]), ", ")
    return inside.groupBy("domain").agg(first("name").alias("name"), first("org").alias("org"), address.alias("address"), first("created").alias("created"))


def registrant_tier(answers: DataFrame, companies: DataFrame, people: DataFrame) -> DataFrame:
    """Why a registrant is the company: a person of the board, the same key, a part of it, the postcode.

    A part counts with the same postcode, or where the company's own key is too long to meet by chance.
    ``answers``: ico, domain, pos, registrant, postcode.  The first tier wins, then the
    earlier candidate domain.
    """
    key, own = registry_key(F.col("registrant")), registry_key(F.col("name"))
    board = people.select("ico", X.fold("name").alias("person")).distinct().withColumn("on_board", F.lit(True))
    rows = answers.withColumn("person", X.fold("registrant")).join(board, ["ico", "person"], "left").join(companies.select("ico", "name", F.col("postcode").alias("own_postcode")), "ico")
    rows = rows.withColumn("key", key).withColumn("own", own).withColumn("same_post", F.coalesce(F.col("postcode") == F.col("own_postcode"), F.lit(False)))
    part = (F.contains("key", F.col("own")) | F.contains("own", F.col("key"))) & (F.length("key") > 0)
    exact = (F.col("key") == F.col("own")) & (F.length("key") > 0)
    tier = (
        F.when(F.col("on_board"), F.struct(F.lit(0).alias("rank"), F.lit("person").alias("tier")))
        .when(exact, F.struct(F.lit(1).alias("rank"), F.lit("name").alias("tier")))
        .when(part & (F.col("same_post") | (F.length("own") >= 7)), F.struct(F.lit(2).alias("rank"), F.lit("partial").alias("tier")))
        .when(F.col("same_post"), F.struct(F.lit(3).alias("rank"), F.lit("postcode").alias("tier")))
    )
    best = rows.withColumn("t", tier).where("t is not null").groupBy("ico").agg(F.min(F.struct("t.rank", "pos", "domain", "t.tier")).alias("b"))
    return best.select("ico", "b.domain", "b.tier")


def best_domain(candidates: DataFrame, rank: dict[str, int]) -> DataFrame:
    """The candidate domain of the best evidence; ties go to the earlier one."""
    order = F.create_map(*[F.lit(x) for p in rank.items() for x in p])
    best = candidates.withColumn("rank", order[F.col("evidence")]).where("rank is not null").groupBy("ico").agg(F.min(F.struct("rank", "pos", "domain", "evidence")).alias("b"))
    return best.select("ico", "b.domain", "b.evidence")


def regrade(sites: DataFrame, proofs: DataFrame) -> DataFrame:
    """Unproven sites whose stored pages now prove them become proven."""
    rows = sites.join(proofs.select("ico", F.col("evidence").alias("fresh")), "ico", "left")
    better = F.col("fresh").isNotNull() & (F.col("status") != "proven")
    return rows.withColumn("regraded", better).withColumn("status", F.when(better, "proven").otherwise(F.col("status"))).withColumn("evidence", F.when(better, F.col("fresh")).otherwise(F.col("evidence"))).drop("fresh")


def primary_record(records: Column, mark: str = "primary") -> Column:
    """The envelope's primary record, else its first; null without any."""
    return F.coalesce(F.get(F.filter(records, lambda r: r[mark]), 0), F.get(records, 0))


def split_by_end(entries: Column) -> Column:
    """current and departed entries of a register list, by whether they have an end."""
    return F.struct(F.filter(entries, lambda e: e["until"].isNull()).alias("current"), F.filter(entries, lambda e: e["until"].isNotNull()).alias("departed"))


def merge_registers(keys: DataFrame, registers: dict[str, DataFrame]) -> DataFrame:
    """One row per key with a struct per register; a register without the key gives nulls."""
    out = keys
    for name, rows in registers.items():
        out = out.join(rows.select("ico", F.struct(*[c for c in rows.columns if c != "ico"]).alias(name)), "ico", "left")
    return out


def newest_statement(documents: DataFrame, least_year: int) -> DataFrame:
    """The statement of the latest year of each company, if it is recent enough."""
    best = documents.groupBy("ico").agg(F.max(F.struct("year", "doc")).alias("b"))
    return best.select("ico", "b.year", "b.doc").where(F.col("year") >= least_year)


def unit_scale(texts: DataFrame, row_pattern: str) -> DataFrame:
    """id, scale: the unit marker last named above the row that matches, 1 without one."""
    markers = F.lit(r"(?i)(v tis\.|tis\. k|mil\. k|v mil\.)")
    at = F.regexp_instr("text", F.lit(row_pattern))
    above = F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise("")
    last = F.lower(F.element_at(F.regexp_extract_all(above, markers, F.lit(1)), -1))
    found = F.when(F.size(F.regexp_extract_all(above, markers, F.lit(1))) > 0, last)
    scale = F.when(F.contains(found, F.lit("tis")), 1000).when(F.contains(found, F.lit("mil")), 1_000_000).otherwise(1)
    return texts.where(at > 0).select("id", scale.alias("scale"))


def snapshot_for(happened: DataFrame, latest: DataFrame) -> DataFrame:
    """Events with the newest snapshot of their source (and url, if they name one); orphans have none."""
    by_url = latest.select("ico", "source", "url", F.col("id").alias("url_id"))
    by_source = latest.groupBy("ico", "source").agg(F.max("id").alias("source_id"))
    rows = happened.join(by_url, ["ico", "source", "url"], "left").join(by_source, ["ico", "source"], "left")
    return rows.withColumn("snapshot_id", F.when(F.col("url").isNotNull(), F.col("url_id")).otherwise(F.col("source_id"))).drop("url_id", "source_id")


def places_with_parts(towns: DataFrame, parts: DataFrame) -> DataFrame:
    """All places; a part of a town takes the town's place where both have one code."""
    rows = towns.withColumn("o", F.lit(1)).unionByName(parts.withColumn("o", F.lit(0)))
    rest = [c for c in towns.columns if c != "code"]
    return rows.groupBy("code").agg(F.min(F.struct("o", *rest)).alias("b")).select("code", *[F.col(f"b.{c}").alias(c) for c in rest])


def proven_domains(websites: DataFrame) -> DataFrame:
    """ico, domain of sites that are proven to be the company's."""
    return websites.where((F.col("status") == "proven") & (F.coalesce("domain", F.lit("")) != "")).select("ico", "domain").distinct()
