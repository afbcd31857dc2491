"""Raw JSON envelopes to typed tables. Items are kept as variants, so a field may be absent or
of any type; every table is one projection of the items, so columns prune. Values are text, as the
tables are exchanged as CSV: absent and null are '', lists and objects JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_paths import strict_json

ITEM = "item"


def envelopes(raw: DataFrame, column: str = "raw_text") -> DataFrame:
    """endpoint, source_raw and the whole envelope; texts that aren't JSON give none."""
    v = raw.select(strict_json(F.col(column)).alias("envelope")).filter("envelope is not null")
    return v.select(F.coalesce(get("envelope", "endpoint"), F.lit("")).alias("endpoint"), F.coalesce(get("envelope", "raw_uri"), F.lit("")).alias("source_raw"), "envelope")


def items(rows: DataFrame) -> DataFrame:
    """One row an object of ``data.list`` (or of ``data``, if that is a list), with its position."""
    listed = F.coalesce(get("envelope", "data.list", "array<variant>"), get("envelope", "data", "array<variant>"))
    return rows.select("endpoint", "source_raw", F.posexplode(listed).alias("position", ITEM)).filter(is_a(F.col(ITEM), "OBJECT"))


def get(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def is_a(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def truth(v: Column) -> Column:
    """The variant, or null where it is null, '', 0, false or empty."""
    shown = F.to_json(v)
    empty = shown.isin('""', "null", "false", "[]", "{}") | shown.rlike(r"^-?0+(\.0+)?([eE].*)?$")
    return F.when(~empty, v)


def either(*paths: str, of: str = ITEM) -> Column:
    """The first truthy of some fields, as a variant."""
    return F.coalesce(*(truth(get(of, p, "variant")) for p in paths))


def text(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))


def field(path: str, of: str = ITEM) -> Column:
    return text(get(of, path, "variant"))


def first(*paths: str, of: str = ITEM, default: str = "") -> Column:
    return F.coalesce(F.try_variant_get(either(*paths, of=of), "$", "string"), F.lit(default))


def listed(*paths: str) -> Column:
    """The first truthy field as JSON, else an empty list."""
    return F.coalesce(F.to_json(either(*paths)), F.lit("[]"))


def strings(path: str) -> Column:
    """A list of the non-empty texts; a scalar is a list of one, null an empty list."""
    v = get(ITEM, path, "variant")
    many = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
    one = F.try_variant_get(v, "$", "string")
    found = F.when(is_a(v, "ARRAY"), many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
    return F.filter(found, lambda x: x.isNotNull() & (x != ""))


def some(a: str, b: str) -> Column:
    return F.when(F.size(strings(a)) > 0, strings(a)).otherwise(strings(b))


def entity_id(kind: str) -> Column:
    return first(f"{kind}_id", "id")


def heat() -> Column:
    """heat or hotness: of an object its half year, else its month."""
    v = either("heat", "hotness")
    return F.when(is_a(v, "OBJECT"), F.coalesce(*(F.try_variant_get(truth(F.try_variant_get(v, f"$.{p}", "variant")), "$", "string") for p in ("half_year", "month")), F.lit(""))).otherwise(text(v))


def previous_heat() -> Column:
    v = either("heat", "hotness")
    return F.when(is_a(v, "OBJECT"), F.coalesce(F.try_variant_get(v, "$.previous_half_year", "string"), F.lit(""))).otherwise("")


def _table(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(*(c.alias(n) for n, c in columns.items()), "source_raw")


def _plain(*names: str) -> dict[str, Column]:
    return {n: field(n) for n in names}


def _lists(*names: str) -> dict[str, Column]:
    return {n: listed(n) for n in names}


def papers(rows: DataFrame) -> DataFrame:
    awards = F.coalesce(F.to_json(either("conf_award_info")), F.concat(F.lit('{"awards":'), listed("awards"), F.lit("}")))
    return _table(
        rows,
        paper_id=entity_id("paper"),
        **_plain("title", "abstract", "institution", "institution_id", "country_code", "journal_name", "journal_abbreviation", "conference_name", "conference_abbreviation", "landing_page_url", "pdf_url"),
        **_lists("first_authors", "corresponding_authors", "sub_domains", "count_by_year"),
        institution_ids=F.to_json(some("institution_ids", "institution_id")),
        institutions=F.to_json(some("institutions", "institution")),
        pub_date=first("pub_date", "published_at"),
        venue=first("conference_abbreviation", "conference_name", "journal_abbreviation", "journal_name", "venue"),
        conf_award_info=awards,
        heat=heat(),
        previous_heat=previous_heat(),
        cited_by_count=first("cited_by_count", "citation_count", default="0"),
        citation_count=first("citation_count", "cited_by_count", default="0"),
        domains=listed("domains", "fields"),
    )


def paper_author(rows: DataFrame) -> DataFrame:
    """Author objects in order, then bare ids, of which the first is the first author."""
    flag = lambda p: truth(get("x", p, "variant")).isNotNull()
    objects = rows.select(entity_id("paper").alias("paper_id"), "source_raw", F.posexplode(get(ITEM, "authors", "array<variant>")).alias("i", "x"))
    ids = rows.select(entity_id("paper").alias("paper_id"), "source_raw", F.posexplode(strings("author_ids")).alias("i", "x"))
    columns = lambda df, scholar, name, lead, contact: _table(df, paper_id=F.col("paper_id"), scholar_id=scholar, display_name=name, is_first_author=lead, is_corresponding_author=contact, author_order=F.col("i") + 1)
    return columns(objects, field("author_id", "x"), field("display_name", "x"), flag("is_first_author"), flag("is_corresponding_author")).unionByName(columns(ids, F.col("x"), F.lit(""), F.col("i") == 0, F.lit(False)))


def members(rows: DataFrame, kind: str) -> DataFrame:
    """The institutions of papers or scholars, by place; names go with ids by place."""
    own = F.when(F.schema_of_variant(get(ITEM, "institution_id", "variant")) == "VOID", "None").otherwise(field("institution_id"))
    each = rows.select(entity_id(kind).alias("k"), own.alias("own"), some("institutions", "institution").alias("names"), "source_raw", F.posexplode(some("institution_ids", "institution_id")).alias("i", "id"))
    return _table(each, **{f"{kind}_id": F.col("k")}, institution_id=F.col("id"), institution_name=F.coalesce(F.get("names", F.col("i")), F.lit("")), is_primary=F.col("id") == F.col("own"))


def yearly_counts(rows: DataFrame, kind: str) -> DataFrame:
    each = rows.select(entity_id(kind).alias("k"), "source_raw", F.explode(get(ITEM, "count_by_year", "array<variant>")).alias("x")).filter(is_a(F.col("x"), "OBJECT"))
    return _table(each, **{f"{kind}_id": F.col("k")}, year=field("year", "x"), cited_by_count=first("cited_by_count", "count", "value", of="x"))


def _variant(prefix: str, v: Column, suffix: str) -> Column:
    return F.parse_json(F.concat(F.lit(prefix), F.to_json(v), F.lit(suffix)))


def award_groups(v: Column) -> Column:
    """An object is a group; of a list, the objects are, or all its texts together."""
    many = F.try_variant_get(v, "$", "array<variant>")
    texts = F.forall(many, lambda x: is_a(x, "STRING"))
    return F.when(is_a(v, "OBJECT"), F.array(v)).when(texts, F.array(_variant('{"awards":', v, "}"))).otherwise(F.filter(many, lambda x: is_a(x, "OBJECT")))


def awards(rows: DataFrame, kind: str) -> DataFrame:
    """One row an award: of a group's awards, or the group itself if it has a key and none."""
    groups = award_groups(either("award_list", "awards"))
    if kind == "paper":
        groups = F.array(F.coalesce(either("conf_award_info"), _variant('{"awards":', either("awards"), "}")))
    group = rows.select(entity_id(kind).alias("k"), "source_raw", F.explode(groups).alias("g"))
    held = either("awards", of="g")
    several = F.filter(F.try_variant_get(held, "$", "array<variant>"), lambda x: ~F.to_json(x).isin('""', "null"))
    own = F.when(held.isNull() & either("key", of="g").isNotNull(), F.array(F.col("g")))
    listed_ = F.when(is_a(held, "ARRAY"), several).when(is_a(held, "OBJECT") | is_a(held, "STRING"), F.array(held)).otherwise(own)
    each = group.select("k", "source_raw", field("conf", "g").alias("conf"), field("year", "g").alias("year"), F.explode(listed_).alias("x"))
    whole = is_a(F.col("x"), "OBJECT")
    return _table(each, **{f"{kind}_id": F.col("k")}, conf=F.col("conf"), year=F.col("year"), award_key=F.when(whole, field("key", "x")).otherwise(""), award_title=F.when(whole, first("title", "awards", of="x")).otherwise(text(F.col("x"))))


def venues(rows: DataFrame, kind: str) -> DataFrame:
    conferences = some("conference_names", "venues") if kind == "scholar" else strings("conference_names")
    named = F.array(F.struct(F.lit("conference").alias("t"), conferences.alias("n")), F.struct(F.lit("journal").alias("t"), strings("journal_names").alias("n")))
    each = rows.select(entity_id(kind).alias("k"), "source_raw", F.explode(named).alias("x")).select("k", "source_raw", "x.t", F.explode("x.n").alias("n"))
    return _table(each, **{f"{kind}_id": F.col("k")}, venue_type=F.col("t"), venue_name=F.col("n"))


#: The radar's measures.
RADAR = ("academic_impact", "capital_signal", "innovation_power", "media_momentum", "talent_momentum", "total_score")


def institutions(rows: DataFrame) -> DataFrame:
    people = first("author_count", "scholar_count", default="0")
    return _table(
        rows,
        institution_id=entity_id("institution"),
        **_plain("name", "image", "full_description", "num_employees", "funding_total_usd"),
        country_code=first("country_code", "country"),
        paper_count=F.coalesce(get(ITEM, "paper_count"), F.lit("0")),
        author_count=people,
        scholar_count=people,
        heat=heat(),
        previous_heat=previous_heat(),
        domains=listed("domains", "fields"),
        **_lists("sub_tags", "conference_names", "journal_names"),
        award_list=listed("award_list", "awards"),
        **{r: field(f"index_radar_display.{r}") for r in RADAR},
    )


def scholars(rows: DataFrame) -> DataFrame:
    return _table(
        rows,
        scholar_id=entity_id("scholar"),
        display_name=first("display_name", "name"),
        **_plain("avatar", "institution", "institution_id", "cited_by_count", "first_author_paper_count", "corresponding_paper_count", "homepage", "is_ethnic_chinese", "country_code", "email"),
        institution_ids=F.to_json(some("institution_ids", "institution_id")),
        institutions=F.to_json(some("institutions", "institution")),
        paper_count=F.coalesce(F.try_variant_get(either("paper_count"), "$", "string"), F.size(strings("paper_ids")).cast("string")),
        heat=heat(),
        previous_heat=previous_heat(),
        domains=listed("domains", "fields"),
        **_lists("count_by_year", "sub_domains", "journal_names", "journal_abbreviations", "conference_abbreviations"),
        conference_names=listed("conference_names", "venues"),
        award_list=listed("award_list", "awards"),
    )


def _profile(rows: DataFrame) -> DataFrame:
    """A funding profile is a whole envelope, of the institution that was asked for."""
    total = F.coalesce(either("data.summary.total_funding", of="envelope"), either("data.funding.financials_highlights.funding_total", of="envelope"))
    return rows.select(F.coalesce(get("envelope", "request.institution_id"), F.lit("")).alias("institution_id"), "source_raw", "envelope", total.alias("total"))


def funding_summary(rows: DataFrame) -> DataFrame:
    one = _profile(rows)
    known = lambda name, other=None: F.coalesce(get("envelope", f"data.summary.{name}"), *([get("envelope", f"data.funding.financials_highlights.{other}")] if other else []), F.lit(""))
    return _table(
        one,
        institution_id=F.col("institution_id"),
        **{f"total_funding_{n}": field(n, "total") for n in ("currency", "value", "value_usd")},
        funding_round_count=known("funding_round_count", "num_funding_rounds"),
        investor_count=known("investor_count", "num_investors"),
        lead_investor_count=known("lead_investor_count", "num_lead_investors"),
        invested_round_count=known("invested_round_count"),
        lead_invested_round_count=known("lead_invested_round_count"),
        **{n: field(f"data.invested.{n}", "envelope") for n in ("investment_count", "lead_investment_count")},
    )


def funding_rounds(rows: DataFrame) -> DataFrame:
    """One row a round; one made of the total where there is none."""
    rounds = get("envelope", "data.funding.funding_rounds", "array<variant>")
    none = F.array(F.lit(None).cast("variant"))
    each = _profile(rows).select("institution_id", "source_raw", "total", F.posexplode(F.when(F.size(rounds) > 0, rounds).otherwise(none)).alias("i", "x"))
    made = F.col("x").isNull()
    money = lambda n: F.when(made, field(n, "total")).otherwise(field(f"money_raised.{n}", "x"))
    number = F.concat("institution_id", F.when(made, "_funding_summary").otherwise(F.concat(F.lit("_funding_"), F.col("i") + 1)))
    return _table(
        each,
        funding_id=F.coalesce(F.try_variant_get(either("id", of="x"), "$", "string"), number),
        institution_id=F.col("institution_id"),
        uuid=field("uuid", "x"),
        title=F.when(made, "Funding summary").otherwise(field("title", "x")),
        announced_on=field("announced_on", "x"),
        image_id=field("image_id", "x"),
        **{n: money(n) for n in ("currency", "value", "value_usd")},
        lead_investors=F.coalesce(F.to_json(either("lead_investors", of="x")), F.lit("[]")),
    )


def _deals(path: str, record: str, other: str) -> Callable[[DataFrame], DataFrame]:
    def make(rows: DataFrame) -> DataFrame:
        each = _profile(rows).select("institution_id", "source_raw", F.explode(get("envelope", path, "array<variant>")).alias("x"))
        return _table(
            each,
            institution_id=F.col("institution_id"),
            **{record: field("id", "x")},
            **{n: field(n, "x") for n in ("type", "value", "lead_investor")},
            **{f"funding_round_{n}": field(f"funding_round.{n}", "x") for n in ("id", "value")},
            **{f"{other}_{n}": field(f"investor.{p}", "x") for n, p in (("id", "id"), ("name", "value"), ("type", "type"))},
        )

    return make


#: By what an endpoint's name holds, tried in this order: the tables and whether they are of items.
NORMALISERS: dict[str, tuple[bool, dict[str, Callable[[DataFrame], DataFrame]]]] = {
    "paper/search": (True, {"papers": papers, "paper_author": paper_author, "paper_institution": lambda r: members(r, "paper"), "paper_yearly_counts": lambda r: yearly_counts(r, "paper"), "paper_awards": lambda r: awards(r, "paper")}),
    "institutions/search": (True, {"institutions": institutions, "institution_awards": lambda r: awards(r, "institution"), "institution_venues": lambda r: venues(r, "institution")}),
    "scholar/search": (True, {"scholars": scholars, "scholar_institution": lambda r: members(r, "scholar"), "scholar_yearly_counts": lambda r: yearly_counts(r, "scholar"), "scholar_awards": lambda r: awards(r, "scholar"), "scholar_venues": lambda r: venues(r, "scholar")}),
    "funding-profile": (False, {"funding": funding_rounds, "funding_rounds": funding_rounds, "funding_summary": funding_summary, "funding_investors": _deals("data.funding.investors", "investor_record_id", "investor"), "institution_investments": _deals("data.invested.investments", "investment_id", "target")}),
}


def endpoint_kind(endpoint: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name in reversed(NORMALISERS):
        kind = F.when(F.contains(endpoint, F.lit(name)), name).otherwise(kind)
    return kind


def normalise(raw: DataFrame, column: str = "raw_text") -> dict[str, DataFrame]:
    """Every table, from the envelopes whose endpoint names its kind; unknown ones give none."""
    rows = envelopes(raw, column)
    out = {}
    for kind, (of_items, tables) in NORMALISERS.items():
        own = rows.filter(endpoint_kind(F.col("endpoint")) == kind)
        own = items(own) if of_items else own
        out |= {name: make(own) for name, make in tables.items()}
    return out


def append_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows once, on typed values; columns that one lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True).dropDuplicates()


def record_kind(endpoint: Column) -> Column:
    """paper, scholar, institution or funding; null for other endpoints."""
    marks = {"paper/search": "paper", "scholar/search": "scholar", "institutions/search": "institution", "funding-profile": "funding"}  # fixed values
    return F.coalesce(*(F.when(endpoint.contains(m), k) for m, k in marks.items()))
