"""Projections, filters and predicates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalex.functions import text as T
from stratalex.functions.text import c

PUNCTUATION = "!-/:-@。，、；：？！“”（）…·—"


def compiled(df: DataFrame, spec: dict) -> DataFrame:
    """Equality and membership filters from a mapping; nulls and empty lists are left out. Catalyst pushes them to the scan."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(k) == v for k, v in spec.items() if v is not None and v != [] and v != ""]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def reconciled(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that the table has, in the wanted order."""
    return [x for x in wanted if x in df.columns]


def kept_or_all(df: DataFrame, keep: Column, group: str) -> DataFrame:
    """Rows that pass, or all rows of a group in which none passes."""
    k = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    return k.withColumn("_any", F.max("_keep").over(Window.partitionBy(group))).filter(F.col("_keep") | ~F.col("_any")).drop("_keep", "_any")


def _count(x: Column, cls: str) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, f"[{cls}]", ""))


def is_noise(page_type: str, text: str) -> Column:
    t = F.coalesce(c(text), F.lit(""))
    return c(page_type).isin("toc", "title_page") | (F.length(t) < 24) | (_count(t, "—-") >= 8) | (_count(t, PUNCTUATION) > 0.38 * F.length(t))


def looks_like_index(page_type: str, text: str) -> Column:
    t = c(text)
    return c(page_type).isin("toc", "title_page") | ((F.length(t) < 600) & (_count(t, "—-") >= 3)) | (_count(t, PUNCTUATION) > 0.42 * F.length(t))


def is_front_matter(article: str, text: str, page_type: str, patterns: list[str]) -> Column:
    head = F.concat(F.coalesce(c(article), F.lit("")), F.lit(" "), F.substring(F.coalesce(c(text), F.lit("")), 1, 260))
    return head.rlike("|".join(patterns)) | c(page_type).isin("toc", "title_page")


def is_noisy_title(title: str) -> Column:
    t = c(title)
    unbalanced = lambda a, b: _count(t, a) != _count(t, b)
    return (
        (F.trim(t) == "") | t.rlike("^[0-9]+$") | t.rlike("^[ -~]+$") | (F.length(t) > 40) | t.rlike("^(和|与|及|或|但|而)")
        | unbalanced("（", "）") | unbalanced("《", "》") | (_count(t, PUNCTUATION) > 0.25 * F.length(t))
    )


def family_rank(source: str, patterns: list[str]) -> Column:
    """The position of the first matching pattern, or their number."""
    return reduce(lambda acc, p: acc.when(c(source).rlike(p[1]), p[0]), list(enumerate(patterns))[1:], F.when(c(source).rlike(patterns[0]), 0)).otherwise(len(patterns))


def quality(page_type: str, text: str, article: str) -> Column:
    """Sum of penalties; 0 is best."""
    t = F.coalesce(c(text), F.lit(""))
    rules = [
        (c(page_type).isin("toc", "title_page"), -60), (F.length(t) < 40, -30), (F.coalesce(c(article), F.lit("")) == "", -10), (t.rlike("[!！]{5,}"), -25),
        (F.contains(t, F.lit("锟斤拷")), -45), (F.length(F.regexp_replace(t, "[^0-9]", "")) > 0.3 * F.length(t), -35),
    ]
    return reduce(lambda a, b: a + b, [F.when(test, F.lit(p)).otherwise(0) for test, p in rules])


def pollution(article: str, terms: list[str]) -> Column:
    """The first term, in order, that a title's label holds."""
    return T.bound(T.label(article), lambda lab: F.coalesce(*[F.when(F.contains(lab, F.lit(p)), p) for p in terms]))


def mojibake(text: str, marks: list[str]) -> Column:
    t = F.coalesce(c(text), F.lit(""))
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(m)) for m in marks])


def orphan_footnote(text: str) -> Column:
    t = F.coalesce(c(text), F.lit(""))
    return (F.length(F.trim(t)) <= 400) & t.rlike("^\\s*[\\[［【]\\s*[0-9０-９]{1,2}\\s*[\\]］】]")


def quarantined(df: DataFrame, terms: list[str], marks: list[str]) -> DataFrame:
    """Volume, page type, page span, mojibake flag and retrievability filled in by the record contract."""
    found = F.regexp_extract("book", "第\\s*([0-9]+)\\s*卷", 1)
    kind = pollution("article", terms)
    end = F.coalesce("pdf_page_end", "pdf_page_start")
    span = F.when(F.col("pdf_page_start").isNull(), F.array().cast("array<int>")).when(end >= F.col("pdf_page_start"), F.sequence("pdf_page_start", end)).otherwise(F.array("pdf_page_start"))
    new_type = F.when((F.col("page_type") == "body") & kind.isNotNull(), F.when(kind == "注释", "notes").when(kind == "目录", "toc").otherwise("subject_index")).otherwise(F.col("page_type"))
    bad = mojibake("paragraph_text", marks)
    flags = F.coalesce(F.size("quality_flags"), F.lit(0))
    out = df.withColumn("volume", F.coalesce("volume", F.when(found != "", F.concat(F.lit("第"), found, F.lit("卷"))), F.lit("")))
    return out.select(
        *[x for x in out.columns if x != "page_type"], new_type.alias("page_type"), bad.alias("mojibake"), span.alias("page_span"),
        ((F.col("page_type") == "body") & kind.isNull() & ~bad & (flags <= 0)).alias("retrievable"),
    )


def inherited(children: DataFrame, parents: DataFrame, parent_key: str, key: str, fields: list[str]) -> DataFrame:
    """Children with the fields of their parent where they have none of their own."""
    p = parents.select(F.col(key).alias("_p"), *[F.col(f).alias(f"_p_{f}") for f in fields])
    return children.join(p, F.col(parent_key) == F.col("_p")).select(key, parent_key, *[F.coalesce(f, f"_p_{f}").alias(f) for f in fields])


def storage_row(df: DataFrame, ints: list[str], strings: list[str], nested: list[str]) -> DataFrame:
    """An export view: -1 for missing integers, '' for missing strings, JSON text for nested fields."""
    rest = [x for x in df.columns if x not in {*ints, *strings, *nested}]
    return df.select(
        *rest, *[F.coalesce(x, F.lit(-1)).alias(x) for x in ints], *[F.coalesce(x, F.lit("")).alias(x) for x in strings],
        *[F.coalesce(F.to_json(x), F.lit("[]")).alias(x) for x in nested],
    )


def is_noise_line(line: str, titles: list[str]) -> Column:
    k = T.compact(line)
    same = reduce(lambda a, b: a | b, [k == T.compact(F.coalesce(c(t), F.lit(""))) for t in titles])
    return (
        (k == "") | ((F.length(k) <= 2) & ~k.rlike("[一-鿿]")) | k.rlike("^[!！.。·•…_-]{4,}$") | k.rlike("[!！]{5,}") | same | k.rlike("^[-—_·•.。,0-9]+$")
    )


def markers(text: str, any_of: list[str], all_groups: list[list[str]]) -> Column:
    """At least one of the first list, and at least one of every group."""
    t = c(text)
    has = lambda xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: F.contains(t, x))
    return reduce(lambda a, b: a & b, [has(any_of), *[has(g) for g in all_groups]])


def tri_state(text: str, positive: str, negative: str) -> Column:
    return F.when(c(text).rlike(positive), "relevant").when(c(text).rlike(negative), "irrelevant").otherwise("pass")


def unreadable(text: str) -> Column:
    t = c(text)
    return t.isNotNull() & (F.length(t) >= 4) & (F.length(F.regexp_replace(t, "[^0-9A-Za-zÀ-ÿА-яёЁ一-鿿]", "")) < 0.4 * F.length(t))


def non_body(page_type: str, article: str) -> Column:
    return c(page_type).isin("toc", "title_page", "blank", "notes") | T.label(article).rlike("(目录|注释|索引)$")


def record_page() -> Column:
    """The printed page, else the citation page where that is a printed one."""
    return F.coalesce("printed_page_start", F.when(F.col("citation_page_type") == "printed_page", F.col("citation_page_start")))


def validated_items(df: DataFrame) -> DataFrame:
    """Test items with defaults for unknown values, non-empty quotes counted and the scope widened by the cited sources."""
    cited = F.transform("expected_citations", lambda x: x["source"])
    scope = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("source_scope", F.array().cast("array<string>")), F.coalesce(cited, F.array().cast("array<string>"))))))
    return df.select(
        "item_id", F.when(F.col("difficulty").isin("easy", "medium", "hard"), F.col("difficulty")).otherwise("medium").alias("difficulty"),
        F.size(F.filter("expected_citations", lambda x: F.coalesce(x["quote"], F.lit("")) != "")).cast("long").alias("n_quotes"), F.array_join(scope, "|").alias("scope"),
    )
