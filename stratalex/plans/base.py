"""Shared inputs of the queries, and the same inputs as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.functions.text import BLANKS, HAN, LABEL_NOISE, NARROW, WIDE
from stratalex.operators import intervals as I
from stratalex.operators import ranking as R
from stratalex.session import cut, table

#: Words for non-body regions in titles, in order of precedence (fixed values of the record contract).
POLLUTION = ["目录", "注释", "人名索引", "名目索引", "主题索引", "文献索引", "报刊索引", "书名索引", "事项索引", "索引"]
#: Signs of text decoded with the wrong charset (fixed values of the record contract).
MOJIBAKE = ["锟斤拷", "�", "Ã", "Â", "æ–", "å­", "ä¸", "ï¼", "â€"]
#: Page types of front matter, and retrieval units (fixed values of the record contract).
FRONT = ["toc", "title_page", "blank"]
UNITS = ["paragraph", "semantic_parent", "semantic_child", "paragraph_child", "milvus_passage"]


def records(spark: SparkSession, d: str) -> DataFrame:
    """The records, repeated rows of a paragraph once."""
    return table(spark, d, "records").drop("ingested_at").dropDuplicates(["paragraph_id"])


def narrow(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Some columns of the records, repeated rows once: the shuffle carries no more than these."""
    return table(spark, d, "records").select("paragraph_id", *columns).distinct()


def requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "request_metrics").drop("received_at").dropDuplicates(["request_id"])


def questions(spark: SparkSession, d: str) -> DataFrame:
    asked = F.concat_ws(" ", "question", "expected_work")
    return table(spark, d, "eval_items").select("item_id", "question", "discipline", "difficulty", "question_type", "evaluation_mode", asked.alias("asked"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, ord, source, citation_page, quote, article) of the expected citations."""
    return table(spark, d, "eval_items").select("item_id", F.posexplode("expected_citations").alias("ord", "c")).select(
        "item_id", "ord", "c.source", "c.citation_page", "c.quote", "c.article"
    )


#: Candidates of a test item: the best of the text channel; and of the title channel.
TEXT_K, TITLE_K = 24, 12


def body_rows(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the body with their repeated rows, for operators that count these once themselves."""
    return table(spark, d, "records").filter("page_type = 'body' and paragraph_text is not null").select("paragraph_id", "source", "paragraph_text")


def body(spark: SparkSession, d: str) -> DataFrame:
    return body_rows(spark, d).distinct()


def titled_rows(spark: SparkSession, d: str) -> DataFrame:
    """(paragraph_id, title): article and book of body records that name an article, with repeated rows."""
    t = table(spark, d, "records").filter("page_type = 'body' and trim(article) <> ''")
    return t.select("paragraph_id", F.concat_ws(" ", "article", "book").alias("title"))


def text_channel(spark: SparkSession, d: str, k: int = TEXT_K) -> DataFrame:
    """(item_id, paragraph_id, score, rank): BM25 of each test item over the texts of the body."""
    return R.bm25_topk(body_rows(spark, d), "paragraph_id", "paragraph_text", questions(spark, d), "item_id", "asked", k)


def title_channel(spark: SparkSession, d: str, k: int = TITLE_K) -> DataFrame:
    """(item_id, paragraph_id, score, rank): BM25 of each test item over the titles of the body."""
    return R.bm25_topk(titled_rows(spark, d), "paragraph_id", "title", questions(spark, d), "item_id", "asked", k)


def hits(spark: SparkSession, d: str) -> DataFrame:
    """The candidate list of each test item as the text channel finds it, with its rank and the records' columns.

    distance: pages between a candidate and the nearest expected citation in its source, 9999 where there is none; it
    evaluates the list and takes no part in finding it.
    """
    found = cut(text_channel(spark, d).select("item_id", "paragraph_id", "rank"))
    names = ["source", "book", "article", "section", "page_type", "paragraph_text", "paragraph_index", "printed_page_start", "pdf_page_start"]
    ids = I.dimension(found.select("paragraph_id").distinct())
    r = table(spark, d, "records").select("paragraph_id", *names).join(ids, "paragraph_id", "left_semi").distinct().withColumn("page", F.coalesce("printed_page_start", "pdf_page_start"))
    c = citations(spark, d).select("item_id", "source", F.col("citation_page").alias("cp"))
    listed = found.join(r, "paragraph_id")
    away = listed.join(I.dimension(c), ["item_id", "source"]).groupBy("item_id", "paragraph_id").agg(F.min(F.abs(F.col("page") - F.col("cp"))).alias("distance"))
    out = listed.join(away, ["item_id", "paragraph_id"], "left")
    return out.select("paragraph_id", "item_id", F.coalesce("distance", F.lit(9999)).alias("distance"), "rank", *names, "page")


def entries(spark: SparkSession, d: str) -> DataFrame:
    """(work_id, title, ord, source, article, start_page, end_page, priority, entry_type) of the classics."""
    return table(spark, d, "core_classics").select("work_id", "title", F.posexplode("entries").alias("ord", "e")).select("work_id", "title", "ord", "e.*")


#: A question with the work it asks for.
ASKED_SQL = "concat_ws(' ', e.question, e.expected_work)"
R_SQL = "r AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM records)"
Q_SQL = "q AS (SELECT DISTINCT * EXCLUDE (received_at) FROM request_metrics)"
CIT_SQL = """cit AS (SELECT item_id, i - 1 AS ord, c.source AS source, c.citation_page AS citation_page, c.quote AS quote, c.article AS article
  FROM (SELECT item_id, unnest(expected_citations) AS c, generate_subscripts(expected_citations, 1) AS i FROM eval_items))"""
ENT_SQL = """ent AS (SELECT work_id, title, i - 1 AS ord, e.source AS source, e.article AS article, e.start_page AS start_page, e.end_page AS end_page, e.priority AS priority, e.entry_type AS entry_type
  FROM (SELECT work_id, title, unnest(entries) AS e, generate_subscripts(entries, 1) AS i FROM core_classics))"""


def sq(s: str) -> str:
    """A string as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "(" + ", ".join(sq(v) for v in values) + ")"


def sql_fold(x: str) -> str:
    return f"translate({x}, {sq(WIDE + chr(0x3000))}, {sq(NARROW + ' ')})"


def _class(s: str) -> str:
    return s.replace("\\u", "\\x")


def sql_strip(x: str, cls: str, to: str = "") -> str:
    return f"regexp_replace({x}, {sq('[' + cls + ']+')}, {sq(to)}, 'g')"


def sql_compact(x: str) -> str:
    return sql_strip(x, BLANKS)


def sql_label(x: str) -> str:
    return f"lower({sql_strip(f'coalesce({x}, {sq(str())})', BLANKS + LABEL_NOISE)})"


def sql_match(x: str) -> str:
    return f"lower({sql_strip(sql_fold(x), '^0-9A-Za-z' + HAN)})"


def sql_grams(x: str, n: int) -> str:
    return f"list_transform(range(1, length({x}) - {n - 2}), lambda i: substring({x}, i, {n}))"


def sql_tokens(x: str) -> str:
    """Tokens of a column, in a subquery-free expression."""
    t = f"lower({sql_fold(x)})"
    run = "CASE WHEN length(g) <= 2 THEN [g] ELSE list_concat(list_transform(range(1, length(g)), lambda i: substring(g, i, 2)), list_transform(range(1, length(g) - 1), lambda j: substring(g, j, 3))) END"
    return f"list_concat(regexp_extract_all({t}, '[a-z0-9]+'), flatten(list_transform(regexp_extract_all({t}, '[{HAN}]+'), lambda g: {run})))"


BODY_SQL = "b AS (SELECT paragraph_id, source, paragraph_text FROM r WHERE page_type = 'body' AND paragraph_text IS NOT NULL)"


def bm25_sql(p: str, docs: str, text: str) -> str:
    """CTEs that score the documents of a table for every test item: the last one is {p}sc (item_id, paragraph_id, score)."""
    return f"""{p}tk AS (SELECT paragraph_id, {sql_tokens(text)} AS k FROM {docs}), {p}st AS (SELECT count(*) AS n, avg(len(k)) AS avgdl FROM {p}tk),
  {p}tf AS (SELECT paragraph_id, term, dl, count(*) AS tf FROM (SELECT paragraph_id, len(k) AS dl, unnest(k) AS term FROM {p}tk) GROUP BY ALL),
  {p}qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT e.item_id, unnest({sql_tokens(ASKED_SQL)}) AS term FROM eval_items e) GROUP BY ALL),
  {p}df AS (SELECT term, count(*) AS df FROM {p}tf WHERE term IN (SELECT term FROM {p}qt) GROUP BY term),
  {p}w AS (SELECT q.item_id, q.term, ln(1 + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) AS idf, 1 + ln(q.qtf::DOUBLE) AS q, s.avgdl FROM {p}qt q JOIN {p}df d USING (term), {p}st s),
  {p}sc AS (SELECT w.item_id, f.paragraph_id, round(sum(w.idf * w.idf * w.q * (f.tf * 2.2::DOUBLE / (f.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * f.dl / w.avgdl)))), 6) AS score FROM {p}tf f JOIN {p}w w USING (term) GROUP BY ALL)"""


def top_sql(p: str, k: int) -> str:
    return f"{p}top AS (SELECT item_id, paragraph_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, paragraph_id) AS rank FROM {p}sc QUALIFY rank <= {k})"


HITS_SQL = f"""{R_SQL}, {CIT_SQL}, hb AS (SELECT paragraph_id, paragraph_text FROM r WHERE page_type = 'body' AND paragraph_text IS NOT NULL),
  {bm25_sql('h_', 'hb', 'paragraph_text')}, {top_sql('h_', TEXT_K)},
  rp AS (SELECT *, coalesce(printed_page_start, pdf_page_start) AS page FROM r SEMI JOIN h_top USING (paragraph_id)),
  h_far AS (SELECT t.item_id, rp.paragraph_id, min(abs(rp.page - c.citation_page)) AS distance FROM h_top t JOIN rp USING (paragraph_id) JOIN cit c ON c.item_id = t.item_id AND c.source = rp.source GROUP BY ALL),
  hits AS (SELECT t.item_id, coalesce(f.distance, 9999) AS distance, t.rank, rp.* FROM h_top t JOIN rp USING (paragraph_id) LEFT JOIN h_far f ON f.item_id = t.item_id AND f.paragraph_id = t.paragraph_id)"""
#: The title channel as `dense` (the vectors of the tables belong to no question) and the best of the text channel as `sparse`.
CHANNELS_SQL = f"""ti AS (SELECT paragraph_id, concat_ws(' ', article, book) AS title FROM r WHERE page_type = 'body' AND trim(article) <> ''),
  {bm25_sql('t_', 'ti', 'title')}, {top_sql('t_', TITLE_K)}, dense AS (SELECT item_id, paragraph_id, rank FROM t_top), sparse AS (SELECT item_id, paragraph_id, rank FROM h_top WHERE rank <= 8)"""
