"""Queries of features, formats and tokenisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, spans, text
from ..functions.rules import CHEMICALS, NIL, NIL_CATEGORY
from ..operators import ontology as onto
from ..operators.prompt import count_tokens
from ..session import scratch
from ..sources.tables import append_jsonl, first_rows, load_ontology, parse_synonyms, read_jsonl, write_jsonl
from .cases import MENTION_TOKENS, dealt, dealt_sql
from .data import MENT, NO_ENTRY, ONTO, mentions, ontology, table, toks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a span: their third word."""
    head = F.regexp_extract("text", r"^\s*\S+\s+\S+\s+", 0)
    word = lambda t: F.regexp_extract(t, r"^\S+", 0)
    df = table(spark, d, "documents").select("doc_id", "text", "lang").withColumn("s", F.length(head))
    return df.withColumn("e", F.col("s") + F.length(word(F.expr("substring(text, s + 1)"))))


DOCS = r"""head AS (SELECT doc_id, text, lang, regexp_extract(text, '^\s*\S+\s+\S+\s+') AS pre FROM documents),
docs AS (SELECT doc_id, text, lang, pre, length(pre) AS s, length(pre) + length(regexp_extract(substr(text, length(pre) + 1), '^\S+')) AS e FROM head)"""


@query(f"WITH {DOCS} SELECT doc_id, substr(text, s + 1, e - s) AS mention FROM docs")
def span_mention(spark, d):
    return docs(spark, d).select("doc_id", spans.mention(F.col("text"), F.col("s"), F.col("e")).alias("mention"))


@query(f"WITH {DOCS} SELECT doc_id, md5(substr(text, 1, s) || '[MENTION]' || substr(text, s + 1, e - s) || '[/MENTION]' || substr(text, e + 1)) AS tagged FROM docs")
def tag_mention(spark, d):
    return docs(spark, d).select("doc_id", F.md5(spans.tagged(F.col("text"), F.col("s"), F.col("e"))).alias("tagged"))


@query("SELECT doc_id, md5(text) AS untagged FROM documents")
def untag_mention(spark, d):
    return docs(spark, d).select("doc_id", F.md5(spans.untagged(spans.tagged(F.col("text"), F.col("s"), F.col("e")))).alias("untagged"))


WINDOW = "CASE WHEN m <> '' THEN array_to_string(list_concat(toks[greatest(1, n - 4):n], ['[MENTION]', m, '[/MENTION]'], toks[n + 2:n + 6]), ' ') END"


@query(f"WITH {DOCS} SELECT doc_id, substr(text, s + 1, e - s) AS plain, md5(substr(text, 1, s) || '[MENTION]' || substr(text, s + 1, e - s) || '[/MENTION]' || substr(text, e + 1)) AS tagged FROM docs")
def mention_feature(spark, d):
    args = F.col("text"), F.col("s"), F.col("e")
    return docs(spark, d).select("doc_id", spans.mention_feature(*args, special_tokens=False).alias("plain"), F.md5(spans.mention_feature(*args)).alias("tagged"))


@query(rf"""WITH {DOCS}, t AS (SELECT doc_id, substr(text, s + 1, e - s) AS m, regexp_extract_all(text, '\S+|\n') AS toks, len(regexp_extract_all(pre, '\S+|\n')) AS n, substr(text, 1, s) || '[MENTION]' || substr(text, s + 1, e - s) || '[/MENTION]' || substr(text, e + 1) AS tagged FROM docs)
SELECT doc_id, CASE WHEN m <> '' THEN m END AS mention, {WINDOW} AS mention_with_window, CASE WHEN m <> '' THEN md5(tagged) END AS tagged, md5('{spans.TEXT_PREAMBLE}' || CASE WHEN m <> '' THEN chr(10) || tagged ELSE '' END) AS context FROM t""")
def prep_text(spark, d):
    given = F.when(F.col("e") > F.col("s"), F.array(F.struct(F.col("s").alias("start"), F.col("e").alias("end"))))
    out = spans.prep_text(docs(spark, d).select("doc_id", "text", given.alias("spans")))
    return out.select("doc_id", "mention", "mention_with_window", F.md5("text_with_tagged_mention").alias("tagged"), F.md5("text_context_llm").alias("context"))


@query(rf"""WITH {DOCS}, t AS (SELECT doc_id, substr(text, s + 1, e - s) AS m, regexp_extract_all(text, '\S+|\n') AS toks, len(regexp_extract_all(pre, '\S+|\n')) AS n FROM docs)
SELECT doc_id, {WINDOW} AS mention_with_window FROM t""")
def mention_window(spark, d):
    rows = docs(spark, d).withColumns({c: F.when(F.col("e") > F.col("s"), F.col(c)) for c in ("s", "e")})
    return rows.select("doc_id", spans.mention_window(F.col("text"), F.col("s"), F.col("e"), 5).alias("mention_with_window"))


@query(f"WITH {DOCS} SELECT doc_id, md5('{spans.TEXT_PREAMBLE}' || chr(10) || substr(text, 1, s) || '[MENTION]' || substr(text, s + 1, e - s) || '[/MENTION]' || substr(text, e + 1)) AS context FROM docs")
def llm_text_context(spark, d):
    return docs(spark, d).select("doc_id", F.md5(spans.text_context(spans.tagged(F.col("text"), F.col("s"), F.col("e")))).alias("context"))


# --- tables: one HTML table for each region, with an index row and an index column ---


def region_tables(spark: SparkSession, d: str) -> DataFrame:
    cells = F.format_string("<tr><td>%s</td><td>%s<br/></td><td><b>%s</b> </td></tr>", (F.row_number().over(_by_region()) - 1).cast("string"), F.col("n_name"), F.col("n_nationkey").cast("string"))
    rows = table(spark, d, "nation").withColumn("tr", cells).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "tr"))).alias("rows"), F.count("*").alias("n"))
    head = F.lit("<table><tr><th></th><th>0</th><th>1</th></tr>")
    # the index column counts all rows that follow the index row: the first holds the names of the columns
    body = F.array_join(F.transform("rows", lambda r: r["tr"]), "")
    page = F.concat(F.lit("<div>"), head, body, F.lit("</table></div>"))
    return html.parse_table(rows.select(F.col("n_regionkey").alias("region"), "n", page.alias("table_html")))


def _by_region():
    from pyspark.sql import Window

    return Window.partitionBy("n_regionkey").orderBy("n_nationkey")


NATIONS = "n AS (SELECT n_regionkey AS region, n_name, n_nationkey::VARCHAR AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos FROM nation)"


@query(f"WITH {NATIONS} SELECT region, pos::INTEGER AS row_idx, n_name || ',' || k AS cells FROM n")
def table_rows(spark, d):
    rows = region_tables(spark, d).select("region", F.posexplode("table_data").alias("row_idx", "r"))
    return rows.select("region", "row_idx", F.array_join("r", ",").alias("cells"))


@query(f"WITH {NATIONS} SELECT region, string_agg('| ' || n_name || ' | ' || k || ' |', chr(10) ORDER BY pos) AS markdown FROM n GROUP BY region")
def table_markdown(spark, d):
    return region_tables(spark, d).select("region", "markdown")


@query("SELECT n_regionkey AS region, count(*)::INTEGER AS n_rows, 2 AS n_cols, true AS header_is_index, true AS column_is_index FROM nation GROUP BY 1")
def drop_index_rowcol(spark, d):
    raw = html.raw_table(F.col("table_html"))
    rows = region_tables(spark, d).withColumn("raw", raw)
    column = F.transform(F.slice("raw", 2, F.size("raw")), lambda r: r[0])
    return rows.select("region", F.size("table_data").alias("n_rows"), F.size(F.get("table_data", F.lit(0))).alias("n_cols"), html.is_index(F.get("raw", F.lit(0)), blank=True).alias("header_is_index"), html.is_index(column).alias("column_is_index"))


@query(f"WITH {NATIONS} SELECT region, '| <X> | ' || max(k) FILTER (pos = 1) || ' |' AS row_context, string_agg(CASE WHEN pos = 1 THEN '<X>' ELSE n_name END, ' | ' ORDER BY pos) FILTER (pos <= 3) AS col_cells FROM n GROUP BY region")
def cell_context(spark, d):
    args = F.col("table_data"), F.lit(1), F.lit(0), F.lit("<X>"), 2
    return region_tables(spark, d).select("region", html.row_context(*args).alias("row_context"), F.regexp_replace(html.col_context(*args), r"^\| | \|$", "").alias("col_cells"))


@query(f"WITH {NATIONS} SELECT a.region, '[TABLE CELL] <X> [ROW-HEADER] ' || a.n_name || ' [COL-HEADER] ' || b.k AS headers FROM n a JOIN n b ON a.region = b.region AND b.pos = 0 WHERE a.pos = 2")
def cell_headers(spark, d):
    return region_tables(spark, d).select("region", html.headers_feature(F.col("table_data"), F.lit(2), F.lit(1), F.lit("<X>")).alias("headers"))


@query(f"WITH {NATIONS} SELECT region, '[CELL] <X> [ROW] ' || max(n_name || ' | ' || k) FILTER (pos = 0) || ' [COL] ' || string_agg(k, ' | ' ORDER BY pos) || ' [CAPTION] nations [FOOTER] region ' || region AS context FROM n GROUP BY region")
def cell_full_context(spark, d):
    context = html.full_context_feature(F.col("table_data"), F.lit(0), F.lit(1), F.lit("<X>"), F.lit(" nations "), F.concat(F.lit("region "), F.col("region").cast("string")))
    return region_tables(spark, d).select("region", context.alias("context"))


@query(f"WITH {NATIONS} SELECT region, '<X>' || chr(10) || '[ROW] | <X> | ' || max(k) FILTER (pos = 0) || ' |' || chr(10) || '[COLUMN] | <X> | ' || max(n_name) FILTER (pos = 1) || ' |' AS retrieval, '[CELL] <X> [FOOTER] f' AS foot FROM n GROUP BY region")
def retrieval_context(spark, d):
    args = F.col("table_data"), F.lit(0), F.lit(0), F.lit("<X>"), 1
    rows = region_tables(spark, d).select("region", html.row_context(*args).alias("r"), html.col_context(*args).alias("c"))
    return rows.select("region", html.retrieval_context(F.lit("<X>"), F.col("r"), F.col("c")).alias("retrieval"), html.footer_caption_feature(F.lit("<X>"), F.lit(""), F.lit(" f ")).alias("foot"))


@query(f"WITH {NATIONS} SELECT region, md5('{html.TABLE_PREAMBLE.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}' || chr(10) || '[ROW] | <X> | ' || max(k) FILTER (pos = 0) || ' |' || chr(10) || '[FOOTER] f') AS context FROM n GROUP BY region")
def llm_table_context(spark, d):
    args = F.col("table_data"), F.lit(0), F.lit(0), F.lit("<X>"), 1
    return region_tables(spark, d).select("region", F.md5(html.llm_context(html.row_context(*args), F.lit(""), F.lit("f"))).alias("context"))


@query(f"""WITH {NATIONS} SELECT region, 'EU' AS mention, 'in [MENTION]EU[/MENTION]' AS tagged, 'in [MENTION]EU[/MENTION]' || chr(10) || '[ROW] | in [MENTION]EU[/MENTION] | ' || max(k) FILTER (pos = 0) || ' |' || chr(10) || '[COLUMN] | in [MENTION]EU[/MENTION] | ' || string_agg(n_name, ' | ' ORDER BY pos) FILTER (pos BETWEEN 1 AND 3) || ' |' AS retrieval,
  md5('{html.TABLE_PREAMBLE.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}' || chr(10) || '[ROW] | in [MENTION]EU[/MENTION] | ' || max(k) FILTER (pos = 0) || ' |' || chr(10) || '[COLUMN] | in [MENTION]EU[/MENTION] | ' || string_agg(n_name, ' | ' ORDER BY pos) FILTER (pos BETWEEN 1 AND 3) || ' |' || chr(10) || '[FOOTER] f') AS llm FROM n GROUP BY region""")
def prep_table(spark, d):
    spot = F.array(F.struct(F.lit(3).alias("start"), F.lit(5).alias("end")))
    rows = region_tables(spark, d).select("region", "table_html", F.lit("in EU").alias("text"), spot.alias("spans"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit(" f ").alias("footer"))
    out = html.prep_table(rows)
    return out.select("region", "mention", F.col("text_with_tagged_mention").alias("tagged"), F.col("table_context_retrieval").alias("retrieval"), F.md5("table_context_llm").alias("llm"))


# --- files ---


@query("""SELECT lang AS label, text, source, 1::INTEGER AS start, 3::INTEGER AS "end" FROM documents UNION ALL SELECT lang, 'more', source, 1, 3 FROM documents""")
def jsonl_files(spark, d):
    folder = scratch(spark)
    spot = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end"))).alias("spans")
    rows = table(spark, d, "documents").select("text", spot, F.col("lang").alias("label"), "source")
    write_jsonl(rows, folder)
    append_jsonl(rows.withColumn("text", F.lit("more")), folder)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(folder)
    return read_jsonl(spark, folder).select("label", "text", "source", F.col("spans")[0]["start"].alias("start"), F.col("spans")[0]["end"].alias("end"))


@query("""SELECT CASE WHEN p_partkey % 9 > 0 THEN 'G' || p_size END AS category_id, CASE WHEN p_partkey % 10 > 0 THEN 'Q' || (p_partkey + 1000) END AS parameter_id, trim(p_name) AS parameter_name, p_brand || '|' || p_type AS synonyms, CASE WHEN p_partkey % 4 > 0 THEN p_type ELSE '' END AS units FROM part WHERE p_partkey % 11 > 0""")
def ontology_csv(spark, d):
    folder = scratch(spark)
    k = F.col("p_partkey")
    gone = k % 11 == 0
    rows = table(spark, d, "part").select(
        F.when(gone & (k % 2 == 0), NIL_CATEGORY).when(k % 9 > 0, F.concat(F.lit("G"), F.col("p_size").cast("string"))).alias("category_id"), F.lit("c").alias("parameter_category"),
        F.when(gone & (k % 2 > 0), NIL).when(k % 10 > 0, F.concat(F.lit("Q"), (k + 1000).cast("string"))).alias("parameter_id"), F.concat(F.lit(" "), "p_name").alias("parameter_name"),
        F.format_string("['%s', \"%s\"]", "p_brand", "p_type").alias("parameter_synonyms"), F.lit(None).cast("string").alias("parameter_description"), F.when(k % 4 > 0, F.col("p_type")).alias("units"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(folder)
    out = load_ontology(spark, folder)
    return out.select("category_id", "parameter_id", "parameter_name", F.array_join("parameter_synonyms", "|").alias("synonyms"), "units")


@query("SELECT doc_id, lang FROM documents ORDER BY lang, doc_id LIMIT 25")
def first_documents(spark, d):
    return first_rows(table(spark, d, "documents").select("doc_id", "lang"), 25, "lang", "doc_id")


# --- ontology texts ---


@query(f"WITH {ONTO} SELECT parameter_category, string_agg('[PARAM_NAME] ' || parameter_name || chr(10) || '        [DESC] ' || parameter_description || chr(10) || '        [SYN] ' || parameter_synonyms[1] || chr(10) || '        [UNIT] ' || units || chr(10) || '        [CATEGORY] ' || parameter_category, chr(10) || chr(10) ORDER BY ord) AS ontology_subset FROM onto GROUP BY 1")
def ontology_llm_block(spark, d):
    o = ontology(spark, d)
    return onto.llm_block(o.withColumn("by", F.col("parameter_category")), ["by"]).withColumnRenamed("by", "parameter_category")


@query(f"WITH {ONTO} SELECT parameter_id, '[PARAM] ' || parameter_name || ' [SYN] ' || parameter_synonyms[1] || ' [DESC] ' || parameter_description || ' [UNIT] ' || units AS text_feature FROM onto")
def ontology_embed_feature(spark, d):
    return onto.for_embedding(ontology(spark, d), nil=NO_ENTRY)


@query("SELECT p_partkey, array_to_string(CASE p_partkey % 4 WHEN 0 THEN [p_name, p_brand] WHEN 1 THEN [p_name, p_type] WHEN 2 THEN []::VARCHAR[] ELSE [p_name, p_type] END, '|') AS synonyms FROM part")
def synonyms_parse(spark, d):
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, F.format_string("[\"%s\", \"%s\"]", "p_name", "p_brand")).when(k == 1, F.format_string("['%s', '%s', ]", "p_name", "p_type")).when(k == 2, F.lit(None).cast("string")).otherwise(F.concat_ws(" , ", "p_name", "p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(parse_synonyms(said), "|").alias("synonyms"))


@query(f"WITH {ONTO} SELECT parameter_id, parameter_name, category_id, parameter_category FROM onto")
def ontology_mappings(spark, d):
    o = ontology(spark, d)
    return onto.parameter_names(o).join(onto.parameter_categories(o), "parameter_id").join(onto.category_names(o), "category_id").select("parameter_id", "parameter_name", "category_id", "parameter_category")


# --- tokens ---

EDGE = r"[^\p{L}\p{M}\p{N}_]"
STOP = r"of|at|by|on|the|from|and|is|in|an|with|for|it|as|between|based"


def pre_sql(x: str) -> str:
    """Preprocessing without lookaround: edges are matched with the word, so each rewrite runs twice."""
    out = f"lower({x})"
    for _ in range(2):
        out = rf"regexp_replace({out}, '(^|{EDGE})(?:{STOP})($|{EDGE})', '\1\2', 'g')"
    out = rf"regexp_replace({out}, '<[^>]+>', '', 'g')"
    out = rf"regexp_replace({out}, '(mea|michaeli)s($|{EDGE})', '\1' || chr(1) || '\2', 'g')"
    for _ in range(2):
        out = rf"regexp_replace({out}, '(^|[^s])s($|{EDGE})', '\1\2', 'g')"
    return f"replace({out}, chr(1), 's')"


@query(f"SELECT doc_id, md5({pre_sql('text')}) AS preprocessed FROM documents")
def basic_preprocess(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.preprocess(F.col("text"))).alias("preprocessed"))


@query(rf"SELECT doc_id, len(list_filter(string_split_regex({pre_sql('text')}, '\s+'), lambda w: w <> ''))::INTEGER AS n FROM documents")
def basic_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.basic_tokens(F.col("text"))).alias("n"))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS stripped FROM pages")
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(F.regexp_replace("html", r"<[^>]+>", "")).alias("stripped"))


@query(r"WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]') AS w FROM documents) SELECT doc_id, len(w)::INTEGER AS n, md5(array_to_string(w, '|')) AS words FROM t")
def word_tokens(spark, d):
    w = text.word_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).alias("n"), F.md5(F.array_join(w, "|")).alias("words"))


@query(f"WITH {ONTO}, {MENT} SELECT l_orderkey, l_linenumber, array_to_string({toks('mention')}, ' ') AS tokens FROM ment")
def pk_tokens(spark, d):
    df = text.tokenised(mentions(spark, d), "mention", text.pk_tokens)
    return df.select("l_orderkey", "l_linenumber", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {ONTO}, {MENT} SELECT DISTINCT mention, array_to_string({toks('mention')}, ' ') AS basic, array_to_string({toks('mention')}, ' ') AS pk FROM ment")
def tokenizer_registry(spark, d):
    df = mentions(spark, d).select("mention").distinct()
    return df.select("mention", *(F.array_join(F.array_sort(F.array_distinct(text.tokenizer(n)(F.col("mention")))), " ").alias(n) for n in ("basic", "pk")))


@query(r"SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '' AND lower(w) NOT IN ('the', 'und', 'les', 'que')), ' ')) AS kept FROM documents")
def drug_removal(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.remove_words(F.col("text"), ("the", "und", "les", "que"))).alias("kept"))


@query(f"SELECT p_partkey, {dealt_sql(MENTION_TOKENS, 'p_partkey')} AS mention, array_to_string(list_sort(string_split({dealt_sql(MENTION_TOKENS.values(), 'p_partkey')}, ' ')), ' ') AS tokens FROM part")
def pk_rules(spark, d):
    df = text.tokenised(table(spark, d, "part").select("p_partkey", dealt(MENTION_TOKENS, "p_partkey").alias("mention")), "mention", text.pk_tokens)
    return df.select("p_partkey", "mention", F.array_join("tokens", " ").alias("tokens"))


@query("SELECT p_partkey, array_to_string([p_brand, CASE p_partkey % 3 WHEN 0 THEN 'lambda' WHEN 1 THEN 'alpha' ELSE 'percentage' END, 'zeta'], ' ') AS tokens FROM part")
def special_tokens(spark, d):
    sign = F.when(F.col("p_partkey") % 3 == 0, "λ").when(F.col("p_partkey") % 3 == 1, "α").otherwise("%")
    tokens = F.array("p_brand", sign, F.col("p_brand"), F.lit("z"), sign)
    return table(spark, d, "part").select("p_partkey", F.array_join(text.unique_tokens(text.special_characters(tokens)), " ").alias("tokens"))


NAMED = f"{dealt_sql(CHEMICALS, 'doc_id')} || ' ' || text || ' Un' || {dealt_sql(CHEMICALS, 'doc_id')} || ' ' || upper({dealt_sql(CHEMICALS, 'doc_id')})"


@query(rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace({NAMED}, '(?i)\b(?:{'|'.join(CHEMICALS)})\b', '', 'g'), '\s+', ' ', 'g'))) AS kept FROM documents")
def chemical_removal(spark, d):
    word = dealt(CHEMICALS, "doc_id")
    said = F.concat(word, F.lit(" "), "text", F.lit(" Un"), word, F.lit(" "), F.upper(word))
    return table(spark, d, "documents").select("doc_id", F.md5(text.remove_chemicals(said)).alias("kept"))


@query(r"SELECT role, count(*) AS n, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS tokens FROM conversations GROUP BY role")
def token_counts(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(count_tokens(F.col("text"))).alias("tokens"))
